"""Training-data operators on Spark: scoring, de-duplication, privacy, mixing, sharding."""
