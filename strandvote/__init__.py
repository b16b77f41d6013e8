"""Sequence purification on Spark: shuffle, score, vote, recompile and compare alignments as DataFrames."""
