"""Column functions: text and path keys, bins, superposition algebra."""
