"""Column builders for text, and the stemmer."""
