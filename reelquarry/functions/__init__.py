"""Column builders and codecs."""
