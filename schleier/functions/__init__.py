"""Column functions: text normalisation, patterns, and spans of a pattern's matches."""
