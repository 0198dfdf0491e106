"""Column functions: text, identifiers, scores, times, variants."""
