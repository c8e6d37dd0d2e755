"""Column functions: text, paths, scores and payloads."""
