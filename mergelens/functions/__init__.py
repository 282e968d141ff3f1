"""Column functions: texts, paths, diffs."""
