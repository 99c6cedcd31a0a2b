"""Column functions: text, slugs, paths, and search patterns."""
