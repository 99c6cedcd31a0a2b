"""Query operators over catalog, node, line and link tables."""
