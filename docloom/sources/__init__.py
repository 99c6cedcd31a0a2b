"""Readers: document trees, Markdown, quick references, manual pages."""
