"""Bounds and closed domains of the document model."""

from __future__ import annotations

#: Fixed values that requests and readers keep to.
MAX_INPUT_BYTES = 16 * 1024 * 1024
MAX_REDIRECTS = 16
MAX_MARKDOWN_DEPTH = 64
MAX_PATTERN_BYTES = 4096
MAX_CONTEXT_LINES = 100
DEFAULT_PAGE, MAX_PAGE = 100, 10_000
MAX_OCCURRENCES = 256
MAX_SCOPE_ROOTS, DEFAULT_SCOPE_DEPTH, MAX_SCOPE_DEPTH = 16, 8, 32
DEFAULT_SCOPE_DOCUMENTS, MAX_SCOPE_DOCUMENTS = 64, 256
MAX_SCOPE_BYTES = 64 * 1024 * 1024
MAX_SELECTOR_BYTES, MAX_ENTRY_BYTES = 1024, 512
MAX_TREE_DEPTH, MAX_TREE_DOCUMENTS = 32, 10_000
MAX_SOURCE_ENTRIES, MAX_SOURCE_BYTES = 20_000, 256 * 1024 * 1024
DEFAULT_CHARS, MAX_CHARS = 16 * 1024, 32 * 1024

KINDS = ("markdown", "manual")
MANUAL_SECTIONS = "1 1p n l 8 3 3p 0 0p 2 3type 5 4 9 6 7".split()
ROLES = ("option", "command", "environment-variable", "variable")
RESERVED_IDS = ("tldr", "root", "document-overview")


class RequestError(ValueError):
    """A request that is refused before anything is read; code names the rule."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class ResolutionError(LookupError):
    """A valid request that finds nothing, or more than it may."""

    def __init__(self, code: str, message: str, candidates: list[str] | None = None) -> None:
        super().__init__(message)
        self.code = code
        self.candidates = candidates or []
