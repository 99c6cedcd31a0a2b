"""Listing of document trees and manual roots, bounded reads, and alias pages.

Personal trees lie on the driver's file system, so they are listed there; corpora in shared storage are
read by Spark itself with :func:`read_tree`.
"""

from __future__ import annotations

import gzip
import os
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schema import MAX_INPUT_BYTES, MAX_REDIRECTS, MAX_TREE_DEPTH, MAX_TREE_DOCUMENTS, RequestError
from docloom.sources.roff import redirect

FILES = "name string, logical_path string, kind string, origin string, source_name string, source_priority int, manual_section string, path string"


def normalize_path(path: str) -> str | None:
    """A logical path of ordinary components without extension; None for anything else."""
    bare = re.sub(r"\.(md|markdown)$", "", path, flags=re.I)
    parts = bare.split("/")
    ok = all(p not in ("", ".", "..") and not re.search(r"[\x00-\x1f\x7f]", p) for p in parts)
    return bare if ok else None


def walk(root: str, leaf_symlinks: bool = False) -> list[tuple[str, str]]:
    """(logical path, file) of a tree in sorted order; .md goes before .markdown; folders behind links are not followed."""
    found: dict[str, str] = {}

    def into(folder: str, depth: int) -> None:
        if depth > MAX_TREE_DEPTH:
            raise RequestError("Registry", f"{root} is nested deeper than {MAX_TREE_DEPTH}")
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.is_dir(follow_symlinks=False):
                into(entry.path, depth + 1)
            elif entry.name.lower().endswith((".md", ".markdown")) and (entry.is_file(follow_symlinks=False) or leaf_symlinks and entry.is_symlink() and os.path.isfile(entry.path)):
                logical = normalize_path(os.path.relpath(entry.path, root).replace(os.sep, "/"))
                if logical is not None and (logical not in found or entry.name.lower().endswith(".md")):
                    found[logical] = entry.path
                if len(found) > MAX_TREE_DOCUMENTS:
                    raise RequestError("Registry", f"{root} has over {MAX_TREE_DOCUMENTS} documents")

    if os.path.isdir(root):
        into(root, 0)
    return sorted(found.items())


def load_sources(file: str) -> list[dict]:
    """Configured sources by precedence: priority (1 unless given) descending, then name; no file, no sources."""
    if not os.path.exists(file):
        return []
    rows = []
    for name, given in tomllib.loads(Path(file).read_text()).get("sources", {}).items():
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or not isinstance(given.get("priority", 1), int):
            raise RequestError("InvalidSource", name)
        rows.append({"name": name, "priority": given.get("priority", 1), **given})
    return sorted(rows, key=lambda r: (-r["priority"], r["name"]))


def markdown_files(spark: SparkSession, personal: str | None, sources: dict[str, tuple[str, int]] | None = None, marker: str = ".source.toml") -> DataFrame:
    """Registered Markdown: the personal tree, then sources (name → root, priority) that hold their marker file."""
    rows = [(p.rsplit("/", 1)[-1], p, "markdown", "documents", None, None, None, f) for p, f in (walk(personal, True) if personal else [])]
    for name, (root, priority) in sorted((sources or {}).items(), key=lambda s: (-s[1][1], s[0])):
        if os.path.isfile(os.path.join(root, marker)):
            rows += [(p.rsplit("/", 1)[-1], p, "markdown", "source", name, priority, None, f) for p, f in walk(root)]
    return spark.createDataFrame(rows, FILES)


def manual_identity(root: str, path: str) -> tuple[str, str] | None:
    """Name and section of a manual file; its folder must be that section's or the root itself."""
    name = re.sub(r"\.(gz|zst)$", "", os.path.basename(path))
    m = re.fullmatch(r"(.+)\.([0-9][A-Za-z0-9]{0,15}|l|n)", name)
    if not m:
        return None
    folder = os.path.relpath(os.path.dirname(path), root).replace(os.sep, "/").split("/")[-1]
    held = re.fullmatch(r"man([0-9a-z]\w*)", folder)
    if folder == "." or held and re.fullmatch(re.escape(held[1]) + r"[A-Za-z]*", m[2]):
        return m[1], m[2]
    return None


def locale_rank(root: str, path: str, locale: str | None) -> int:
    parts = os.path.relpath(path, root).replace(os.sep, "/").split("/")
    local = parts[0] if len(parts) > 2 and not parts[0].startswith("man") else None
    if locale is None:
        return 0 if local is None else 1
    if local is None:
        return 2
    plain = lambda x: x.split(".")[0]
    return 0 if plain(local) == plain(locale) else 1 if plain(local).split("_")[0] == plain(locale).split("_")[0] else 3


def manual_files(spark: SparkSession, roots: list[str], locale: str | None = None) -> DataFrame:
    """Candidates of all roots with root_ord and locale_rank, for first_manual_pages."""
    rows = []
    for n, root in enumerate(roots):
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if (found := manual_identity(root, path)) is not None:
                    rows.append((*found, path, n, locale_rank(root, path, locale)))
    return spark.createDataFrame(rows, "name string, manual_section string, path string, root_ord int, locale_rank int")


def detect_format(path: str) -> str | None:
    """markdown or roff, by suffix; compressed Markdown is refused."""
    lower = path.lower()
    packed = lower.endswith((".gz", ".zst"))
    bare = re.sub(r"\.(gz|zst)$", "", lower)
    if bare.endswith((".md", ".markdown")):
        return None if packed else "markdown"
    return "roff" if re.search(r"\.(roff|man|mdoc|[0-9][a-z0-9]*|l|n)$", bare) else None


def decompress(raw: bytes) -> bytes:
    """Plain bytes of gzip, zstd or plain content; both forms are bounded."""
    if len(raw) > MAX_INPUT_BYTES:
        raise RequestError("Limit", "the stored page is too large")
    if raw[:2] == b"\x1f\x8b":
        import io

        out = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MAX_INPUT_BYTES + 1)
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        out = zstandard.ZstdDecompressor().stream_reader(raw).read(MAX_INPUT_BYTES + 1)
    else:
        out = raw
    if len(out) > MAX_INPUT_BYTES:
        raise RequestError("Limit", "the page is too large")
    return out


def load_manual(root: str, path: str) -> tuple[str, str | None]:
    """Text of a page behind its alias chain, and the first alias; chains may not leave the root, repeat or exceed 16 hops."""
    seen, first = [os.path.realpath(path)], None
    while True:
        text = decompress(Path(seen[-1]).read_bytes()).decode("utf-8", "replace")
        target = redirect(text)
        if target is None:
            return text, first
        first = first or target
        candidates = [os.path.join(root, target) + s for s in ("", ".gz", ".zst")]
        found = next((os.path.realpath(c) for c in candidates if os.path.isfile(c)), None)
        if found is None or not found.startswith(os.path.realpath(root) + os.sep) or found in seen or len(seen) > MAX_REDIRECTS:
            raise RequestError("Redirect", f"{path}: {target}")
        seen.append(found)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Markdown and manual files of a tree in any storage: doc_key, format, content, content_len; the size bound reaches the scan."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_INPUT_BYTES)
    kind = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), "markdown").when(F.lower("path").rlike(r"\.(roff|man|mdoc|[0-9][a-z0-9]*|l|n)(\.gz|\.zst)?$"), "roff")
    return rows.select(F.col("path").alias("doc_key"), kind.alias("format"), "content", F.col("length").alias("content_len")).where("format IS NOT NULL")
