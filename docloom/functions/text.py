"""Column functions over text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(value: Column) -> Column:
    """Lower-case of A-Z alone, as entry names compare."""
    return F.translate(value, UPPER, LOWER)


def slug(value: Column, keep_underscore: bool = True) -> Column:
    """Words of letters and digits (and underscores), lower-case, with single hyphens between."""
    kept = r"[^\p{L}\p{N}_]+" if keep_underscore else r"[^\p{L}\p{N}]+"
    return F.regexp_replace(F.regexp_replace(F.lower(value), kept, "-"), r"^-+|-+$", "")


def entry_slug(name: Column) -> Column:
    bare = F.regexp_replace(name, r"^[-/]+", "")
    made = slug(F.when(bare == "?", F.lit("help")).otherwise(bare))
    return F.when(made == "", F.lit("entry")).otherwise(made)


def sanitize_terminal(value: Column) -> Column:
    """Control characters become the replacement character."""
    return F.regexp_replace(value, r"\p{Cc}", "\ufffd")


def collapse_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def char_page(value: Column, start: int, size: int) -> Column:
    """Half-open range of characters, clamped: struct of text, start, stop, total, next_start."""
    total = F.length(value).cast("long")
    first = F.least(F.lit(start).cast("long"), total)
    stop = F.least(first + F.lit(size), total)
    page = F.substring(value, first.cast("int") + 1, F.lit(size))
    return F.struct(page.alias("text"), first.alias("start"), stop.alias("stop"), total.alias("total"), F.when(stop < total, stop).alias("next_start"))


def component_suffix(path: Column, selector: Column) -> Column:
    """Equal, or ends with the selector as whole path components."""
    return (path == selector) | path.endswith(F.concat(F.lit("/"), selector))


def html_attribute(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def escape_markdown(value: Column) -> Column:
    """Prose that CommonMark reads back as it is; an underscore inside a word needs no escape."""
    word = r"[\p{IsAlphabetic}\p{N}]"
    out = F.regexp_replace(F.replace(value, F.lit("&"), F.lit("&amp;")), r"([\\`*\[\]<>$])", r"\\$1")
    return F.regexp_replace(out, rf"(?<!{word})_|_(?!{word})", r"\\_")


def link_target(value: Column) -> Column:
    """The target of a link in parentheses: these are escaped, blanks become %20."""
    return F.replace(F.regexp_replace(value, r"([\\()])", r"\\$1"), F.lit(" "), F.lit("%20"))


def content_fingerprint(value: Column) -> Column:
    """SHA-256 of the bytes, in lower-case hex; null stays null."""
    return F.sha2(value.cast("binary"), 256)


def html_anchor(id_: Column) -> Column:
    return F.concat(F.lit('<a id="'), html_attribute(id_), F.lit('"></a>'))


def strip_anchors(line: Column) -> Column:
    """A line as shown: complete, empty anchors are dropped and the end is trimmed."""
    return F.rtrim(F.regexp_replace(line, r'<a id="[^"]*?"></a>', ""))


def longest_run(value: Column, char: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit(f"{char}+"), F.lit(0)), F.length)), F.lit(0))


def relative_path(base: Column, reference: Column) -> Column:
    """Lexical resolution of a relative link inside its namespace; null if it escapes or is absolute."""
    parts = F.split(reference, "/")
    start = F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1)
    walked = F.aggregate(
        parts,
        start.cast("array<string>"),
        lambda acc, c: F.when(acc.isNull() | (c == ".") | (c == ""), acc)
        .when(c == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.lit(None)))
        .otherwise(F.concat(acc, F.array(c))),
    )
    return F.when(reference.startswith("/"), F.lit(None)).otherwise(F.array_join(walked, "/"))
