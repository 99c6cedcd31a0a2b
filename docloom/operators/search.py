"""Structure-aware grep over line tables.

lines: doc_key, line_no (1-based), start_byte, text, and for addressed documents owners.
Documents without a match are dropped before lines are numbered, so only those that match
are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.linear import LinearPattern
from docloom.functions.patterns import Pattern
from docloom.schema import DEFAULT_PAGE, MAX_CONTEXT_LINES, MAX_OCCURRENCES, MAX_PAGE, RequestError


@dataclass(frozen=True)
class SearchQuery:
    pattern: Pattern | LinearPattern
    scope: str = "visible"
    context_lines: int = 0
    limit: int = DEFAULT_PAGE
    offset: int = 0

    def __post_init__(self) -> None:
        if self.scope not in ("visible", "markdown"):
            raise RequestError("InvalidPattern", f"unknown scope {self.scope}")
        if not 1 <= self.limit <= MAX_PAGE or self.offset < 0:
            raise RequestError("InvalidLimit", f"limit {self.limit}, offset {self.offset}")
        if not 0 <= self.context_lines <= MAX_CONTEXT_LINES:
            raise RequestError("ContextTooLarge", f"{self.context_lines} context lines")


def numbered_lines(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """doc_key, line_no, text of every line; a final line break makes an empty last line."""
    return docs.select(F.col(key).alias("doc_key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_n", "text")).select("doc_key", (F.col("_n") + 1).cast("long").alias("line_no"), "text")


def line_index(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """Lines with the byte at which each starts."""
    before = Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long")
    return numbered_lines(docs, key, text).withColumn("start_byte", start)


def matching_lines(lines: DataFrame, pattern: Pattern | LinearPattern) -> DataFrame:
    """Lines with matches, with occurrence_count."""
    if isinstance(pattern, LinearPattern):
        return pattern.counted(lines)
    return lines.withColumn("occurrence_count", pattern.count(F.col("text"))).where("occurrence_count > 0")


def hits(docs: DataFrame, pattern: Pattern | LinearPattern, key: str = "doc_key", text: str = "text") -> DataFrame:
    """One row a line with matches: doc_key, line_no, text, occurrence_count, ordinal (document-local)."""
    matching = docs.where(pattern.matches(F.col(text))) if isinstance(pattern, Pattern) else docs
    lines = matching_lines(numbered_lines(matching, key, text), pattern)
    return lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_key").orderBy("line_no")).cast("long"))


def occurrences(hit_lines: DataFrame, pattern: Pattern) -> DataFrame:
    """Exact places, at most MAX_OCCURRENCES a hit: nth, matched, columns in characters (1-based) and bytes of the line."""
    each = hit_lines.select("doc_key", "line_no", "ordinal", "text", F.posexplode(F.slice(pattern.occurrences(F.col("text")), 1, MAX_OCCURRENCES)).alias("_n", "_o"))
    before = F.substring("text", F.lit(1), F.col("_o.start").cast("int"))
    return each.select(
        "doc_key", "line_no", "ordinal", (F.col("_n") + 1).cast("long").alias("nth"), F.col("_o.text").alias("matched"),
        (F.col("_o.start") + 1).alias("column"), F.octet_length(before).cast("long").alias("start_byte"),
        (F.octet_length(before) + F.octet_length("_o.text")).cast("long").alias("end_byte"),
    )


def page(hit_rows: DataFrame, limit: int, offset: int, order: list[Column] | None = None) -> DataFrame:
    """Global ordinals offset+1 to offset+limit with the total; a top-k, not a global window."""
    order = order or [F.col("doc_key").asc(), F.col("ordinal").asc()]
    total = hit_rows.agg(F.count(F.lit(1)).alias("total"))
    rows = hit_rows.orderBy(*order).offset(offset).limit(limit)
    rows = rows.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))
    return rows.join(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("long"))


def context(hit_rows: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Lines from n before to n after each hit, clamped to the document, with a mark on the hit's own."""
    around = hit_rows.select("doc_key", "ordinal", F.col("line_no").alias("_hit"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no"))
    return around.join(lines.select("doc_key", "line_no", "text"), ["doc_key", "line_no"]).select("doc_key", "ordinal", "line_no", "text", (F.col("line_no") == F.col("_hit")).alias("matched"))


def owners(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """As-of join: each position gets the node of its document with the greatest start at or before it, if the node's end is after it.

    positions: doc_key, pos, ...; nodes: doc_key, start, stop, node.
    """
    carried = [c for c in positions.columns if c not in ("doc_key", "pos")]
    marks = nodes.select("doc_key", F.col("start").alias("pos"), F.lit(0).alias("_kind"), F.struct("node", "stop").alias("_node"))
    asked = positions.select("doc_key", "pos", F.lit(1).alias("_kind"), *carried)
    both = marks.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("doc_key").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_at", F.last("_node", ignorenulls=True).over(upto)).where("_kind = 1 AND pos < _at.stop")
    return found.select("doc_key", "pos", *carried, F.col("_at.node").alias("node"))


def group_occurrences(found: DataFrame) -> DataFrame:
    """Neighbouring occurrences of one line span and owner become one hit (gaps and islands).

    found: doc_key, pos, start_line, end_line, node.
    """
    order = Window.partitionBy("doc_key").orderBy("pos")
    same = (F.lag("start_line").over(order) == F.col("start_line")) & (F.lag("end_line").over(order) == F.col("end_line")) & (F.lag("node").over(order) == F.col("node"))
    island = F.sum(F.when(same, 0).otherwise(1)).over(order)
    return (
        found.withColumn("ordinal", island.cast("long"))
        .groupBy("doc_key", "ordinal")
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.first("node").alias("node"), F.count(F.lit(1)).alias("occurrence_count"), F.slice(F.array_sort(F.collect_list("pos")), 1, MAX_OCCURRENCES).alias("positions"))
    )


def running_ends(intervals: DataFrame) -> DataFrame:
    upto = Window.partitionBy("doc_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return intervals.withColumn("greatest_stop", F.max("stop").over(upto))
