"""Catalog discovery: merge, precedence, ranked find, pages and coverage.

A catalog has the columns of :data:`COLUMNS`; all steps are DataFrame expressions, so scope
filters and patterns reach the scan and a page is a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.patterns import Pattern
from docloom.functions.text import component_suffix
from docloom.operators.ordinals import numbered
from docloom.schema import DEFAULT_PAGE, KINDS, MANUAL_SECTIONS, MAX_PAGE, RequestError

COLUMNS = ("catalog_path", "name", "logical_path", "kind", "origin", "source_name", "source_priority", "manual_section", "path", "precedence_class")
#: Relevance of a literal match, best first.
EXACT, COMPONENT_SUFFIX, PREFIX, SUBSTRING = range(4)


def catalog_path() -> Column:
    return (
        F.when(F.col("kind") == "manual", F.concat_ws("/", F.lit("manual"), "manual_section", "name"))
        .when(F.col("origin") == "source", F.concat_ws("/", F.lit("sources"), "source_name", "logical_path"))
        .otherwise(F.concat_ws("/", F.lit("documents"), "logical_path"))
    )


#: A catalog path taken apart; null where it is malformed.
ADDRESS = r"^(?:documents/([^/]+(?:/[^/]+)*)|sources/([^/]+)/([^/]+(?:/[^/]+)*)|manual/([^/]+)/([^/]+))$"


def parse_address(path: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(path, ADDRESS, k), F.lit(""))
    kind = F.when(part(5).isNotNull(), F.lit("manual")).otherwise(F.lit("markdown"))
    origin = F.when(part(1).isNotNull(), F.lit("documents")).when(part(2).isNotNull(), F.lit("source")).otherwise(F.lit("manual"))
    whole = F.struct(kind.alias("kind"), origin.alias("origin"), part(2).alias("source_name"), F.coalesce(part(1), part(3), part(5)).alias("logical_path"), part(4).alias("manual_section"))
    return F.when(path.rlike(ADDRESS), whole)


def precedence_class() -> Column:
    """Personal documents, sources above the baseline, manuals, other sources."""
    return (
        F.when(F.col("kind") == "manual", F.lit(2))
        .when(F.col("origin") == "documents", F.lit(0))
        .when(F.col("source_priority") > 0, F.lit(1))
        .otherwise(F.lit(3))
    )


def merge_catalog(markdown: DataFrame, manuals: DataFrame) -> DataFrame:
    """One catalog of registered Markdown and native manual pages."""
    both = markdown.unionByName(manuals, allowMissingColumns=True)
    return both.withColumn("catalog_path", catalog_path()).withColumn("precedence_class", precedence_class()).select(*COLUMNS)



def by_precedence() -> list[Column]:
    return [F.col("precedence_class").asc(), F.col("source_priority").desc_nulls_last(), F.col("source_name").asc_nulls_first()]


def base_order() -> list[Column]:
    return [F.col("logical_path").asc(), *by_precedence(), F.col("manual_section").asc_nulls_first(), F.col("origin").asc()]


def section_rank(section: Column, order: list[str] | None = None) -> Column:
    names = order or MANUAL_SECTIONS
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), section), F.lit(0)), F.lit(len(names) + 1))


def first_manual_pages(candidates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One page for each name and section: the earliest root, then locale rank, then path."""
    best = Window.partitionBy("name", "manual_section").orderBy("root_ord", "locale_rank", "path")
    kept = candidates.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return kept.withColumn("section_rank", section_rank(F.col("manual_section"), order))


def best_extension(files: DataFrame) -> DataFrame:
    """`.md` before `.markdown` for one logical path of an origin."""
    rank = F.when(F.lower("path").endswith(".md"), 0).otherwise(1)
    best = Window.partitionBy("origin", "source_name", "logical_path").orderBy(rank, "path")
    return files.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class CatalogQuery:
    """A checked find request."""

    pattern: str | None = None
    syntax: str = "literal"
    case: str = "insensitive"
    kind: str | None = None
    manual_section: str | None = None
    source: str | None = None
    limit: int | None = DEFAULT_PAGE  # None: all
    offset: int = 0

    def __post_init__(self) -> None:
        if self.kind is not None and self.kind not in KINDS:
            raise RequestError("ConflictingSelectors", f"unknown kind {self.kind}")
        if self.limit is not None and not 1 <= self.limit <= MAX_PAGE or self.offset < 0:
            raise RequestError("InvalidLimit", f"limit {self.limit}, offset {self.offset}")
        if self.source is not None and self.manual_section is not None:
            raise RequestError("ConflictingSelectors", "a source has no manual sections")
        if self.kind == "manual" and self.source is not None or self.kind == "markdown" and self.manual_section is not None:
            raise RequestError("ConflictingSelectors", "the kind conflicts with the source or section")
        self.compiled  # noqa: B018  refuses bad patterns

    @property
    def compiled(self) -> Pattern | None:
        return None if self.pattern is None else Pattern(self.pattern, self.syntax, self.case)


def in_scope(catalog: DataFrame, query: CatalogQuery) -> DataFrame:
    for column, value in (("kind", query.kind), ("manual_section", query.manual_section), ("source_name", query.source)):
        if value is not None:
            catalog = catalog.where(F.col(column) == value)
    return catalog


def match_score(query: CatalogQuery) -> Column:
    """The best (relevance, spelling) of name, logical path and, if the pattern has a slash, catalog path."""
    if query.pattern is None or query.syntax != "literal":
        return F.struct(F.lit(5).alias("relevance"), F.lit(2).alias("spelling"))
    folds = query.case == "insensitive" or query.case == "smart" and not any(c.isupper() for c in query.pattern)
    pattern = F.lit(query.pattern)
    folded = F.lower(pattern) if folds else pattern

    def score(candidate: Column) -> Column:
        value = F.lower(candidate) if folds else candidate
        tests = lambda v, p: [v == p, v.endswith(F.concat(F.lit("/"), p)), v.startswith(p), v.contains(p)]
        plain = tests(candidate, pattern)
        out = F.struct(F.lit(4).alias("relevance"), F.lit(2).alias("spelling"))
        for rank, holds in reversed(list(enumerate(tests(value, folded)))):
            out = F.when(holds, F.struct(F.lit(rank).alias("relevance"), F.when(plain[rank], 0).otherwise(1).alias("spelling"))).otherwise(out)
        return out

    scores = [score(F.col("name")), score(F.col("logical_path"))] + ([score(F.col("catalog_path"))] if "/" in query.pattern else [])
    return F.least(*scores)


def find(catalog: DataFrame, query: CatalogQuery) -> DataFrame:
    """The page of matching rows in order, with score, ordinal and total on every row."""
    rows = in_scope(catalog, query)
    if (pattern := query.compiled) is not None:
        names = ["name", "logical_path"] + (["catalog_path"] if "/" in query.pattern else [])
        hit = F.lit(False)
        for c in names:
            hit = hit | pattern.matches(F.col(c))
        rows = rows.where(hit)
    rows = rows.withColumn("_score", match_score(query))
    order = [
        F.col("_score").asc(), F.lower("logical_path").asc(), F.col("logical_path").asc(), F.lower("name").asc(), F.col("name").asc(),
        *by_precedence(), F.col("manual_section").asc_nulls_first(), F.col("origin").asc(),
    ]
    if query.limit is None:
        ranked = numbered(rows, [*order, F.col("path").asc()]).where(F.col("ordinal") > query.offset)
    else:
        page = rows.orderBy(*order, "path").offset(query.offset).limit(query.limit)
        ranked = page.withColumn("ordinal", (F.row_number().over(Window.orderBy(*order, "path")) + query.offset).cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(F.broadcast(total)).select(*COLUMNS, F.col("_score.relevance").alias("relevance"), F.col("_score.spelling").alias("spelling"), "ordinal", "total")


def coverage(catalog: DataFrame, query: CatalogQuery) -> DataFrame:
    """One row: sections, sources and personal documents of the whole catalog; scope_total before the pattern."""
    scoped = F.lit(True)
    for column, value in (("kind", query.kind), ("manual_section", query.manual_section), ("source_name", query.source)):
        if value is not None:
            scoped = scoped & F.coalesce(F.col(column) == value, F.lit(False))
    return catalog.agg(
        F.array_sort(F.collect_set("manual_section")).alias("sections"),
        F.array_sort(F.collect_set("source_name")).alias("sources"),
        F.coalesce(F.bool_or(F.col("origin") == "documents"), F.lit(False)).alias("personal"),
        F.count_if(scoped).alias("scope_total"),
    )


def page_envelope(total: int, offset: int, limit: int) -> dict[str, object]:
    """total, returned, clamped offset, truncated, next_offset of a catalog page."""
    start = min(offset, total)
    end = min(start + limit, total)
    return {"total": total, "returned": end - start, "offset": start, "truncated": end < total, "next_offset": end if end < total else None}


def folder_tree(catalog: DataFrame) -> DataFrame:
    """Folders of all catalog paths with their depth and the number of documents below."""
    parts = F.split("catalog_path", "/")
    prefixes = catalog.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    return prefixes.groupBy("folder").agg(F.count(F.lit(1)).alias("documents")).withColumn("depth", F.size(F.split("folder", "/")).cast("long"))


def suffix_matches(catalog: DataFrame, selector: str) -> DataFrame:
    return catalog.where(component_suffix(F.col("logical_path"), F.lit(selector)))


def catalog_text(catalog: DataFrame, grouped: bool = False) -> DataFrame:
    """Lines of a listing: path and kind, or names under sorted namespaces."""
    if not grouped:
        return catalog.select("catalog_path", F.concat_ws("\t", "catalog_path", "kind").alias("line"))
    space = F.when(F.col("kind") == "manual", F.concat(F.lit("manual/"), "manual_section")).when(F.col("origin") == "source", F.concat(F.lit("sources/"), "source_name")).otherwise(F.lit("documents"))
    return catalog.groupBy(space.alias("namespace")).agg(F.array_join(F.array_sort(F.collect_list("logical_path")), "\n").alias("body"), F.count(F.lit(1)).alias("documents"))
