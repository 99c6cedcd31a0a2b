"""Outlines, excerpts, explanations and validation over node tables.

nodes: doc_key, ord, kind (document-root, document-section, document-entry, tldr), path, coords,
entry_ix, id, title, names, case_policy, parent_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import ascii_fold

PATH = r"^(0|root|root/e[1-9][0-9]*|[1-9][0-9]*(\.[1-9][0-9]*)*(/e[1-9][0-9]*)?)$"


def is_path(value: Column) -> Column:
    return value.rlike(PATH)


def number_sections(sections: DataFrame) -> DataFrame:
    """Paths from levels in document order: the parent is the last earlier section of a smaller level.

    sections: doc_key, ord, level (1..6).  Skipped levels are allowed; numbering restarts in each parent.
    """
    upto = Window.partitionBy("doc_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = sections
    parents = []
    for level in range(1, 7):
        last = F.last(F.when(F.col("level") <= level, F.struct("ord", "level")), ignorenulls=True).over(upto)
        out = out.withColumn(f"_at{level}", last)
        parents.append(f"_at{level}")
    # the nearest earlier section with a smaller level, level by level
    parent = F.lit(None).cast("long")
    for level in range(2, 7):
        parent = F.when(F.col("level") == level, F.col(f"_at{level - 1}.ord").cast("long")).otherwise(parent)
    out = out.withColumn("parent_ord", parent).drop(*parents)
    nth = F.row_number().over(Window.partitionBy("doc_key", "parent_ord").orderBy("ord"))
    return out.withColumn("nth", nth)


def section_paths(numbered: DataFrame, depth: int = 6) -> DataFrame:
    """coords and path of each numbered section, by joining parents level by level (at most six)."""
    base = numbered.withColumn("coords", F.array("nth"))
    up = numbered.select("doc_key", F.col("ord").alias("_ord"), F.col("parent_ord").alias("_up"), F.col("nth").alias("_nth"))
    out = base.withColumn("_walk", F.col("parent_ord"))
    for _ in range(depth - 1):
        out = (
            out.join(up.withColumnRenamed("doc_key", "_doc"), (F.col("doc_key") == F.col("_doc")) & (F.col("_walk") == F.col("_ord")), "left")
            .withColumn("coords", F.when(F.col("_nth").isNotNull(), F.concat(F.array("_nth"), "coords")).otherwise(F.col("coords")))
            .withColumn("_walk", F.col("_up"))
            .drop("_doc", "_ord", "_up", "_nth")
        )
    return out.drop("_walk").withColumn("path", F.array_join(F.transform("coords", lambda c: c.cast("string")), "."))


def subtree_totals(sections: DataFrame, measures: list[str], levels: int = 6) -> DataFrame:
    """sections (doc_key, ord, level, measures) with the totals of each section and all below it.

    A section's subtree is the run up to the next section of its level or a smaller one, so a total is the difference of two prefix
    sums; where the run ends is carried backwards, level by level, so nothing is walked or joined.
    """
    order = Window.partitionBy("doc_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = sections
    for m in measures:
        out = out.withColumn(f"_upto_{m}", F.sum(F.coalesce(m, F.lit(0))).over(order))
    # what lies before a section, and all of its document, seen from behind
    back = Window.partitionBy("doc_key").orderBy(F.col("ord").desc())
    earlier, upto = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.struct(*[F.col(f"_upto_{m}").alias(m) for m in measures])
    before = F.struct(*[(F.col(f"_upto_{m}") - F.coalesce(m, F.lit(0))).alias(m) for m in measures])
    ends = [F.last(F.when(F.col("level") <= k, before), ignorenulls=True).over(earlier).alias(f"_end{k}") for k in range(1, levels + 1)]
    out = out.select("*", F.first(whole).over(upto).alias("_all"), *ends)
    end = F.coalesce(F.element_at(F.array(*[F.col(f"_end{k}") for k in range(1, levels + 1)]), F.col("level").cast("int")), F.col("_all"))
    out = out.withColumn("_end", end)
    totals = [(F.col("_end").getField(m) - F.col(f"_upto_{m}") + F.coalesce(m, F.lit(0))).cast("long").alias(f"total_{m}") for m in measures]
    return out.select(*sections.columns, *totals)


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """nodes (doc_key, kind, path, coords, title) with breadcrumbs: path and title of each node around one, the outermost first.

    Sections stand in the sections of their shorter coordinates, entries also in their own section, entries of the root in
    the root, which like the quick reference stands in nothing. Every prefix of coordinates meets its section in one join by (document, path).
    """
    depth = F.size("coords") - F.when(F.col("kind") == "document-section", 1).otherwise(0)
    inside = nodes.where(F.col("kind").isin("document-section", "document-entry") & (depth > 0))
    wanted = inside.select("doc_key", F.col("path").alias("_own"), "coords", F.explode(F.sequence(F.lit(1), depth)).alias("_k"))
    wanted = wanted.select("doc_key", "_own", "_k", F.array_join(F.slice("coords", F.lit(1), F.col("_k")).cast("array<string>"), ".").alias("path"))
    root = nodes.where((F.col("kind") == "document-entry") & (F.coalesce(F.size("coords"), F.lit(0)) <= 0)).select("doc_key", F.col("path").alias("_own"), F.lit(0).alias("_k"), F.lit("root").alias("path"))
    around = nodes.where(F.col("kind").isin("document-section", "document-root")).select("doc_key", "path", "title")
    met = wanted.unionByName(root).join(around, ["doc_key", "path"])
    trails = met.groupBy("doc_key", "_own").agg(F.array_sort(F.collect_list(F.struct("_k", "path", "title"))).alias("_t"))
    trails = trails.select("doc_key", F.col("_own").alias("path"), F.transform("_t", lambda t: F.struct(t["path"].alias("path"), t["title"].alias("title"))).alias("breadcrumbs"))
    empty = F.array().cast("array<struct<path:string,title:string>>")
    return nodes.join(trails, ["doc_key", "path"], "left").withColumn("breadcrumbs", F.coalesce("breadcrumbs", empty))


def outline(nodes: DataFrame, detail: str = "sections") -> DataFrame:
    """Rows of the outline in document order; entries only in detail "entries"."""
    rows = nodes if detail == "entries" else nodes.where("kind <> 'document-entry'")
    return rows.orderBy("doc_key", "ord")


def aliases(nodes: DataFrame) -> DataFrame:
    """Names of entries with the shorthand each allows: options without dashes, environment variables without $env:."""
    each = nodes.where("kind = 'document-entry'").select("doc_key", "ord", "path", "id", "role", "case_policy", F.explode("names").alias("name"))
    short = F.when(F.col("role") == "option", F.regexp_replace("name", "^-+", "")).when(F.col("role") == "environment-variable", F.regexp_replace("name", r"^\$(?:env|ENV):", ""))
    return each.withColumn("shorthand", F.when((short != F.col("name")) & (short != ""), short))


def select_nodes(nodes: DataFrame, selectors: DataFrame, entries_only: bool = False) -> DataFrame:
    """The nodes a selector means, at the best tier at which any fits: path, id, exact name, shorthand.

    selectors: doc_key, selector, sel_ord.  n_choices over 1 at a name tier is ambiguous; a selector without rows is unknown.
    """
    own = nodes.where("kind = 'document-entry'") if entries_only else nodes
    s = selectors.alias("s")

    def at(tier: int, rows: DataFrame, condition: Column) -> DataFrame:
        joined = s.join(rows.alias("n"), (F.col("s.doc_key") == F.col("n.doc_key")) & condition)
        return joined.select("s.doc_key", "s.selector", "s.sel_ord", F.lit(tier).cast("long").alias("tier"), "n.ord", "n.path", "n.id")

    named = aliases(nodes)
    equal = lambda a: F.when(F.col("n.case_policy") == "sensitive", F.col(a) == F.col("s.selector")).otherwise(ascii_fold(F.col(a)) == ascii_fold(F.col("s.selector")))
    found = at(1, own, F.col("n.path") == F.col("s.selector")).unionByName(at(2, own, F.col("n.id") == F.col("s.selector")))
    # a folded key keeps the name tiers equi-joins
    fold = lambda a: ascii_fold(F.col(a)) == ascii_fold(F.col("s.selector"))
    found = found.unionByName(at(3, named, fold("n.name") & equal("n.name"))).unionByName(at(4, named.where("shorthand IS NOT NULL"), fold("n.shorthand") & equal("n.shorthand")))
    best = Window.partitionBy("doc_key", "selector")
    top = found.withColumn("_best", F.min("tier").over(best)).where("tier = _best").dropDuplicates(["doc_key", "selector", "ord"])
    return top.withColumn("n_choices", F.count(F.lit(1)).over(best)).drop("_best")


def suppress_descendants(selected: DataFrame) -> DataFrame:
    """Selected nodes without those inside another selected section; coords is the section path, entry_ix set for entries."""
    a = selected.where("entry_ix IS NULL").select(F.col("doc_key").alias("_doc"), F.col("coords").alias("_coords"), F.get("coords", F.lit(0)).alias("_top"))
    inside = (
        (F.col("doc_key") == F.col("_doc")) & F.get("coords", F.lit(0)).eqNullSafe(F.col("_top"))
        & (F.slice("coords", F.lit(1), F.size("_coords")) == F.col("_coords"))
        & ((F.size("coords") > F.size("_coords")) | F.col("entry_ix").isNotNull())
    )
    return selected.join(a, inside, "left_anti")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_key", "id", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("id = '' OR id IS NULL")


def dangling_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Section links whose target is no id of the document."""
    ids = nodes.select(F.col("doc_key").alias("_doc"), F.col("id").alias("_id"))
    return links.where("kind = 'section'").join(ids, (F.col("doc_key") == F.col("_doc")) & (F.col("target_id") == F.col("_id")), "left_anti")


def document_index(nodes: DataFrame) -> DataFrame:
    """id → roles, first containing section and whether it occurs again."""
    return nodes.groupBy("doc_key", "id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.min_by("path", "ord").alias("first_path"), (F.count(F.lit(1)) > 1).alias("duplicate"))


def ambiguous_names(nodes: DataFrame) -> DataFrame:
    """Names and shorthands that two or more entries of a document answer to, once a set of candidates."""
    named = aliases(nodes)
    spelled = named.select("doc_key", "ord", "id", F.col("name").alias("selector")).unionByName(named.where("shorthand IS NOT NULL").select("doc_key", "ord", "id", F.col("shorthand").alias("selector")))
    sets = spelled.groupBy("doc_key", ascii_fold(F.col("selector")).alias("selector")).agg(F.array_sort(F.collect_set("ord")).alias("candidates")).where("size(candidates) > 1")
    return sets.groupBy("doc_key", "candidates").agg(F.min("selector").alias("selector"))
