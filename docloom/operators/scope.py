"""Bounded breadth-first closure over links, with frontiers and budgets.

documents: doc_key, n_bytes.  links: from_key, to_key, kind, link_ord.  Each level is one join
against what is not yet visited; order within a level is that of a queue: by the place
of the linking document, then by the place of the link in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.admission import admit
from docloom.plans.tables import materialize
from docloom.schema import DEFAULT_SCOPE_DEPTH, DEFAULT_SCOPE_DOCUMENTS, MAX_SCOPE_BYTES, MAX_SCOPE_DEPTH, MAX_SCOPE_DOCUMENTS, MAX_SCOPE_ROOTS, MAX_SELECTOR_BYTES, RequestError, ResolutionError


@dataclass(frozen=True)
class ScopeQuery:
    roots: tuple[str, ...]
    follow_links: bool = False
    max_depth: int | None = None
    max_documents: int | None = None
    max_bytes: int = MAX_SCOPE_BYTES

    def __post_init__(self) -> None:
        if not self.roots:
            raise RequestError("EmptyScope", "a scope needs a document")
        if len(self.roots) > MAX_SCOPE_ROOTS:
            raise RequestError("TooManyDocuments", f"over {MAX_SCOPE_ROOTS} documents")
        if any(not r or len(r.encode()) > MAX_SELECTOR_BYTES or any(ord(c) < 32 for c in r) for r in self.roots):
            raise RequestError("DocumentSelector", "a selector is empty, too long or holds controls")
        if not self.follow_links and (self.max_depth is not None or self.max_documents is not None):
            raise RequestError("TraversalLimitsRequireLinks", "limits need follow_links")
        if not 0 <= self.depth <= MAX_SCOPE_DEPTH:
            raise RequestError("DepthLimit", f"depth {self.depth}")
        if not len(self.roots) <= self.documents <= MAX_SCOPE_DOCUMENTS:
            raise RequestError("DocumentLimit", f"{self.documents} documents")

    @property
    def depth(self) -> int:
        return DEFAULT_SCOPE_DEPTH if self.max_depth is None else self.max_depth

    @property
    def documents(self) -> int:
        return max(DEFAULT_SCOPE_DOCUMENTS, len(self.roots)) if self.max_documents is None else self.max_documents


@dataclass
class Scope:
    documents: DataFrame  # doc_key, depth, place, root_indices
    edges: DataFrame  # from_key, to_key, kind
    frontier: DataFrame  # from_key, to_key, kind, reason
    unresolved: DataFrame  # from_key (null for a root), to_key, reason


_REFUSED = "from_key string, to_key string, kind string, reason string"


def _admitted(level: DataFrame, room: int, left: int) -> tuple[list, DataFrame | None]:
    """The first `room` documents of a level (to_key, via, n_bytes) that fit in what is left of the bytes, and the links refused before them."""
    order = F.struct("via.place", "via.link_ord", "to_key")
    total = level.agg(F.sum("n_bytes")).first()[0] or 0
    if total <= left:
        return level.orderBy(order).limit(room).collect(), None
    fits = admit(level.select(F.col("to_key").alias("key"), order.alias("order"), F.col("n_bytes").alias("size")), left)
    judged = level.join(fits.select(F.col("key").alias("to_key"), "admitted"), "to_key").withColumn("order", order)
    taken = judged.where("admitted").orderBy("order").limit(room).collect()
    refused = judged.where("NOT admitted")
    if len(taken) == room:  # what comes later is beyond the number of documents first
        last = taken[-1]["order"] if room else None
        place, link, key = F.col("via.place"), F.col("via.link_ord"), F.col("to_key")
        earlier = (place < last[0]) | ((place == last[0]) & ((link < last[1]) | ((link == last[1]) & (key < last[2])))) if last else F.lit(False)
        refused = refused.where(earlier)
    return taken, refused.select(F.col("via.from_key").alias("from_key"), "to_key", F.col("via.kind").alias("kind"), F.lit("max-content-bytes").alias("reason"))


def closure(documents: DataFrame, links: DataFrame, query: ScopeQuery) -> Scope:
    """Documents within the limits; at most MAX_SCOPE_DOCUMENTS rows, so a level's new ones are counted on the driver.

    A document that is too large for what is left of the bytes is refused, and later smaller ones may still come in. Roots that are no documents and
    links to none are unresolved; roots that are together too large are an error.
    """
    spark = documents.sparkSession
    roots = spark.createDataFrame([(r, i) for i, r in enumerate(query.roots)], "doc_key string, ix int").groupBy("doc_key").agg(F.array_sort(F.collect_list("ix")).alias("root_indices"))
    known = [(r["doc_key"], 0, list(r["root_indices"]), r["n_bytes"]) for r in documents.join(F.broadcast(roots), "doc_key").orderBy(F.col("root_indices")[0]).collect()]
    schema = "doc_key string, depth int, place int, root_indices array<int>"
    rows: list[tuple] = [(k, d, i, ix) for i, (k, d, ix, _) in enumerate(known)]
    used = sum(n or 0 for *_, n in known)
    if used > query.max_bytes:
        raise ResolutionError("ContentLimit", f"the documents of a scope have {used} bytes")
    refused = spark.createDataFrame([], _REFUSED)
    depth = 0
    while query.follow_links and depth < query.depth:
        level = [r for r in rows if r[1] == depth]
        if not level:
            break
        here = F.broadcast(spark.createDataFrame([(r[0], r[2]) for r in level], "from_key string, place int"))
        seen = F.broadcast(spark.createDataFrame([(r[0],) for r in rows], "to_key string"))
        reached = links.join(here, "from_key").join(seen, "to_key", "left_anti")
        # a document counts once, where it is reached first
        first = reached.groupBy("to_key").agg(F.min(F.struct("place", "link_ord", "from_key", "kind")).alias("via"))
        found = materialize(first.join(documents, F.col("to_key") == F.col("doc_key")).select("to_key", "via", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")), "level")
        depth += 1
        taken, large = _admitted(found, query.documents - len(rows), query.max_bytes - used)
        if large is not None:
            refused = refused.unionByName(large)
        for r in taken:
            used += r["n_bytes"]
            rows.append((r["to_key"], depth, len(rows), []))
    inside = spark.createDataFrame(rows, schema)
    refused = materialize(refused, "refused")
    keys = F.broadcast(inside.select(F.col("doc_key").alias("from_key"), F.col("depth").alias("from_depth")))
    own = links.join(keys, "from_key")
    to = F.broadcast(inside.select(F.col("doc_key").alias("to_key")))
    edges = own.join(to, "to_key", "left_semi").groupBy("from_key", "to_key", "kind").agg(F.min("link_ord").alias("link_ord"))
    # a document refused for its bytes is tried once; another link to it is refused for the same reason
    large = refused.select("to_key", F.lit(True).alias("_large")).distinct()
    outside = own.join(to, "to_key", "left_anti").join(large, "to_key", "left").join(documents.select(F.col("doc_key").alias("to_key"), F.lit(True).alias("_known")), "to_key", "left")
    reason = F.when(F.col("from_depth") >= query.depth, "max-depth").when(F.col("_large"), "max-content-bytes").otherwise("max-documents")
    lost = spark.createDataFrame([(None, r, "not-found") for r in query.roots if r not in {k[0] for k in known}], "from_key string, to_key string, reason string")
    if not query.follow_links:
        return Scope(inside, edges, spark.createDataFrame([], _REFUSED), lost)
    open_ends = (F.col("from_depth") < query.depth) & F.col("_known").isNull()
    frontier = outside.where(~open_ends).select("from_key", "to_key", "kind", reason.alias("reason")).distinct()
    return Scope(inside, edges, frontier, lost.unionByName(outside.where(open_ends).select("from_key", "to_key", F.lit("not-found").alias("reason")).distinct()))


def reached_from(scope: Scope) -> DataFrame:
    """For each document of the scope, the others that link to it."""
    into = scope.edges.where("from_key <> to_key").groupBy(F.col("to_key").alias("doc_key")).agg(F.array_sort(F.collect_set("from_key")).alias("reached_from"))
    return scope.documents.join(into, "doc_key", "left")


def distances(roots: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """Distance of every document from the roots, without budgets: a frontier join a level, each written once."""
    seen = materialize(roots.select("doc_key", F.lit(0).cast("long").alias("depth")).distinct(), "distances")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = links.join(frontier, links["from_key"] == frontier["doc_key"]).select(F.col("to_key").alias("doc_key")).distinct()
        frontier = materialize(step.join(seen.select("doc_key"), "doc_key", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "distances")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def paged_search(hits: DataFrame, scope_documents: DataFrame, limit: int, offset: int) -> DataFrame:
    """A global page in scope order; ordinals stay local to their document."""
    order = [F.col("place").asc(), F.col("ordinal").asc()]
    joined = hits.join(scope_documents.select("doc_key", "place"), "doc_key")
    total = joined.agg(F.count(F.lit(1)).alias("total"))
    rows = joined.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long")).join(F.broadcast(total))
