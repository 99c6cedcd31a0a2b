"""One snapshot of documents with find, outline, read, explain, search and scope queries."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.linear import LinearPattern, pattern_of
from docloom.functions.patterns import Pattern
from docloom.functions.text import relative_path, strip_anchors
from docloom.operators import admin, outline, resolve, scope, search, stabbing
from docloom.operators import catalog as catalog_ops
from docloom.plans import render
from docloom.plans.index import Index, index
from docloom.schema import DEFAULT_CHARS, MAX_CHARS, RequestError, ResolutionError

#: Largest request in JSON.
MAX_REQUEST_BYTES = 64 * 1024
VIEWS = ("full", "outline", "excerpt", "explain", "search")


class Engine:
    """catalog (:data:`catalog_ops.COLUMNS`) and raw (doc_key = catalog path, format, content)."""

    def __init__(self, spark: SparkSession, catalog: DataFrame, raw: DataFrame) -> None:
        self.spark, self.catalog, self.raw = spark, catalog, raw

    @classmethod
    def of_markdown(cls, spark: SparkSession, documents: dict[str, str]) -> Engine:
        """Personal documents in memory: logical path → Markdown."""
        rows = [(p.rsplit("/", 1)[-1], p, "markdown", "documents", f"memory:{p}") for p in documents]
        files = spark.createDataFrame(rows, "name string, logical_path string, kind string, origin string, path string")
        none = spark.createDataFrame([], "name string, logical_path string, kind string, origin string, manual_section string, source_name string, source_priority int, path string")
        raw = spark.createDataFrame([(f"documents/{p}", "markdown", t.encode()) for p, t in documents.items()], "doc_key string, format string, content binary")
        return cls(spark, catalog_ops.merge_catalog(files, none), raw)

    @cached_property
    def index(self) -> Index:
        """All documents, parsed once."""
        return index(self.raw)

    def find(self, **query: object) -> DataFrame:
        return catalog_ops.find(self.catalog, catalog_ops.CatalogQuery(**query))

    def coverage(self, **query: object) -> DataFrame:
        return catalog_ops.coverage(self.catalog, catalog_ops.CatalogQuery(**query))

    def resolve(self, selector: str, source: str | None = None) -> str:
        """The catalog path a selector means: an exact path, or a name by precedence."""
        if not selector.strip():
            raise RequestError("EmptyName", "the selector is empty")
        if self.catalog.where(F.col("catalog_path") == selector).limit(1).count():
            return selector
        names = self.spark.createDataFrame([(selector, selector, 0)], "selector string, name string, cand_ord int")
        row = (resolve.resolve(self.catalog, names) if source is None else resolve.resolve_in_source(self.catalog, source, names)).first()
        if row["ambiguous"]:
            raise ResolutionError("Ambiguous", f"{selector} is ambiguous")
        if row["winner"] is None:
            raise ResolutionError("NotFound", f"no document {selector}")
        return row["winner"]

    def _one(self, key: str) -> Index:
        """The index of one document: it is selected before anything is parsed."""
        return index(self.raw.where(F.col("doc_key") == key))

    def outline(self, selector: str, detail: str = "sections") -> DataFrame:
        return outline.outline(self._one(self.resolve(selector)).nodes, detail)

    def outline_markdown(self, selector: str) -> str:
        return "\n".join(r["line"] for r in self.outline(selector, "entries").select(render.outline_markdown().alias("line")).collect())

    def full(self, selector: str) -> str:
        row = self._one(self.resolve(selector)).documents.select("markdown", "error").first()
        if row is None or row["error"]:
            raise ResolutionError("NoReadableContent", (row and row["error"]) or "not readable")
        return row["markdown"]

    def _selected(self, parsed: Index, key: str, selectors: list[str], entries_only: bool) -> DataFrame:
        asked = self.spark.createDataFrame([(key, "root" if s == "document-overview" else s, i) for i, s in enumerate(selectors)], "doc_key string, selector string, sel_ord int")
        found = outline.select_nodes(parsed.nodes, asked, entries_only)
        rows = found.select("selector", "path", "id", "n_choices").collect()
        by = {r["selector"]: r for r in rows}
        for s in selectors:
            s = "root" if s == "document-overview" else s
            if s not in by:
                raise ResolutionError("UnknownSelector", f"{key} has no {s}")
            if by[s]["n_choices"] > 1:
                raise ResolutionError("AmbiguousSelector", f"{s} is ambiguous in {key}", [f"{r['path']} ({r['id']})" for r in rows if r["selector"] == s])
        return parsed.nodes.join(F.broadcast(found.select("doc_key", "path").distinct()), ["doc_key", "path"], "left_semi")

    def read(self, selector: str, selectors: list[str]) -> str:
        """The chosen nodes in document order, without those inside others."""
        if not selectors or any(not s.strip() for s in selectors):
            raise RequestError("EmptySelection", "choose something")
        key = self.resolve(selector)
        parsed = self._one(key)
        nodes = outline.suppress_descendants(self._selected(parsed, key, selectors, False))
        return "\n\n---\n\n".join(r["text"] for r in render.excerpt_markdown(nodes, parsed.documents).orderBy("ord").collect())

    def explain(self, selector: str, entry: str) -> str:
        key = self.resolve(selector)
        parsed = self._one(key)
        if parsed.nodes.where((F.col("kind") != "document-entry") & ((F.col("path") == entry) | (F.col("id") == entry))).limit(1).count():
            raise ResolutionError("ExplanationRequiresEntry", f"{entry} is no entry")
        try:
            nodes = self._selected(parsed, key, [entry], True)
        except ResolutionError as e:
            if e.code == "UnknownSelector":
                hint = self.search(selector, entry, limit=1).first()
                if hint is not None:
                    raise ResolutionError("SelectorFoundOnlyInText", f"{entry} occurs in {key}, line {hint['line_no']}") from None
            raise
        return "\n\n".join(r["text"] for r in render.excerpt_markdown(nodes, parsed.documents).collect())

    def _hits(self, parsed: Index, pattern: Pattern | LinearPattern) -> DataFrame:
        """Hits of the addressable render with the node that owns each line; lines that none owns are no hits."""
        docs = parsed.documents.where(pattern.matches(F.col("markdown")) if isinstance(pattern, Pattern) else F.lit(True)).select("doc_key", F.col("markdown").alias("text"))
        lines = search.line_index(docs).withColumn("text", strip_anchors(F.col("text")))
        matching = search.matching_lines(lines, pattern)
        spots = matching.select("doc_key", F.col("start_byte").alias("pos"), "line_no", "text", "occurrence_count")
        nodes = parsed.nodes.where("md_start IS NOT NULL")
        sections = nodes.where("kind <> 'document-entry'").select("doc_key", F.col("md_start").alias("start"), F.col("md_end").alias("stop"), F.col("path").alias("node"))
        entries = nodes.where("kind = 'document-entry'").select("doc_key", F.col("md_start").alias("start"), F.col("md_end").alias("stop"), F.col("path").alias("node"))
        inner = stabbing.innermost(spots.select("doc_key", "pos", F.col("line_no").alias("id")), entries.withColumn("ord", F.col("start"))).where("node IS NOT NULL")
        inner = inner.select("doc_key", F.col("id").alias("line_no"), F.col("node").alias("entry"))
        owned = search.owners(spots, sections).join(inner, ["doc_key", "line_no"], "left").withColumn("node", F.coalesce("entry", "node")).drop("entry")
        from pyspark.sql import Window

        return owned.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_key").orderBy("line_no")).cast("long"))

    def search(self, selector: str, pattern: str, syntax: str = "literal", case: str = "insensitive", word: bool = False, context_lines: int = 0, limit: int = 100, offset: int = 0) -> DataFrame:
        query = search.SearchQuery(pattern_of(pattern, syntax, case, word), "markdown", context_lines, limit, offset)
        parsed = self._one(self.resolve(selector))
        rows = search.page(self._hits(parsed, query.pattern), query.limit, query.offset)
        if not query.context_lines:
            return rows
        lines = search.line_index(parsed.documents.select("doc_key", F.col("markdown").alias("text"))).withColumn("text", strip_anchors(F.col("text")))
        around = search.context(rows, lines, query.context_lines).groupBy("doc_key", "ordinal")
        around = around.agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "matched"))).alias("context"))
        return rows.join(around, ["doc_key", "ordinal"], "left").orderBy("position")

    @cached_property
    def references(self) -> DataFrame:
        """Typed links as edges between catalog paths; those that escape their namespace lead nowhere."""
        rows = self.index.links.where("kind IN ('document', 'manual')")
        parts = F.split("doc_key", "/")
        depth = F.when(parts[0] == "sources", 2).otherwise(1)
        space, inside = F.array_join(F.slice(parts, F.lit(1), depth), "/"), F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/")
        documents = rows.where("kind = 'document'").select(F.col("doc_key").alias("from_key"), F.concat_ws("/", space, relative_path(inside, F.col("name"))).alias("to_key"), "kind", F.col("ord").alias("link_ord"))
        manuals = rows.where("kind = 'manual'").select(F.col("doc_key").alias("from_key"), F.concat_ws("/", F.lit("manual"), "manual_section", "name").alias("to_key"), "kind", F.col("ord").alias("link_ord"))
        return documents.unionByName(manuals)

    def _root(self, selector: str) -> str:
        """What a root means; one that means nothing stays as it is and is unresolved."""
        try:
            return self.resolve(selector)
        except ResolutionError as e:
            if e.code == "Ambiguous":
                raise
            return selector

    def scope(self, roots: list[str], follow_links: bool = False, max_depth: int | None = None, max_documents: int | None = None) -> scope.Scope:
        query = scope.ScopeQuery(tuple(map(self._root, roots)), follow_links, max_depth, max_documents)
        sizes = self.index.documents.select("doc_key", F.octet_length("markdown").cast("long").alias("n_bytes"))
        return scope.closure(sizes, self.references, query)

    def scope_search(self, found: scope.Scope, pattern: str, limit: int = 100, offset: int = 0, **how: object) -> DataFrame:
        keys = F.broadcast(found.documents.select("doc_key"))
        inside = Index(self.index.documents.join(keys, "doc_key", "left_semi"))
        return scope.paged_search(self._hits(inside, pattern_of(pattern, **how)), found.documents, limit, offset)

    def scope_explain(self, found: scope.Scope, entry: str) -> DataFrame:
        """For each document of the scope in order, the entry it means; n_choices over 1 is a failure, null a miss."""
        asked = found.documents.select("doc_key", F.lit(entry).alias("selector"), F.lit(0).alias("sel_ord"))
        keys = F.broadcast(found.documents.select("doc_key"))
        hits = outline.select_nodes(self.index.nodes.join(keys, "doc_key", "left_semi"), asked, entries_only=True)
        return found.documents.join(hits.drop("selector", "sel_ord"), "doc_key", "left").orderBy("place", "ord")

    def validate(self) -> DataFrame:
        """Diagnostics of all documents, with those of the whole tree: empty and duplicate ids, dangling links, ambiguous names."""
        nodes = self.index.nodes.withColumn("role", F.coalesce("role", "kind"))
        row = lambda code, message: (F.lit("warning").alias("level"), F.lit(code).alias("code"), message.alias("message"))
        out = self.index.diagnostics.select("doc_key", "level", "code", "message")
        for found, code, message in (
            (outline.empty_ids(nodes), "ir.empty-identity", F.col("path")),
            (outline.duplicate_ids(nodes), "ir.duplicate-identity", F.col("id")),
            (outline.dangling_links(self.index.links, nodes), "ir.dangling-section-link", F.col("target_id")),
            (outline.ambiguous_names(nodes), "markdown.semantic-entry.ambiguous-selector", F.col("selector")),
        ):
            out = out.unionByName(found.select("doc_key", *row(code, message)))
        return out

    def doctor(self) -> DataFrame:
        worst = self.validate().groupBy("code").agg(F.when(F.bool_or(F.col("level") == "error"), "error").otherwise("warning").alias("status"))
        return admin.summary(worst)

    def page(self, text: str, start: int = 0, size: int = DEFAULT_CHARS) -> str:
        """A page of text under a header that says where it lies and how to go on."""
        if not 1 <= size <= MAX_CHARS:
            raise RequestError("InvalidLimit", f"{size} characters")
        start = min(start, len(text))
        stop = min(start + size, len(text))
        more = f" nextChar={stop}" if stop < len(text) else ""
        return f"[page chars={start}..{stop} totalChars={len(text)}{more}]\n{text[start:stop]}"

    def request(self, body: str | bytes) -> object:
        """A closed JSON request: {"input": {"selector", "source"?}, "view": {"kind", ...}}; unknown fields are refused."""
        raw = body.encode() if isinstance(body, str) else body
        if len(raw) > MAX_REQUEST_BYTES:
            raise RequestError("Limit", "the request is too large")
        data = json.loads(raw)
        if set(data) != {"input", "view"} or not set(data["input"]) <= {"selector", "source"} or "kind" not in data["view"]:
            raise RequestError("Request", "a request has input and view")
        view = dict(data["view"])
        kind = view.pop("kind")
        allowed = {"full": set(), "outline": {"detail"}, "excerpt": {"selectors"}, "explain": {"entry"}, "search": {"pattern", "syntax", "case", "word", "context_lines", "limit", "offset"}}
        if kind not in allowed or not set(view) <= allowed[kind]:
            raise RequestError("Request", f"unknown view or field: {kind}, {sorted(view)}")
        selector = self.resolve(data["input"]["selector"], data["input"].get("source"))
        return {"full": self.full, "outline": self.outline, "excerpt": self.read, "explain": self.explain, "search": self.search}[kind](selector, **view)
