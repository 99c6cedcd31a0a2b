"""Parsed tables: one Arrow pass over raw documents, then columns and explodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.tables import materialize
from docloom.sources import markdown, roff, tldr
from docloom.sources.trees import decompress

_NODE = pa.struct([("kind", pa.string()), ("path", pa.string()), ("id", pa.string()), ("title", pa.string()), ("parent_path", pa.string()), ("role", pa.string()), ("case_policy", pa.string()), ("names", pa.list_(pa.string()))])
_BLOCK = pa.struct([("type", pa.string()), ("owner_path", pa.string()), ("text", pa.string()), ("language", pa.string()), ("items", pa.list_(pa.string())), ("ordered", pa.bool_()), ("start", pa.int64()), ("compact", pa.bool_()), ("rows", pa.list_(pa.list_(pa.string())))])
_LINK = pa.struct([(c, pa.string()) for c in ("owner_path", "label", "title", "kind", "uri", "address", "name", "fragment", "manual_section", "target_id")])
_DIAGNOSTIC = pa.struct([("level", pa.string()), ("code", pa.string()), ("message", pa.string())])
_RANGE = pa.struct([("path", pa.string()), ("md_start", pa.int64()), ("md_end", pa.int64())])
_COLUMNS = [("title", pa.string()), ("nodes", pa.list_(_NODE)), ("blocks", pa.list_(_BLOCK)), ("links", pa.list_(_LINK)), ("diagnostics", pa.list_(_DIAGNOSTIC)), ("markdown", pa.string()), ("ranges", pa.list_(_RANGE)), ("tldr", pa.string()), ("error", pa.string())]

_SCHEMA = (
    "doc_key string, format string, title string, nodes array<struct<kind:string,path:string,id:string,title:string,parent_path:string,role:string,case_policy:string,names:array<string>>>,"
    "blocks array<struct<type:string,owner_path:string,text:string,language:string,items:array<string>,ordered:boolean,start:bigint,compact:boolean,rows:array<array<string>>>>,"
    "links array<struct<owner_path:string,label:string,title:string,kind:string,uri:string,address:string,name:string,fragment:string,manual_section:string,target_id:string>>,"
    "diagnostics array<struct<level:string,code:string,message:string>>, markdown string, ranges array<struct<path:string,md_start:bigint,md_end:bigint>>, tldr string, error string"
)


def parse_one(key: str, kind: str, content: bytes) -> dict:
    """The row of one document; what goes wrong with it is its error, not the query's."""
    row: dict = {c: None for c, _ in _COLUMNS}
    try:
        text = decompress(content).decode("utf-8") if kind != "roff" else decompress(content).decode("utf-8", "replace")
        parsed = roff.parse(text) if kind == "roff" else markdown.parse(text)
    except (ValueError, OSError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}
    if not parsed.blocks and not parsed.nodes and parsed.tldr is None:
        row["error"] = "Empty: no readable content"
    rendered = markdown.render(parsed, key)
    return row | {
        "title": parsed.title,
        "nodes": [{"kind": n.kind, "path": n.path, "id": n.id, "title": n.title, "parent_path": n.parent_path, "role": n.role, "case_policy": n.case_policy, "names": n.names} for n in parsed.nodes],
        "blocks": [{"type": b.type, "owner_path": b.owner, "text": b.text, "language": b.language, "items": b.items, "ordered": b.ordered, "start": b.start, "compact": b.compact, "rows": b.rows} for b in parsed.blocks],
        "links": [{"owner_path": x["owner"]} | {c: x.get(c) for c in ("label", "title", "kind", "uri", "address", "name", "fragment", "manual_section", "target_id")} for x in parsed.links],
        "diagnostics": parsed.diagnostics,
        "markdown": rendered.text,
        "ranges": [{"path": p, "md_start": a, "md_end": b} for p, a, b in rendered.ranges],
        "tldr": parsed.tldr,
    }


#: Bytes of raw documents that are parsed into rows together; a larger document is alone.
PARSED_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose values in a column of strings or bytes have at most so many bytes, or one row."""
    start = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if k > start and held + n > size:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # parsed rows are many times larger than their documents, so few of them are held at once
    for batch in (part for whole in batches for part in pieces(whole, "content", PARSED_BYTES)):
        keys, kinds, contents = (batch.column(c).to_pylist() for c in ("doc_key", "format", "content"))
        rows = [parse_one(k, f, c or b"") for k, f, c in zip(keys, kinds, contents)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), *[pa.array([r[c] for r in rows], t) for c, t in _COLUMNS]], names=["doc_key", "format", *[c for c, _ in _COLUMNS]])


@dataclass
class Index:
    """Tables of the parsed documents; each is a projection of one written table."""

    documents: DataFrame

    @property
    def nodes(self) -> DataFrame:
        each = self.documents.select("doc_key", "ranges", F.posexplode("nodes").alias("ord", "n")).select("doc_key", F.col("ord").cast("long").alias("ord"), "n.*", "ranges")
        at = F.get(F.filter("ranges", lambda r: r["path"] == F.col("path")), F.lit(0))
        section = F.regexp_replace("path", "/e[0-9]+$", "")
        coords = F.when(section == "root", F.array().cast("array<int>")).otherwise(F.split(section, r"\.").cast("array<int>"))
        entry = F.nullif(F.regexp_extract("path", "/e([0-9]+)$", 1), F.lit("")).cast("int")
        return each.select("doc_key", "ord", "kind", "path", "id", "title", "parent_path", "role", "case_policy", "names", coords.alias("coords"), entry.alias("entry_ix"), at["md_start"].alias("md_start"), at["md_end"].alias("md_end"))

    @property
    def blocks(self) -> DataFrame:
        return self.documents.select("doc_key", F.posexplode("blocks").alias("ord", "b")).select("doc_key", F.col("ord").cast("long").alias("ord"), "b.*")

    @property
    def links(self) -> DataFrame:
        return self.documents.select("doc_key", F.posexplode("links").alias("ord", "l")).select("doc_key", F.col("ord").cast("long").alias("ord"), "l.*")

    @property
    def diagnostics(self) -> DataFrame:
        return self.documents.select("doc_key", F.posexplode("diagnostics").alias("ord", "d")).select("doc_key", F.col("ord").cast("long").alias("ord"), "d.*")


def index(raw: DataFrame) -> Index:
    """Parse raw (doc_key, format, content) once."""
    return Index(materialize(raw.select("doc_key", "format", "content").mapInArrow(_parsed, _SCHEMA), "index"))


def tldr_rows(pages: DataFrame) -> DataFrame:
    """pages (topic, text) as rows: title, description, more_information, examples; error where a page has no title."""
    example = "array<struct<description:string,command:string,parts:array<struct<type:string,value:string>>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("description", pa.string()), ("command", pa.string()), ("parts", pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())])))]))
        for batch in (part for whole in batches for part in pieces(whole, "text", PARSED_BYTES)):
            rows = []
            for text in batch.column("text").to_pylist():
                try:
                    rows.append(tldr.parse(text or "") | {"error": None})
                except ValueError as e:
                    rows.append({"title": None, "description": [], "more_information": None, "examples": [], "error": str(e)})
            types = (("title", pa.string()), ("description", pa.list_(pa.string())), ("more_information", pa.string()), ("examples", kind), ("error", pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("topic"), *[pa.array([r[c] for r in rows], t) for c, t in types]], names=["topic", *[c for c, _ in types]])

    return pages.select("topic", "text").mapInArrow(run, f"topic string, title string, description array<string>, more_information string, examples {example}, error string")
