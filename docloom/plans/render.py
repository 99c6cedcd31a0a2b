"""Results as text, CommonMark and JSON; rows are built by Spark, only pages of bounded size are joined here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON object a row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("json"))


def outline_markdown() -> Column:
    depth = F.when(F.col("path") == "root", 0).otherwise(F.size(F.split("path", r"[./]")) - 1)
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- `"), "path", F.lit("` (`"), "id", F.lit("`) "), "title")


def outline_text(rows: list[dict]) -> str:
    """A tree with connectors; rows have path, title, in document order."""
    parents = [r["path"].rpartition("/")[0] or r["path"].rpartition(".")[0] for r in rows]
    out = []
    for i, r in enumerate(rows):
        last = parents[i] not in parents[i + 1 :]
        depth = 0 if not parents[i] else parents[i].count(".") + parents[i].count("/") + 1
        out.append("   " * depth + ("└─ " if last else "├─ ") + f"{r['path']} {r['title']}")
    return "\n".join(out)


def excerpt_markdown(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """The text of selected nodes, cut from the addressable render by bytes, under a breadcrumb."""
    text = F.decode(F.substring(F.encode("markdown", "utf-8"), F.col("md_start").cast("int") + 1, (F.col("md_end") - F.col("md_start")).cast("int")), "utf-8")
    joined = nodes.join(documents.select("doc_key", "markdown"), "doc_key")
    return joined.select("doc_key", "ord", "path", F.concat(F.lit("*Outline "), "path", F.lit("*\n\n"), text).alias("text"))


def search_text(rows: list[dict]) -> str:
    """grep-like: one heading a node, hit and context lines in order, each once."""
    out, node = [], None
    seen: set[tuple] = set()
    for r in sorted(rows, key=lambda r: (r["doc_key"], r["line_no"], not r["matched"])):
        if (r["doc_key"], r["line_no"]) in seen:
            continue
        seen.add((r["doc_key"], r["line_no"]))
        if (r["doc_key"], r.get("node")) != node:
            node = (r["doc_key"], r.get("node"))
            out.append(f"{r['doc_key']} {r['node']}" if r.get("node") else str(r["doc_key"]))
        out.append(f"{r['line_no']}{':' if r['matched'] else '-'}{r['text']}")
    return "\n".join(out)


def coverage_text(coverage: dict, scope: str) -> str | None:
    """Why a scope is empty; None if it is not."""
    if coverage["scope_total"]:
        return None
    return f"no documents in {scope}; sections: {', '.join(coverage['sections']) or 'none'}; sources: {', '.join(coverage['sources']) or 'none'}"
