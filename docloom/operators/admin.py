"""Sources and health: inspection, pruning, selection, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inspect_sources(configured: DataFrame, installed: DataFrame) -> DataFrame:
    """Status of each source, configured or installed: missing, stale, ready or orphaned."""
    c, i = configured.alias("c"), installed.alias("i")
    status = (
        F.when(F.col("c.name").isNull(), "orphaned").when(F.col("i.name").isNull(), "missing").when(F.col("i.fingerprint") != F.col("c.fingerprint"), "stale").otherwise("ready")
    )
    return c.join(i, F.col("c.name") == F.col("i.name"), "full_outer").select(F.coalesce("c.name", "i.name").alias("name"), status.alias("status"))


def orphans(configured: DataFrame, installed: DataFrame) -> DataFrame:
    return installed.join(configured.select("name"), "name", "left_anti")


def selected(files: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Paths equal to or below an included prefix and none of the excluded ones; no prefix includes all."""
    below = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: (F.col(column) == p) | F.col(column).startswith(F.concat(p, F.lit("/"))))
    out = files.where(below(include)) if include else files
    return out.where(~below(exclude)) if exclude else out


def case_collisions(files: DataFrame, column: str = "path") -> DataFrame:
    """Paths that differ in case only."""
    return files.groupBy(F.lower(column).alias("folded")).agg(F.countDistinct(column).alias("spellings")).where("spellings > 1")


def summary(checks: DataFrame) -> DataFrame:
    """One row: how many checks are ok, warnings and errors, and the worst of them."""
    worst = F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("healthy")
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "ok"), ("warning", "warnings"), ("error", "errors"))]
    return checks.agg(*counts, worst.alias("outcome"))


def scope_status(frontier: DataFrame) -> DataFrame:
    reasons = ("max-depth", "max-documents", "max-content-bytes")
    return frontier.agg(*[F.count_if(F.col("reason") == r).alias(r.replace("-", "_")) for r in reasons])
