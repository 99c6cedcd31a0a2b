"""Connected components of a table of links, in rounds of joins and aggregates.

Rounds alternate between joining every node's larger neighbours and its smaller ones to
the smallest (large star, small star) until nothing changes; each round is written to
the shared folder, so lineage stays short and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_scratch, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """A node's smallest neighbour is needed for the smaller ends alone, as only links to larger nodes move; a > b in all links."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    return links.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contracted(links: DataFrame, rounds: int) -> DataFrame:
    """Links with the same components, nearer to stars, after so many rounds; a larger node comes as a, a smaller one as b."""
    now = materialize(_ordered(links), "links")
    for _ in range(rounds):
        then = materialize(_small_star(_large_star(now)), "links")
        drop_scratch(now)
        now = then
    return now


def neighbours(links: DataFrame) -> DataFrame:
    """From contracted links: node and root, some smaller node of its component; nodes with one root are connected, connected ones may differ in it."""
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b), in any direction: node and root, the smallest node of its component, for all nodes but roots."""
    now = materialize(_ordered(links), "links")
    mark = _mark(now)
    while True:
        then = materialize(_small_star(_large_star(now)), "links")
        found = _mark(then)
        drop_scratch(now)
        if found == mark:
            return then.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, mark = then, found
