"""Targets of alias chains by pointer jumping.

Every alias points at one page, which may be an alias again. Each round joins the table of pointers with itself, so after k rounds a pointer spans 2^k hops;
four joins follow chains of MAX_REDIRECTS hops, whatever their number. A pointer also carries the least page that it has come past: the least one
on a cycle comes past itself. From these pages alone the same pointers, the shortest first, name all pages of their cycles.

Defined cases: an alias of a page that does not exist is `missing`; a chain that is in a cycle of up to MAX_REDIRECTS pages after MAX_REDIRECTS hops is a `cycle`; a longer chain, also one that
comes into a cycle later, or a longer cycle is `too-long`; only
`found` has a target; a page that is no alias is its own target after no hops; of several targets of one alias the least counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.tables import materialize
from docloom.schema import MAX_REDIRECTS


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers of twice as many hops; those that lead to no alias stay."""
    then = pointers.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
    far = pointers.join(then, "to", "left")
    return far.select("node", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", F.coalesce("_least", "least")).alias("least"))


def alias_targets(pages: DataFrame, aliases: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """For every page (node): status, target, hops.  pages: node; aliases: node, to.  max_hops is a power of two."""
    if max_hops < 1 or max_hops & (max_hops - 1):
        raise ValueError(f"{max_hops} hops")
    first = aliases.groupBy("node").agg(F.min("to").alias("to"))
    pointers = materialize(first.select("node", "to", F.lit(1).alias("hops"), F.col("to").alias("least")), "pointers")
    direct = pointers.select(F.col("node").alias("to"), F.lit(True).alias("_again"))
    spans = [pointers]
    for _ in range(max_hops.bit_length() - 1):
        pointers = materialize(_jumped(pointers), "pointers")
        spans.append(pointers)
    ends = pointers.join(direct, "to", "left").join(pages.select(F.col("node").alias("to"), F.lit(True).alias("_page")).distinct(), "to", "left")
    # the least page of each cycle comes past itself; pointers of 1, 2, 4, ... hops lead from it to all others
    cycles = pointers.where("least = node").select("node")
    for span in spans[:-1]:
        cycles = cycles.unionByName(cycles.join(span, "node").select(F.col("to").alias("node"))).distinct()
    in_cycle = cycles.select(F.col("node").alias("to"), F.lit(True).alias("_cycle"))
    open_ends = ends.where("_again").join(in_cycle, "to", "left").select("node", F.when(F.col("_cycle"), "cycle").otherwise("too-long").alias("status"), F.lit(None).cast(pages.schema["node"].dataType).alias("target"), "hops")
    done = ends.where("_again IS NULL").select("node", F.when(F.col("_page"), "found").otherwise("missing").alias("status"), F.when(F.col("_page"), F.col("to")).alias("target"), "hops")
    plain = pages.select("node").distinct().join(aliases.select("node"), "node", "left_anti").select("node", F.lit("found").alias("status"), F.col("node").alias("target"), F.lit(0).alias("hops"))
    return done.unionByName(open_ends).unionByName(plain)
