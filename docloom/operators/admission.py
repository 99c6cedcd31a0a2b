"""Greedy admission in order under a budget: what does not fit is left out, and smaller items behind it may still fit.

No sum over a window gives that, as what is left out has no share in it; but few rounds do. While the rest of the budget is between 2^k and 2^(k+1),
every item below 2^k fits, and the first one from 2^k on that fits ends the round, as it leaves less than 2^k. So a round ends at the first place
where the sum of the small items, or one larger item on top of it, brings the rest below 2^k: both come from prefix sums. The rounds are at most as many as the
budget has bits, whatever the number of items. Items lie in equal ranges of their order, so prefix sums are sums of ranges and sums within one.

Defined cases: sizes that are null or negative count as 0; items of equal order are taken one after the other, in order of key; an item larger than
the budget is never admitted; no items give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.tables import materialize


def admit(items: DataFrame, budget: int) -> DataFrame:
    """items (key, order, size) with admitted."""
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    order = [F.col("order").asc(), F.col("key").asc(), F.col("size").asc()]
    sized = items.select("key", "order", size.alias("size"))
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "admission")
    left, rest, before = int(budget), placed, -1  # what is left, and the place up to which all is decided
    bounds = []  # (from, to, least size that does not fit there, the larger item that ends the round)
    while True:
        sums = rest.where(F.col("size") <= left).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).first()
        if not sums["n"]:
            break
        if sums["s"] <= left:
            bounds.append((before, None, left + 1, None))
            break
        power = 1 << (left.bit_length() - 1)
        small = F.when(F.col("size") < power, F.col("size")).otherwise(F.lit(0))
        parts = rest.groupBy("part").agg(F.sum(small).alias("s"))  # one row a range
        ahead = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        run = rest.join(F.broadcast(ahead), "part").withColumn("used", F.col("ahead") + F.sum(small).over(inside))
        large = (F.col("size") >= power) & (F.col("size") <= left - F.col("used"))
        drained = (F.col("size") < power) & (left - F.col("used") < power)
        end = run.where(large | drained).agg(F.min(F.struct("at", "size", "used")).alias("e")).first()["e"]
        if end is None:  # what is left over is large and fits nowhere
            bounds.append((before, None, power, None))
            break
        taken = end["size"] >= power
        bounds.append((before, end["at"], power, end["at"] if taken else None))
        left -= end["used"] + (end["size"] if taken else 0)
        before, rest = end["at"], rest.where(F.col("at") > end["at"])
    fits = F.lit(False)
    for start, stop, limit, large in bounds:
        here = (F.col("at") > start) & ((F.col("at") <= stop) if stop is not None else F.lit(True))
        fits = fits | (here & ((F.col("size") < limit) | (F.col("at") == large if large is not None else F.lit(False))))
    return placed.select("key", "order", "size", fits.alias("admitted"))
