"""Places of rows in an order over a whole table, from equal ranges: no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.tables import materialize


def numbered(rows: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """rows with their places (1, 2, ...) in order; rows that tie come one after the other."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "numbered")
    part = F.shiftright("_at", 33)
    ranges = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_part", part).join(F.broadcast(ranges.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn(name, (F.col("_before") + F.expr("_at & 8589934591L") + 1).cast("long")).drop("_part", "_before", "_at")
