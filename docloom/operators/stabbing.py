"""The innermost interval around each position, by one sweep over both.

Intervals (at their starts) and positions are put in one order by equal ranges of (document, offset), so a document of any length lies in as
many ranges as it needs.  A range is swept once with a stack: an interval is pushed where it starts, and what has ended is popped from the top before a
position looks at it; what has ended for one position has for all later ones, so each interval is pushed and popped once, nested or not.

An interval of the range itself starts after all earlier ones, so what the stack answers is final. Positions that it leaves open, which are those before the
first open interval of their document in a range, look at the intervals that earlier ranges left open: a range hands on those with lesser and lesser ends
only (an interval that ends no later than one that starts after it can't be anyone's innermost any more), and a running maximum in
order of their ends finds for each position the last start among those that end behind it. What is handed on grows with the nesting
at the cuts, not with the document.

Defined cases: of equal starts the greater ord is the inner one; empty and null intervals hold nothing; positions that no interval holds have a null
node; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.plans.tables import materialize


def _swept(doc_type: pa.DataType, node_type: pa.DataType):
    """Rows (kind 1: a position with its node, or left open; 2: an interval that is open where the range ends; 3: the range's documents at either end)."""
    names = ["kind", "part", "doc_key", "at", "id", "stop", "ord", "node", "open"]
    types = [pa.int32(), pa.int32(), doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), node_type, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack, part = (), [], None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("part", "doc_key", "at", "kind", "id", "stop", "ord", "node")]
            for part, key, at, kind, row, stop, order, node in zip(*columns):
                if (key,) != doc:
                    doc, stack = (key,), []
                if kind == 0:
                    # what ends no later can't be seen again
                    while stack and stack[-1][1] <= stop:
                        stack.pop()
                    stack.append((at, stop, order, node))
                    continue
                while stack and stack[-1][1] <= at:
                    stack.pop()
                found = stack[-1] if stack else None
                out.append((1, part, key, at, row, None, None, found[3] if found else None, found is None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, types)], names)
        if part is not None:
            rest = [(2, part, doc[0], at, None, stop, order, node, None) for at, stop, order, node in stack]
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), types)], names)

    return run


def innermost(positions: DataFrame, intervals: DataFrame) -> DataFrame:
    """positions (doc_key, id, pos) with node: that of the interval (doc_key, start, stop, ord, node) with the last start that holds pos."""
    doc, node = intervals.schema["doc_key"].dataType, intervals.schema["node"].dataType
    marks = intervals.where("start < stop").select("doc_key", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("stop").cast("long").alias("stop"), F.col("ord").cast("long").alias("ord"), "node")
    asked = positions.select(F.col("doc_key").cast(doc).alias("doc_key"), F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"))
    events = marks.unionByName(asked, allowMissingColumns=True)
    order = [F.col("doc_key").asc(), F.col("at").asc(), F.col("kind").asc(), F.col("ord").asc(), F.col("id").asc()]
    dealt = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"kind int, part int, doc_key {doc.simpleString()}, at bigint, id bigint, stop bigint, ord bigint, node {node.simpleString()}, open boolean"
    swept = materialize(dealt.select("part", "doc_key", "at", "kind", "id", "stop", "ord", "node").mapInArrow(_swept(to_arrow_type(doc), to_arrow_type(node)), schema), "sweep")
    left = swept.where("kind = 1 AND open")
    # ranges in which a document's positions are open, behind those that hand intervals on
    later = left.groupBy(F.col("doc_key").alias("_doc"), F.col("part").alias("_to")).agg(F.min("at").alias("_from"))
    handed = swept.where("kind = 2").join(later, (F.col("doc_key").eqNullSafe(F.col("_doc"))) & (F.col("part") < F.col("_to")) & (F.col("stop") > F.col("_from")))
    handed = handed.select("doc_key", F.col("_to").alias("part"), F.col("stop").alias("end"), F.lit(1).alias("_rank"), F.struct("at", "ord", "node").alias("found"))
    asking = left.select("doc_key", "part", F.col("at").alias("end"), F.lit(0).alias("_rank"), "at", "id")
    behind = Window.partitionBy("doc_key", "part").orderBy(F.col("end").desc(), F.col("_rank").asc()).rowsBetween(Window.unboundedPreceding, 0)
    closed = handed.unionByName(asking, allowMissingColumns=True).withColumn("best", F.max("found").over(behind)).where("_rank = 0")
    done = swept.where("kind = 1 AND NOT open").select("doc_key", "id", F.col("at").alias("pos"), "node")
    return done.unionByName(closed.select("doc_key", "id", F.col("at").alias("pos"), F.col("best.node").alias("node")))
