"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  A source's documents are put in key order by
equal ranges of the key (buckets), bucket totals give distributed prefix sums, and
only the one bucket of each source in which its budget ends is sorted row by row.
That yields one *cut* a source: whole epochs, then the documents below the cut key,
then a part of the document at the cut.  Applying the cuts is a join with one row per
source, so a source that holds a third of all rows is never gathered anywhere.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is
a source of its own, ordered last; rows with equal ids have equal keys, and if the cut
falls on them all are filled up to one level, so short ones are taken whole and the words missing are fewer than
the rows; a very long text is one row, taken in part if the cut falls on it; an empty table gives no rows;
further columns of the input are kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, materialize, word_count

#: Ranges of the random key: a bucket holds about 1/4096 of its source.
BUCKETS = 4096
#: Up to this many sources the table of cuts is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def mix_key(id_col: Column, seed: str = "mix") -> Column:
    """The hash-random key of a document: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Targets from (source, source_size): shares of the whole by weight, capped by filling up.

    In order of size a weight, the sources at their cap are a prefix of the list; the level of
    the others is what the capped ones leave over, by weight.
    """
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("place").asc())
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("everything", F.sum("source_size").over(whole))
        .withColumn("capped_before", F.coalesce(max_repeats * F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("everything") - F.col("capped_before")).cast("double") / F.col("weight_left").cast("double"))
        .withColumn("capped", (max_repeats * F.col("source_size")).cast("double") <= F.col("level") * F.col("weight"))
    )
    # the level of the first source that is not capped; all before it are capped
    order = F.row_number().over(by_level)
    filled = filled.withColumn("order", order)
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("order"), F.col("level")))).over(whole)
    return filled.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("order") < F.col("first.order")), (max_repeats * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.level") * F.col("weight"))
        .alias("target"),
    )


def mixing_cuts(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row a source: (source, source_size, target, epochs, cut_key, share).

    sized has (source, key, size).  A document takes epochs times its size, its size again if its
    key is below cut_key, and up to share words if its key is cut_key.
    """
    bucketed = sized.withColumn("bucket", _bucket(F.col("key")))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left_over", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("s", F.struct(F.col("source")))
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    at = (
        prefix.alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .where("p.before <= t.left_over AND t.left_over < p.before + p.words")
        .select("p.source", "p.bucket", (F.col("t.left_over") - F.col("p.before")).alias("inside"))
    )
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bucketed.alias("b")
        .join(at.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")) & (F.col("b.bucket") == F.col("a.bucket")))
        .groupBy("b.source", "b.key")
        .agg(F.sum("b.size").alias("words"), F.first("a.inside").alias("inside"))
        .withColumn("before", F.coalesce(F.sum("words").over(by_key), F.lit(0)))
        .where("before <= inside AND inside < before + words")
        .select("source", F.col("key").alias("cut_key"), (F.col("inside") - F.col("before")).alias("rest"))
    )
    # rows at the cut key, of which there may be many, by their sizes: what shorter ones leave over goes to the longer
    tied = (
        bucketed.alias("b")
        .join(cut.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.key") == F.col("c.cut_key")))
        .groupBy("c.source", "c.cut_key", "c.rest", "b.size")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    by_size = Window.partitionBy("source").orderBy("size")
    shares = (
        tied.withColumn("shorter", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("rows").over(by_size.rowsBetween(0, Window.unboundedFollowing)))
        .where("shorter + left * size > rest")
        .groupBy("source", "cut_key")
        .agg(F.min_by(F.expr("(rest - shorter) div left"), "size").alias("share"))
    )
    return (
        targets.alias("t")
        .join(shares.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select("t.source", "t.source_size", "t.target", "t.epochs", "c.cut_key", F.coalesce("c.share", F.lit(0)).alias("share"))
    )


def _with_cuts(rows: DataFrame, cuts: DataFrame, source: str) -> DataFrame:
    """rows with the struct column _cut; one row a source is broadcast if their number is small."""
    cuts = cuts.select(F.struct("*").alias("_cut"))
    small = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(cuts) if small else cuts, rows[source].eqNullSafe(F.col("_cut.source")), "left")


def _taken(size: Column, key: Column) -> Column:
    below = F.when(key < F.col("_cut.cut_key"), size).when(key == F.col("_cut.cut_key"), F.least(size, F.col("_cut.share"))).otherwise(F.lit(0))
    return (F.col("_cut.epochs") * size + below).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """For every row: doc_id, source, size, source_size, target, taken."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", mix_key(F.col("doc_id"), seed)), "mix-sizes")
    cuts = materialize(mixing_cuts(sized, weights, max_repeats), "mix-cuts")
    return _with_cuts(sized, cuts, "source").select(
        "doc_id", "source", "size", F.col("_cut.source_size").alias("source_size"), F.col("_cut.target").alias("target"), _taken(F.col("size"), F.col("key")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each document once for each epoch that takes it, with all its columns.

    A document at a cut comes last with the first words that its source still needs; n_chars
    follows if there is such a column.
    """
    columns = docs.columns
    sized = materialize(docs.select("source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    cuts = materialize(mixing_cuts(sized, weights, max_repeats), "mix-cuts")
    held = docs.select(F.struct(*[docs[c] for c in columns]).alias("_doc"), docs["source"].alias("_source"))
    rows = _with_cuts(held, cuts, "_source").select(
        "_doc", word_count(F.col("_doc.text")).alias("_size"), mix_key(F.col("_doc.doc_id"), seed).alias("_key"), "_cut"
    ).select("_doc", "_size", _taken(F.col("_size"), F.col("_key")).alias("_taken"))
    rows = rows.where("_taken > 0").select(
        "_doc", "_size", "_taken", F.explode(F.sequence(F.lit(1), F.expr("cast((_taken + _size - 1) div _size as int)"))).alias("_epoch")
    )
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("_whole", words >= F.col("_size")).withColumn("_text", F.when(F.col("_whole"), F.col("_doc.text")).otherwise(head))
    out = {c: F.col("_doc").getField(c) for c in columns}
    out["text"] = F.col("_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_whole"), out["n_chars"]).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[v.alias(c) for c, v in out.items()])
