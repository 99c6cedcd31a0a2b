"""Benchmark decontamination, with DataFrame operations only.

Benchmark items become windows of N_WORDS normalised words (an item of fewer words is one
window).  A window that occurs in a document holds one of its own shorter grams at a position of the document
that is divisible by the stride, so the hashes of all those grams form a small set that is sent
to every task, and the documents' grams at these positions are looked up in it where they lie.
Texts with such a gram, and only they, are looked up window by window and verified word by word.

A text is named by 128 bits of its hash, so copies are looked at once, however many there are, and results
meet their rows by that name.  Every table that is broadcast is counted before: beyond its bound the same
join goes through a shuffle, of hashes in the first step and of suspect texts after it.

Defined cases: a null or wordless text has no words, no hits and is clean; a null item
has no windows; a null item_id counts as the empty id; equal windows of several items
count for each of them; repeated rows have equal results; a very long text is searched whole, as rows of its
positions; empty tables give no hits or no rows; further columns, whatever their names, are kept
by :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, materialize

#: Words in a window of the contract.
N_WORDS = 13
#: Normalised words of the contract, as a Java pattern.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this many rows of hashes (about 32 bytes each) or of windows (about 200 bytes each) are broadcast.
BROADCAST_HASHES, BROADCAST_WINDOWS = 2_000_000, 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(ITEM_WORD), F.lit(0))


def _names(text: Column) -> list[Column]:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def _sent(rows: DataFrame, bound: int) -> DataFrame:
    """A written table, marked for broadcast if it is within the bound."""
    return F.broadcast(rows) if rows.limit(bound + 1).count() <= bound else rows


def item_windows(benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """Distinct windows: gram (space-joined), size, h, items (ids as strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    cut = items.where("size(w) > 0").select(
        "item", F.explode(F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), p -> slice(w, p, {n})) ELSE array(w) END")).alias("w")
    )
    return (
        cut.groupBy(F.array_join("w", " ").alias("gram"), F.size("w").alias("size"))
        .agg(F.first("w").alias("w"), F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("h", F.xxhash64("w"))
    )


def _grams(size: int) -> tuple[int, int]:
    """Words of the grams of a window, and the stride of their positions: any window holds one at such a position."""
    gram = (size + 1) // 2
    return gram, size - gram + 1


def _suspects(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Names of the texts that hold a gram of a window at a position of the stride."""
    own = [F.expr(f"CASE WHEN size = {s} THEN transform(sequence(1, {_grams(s)[1]}), p -> xxhash64(slice(w, p, {_grams(s)[0]}))) ELSE array() END") for s in sizes]
    seeds = materialize(windows.select(F.explode(F.concat(*own)).alias("g")).distinct(), "seeds")
    strided = [F.expr(f"CASE WHEN size(_w) >= {s} THEN transform(sequence(1, size(_w) - {_grams(s)[0] - 1}, {_grams(s)[1]}), p -> xxhash64(slice(_w, p, {_grams(s)[0]}))) ELSE array() END") for s in sizes]
    worded = docs.select(*_names(docs["text"]), words_of(docs["text"]).alias("_w"))
    met = worded.select("_k1", "_k2", F.explode(F.array_distinct(F.concat(*strided))).alias("g")).join(_sent(seeds, BROADCAST_HASHES), "g", "left_semi")
    return materialize(met.select("_k1", "_k2").distinct(), "suspects")


def _verdicts(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """Written: _k1, _k2, n_hit, spans (first word and one past the last), items, of the texts in which windows occur."""
    windows = materialize(item_windows(benchmark, n), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # n numbers at most
    none = "_k1 bigint, _k2 bigint, n_hit bigint, spans array<struct<start:int,stop:int>>, items array<string>"
    if not sizes:
        return docs.sparkSession.createDataFrame([], none)
    suspects = _suspects(docs, windows, sizes)
    named = docs.select(*_names(docs["text"]), docs["text"].alias("_text"))
    once = named.join(_sent(suspects, BROADCAST_HASHES), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"))
    texts = materialize(once.select("_k1", "_k2", words_of(F.col("_text")).alias("_w")), "suspect-texts")
    every = [F.expr(f"CASE WHEN size(_w) >= {s} THEN transform(sequence(1, size(_w) - {s - 1}), p -> named_struct('at', p, 'h', xxhash64(slice(_w, p, {s})), 'size', {s})) ELSE array() END") for s in sizes]
    starts = texts.select("_k1", "_k2", F.inline(F.concat(*every)))
    near = starts.join(_sent(windows.select("h", "size", "gram", "items"), BROADCAST_WINDOWS), ["h", "size"])
    sure = near.join(texts, ["_k1", "_k2"]).where("array_join(slice(_w, at, size), ' ') = gram")
    # occurrences that touch or overlap are one span: islands by the greatest end so far
    order = Window.partitionBy("_k1", "_k2").orderBy("at", "size")
    spots = sure.select("_k1", "_k2", "at", "size", "items")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spots = spots.withColumn("_new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(order))
    merged = spots.groupBy("_k1", "_k2", "_span").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop"), F.collect_set("items").alias("items"))
    found = merged.groupBy("_k1", "_k2").agg(
        F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.array_distinct(F.flatten(F.collect_set("items")))))).alias("items"),
    )
    return materialize(found.select("_k1", "_k2", "n_hit", "spans", "items"), "verdicts")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_words_of(text: Column) -> Column:
    """Normalised words of a text as a long; lower-casing changes none of their bounds."""
    return F.coalesce(F.regexp_count(text, F.lit(ITEM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0)).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items, spans (1-based words), contaminated."""
    verdicts = _verdicts(docs, benchmark, n)
    named = docs.select("doc_id", n_words_of(docs["text"]).alias("n_words"), *_names(docs["text"]))
    out = named.join(_sent(verdicts, BROADCAST_WINDOWS), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, unit: str = "document", n: int = N_WORDS) -> DataFrame:
    """docs without contaminated documents, or with unit="span" without the words that are hit.

    With spans, separators before a removed word go with it, and n_chars follows the text.
    """
    if unit not in ("document", "span"):
        raise ValueError(f"unit: {unit}")
    verdicts = _verdicts(docs, benchmark, n)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *_names(docs["text"]))
    joined = held.join(_sent(verdicts.select("_k1", "_k2", "n_hit", "spans"), BROADCAST_WINDOWS), ["_k1", "_k2"], "left")
    out = {c: F.col("_doc").getField(c) for c in docs.columns}
    if unit == "document":
        # words are counted only where there are hits
        bad = F.when(F.col("n_hit") > 0, contaminated(F.col("n_hit"), n_words_of(F.col("_doc.text")))).otherwise(F.lit(False))
        return joined.where(~bad).select(*[v.alias(c) for c, v in out.items()])
    pieces = joined.withColumn("_pieces", F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(0)))
    pieces = pieces.withColumn("_tail", F.expr("substr(_doc.text, length(array_join(_pieces, '')) + 1)"))
    left = F.expr("array_join(filter(_pieces, (x, i) -> NOT exists(spans, s -> i + 1 >= s.start AND i + 1 < s.stop)), '')")
    pieces = pieces.withColumn("_text", F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(F.concat(left, F.col("_tail"))))
    out["text"] = F.col("_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("spans").isNull(), out["n_chars"]).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return pieces.select(*[v.alias(c) for c, v in out.items()])
