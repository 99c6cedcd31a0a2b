"""Importance resampling towards a target distribution over hashed word runs.

A text's features are its runs of 1 to N_GRAM consecutive words; each falls into one of N_BUCKETS buckets by the
CRC of its bytes.  A bucket's gain is the logarithm of how much likelier it is in the target than in the
documents; a document's weight is the mean gain of its features.  Weight plus Gumbel noise from a hash of its
id is its score, and the highest scores are drawn, which samples without replacement in proportion to the weights.

The byte automaton works on the buffers of Arrow's UTF-8 columns, some megabytes of rows at a time: a lookup table
classes every byte, differences of the classes are the words' bounds, and the CRCs of all words advance together, one byte a
step, by the CRC's own table, longest words first so that the live ones are a prefix.  A run of several words goes on
from the CRC of the shorter run before it.  A word's bytes beyond LONG_WORD are left to zlib, which goes on from the same state.

The corpus is read twice, for counts and for weights; what is gathered on the driver is one number a bucket. Ranks come
from equal ranges of the scores with prefix sums over the ranges, so nothing is ordered in one task.

Defined cases: null and wordless texts have no features, weight 0 and are never drawn; words may hold any
character beyond ASCII; a very long text is cut at word bounds for its steps, in memory linear in its bytes; a null id
hashes as the empty one and comes last among ties; rows that tie in score and id are ranked one after the
other; an empty table gives no rows; an empty target has T = 0; further columns, whatever their names, are
kept by :func:`resampled_documents`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Features are runs of up to so many words, in so many buckets.
N_GRAM, N_BUCKETS = 2, 10_000
#: Documents of fewer words are never drawn; of the others so many of a hundred are.
MIN_WORDS, SHARE = 20, 25
#: Seed of the noise.
SEED = 7
#: Bytes of rows, and words, that are worked on together.
BYTES_AT_ONCE, WORDS_AT_ONCE = 4_000_000, 1_000_000
#: Bytes of a word that advance with those of all others.
LONG_WORD = 64

#: The class of a byte: itself (A-Z as a-z) if it is of a word, else 0; digits, letters and all bytes beyond ASCII are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.where((_LOWER >= 48) & (_LOWER <= 57) | (_LOWER >= 97) & (_LOWER <= 122) | (_LOWER >= 128), _LOWER, 0).astype(np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _advanced(states: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC states (not inverted) after the bytes of each word; words come longest first."""
    states = states.copy()
    longest = int(min(size[0], LONG_WORD)) if len(size) else 0
    for k in range(longest):
        n = int(np.searchsorted(-size, -k))  # words with more than k bytes are a prefix
        states[:n] = _step(states[:n], data[start[:n] + k])
    for i in range(int(np.searchsorted(-size, -LONG_WORD))):
        rest = data[start[i] + LONG_WORD : start[i] + size[i]].tobytes()
        states[i] = zlib.crc32(rest, int(states[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return states


def features(texts: pa.Array, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, bucket) of all features of the texts, in blocks; the first run lengths come first within a block."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    if base == stop:
        return
    data = _CLASS[np.frombuffer(texts.buffers()[2], np.uint8)[base:stop]]
    # bounds: where a byte's being of a word differs from that of the byte before; rows end words too
    live = np.zeros(len(data) + 1, bool)
    live[:-1] = data != 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets - base] = True
    before = np.r_[False, live[:-1]]
    start = np.flatnonzero(live & (~before | first))
    end = np.flatnonzero(before & (~live | first))
    row = np.searchsorted(offsets - base, start, side="right") - 1
    for lo in range(0, len(start), WORDS_AT_ONCE):
        # a block looks back over the words before it, for its runs of several words
        back = max(0, lo - (n_gram - 1))
        s, size, r = start[back : lo + WORDS_AT_ONCE], (end - start)[back : lo + WORDS_AT_ONCE], row[back : lo + WORDS_AT_ONCE]
        order = np.argsort(-size, kind="stable")
        own = np.arange(len(s)) >= lo - back
        states = np.full(len(s), 0xFFFFFFFF, np.uint32)
        valid = np.ones(len(s), bool)
        for n in range(n_gram):
            if n:  # the run that ends one word before, a space, this word
                states = np.r_[states[:1], _step(states[:-1], np.uint32(32))]
                valid = np.r_[False, valid[:-1] & (r[1:] == r[:-1])]
            moved = np.empty_like(states)
            moved[order] = _advanced(states[order], data, s[order], size[order])
            states = moved
            take = valid & own
            yield r[take], ((states[take] ^ np.uint32(0xFFFFFFFF)) % np.uint32(n_buckets)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of some megabytes each."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def _counted(n_gram: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                for _, buckets in features(texts, n_gram, n_buckets):
                    total += np.bincount(buckets, minlength=n_buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket, n: features of all texts by bucket; every task sums up its own first."""
    part = texts.select(F.col("text").cast("string")).mapInArrow(_counted(n_gram, n_buckets), "bucket bigint, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket, gain: thousandths of the logarithm of the target's share over the documents', each with one added."""
    raw, aim = bucket_counts(docs, n_gram, n_buckets).withColumnRenamed("n", "s"), bucket_counts(target, n_gram, n_buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(n_buckets).select(F.col("id").alias("bucket")).join(raw, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy()  # as many rows as there are buckets
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.sum(s).over(whole) + n_buckets)) / ((s + 1) * (F.sum(t).over(whole) + n_buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weighed(gains: np.ndarray, n_gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            n_words, n_features, sums = (np.zeros(len(column), np.int64) for _ in range(3))
            for at, texts in _slices(column):
                here = slice(at, at + len(texts))
                for k, (rows, buckets) in enumerate(features(texts, n_gram, len(gains))):
                    n = np.bincount(rows, minlength=len(texts))
                    n_features[here] += n
                    if k % n_gram == 0:
                        n_words[here] += n
                    np.add.at(sums[here], rows, gains[buckets])
            weight = np.floor_divide(sums, np.maximum(n_features, 1))
            added = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], ["key", "n_words", "n_features", "weight"])

    return run


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _scored(docs: DataFrame, target: DataFrame, key: Column, n_gram: int, n_buckets: int, seed: int) -> DataFrame:
    """key, n_words, n_features, weight of every row; key may be any value."""
    gains = np.zeros(n_buckets, np.int64)
    for r in bucket_gains(docs, target, n_gram, n_buckets).collect():  # n_buckets rows
        gains[r["bucket"]] = r["gain"]
    held = docs.select(key.alias("key"), docs["text"].cast("string").alias("text"))
    kind = held.schema["key"].dataType.simpleString()
    return held.mapInArrow(_weighed(gains, n_gram), f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def _ranked(scored: DataFrame, min_words: int, share: int) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, ... in order of score, then id, null where a row is not drawn."""
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    order = [(F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranks")
    part = F.shiftright("at", 33)
    ranges = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") >= min_words).alias("able"))
    # one row a range: their number is that of shuffle partitions, whatever the size of the table
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", before.alias("before"), F.expr(f"({share} * sum(able) OVER ()) div 100").alias("drawn"))
    rank = F.col("before") + F.expr("at & 8589934591L") + 1
    return dealt.withColumn("part", part).join(F.broadcast(ranges), "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank).cast("long")).drop("part", "before", "drawn", "at", "row")


def resample(
    docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, share: int = SHARE
) -> DataFrame:
    """For every row: doc_id, n_words, n_features, weight, score, rank."""
    weighed = _scored(docs, target, docs["doc_id"], n_gram, n_buckets, seed).withColumnRenamed("key", "doc_id")
    return _ranked(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), min_words, share)


def resampled_documents(
    docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, share: int = SHARE
) -> DataFrame:
    """The drawn rows themselves, with all their columns."""
    # a row is met again by its id and text's hash; equal rows have equal scores, so how many of them are drawn is enough
    name = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("a"), F.xxhash64(F.lit(1), docs["text"]).alias("b"))
    weighed = _scored(docs, target, name, n_gram, n_buckets, seed)
    ranked = _ranked(weighed.withColumn("doc_id", F.col("key.doc_id")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), min_words, share)
    drawn = ranked.groupBy("key").agg(F.count("rank").alias("_drawn"), F.count(F.lit(1)).alias("_rows")).where("_drawn > 0")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), name.alias("_key"))
    met = held.join(drawn.withColumnRenamed("key", "_key"), "_key")
    # only rows that tie at the cut are drawn in part
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_doc")))
    cut = met.where("_drawn < _rows").withColumn("_nth", nth).where("_nth <= _drawn").drop("_nth")
    return met.where("_drawn = _rows").unionByName(cut).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
