"""Near copies by exact similarity of word shingles: what fingerprints propose is verified, what they miss is found.

A text is the set of its five-word shingles; two texts are near copies if the sets' Jaccard
similarity is 0.8 or more.  Equal sets are joined by digest and searched once.  Fingerprints of the
same shingles go through the generalised pigeonhole search of :mod:`docloom.llm.simhash`; the pairs it
proposes are compared as whole sets, and those that are similar are the first links.

Sets of that similarity may differ in more bits than any search can bridge (at 0.8, ten of 64 on average), so the
remaining pairs come from an index that misses none: all shingles get one order, the rare ones first, and sets of n
shingles that are so similar share one of their first n // 5 + 1 in that order.  How rare a
shingle is comes from a sample of texts, which changes the time only.  A sample does not know what a growing number of texts
shares, such as quoted passages, so the first shingles of all texts are counted: those of more than MANY texts go behind the others,
by their counts, and texts that had one among their first ones get these anew (:func:`refilled`).  The prefixes of all other texts stay
what they are in the new order, as what is moved only moves back.  Shingles whose texts are all in one
group already are left out, and so are texts under a shingle that no text of another group there can be similar to,
by their sizes and the shingle's places in both.  Rounds compare all texts under a shingle with one of
them and join those that are similar, so a large group of near copies costs about its members and not
their pairs; then all remaining pairs of texts that are in different groups are compared, which are made where two texts first
meet and not under all shingles they share.  The one text is that with the fewest shingles
before the shared one: copies have words of their own, which are rare and come first, so it is the text they were made from,
or the nearest to it; every other round takes any text.  Connected
components of the links are the groups.

Before texts move, pairs are held against sketches: a bit for every residue of the hashes, the parity of its shingles. Sets
differ in at least as many shingles as their sketches in bits, so a pair with too many of them is not similar for certain
and its texts stay where they are; the others are compared as whole sets as before.

Defined cases: texts without words, null ones too, are copies of each other; a text of fewer
words than a shingle is one shingle; repeated rows are copies; a very long text is one row with all its
shingles; a null doc_id is kept only where a group has no other; an empty table gives no rows; further
columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import drop_scratch, materialize
from docloom.llm.components import components, contracted, neighbours

#: Words of a shingle and seed of XXH64.
SHINGLE, SEED = 5, 42
#: Texts of the sample, and the shingles that are taken from it as common ones.
SAMPLE, COMMON = 20_000, 100_000
#: Texts that have a shingle among their first ones, beyond which it goes behind rarer ones.
MANY = 8
#: Rounds with one text a shingle at most, and the pairs a text that are left without another round.
ROUNDS, PAIRS_A_ROW = 4, 4
#: Rounds of the components' stars between two such rounds; groups that are found in part there leave pairs to compare, but lose none.
STARS = 2
#: Shingles before one by which two texts tell that they have met before.
BEFORE = 8
#: Texts that are compared with one text by one task; rows of ids (24 bytes each) that may be broadcast.
A_PART, BROADCAST_ROWS = 256, 1_000_000


def hashed_shingles(text: str | None) -> np.ndarray:
    """Hashes of all shingles, in order; eight bytes each, the highest first."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, ">i8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(SHINGLE, len(words))
    cuts = zip((ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.frombuffer(b"".join(map(xxh64_digest, [joined[a:b] for a, b in cuts], repeat(SEED))), ">i8")


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(hashed_shingles(text).astype(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of distinct hashes by their lowest bits, in the least power of two of bits, 64 or more, that is no less than their number."""
    bits = 64 << max(0, (len(hashes) - 1 >> 6).bit_length())
    return np.packbits(np.bincount((hashes & (bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles, at least, that only one of the sets of two sketches has; the longer one is folded to the size of the other."""
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(folded ^ np.frombuffer(b, np.uint8)).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["row", "hashes"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that come again in the sample, and in how many texts they are by that."""
    texts = docs.select(F.lit(0).cast("long").alias("row"), "text")
    parts = max(1, docs.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).mapInArrow(_sets, "row bigint, hashes array<bigint>")
    counts = sample.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    pairs = sorted((r["h"], r["count"]) for r in counts)
    return np.array([h for h, _ in pairs], np.int64), parts * np.array([c for _, c in pairs], np.int64)


def _often(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the hashes found by a sorted list of common ones; 0 for others."""
    if not len(common):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return np.where(common[at] == found, counts[at], 0)


def _first(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of a set, so many of the rarest shingles that similar sets have one of them in common."""
    return found[np.lexsort((found, often))][: len(found) // 5 + 1]


def _prefixes(common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, prefixes, prints, sketches = [], [], [], [], []
            for text in batch.column("_text"):
                every = hashed_shingles(text.as_py())
                prints.append(simhash.majority(every.view(np.uint8).reshape(-1, 8)))
                found = np.unique(every.astype(np.int64))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                sketches.append(sketch(found))
                prefixes.append(_first(found, _often(found, common, counts)))
            kept = [c for c in batch.schema.names if c != "_text"]
            fps = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(fps), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, "digest", "size", "prefix", "fp", "sketch"])

    return run


def _refilled(common: np.ndarray, counts: np.ndarray):
    """Rows (row, text, heavy), heavy the text's shingles h that more than MANY texts have among their first n: row, size, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], []
            for text, heavy in zip(batch.column("text"), batch.column("heavy")):
                found = shingles(text.as_py())
                h, n = (heavy.values.field(k).to_numpy() for k in ("h", "n"))
                by_hash = np.argsort(h)
                # a fifth of a text's shingles are its first ones
                often = np.maximum(_often(found, common, counts), 5 * _often(found, h[by_hash], n[by_hash]))
                sizes.append(len(found))
                prefixes.append(_first(found, often))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["row", "size", "prefix"])

    return run


def _possible(a: str, b: str) -> str:
    """Whether sets that first share a shingle at these places can be similar enough."""
    return f"9 * least({a}.size - {a}.pos, {b}.size - {b}.pos) >= 4 * ({a}.size + {b}.size)"


def _few(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n, own, other), n the size of both sets, the pairs whose sketches allow a similarity of 0.8."""
    for batch in batches:
        held = [9 * least_difference(x, y) <= n for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "own", "other")))]
        yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, row, text) in order, those of one a and part together with that of a itself first: the similar (a, row)."""
    now, of_a = None, np.empty(0, np.int64)
    for batch in batches:
        found = []
        for a, part, row, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "row", "text"))):
            own = shingles(text)
            if (a, part) != now:
                if row != a:
                    raise ValueError("a text that others are compared with is missing")
                now, of_a = (a, part), own
            elif 9 * len(np.intersect1d(of_a, own, assume_unique=True)) >= 4 * (len(of_a) + len(own)):
                found.append((a, row))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _similar(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have a similarity of 0.8 or more.

    Most pairs end at their sketches (row, size, sketch).  The texts b come to a in parts of about A_PART, each with the text a; only texts that are asked for move.
    """
    own, other = (sketches.select(F.col("row").alias(c), F.col("size").alias(f"n_{c}"), F.col("sketch").alias(v)) for c, v in (("a", "own"), ("b", "other")))
    met = pairs.join(own, "a").join(other, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "own", "other")
    pairs = materialize(met.mapInArrow(_promising, "a bigint, b bigint"), "promising")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / A_PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    asked = materialize(dealt.select("a", "part", F.explode(F.array("a", "b")).alias("row")).distinct(), "asked")
    met = texts.join(_few(asked), "row").select("a", "part", "row", "text")
    ordered = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("row") != F.col("a"))
    found = materialize(ordered.mapInArrow(_compared, "a bigint, b bigint"), "similar")
    drop_scratch(asked)
    drop_scratch(pairs)
    return found


def proposed(sets: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of rows whose fingerprints the pigeonhole search links, and of rows with one fingerprint; sets has row, fp."""
    first = materialize(sets.groupBy("fp").agg(F.min("row").alias("first")), "distinct-prints")
    equal = sets.join(first, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = simhash.links(first.select("fp"), max_bits).distinct()
    named = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return materialize(equal.unionByName(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "proposed")


def refilled(sets: DataFrame, texts: DataFrame, tree: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """row, size and prefix of all sets, by an order in which shingles of more than MANY texts' prefixes, of several groups, come later."""
    roots = neighbours(tree).withColumnRenamed("node", "row")
    named = sets.select("row", "prefix").join(_few(materialize(roots, "roots")), "row", "left")
    firsts = named.select(F.coalesce("root", "row").alias("root"), F.explode("prefix").alias("h"))
    held = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    heavy = _few(materialize(held.where((F.col("n") > MANY) & (F.col("r0") < F.col("r1"))).select("h", "n"), "heavy"))
    having = sets.select("row", F.explode("prefix").alias("h")).join(heavy, "h", "left_semi")
    again = _few(materialize(having.select("row").distinct(), "again"))
    asked = texts.join(again, "row", "left_semi")
    every = asked.mapInArrow(_sets, "row bigint, hashes array<bigint>").select("row", F.explode("hashes").alias("h"))
    known = every.join(heavy, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("heavy"))
    new = asked.join(known, "row").select("row", "text", "heavy").mapInArrow(_refilled(common, counts), "row bigint, size bigint, prefix array<bigint>")
    return sets.select("row", "size", "prefix").join(again, "row", "left_anti").unionByName(new)


def _open(index: DataFrame) -> DataFrame:
    """The index less shingles whose texts are of one root, and less texts that can be similar to none under their shingle (see _possible)."""
    spare = F.expr("5 * size - 9 * pos")
    ends = index.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("size").alias("least"), F.max(spare).alias("spare")).where("r0 < r1")
    return index.join(ends, "h").where("5 * size - 9 * pos >= 4 * least AND 4 * size <= spare").select(*index.columns)


def _grouped(index: DataFrame, tree: DataFrame) -> DataFrame:
    """The index with the group of each text as far as known, less what can give no pair of different groups."""
    roots = neighbours(tree).withColumnRenamed("node", "row")
    named = index.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    first = materialize(_open(named), "open")
    found = materialize(_open(first), "grouped")
    drop_scratch(first)
    return found


def _meeting(index: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of texts of different groups that can be similar by an open index, most of them once.

    Where they have a shingle in common among the last BEFORE ones of both they have met before, and were possible there as they had more left.
    """
    last = Window.partitionBy("row").orderBy("pos").rowsBetween(-BEFORE, -1)
    placed = materialize(index.withColumn("last", F.collect_list("h").over(last)), "placed")
    met = placed.alias("o").join(placed.alias("m"), "h").where("o.row < m.row AND o.root <> m.root").where(_possible("o", "m")).where("NOT arrays_overlap(o.last, m.last)")
    return met.select(F.col("o.row").alias("a"), F.col("m.row").alias("b"))


def links(sets: DataFrame, texts: DataFrame, max_bits: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs; sets has row, size, prefix, fp, sketch, texts has row, text; prefixes are by common and counts."""
    sketches = materialize(sets.select("row", "size", "sketch"), "sketches")
    tried = proposed(sets.select("row", "fp"), max_bits)
    tree = contracted(_similar(tried, sketches, texts), STARS)
    # a shingle that two texts have leads on; one row holds a text's place and size in eight bytes
    rows = refilled(sets, texts, tree, common, counts).select("row", "size", F.posexplode("prefix").alias("pos", "h")).select("h", "row", F.expr("shiftleft(size, 32) | pos").alias("at"))
    met = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1")
    index = materialize(met.select("h", "row", F.expr("shiftright(at, 32)").alias("size"), F.expr("cast(at & 4294967295 as int)").alias("pos")), "index")
    enough, before = PAIRS_A_ROW * sketches.count(), []
    for k in range(ROUNDS + 1):
        # what is out stays out, as groups only grow
        now = _grouped(index, tree)
        drop_scratch(index)
        index = now.drop("root")
        by_root = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
        by_shingle = by_root.groupBy("h").agg(((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
        pairs_left = by_shingle.agg(F.sum("pairs").alias("pairs")).first()["pairs"] or 0
        # where both kinds of rounds leave most pairs, they are of different groups and others would, too
        if k == ROUNDS or pairs_left <= enough or (k > 1 and 2 * pairs_left > before[k - 2]):
            break
        before.append(pairs_left)
        text = F.struct("row", "size", "pos", "root")
        order = F.struct(F.lit(0) if k % 2 else F.col("pos"), F.xxhash64("row", F.lit(k)))
        one = now.groupBy("h").agg(F.min_by(text, order).alias("m"))
        met = now.select("h", text.alias("o")).join(one, "h").where("o.root <> m.root").where(_possible("o", "m"))
        pairs = met.select(F.col("m.row").alias("a"), F.col("o.row").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        then = contracted(tree.unionByName(_similar(pairs, sketches, texts)), STARS)
        drop_scratch(tree)
        tree = then
    pairs = _meeting(now).distinct()
    pairs = pairs.join(tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    return tree.unionByName(_similar(materialize(pairs, "pairs"), sketches, texts))


def drop_similar(docs: DataFrame, max_bits: int) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["text"].alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_text")
    sampled = common_shingles(docs)
    rows = materialize(held.mapInArrow(_prefixes(*sampled), f"{kept}, digest binary, size bigint, prefix array<bigint>, fp bigint, sketch binary"), "prefixes")
    order = F.struct(F.col("_doc.doc_id").isNull().alias("no_id"), F.col("_doc.doc_id").alias("id"), F.col("row").alias("row"))
    first = materialize(rows.groupBy("digest").agg(F.min(order).alias("first")).select("first", F.col("first.row").alias("row")), "distinct")
    sets = rows.select("row", "size", "prefix", "fp", "sketch").join(first.select("row"), "row", "left_semi")
    texts = rows.select("row", F.col("_doc.text").alias("text"))
    roots = components(links(sets, texts, max_bits, *sampled)).withColumnRenamed("node", "row")
    named = first.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = materialize(rows.select("row").join(chosen, "row", "left_anti"), "gone")
    return rows.join(_few(gone), "row", "left_anti").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
