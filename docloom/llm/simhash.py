"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word
shingles.  To find all distinct fingerprints that differ in at most MAX_BITS bits, the bits
are dealt into groups of correlated bits and each group gets a threshold of its own.
If the thresholds t plus one sum to more than MAX_BITS, any two such fingerprints differ in
at most t bits in some group; a threshold of -1 leaves its group out.  A dynamic program chooses
the thresholds that give the fewest probes and candidates; the candidates are estimated from
counts over all fingerprints.  Each fingerprint is stored under its own bits of a group and
probes all bits within the threshold; those that meet are compared in full.

Only links that join something new leave a task, so a large group of near copies gives about
as many rows as members; a very full bucket is dealt in tiles of bounded size, all of which
are compared.  Connected components of the links are the groups.

Defined cases: a null or wordless text has the fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; equal texts have equal
fingerprints, which are searched once; a null doc_id never names a group unless all its
ids are null; an empty table gives no rows; further columns are kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize
from docloom.llm.components import components

#: Words of a shingle, seed of XXH64, and the bits in which linked fingerprints may differ (the contract's values).
SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Stored fingerprints, and probes, of one tile of a bucket.
TILE = 2048
#: Cost of comparing one candidate, in rows sent.
CANDIDATE_COST = 0.01
#: Numbers of groups that are weighed against each other.
GROUPS = (2, 3, 4, 5)
#: Pairs up to so many rows apart are compared by shifting; fuller buckets by blocks.
SHIFTS = 32


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    cuts = zip((ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return majority(np.frombuffer(b"".join(map(xxh64_digest, [joined[a:b] for a, b in cuts], repeat(seed))), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half the hashes, which are rows of eight bytes."""
    counts = sum((np.unpackbits(hashes[i : i + 65_536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(hashes), 65_536)), np.zeros(64, np.int64))
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(t.as_py(), shingle, seed) for t in batch.column("_text"))
            values = pa.array(np.frombuffer(found, ">i8").astype(np.int64), pa.int64())
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], names=[*kept, "fp"])

    return run


def fingerprints(docs: DataFrame, columns: list[Column], shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """columns (with names of their own) and fp, the fingerprint as a long."""
    held = docs.select(*columns, docs["text"].alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_text")
    return held.mapInArrow(_fingerprints(shingle, seed), f"{kept}, fp bigint")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((64, 64))
    n = 0
    for batch in batches:
        fps = batch.column(0).to_numpy().astype(">i8")
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        both += bits.T @ bits
        n += len(bits)
    i, j = np.divmod(np.arange(64 * 64), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(64 * 64, n, np.int64))], names=["i", "j", "both", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how many have both of two bits set (bit 0 is the highest)."""
    rows = fps.select("fp").mapInArrow(_bit_counts, "i int, j int, both bigint, n bigint").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    for r in rows:
        both[r["i"], r["j"]] = r["both"]
    return (int(rows[0]["n"]) if rows else 0), both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of about one size; bits that are correlated come together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        size = len(free) // (m - g)
        order = sorted(free)
        seed = max(order, key=lambda b: (related[b, order].max(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (related[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def within(flips: np.ndarray) -> np.ndarray:
    """Chances that two fingerprints differ in 0, 1, ... bits of a group, from the chance of each bit."""
    out = np.ones(1)
    for q in flips:
        out = np.convolve(out, [1 - q, q])
    return out


def _ball(size: int, t: int) -> int:
    return sum(math.comb(size, k) for k in range(t + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that sum to total at the least cost; costs[i][t + 1] is that of t in group i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, c in enumerate(own):
                key = spent + k
                if key not in step or cost + c < step[key][0]:
                    step[key] = (cost + c, [*chosen, k - 1])
        best = step
    return best[total + len(costs)]


def _costs(n: int, groups: list[list[int]], both: np.ndarray, max_bits: int, met: list[float] | None = None) -> list[list[float]]:
    p = np.diag(both) / max(n, 1)
    out = []
    for i, group in enumerate(groups):
        chances = within(2 * p[group] * (1 - p[group]))
        pairs = n * (n - 1) / 2 * np.cumsum(chances)
        if met is not None:  # pairs that share all bits of the group are known; more distant ones are in proportion
            pairs = np.maximum(pairs, met[i] * pairs / max(pairs[0], 1e-9))
            pairs = np.minimum(pairs, n * (n - 1) / 2)
        out.append([0.0, *[max(n, 1) * _ball(len(group), t) + CANDIDATE_COST * float(pairs[t]) for t in range(max_bits + 1)]])
    return out


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    value = sum(1 << (63 - b) for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def search_plan(fps: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, from counts over all fingerprints."""
    n, both = bit_statistics(fps)
    choices = {}
    for m in GROUPS:
        groups = correlated_groups(n, both, m)
        choices[m] = (allocate(_costs(n, groups, both, max_bits), max_bits - m + 1)[0], groups)
    groups = min(choices.values(), key=lambda c: c[0])[1]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("k")) for i, g in enumerate(groups)])).alias("x"))
    met = {r["g"]: r["met"] for r in keyed.groupBy("x.g", "x.k").count().groupBy("g").agg((F.sum((F.col("count") * (F.col("count") - 1)).cast("double")) / 2).alias("met")).collect()}
    thresholds = allocate(_costs(n, groups, both, max_bits, [met.get(i, 0.0) for i in range(len(groups))]), max_bits - len(groups) + 1)[1]
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


class _Forest:
    """Which fingerprints are joined so far; add() tells whether a link joins something new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = z = up.get(y, y)
            x = z
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _new_links(forest: _Forest, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.add(x, y)]


def _compare(bucket: np.ndarray, fp: np.ndarray, stored: np.ndarray, probe: np.ndarray, max_bits: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links between stored and probing rows of one bucket; rows are sorted by bucket, buckets are whole."""
    found: list[tuple[int, int]] = []
    fp = fp.astype(np.int64)
    raw = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    for start, size in zip(starts[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist()):
        part = slice(start, start + size)
        left, right = np.flatnonzero(stored[part]) + start, np.flatnonzero(probe[part]) + start
        for k in range(0, len(left), 256):
            near = np.bitwise_count(raw[left[k : k + 256], None] ^ raw[None, right]) <= max_bits
            i, j = np.nonzero(near)
            found += _new_links(forest, fp[left[k + i]], fp[right[j]])
    at = np.flatnonzero(np.repeat(sizes <= SHIFTS, sizes))
    last = np.repeat(starts + sizes, sizes)
    shift = 1
    while len(at := at[at + shift < last[at]]):
        other = at + shift
        met = (stored[at] & probe[other]) | (probe[at] & stored[other])
        i, j = at[met], other[met]
        near = np.bitwise_count(raw[i] ^ raw[j]) <= max_bits
        found += _new_links(forest, fp[i[near]], fp[j[near]])
        shift += 1
    return found


def _linked(max_bits: int):
    def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "k", "ta", "tb", "fp", "stored", "probe")}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            keys = [rows[c] for c in ("g", "k", "ta", "tb")]
            if not len(keys[0]):
                continue
            change = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
            bucket = np.r_[0, np.cumsum(change)]
            whole = int(np.searchsorted(bucket, bucket[-1]))
            held = {c: rows[c][whole:] for c in rows}
            if whole:
                found = _compare(bucket[:whole], *[rows[c][:whole] for c in ("fp", "stored", "probe")], max_bits, forest)
                if len(forest.up) > 2_000_000:
                    forest = _Forest()
                yield emit(found)
        if held is not None and len(held["fp"]):
            yield emit(_compare(np.zeros(len(held["fp"]), np.int64), held["fp"], held["stored"], held["probe"], max_bits, forest))

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within max_bits."""
    spots = []
    for i, (group, t) in enumerate(search_plan(fps, max_bits)):
        for k in range(t + 1):
            for flipped in combinations(group, k):
                key = F.col("fp").bitwiseAND(F.lit(_mask(group))).bitwiseXOR(F.lit(_mask(flipped)))
                spots.append(F.struct(F.lit(i).cast("tinyint").alias("g"), key.alias("k"), F.lit(k == 0).alias("own")))
    rows = materialize(fps.select("fp", F.inline(F.array(*spots))), "probes")
    # very full buckets are dealt in tiles: stored rows by ta, probes by tb, every tile with every other
    fill = rows.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("own"), 1)).alias("n_own"))
    useful = fill.where("n > 1 AND n_own > 0").select("g", "k", F.ceil(F.col("n_own") / TILE).cast("int").alias("na"), F.ceil(F.col("n") / TILE).cast("int").alias("nb"))
    met = rows.join(useful, ["g", "k"])
    a, b = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("na")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("nb")).cast("int")
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    as_stored = F.expr("transform(sequence(0, nb - 1), x -> named_struct('ta', a, 'tb', x, 'stored', true, 'probe', x = b))")
    as_probe = F.expr("transform(filter(sequence(0, na - 1), x -> NOT (own AND x = a)), x -> named_struct('ta', x, 'tb', b, 'stored', false, 'probe', true))")
    alone = F.array(F.struct(F.lit(0).alias("ta"), F.lit(0).alias("tb"), F.col("own").alias("stored"), F.lit(True).alias("probe")))
    dealt = (
        met.withColumn("a", a).withColumn("b", b)
        .select("g", "k", "fp", F.inline(F.when(one, alone).when(F.col("own"), F.concat(as_stored, as_probe)).otherwise(as_probe)))
    )
    ready = dealt.repartition("g", "k", "ta", "tb").sortWithinPartitions("g", "k", "ta", "tb")
    return ready.mapInArrow(_linked(max_bits), "a bigint, b bigint")


def groups_of(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From distinct fingerprints (fp, ...): the same with root, the smallest fingerprint of its group."""
    joined = components(links(fps, max_bits))
    return fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the group) of each row."""
    rows = materialize(fingerprints(docs, [docs["doc_id"]], shingle, seed), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = groups_of(fps, max_bits)
    named = materialize(named, "groups")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Here near copies are texts whose sets of five-word shingles have a similarity of 0.8 or more: the search's links
    within max_bits are verified, and what fingerprints can't find comes from an index of shingles (:mod:`docloom.llm.similar`).
    """
    from docloom.llm.similar import drop_similar

    return drop_similar(docs, max_bits)
