"""Removal of repeated substrings by a depth-limited radix sort of suffixes.

Every string of DEPTH bytes that also starts in a document with a smaller id is to go, so
suffixes matter only through their first DEPTH bytes.  They are sorted digit by digit, most significant
first: groups that lie in one document are done, and at full depth equal groups are
exactly the repeated strings.

The first digit is chosen so that neighbours share it: the least of the hashed SEED-byte strings
inside the window (its minimizer).  Consecutive windows with one minimizer travel as one stretch of bytes,
compressed, to the bucket of that minimizer, where the further digits are sorted: the
minimizer itself, then eight bytes at a time.  Equal stretches within a map task are settled there: all
but those of the least id are repeats.  Minimizers of very many stretches are found in a first pass over
all texts: a task reports those seeds of which it has its share, by bytes, of the bound or more, so a seed with more than
twice the bound is always found, whatever the number of tasks, and one that is found has more than the bound.
Windows of such seeds travel one by one, to buckets by all their bytes, so no bucket holds
more of a seed than twice the bound and what one map task settles of one window.

Defined cases: a null text is empty; a null doc_id is neither smaller nor larger than any,
so its text stays and removes nothing; rows with equal ids don't remove from each other; repeated
rows get equal results; a very long text is cut into stretches like any other; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, release_shuffles

#: Bytes of the strings (the contract's threshold) and of the seeds inside them.
DEPTH, SEED = 50, 16
#: Bytes of text whose stretches are made together, and about so many bytes of stretches in a bucket.
TEXT_AT_ONCE, BUCKET_BYTES = 8_000_000, 12_000_000
#: Bytes of stretches for a byte of text (from 2 / (DEPTH - SEED + 2) stretches a byte).
EXPANSION = 3.7
#: Bytes of text for a stretch, at the least on average.
STRETCH_BYTES = 16
#: A seed is common if it is the minimizer of more than COMMON stretches and of more than one in COMMON_SEEDS of all stretches,
#: so that there are fewer than COMMON_SEEDS of them (8 bytes each), which are sent to every task.
COMMON, COMMON_SEEDS = 20_000, 4_000_000
#: Windows that a task sorts together.
WINDOWS_AT_ONCE = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _rolled(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-byte strings, by doubling."""
    whole, power = None, _BASE
    part, size, taken = data.astype(np.uint64) + np.uint64(1), 1, 0
    while True:
        if k & size:
            if whole is None:
                whole = part
            else:
                n = len(part) - taken
                whole = whole[:n] * np.uint64(power) + part[taken:]
            taken += size
        if taken == k:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(power) + part[size:]
        power = power * power % (1 << 64)
        size *= 2
    out = whole[: len(data) - k + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size, out = 1, values
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - w + 1
    return np.minimum(out[:n], out[w - size : w - size + n]) if size < w else out


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, one past the last, seed hash, and place of the seed, of runs of windows with one minimizer."""
    hashes = _rolled(data, SEED)
    placed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = _least(placed, DEPTH - SEED + 1)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    stop = np.r_[start[1:], len(least)]
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return start, stop, hashes[at], at


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents (doc_id, tag, bytes) of DEPTH bytes or more, some megabytes at a time, in order of doc_id."""
    held, size = [], 0
    for batch in batches:
        for doc_id, tag, text in zip(batch.column("doc_id"), batch.column("tag"), batch.column("text")):
            raw = (text.as_py() or "").encode()
            if len(raw) >= DEPTH:
                held.append((doc_id.as_py(), tag.as_py(), raw))
                size += len(raw)
            if size >= TEXT_AT_ONCE:
                yield sorted(held, key=lambda x: x[:2])
                held, size = [], 0
    if held:
        yield sorted(held, key=lambda x: x[:2])


def _frequent(bound: int, total: int):
    """Seeds, and their stretches in this task, if those are the task's share of the bound or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [np.empty(0, np.uint64)], 0
        for group in _grouped(batches):
            found += [stretches(np.frombuffer(raw, np.uint8))[2] for _, _, raw in group]
            size += sum(len(raw) for _, _, raw in group)
        seeds, counts = np.unique(np.concatenate(found), return_counts=True)
        often = counts * total > bound * size
        yield pa.RecordBatch.from_arrays([pa.array(seeds[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["seed", "n"])

    return run


def _packed(doc_ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, data: bytes) -> bytes:
    columns = [np.diff(doc_ids, prepend=np.int64(0)).astype("<i8"), tags.astype("<u4"), starts.astype("<u4"), sizes.astype("<u4"), offsets.astype("<u4")]
    planes = b"".join(np.frombuffer(c.tobytes(), np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(np.uint64(len(doc_ids)).tobytes() + planes + data)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw[:8], np.uint64)[0]), 8, []
    for kind in ("<i8", "<u4", "<u4", "<u4", "<u4"):
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.frombuffer(plane.T.tobytes(), kind).astype(np.int64))
        at += n * width
    out[0] = np.cumsum(out[0])
    return out, np.frombuffer(raw, np.uint8, offset=at)


def _sent(common: np.ndarray, n_buckets: int):
    """Rows (bucket, settled, blob): stretches for their buckets, and those that this task has settled as repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            docs, starts, sizes, routes, offsets = [], [], [], [], []
            for k, (_, _, raw) in enumerate(group):
                data = np.frombuffer(raw, np.uint8)
                start, stop, seed, at = stretches(data)
                offset, route = at - start, seed
                if len(common) and (hot := np.isin(seed, common)).any():
                    single = np.concatenate([np.arange(a, b) for a, b in zip(start[hot].tolist(), stop[hot].tolist())])
                    whole = _rolled(data, DEPTH)[single]
                    start, stop = np.r_[start[~hot], single], np.r_[stop[~hot], single + 1]
                    offset, route = np.r_[offset[~hot], np.zeros(len(single), np.int64)], np.r_[route[~hot], whole]
                docs.append(np.full(len(start), k))
                starts.append(start)
                sizes.append(stop - start + DEPTH - 1)
                routes.append(route)
                offsets.append(offset)
            doc, start, size, route, offset = map(np.concatenate, (docs, starts, sizes, routes, offsets))
            texts = [raw for _, _, raw in group]
            parts = [texts[d][a : a + n] for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist())]
            first: dict[bytes, int] = {}
            same = np.fromiter(map(first.setdefault, parts, range(len(parts))), np.int64, len(parts))
            del first
            ids, tags = np.array([i for i, _, _ in group], np.int64)[doc], np.array([t for _, t, _ in group], np.int64)[doc]
            settled = ids > ids[same]
            bucket = ((route * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % n_buckets
            rows: list[tuple[int, bool, bytes]] = []
            for done in (False, True):
                own = np.flatnonzero(settled == done)
                own = own[np.argsort(bucket[own], kind="stable")]
                edges = np.flatnonzero(np.r_[True, bucket[own][1:] != bucket[own][:-1]]) if len(own) else np.zeros(0, int)
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
                    at = own[a:b]
                    data = b"" if done else b"".join([parts[i] for i in at.tolist()])
                    rows.append((int(bucket[at[0]]), done, _packed(ids[at], tags[at], start[at], size[at], offset[at], data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "settled", "blob"])

    return run


def _digit(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The bytes from at on as a number, the first byte the most significant."""
    if width == 8 and len(at):
        return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def _order(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Puts members by group and, inside, equal digits together.

    Half of a mixed digit sorts with the group as one number; should that bring unlike digits together, the digits themselves sort.
    """
    mixed = (digit * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    keys = group.astype(np.uint64) << np.uint64(32) | mixed
    order = np.argsort(keys)
    keys, digit_there = keys[order], digit[order]
    if np.any((keys[1:] == keys[:-1]) & (digit_there[1:] != digit_there[:-1])):
        return np.lexsort((digit, group))
    return order


def _refined(group: np.ndarray | None, digit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: groups split by the digit; places of members, in sorted order, of groups in two or more documents, and their groups."""
    order = _order(group, digit) if group is not None else np.argsort(digit)
    group = group if group is not None else np.zeros(len(digit), np.int8)
    g, d, i = group[order], digit[order], ids[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    edges = np.flatnonzero(first)
    spread = (np.minimum.reduceat(i, edges) != np.maximum.reduceat(i, edges))[number] if len(g) else first
    return order[spread], number[spread]


def repeats(ids: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and first byte in it of every window that also lies in a document with a smaller id."""
    begin = np.cumsum(sizes) - sizes
    # the seed, a digit of the whole stretch; both its halves are mixed to sort once, and what that merges the later digits split
    halves = [_digit(data, begin + offsets + k, 8) for k in (0, 8)]
    at, group = _refined(None, (halves[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (halves[1] * np.uint64(0xC2B2AE3D27D4EB4F)), ids)
    windows = sizes[at] - DEPTH + 1
    found = []
    # whole groups together, some million windows at once; a group of more is taken by the seed's places in the window
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else np.zeros(0, int)
    upto, first = np.cumsum(windows), 0
    while first < len(at):
        done = upto[first - 1] if first else 0
        last = int(ends[max(np.searchsorted(upto[ends - 1], done + WINDOWS_AT_ONCE, "right") - 1, np.searchsorted(ends, first, "right"))])
        part, own, n = at[first:last], group[first:last], windows[first:last]
        if n.sum() <= WINDOWS_AT_ONCE:
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(_deep(np.repeat(part, n), inside, np.repeat(own, n), ids, offsets, begin, data))
        else:
            for place in range(int(offsets[part].min()) - int(n.max()) + 1, int(offsets[part].max()) + 1):
                inside = offsets[part] - place
                held = (inside >= 0) & (inside < n)
                found.append(_deep(part[held], inside[held], own[held], ids, offsets, begin, data))
        first = last
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([i for _, i in found])


def _deep(stretch: np.ndarray, inside: np.ndarray, group: np.ndarray, ids: np.ndarray, offsets: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in groups of one seed: those that also lie in a document with a smaller id."""
    # the seed's place in the window is a digit too: equal windows have it in common
    keep, group = _refined(group, (offsets[stretch] - inside).astype(np.uint64), ids[stretch])
    stretch, inside = stretch[keep], inside[keep]
    for k in range(0, DEPTH, 8):
        keep, group = _refined(group, _digit(data, begin[stretch] + inside + k, min(8, DEPTH - k)), ids[stretch])
        stretch, inside = stretch[keep], inside[keep]
    if not len(stretch):
        return stretch, inside
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(ids[stretch], edges), np.diff(np.r_[edges, len(group)]))
    later = ids[stretch] > least
    return stretch[later], inside[later]


def _runs(ids: np.ndarray, tags: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Removed bytes [start, stop) from first bytes of windows: touching windows of a document become one run."""
    order = np.lexsort((first, tags, ids))
    ids, tags, first = ids[order], tags[order], first[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (first[1:] > first[:-1] + DEPTH)] if len(ids) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    last = np.r_[edges[1:], len(ids)] - 1 if len(ids) else edges
    return [ids[edges], tags[edges], first[edges], first[last] + DEPTH]


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "tag", "start", "stop"])

    def finish(blobs: list[bytes]) -> pa.RecordBatch:
        columns, data = zip(*map(_unpacked, blobs))
        ids, tags, starts, sizes, offsets = (np.concatenate([c[k] for c in columns]) for k in range(5))
        stretch, inside = repeats(ids, sizes, offsets, np.concatenate(data))
        return batch_of(_runs(ids[stretch], tags[stretch], starts[stretch] + inside))

    held, now = [], None
    for batch in batches:
        for bucket, settled, blob in zip(batch.column("bucket").to_pylist(), batch.column("settled").to_pylist(), batch.column("blob").to_pylist()):
            if settled:
                (ids, tags, starts, sizes, _), _ = _unpacked(blob)
                yield batch_of([ids, tags, starts, starts + sizes])
                continue
            if bucket != now and held:
                yield finish(held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield finish(held)


def _removed_runs(docs: DataFrame, tag: Column) -> DataFrame:
    held = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(1, int(total * EXPANSION) // BUCKET_BYTES)
    bound = max(COMMON, int(total / STRETCH_BYTES / COMMON_SEEDS))
    often = held.mapInArrow(_frequent(bound, max(1, total)), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > bound).select("seed")
    found = often.toArrow().column("seed").to_numpy()  # fewer than COMMON_SEEDS
    common = np.sort(found.astype(np.int64).view(np.uint64))
    sent = held.mapInArrow(_sent(common, n_buckets), "bucket bigint, settled boolean, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_buckets, "doc_id bigint, tag bigint, start bigint, stop bigint")


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw, bytes removed, and maximal removed runs."""
    out, last, removed, spans = [], 0, 0, 0
    stop = -1
    for a, b in sorted(runs):
        if a > stop:  # a gap
            out.append(raw[max(last, 0) : a])
            spans += 1
            removed += b - a
            last = stop = b
        elif b > stop:
            removed += b - stop
            last = stop = b
    out.append(raw[last:])
    return b"".join(out), removed, spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
            raw = (text.as_py() or "").encode()
            kept, removed, spans = kept_bytes(raw, [(r["start"], r["stop"]) for r in runs or ()])
            rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # rows with one id and different texts are told apart by a tag; where ids are unique it is 0
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    tag = F.coalesce(F.crc32(F.coalesce("text", F.lit(""))), F.lit(0)).cast("long") if twice else F.lit(0).cast("long")
    runs = materialize(_removed_runs(docs, tag), "repeats")
    release_shuffles(docs.sparkSession)  # the stretches are done with
    by_doc = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("runs")).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "runs")
    held = docs.select("doc_id", "text", tag.alias("tag"))
    joined = held.join(by_doc, (held["doc_id"].cast("long") == F.col("_id")) & (held["tag"] == F.col("_tag")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
