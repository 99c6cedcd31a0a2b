"""Token ids in a content-addressed store.

A rolling hash over the ids of a document, with its end id, cuts them into chunks; a
chunk is named by its digest and stored once however many documents hold it.  A recipe
lists the chunks of a document; recipes lie in ascending order of doc_id with the number
of ids before them.  A manifest of hashes over blocks of recipes, level by level up to
one root, proves recipes and order; the digests prove the chunks.

The store is a folder with these Parquet tables (any file system that Spark writes to):

* ``chunks``: key (digest), n_ids, ids (little-endian unsigned integers of `width` bytes)
* ``recipes``: doc_id, place, start, n_tokens, keys (digests in order)
* ``manifest``: level, node, count, hash
* ``layout``: width, end_id

Defined cases: a null text is empty, so it holds the end id alone; a null doc_id comes
first; rows with equal ids follow each other in the order of their contents; repeated rows
get recipes of their own; a very long text is one row of its task and many chunks; an empty table
gives an empty store; further columns are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bytebpe import LONGEST, Merges, gathered, printed_bytes
from docloom.llm.common import materialize

#: The id after the last of each document.
END_ID = 2
#: Odd pieces and pre-tokens that a Python worker remembers with their ids; a table is emptied when it is full.
PIECES_KEPT, PRE_TOKENS_KEPT = 200_000, 250_000
#: Characters of text that are encoded together.
TEXT_AT_ONCE = 6_000_000
#: Pieces that are encoded as one text.
TOGETHER = 200
#: A chunk ends where the rolling hash of WINDOW ids has its BITS high bits clear, but has LEAST to MOST ids.
WINDOW, BITS, LEAST, MOST = 16, 8, 64, 1024
#: Digests that a task remembers so as not to send a chunk twice.
DIGESTS_KEPT = 200_000
#: Children of a node of the manifest.
FAN_OUT = 1024
#: Documents of a range of doc_id that is put in order by one task.
DOCS_A_RANGE = 20_000

#: Pieces of each call whose ids are held against the library's.
CHECKED = 64
_BASE = 0x9E3779B97F4A7C15 | 1
#: White space that follows white space (a superset of what tokenizers hold to be white space).
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TWO_SPACES = _SPACE + "{2}"
#: A line feed or none, letters of ranges that have nothing else in any version of Unicode, ASCII punctuation.
_SIMPLE = r"^(?P<fed>\n?)(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3f5}\x{3f7}-\x{3ff}\x{400}-\x{481}\x{48a}-\x{527}]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


def _is_plain(piece: str) -> bool:
    """Whether nothing but one blank at the start of a piece is white space at an end."""
    word = piece[1:] if piece[:1] == " " else piece
    return bool(word) and word.strip() == word


class Encoder:
    """Ids of whole texts from a byte-level file of the tokenizers library, by distinct pieces.

    Between two characters that are no white space, a blank always starts a pre-token and a line feed is one,
    so a text is cut before them and each distinct piece of some megabytes of text is looked at once.  Letters
    with punctuation behind them, as most pieces are, are one or two pre-tokens, whose ids come from
    :class:`Merges` for all of them together.  Other pieces are cut by the tokenizer's own pattern and merged
    by the tokenizer itself, and texts with longer runs of white space or with strings of added tokens are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from public_tokenizers import PATTERN
        from regex import compile as pattern
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of an added token are encoded whole, as the library makes it one id there
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole_texts = "|".join([_TWO_SPACES, *added])
        self.dtype = np.dtype(f"<u{width_of(path)}")
        self.pairs = Merges(path)
        self.line_feed = int(self.pairs.byte_ids[10])
        self.pre_tokens = pattern(PATTERN)
        # the same merges on pre-tokens that a tab separates, in the alphabet of bytes
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\t")
        self.alphabet = printed_bytes()
        self.mark_id = self.merges.encode(self.alphabet[9]).ids[0]
        # the bytes FF and FE are never in UTF-8: one stands for the tab between pre-tokens, one for the mark
        self.alphabet |= {0xFF: "\t", 0xFE: self.alphabet[9]}
        self.known: dict[str, bytes] = {}  # pre-tokens of the odd pieces
        self.pieces: dict[str, bytes] = {}  # odd pieces

    def forget(self) -> None:
        """Empty the tables that are full."""
        for table, most in ((self.known, PRE_TOKENS_KEPT), (self.pieces, PIECES_KEPT)):
            if len(table) > most:
                table.clear()

    def _merge(self, new: list[str]) -> None:
        """Learn pre-tokens, some hundred at a time, with a mark after each."""
        width = self.dtype.itemsize
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        texts = [b"\xff\xfe\xff".join([x.encode() for x in group]).decode("latin-1").translate(self.alphabet) for group in groups]
        for group, found in zip(groups, self.merges.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            ends = (np.flatnonzero(ids == self.mark_id) * width).tolist()
            if len(ends) != len(group) - 1:
                raise ValueError("pre-tokens can't be told apart")
            whole, last = ids.tobytes(), 0
            for x, end in zip(group, [*ends, len(whole)]):
                self.known[x] = whole[last:end]
                last = end + width

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of odd pieces, which start with their blank if they have one."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        # between pieces, a tab is a pre-token of its own
        plain = [p for p in new if "\t" not in p and _is_plain(p)]
        cut = self.pre_tokens.findall("\t".join(plain))
        tab = np.array([self.mark_id], self.dtype).tobytes()
        self.known["\t"] = tab
        self._merge([x for x in dict.fromkeys(cut) if x not in self.known])
        whole, last, width = b"".join(map(self.known.__getitem__, cut)), 0, self.dtype.itemsize
        ends = (np.flatnonzero(np.frombuffer(whole, self.dtype) == self.mark_id) * width).tolist()
        if plain and len(ends) != len(plain) - 1:
            raise ValueError("pieces can't be told apart")
        for piece, end in zip(plain, [*ends, len(whole)]):
            self.pieces[piece] = whole[last:end]
            last = end + width
        for piece in new:
            if piece not in self.pieces:
                self.pieces[piece] = self.whole(piece)
        return [self.pieces[p] for p in pieces]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id."""
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // TEXT_AT_ONCE
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(texts) else np.zeros(0, int)
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)]):
            yield from self._encode(pc.fill_null(texts.slice(start, stop - start), ""))

    def _merged(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of strings that are one pre-token each: their codes among the distinct ones, whose ids and numbers of ids follow."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary
        offsets, buffer = distinct.buffers()[1:]
        ends = np.frombuffer(offsets, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        ids, counts = self.pairs.encode(data, ends[:-1], np.diff(ends))
        return coded.indices.to_numpy().astype(np.int64), ids, counts

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, given without their blank or with their line feed: the pool of ids, and where those of each piece lie."""
        parts = pc.extract_regex(words, _SIMPLE)
        simple = pc.and_(pc.is_valid(parts), pc.less_equal(pc.binary_length(words), LONGEST - 1))
        fed, letters, marks = (pc.if_else(simple, pc.struct_field(parts, k), "") for k in range(3))
        is_fed = pc.equal(pc.binary_length(fed), 1)
        alone = pc.equal(pc.binary_length(letters), 0)
        # the blank goes with the letters, or with the marks where there are none
        lead = pc.if_else(pc.or_(is_fed, pc.invert(simple)), "", " ")
        a = self._merged(pc.binary_join_element_wise(lead, pc.if_else(alone, marks, letters), ""))
        b = self._merged(pc.if_else(alone, "", marks))
        odd = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        odd_words = words.take(pa.array(odd)).to_pylist()
        odd_fed = np.array([w[:1] == "\n" for w in odd_words], bool)
        odd_ids = self.learn([w[1:] if f else " " + w for w, f in zip(odd_words, odd_fed.tolist())])
        odd_sizes = np.fromiter(map(len, odd_ids), np.int64, len(odd_ids)) // self.dtype.itemsize
        # three parts of each piece: a line feed, and one or two pre-tokens or the ids of an odd piece
        pool = np.concatenate([[self.line_feed], a[1], b[1], np.frombuffer(b"".join(odd_ids), self.dtype)]).astype(self.dtype)
        starts, sizes = np.zeros((len(words), 3), np.int64), np.zeros((len(words), 3), np.int64)
        sizes[:, 0] = is_fed.to_numpy(zero_copy_only=False)
        base = 1
        for k, (codes, ids, counts) in enumerate((a, b), 1):
            starts[:, k], sizes[:, k] = (base + np.cumsum(counts) - counts)[codes], counts[codes]
            base += len(ids)
        sizes[odd, 0], sizes[odd, 1], sizes[odd, 2] = odd_fed, odd_sizes, 0
        starts[odd, 1] = base + np.cumsum(odd_sizes) - odd_sizes
        own = sizes.sum(1)
        ids, begins = gathered(pool, starts.ravel(), sizes.ravel()), np.cumsum(own) - own
        # the library has the last word: some pieces of every call are held against it
        for k, word in enumerate(words.slice(0, CHECKED).to_pylist()):
            if ids[begins[k] : begins[k] + own[k]].astype(self.dtype).tobytes() != self.whole(word if word[:1] == "\n" else " " + word):
                raise ValueError(f"ids of {word!r} differ from the library's")
        return ids, begins, own

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self.forget()
        spaced = pc.match_substring_regex(texts, self.whole_texts)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(spaced, "", texts), "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # the first piece of a text has no blank
        first = offsets[:-1]
        heads = coded.dictionary.take(pa.array(codes[first])).to_pylist()
        wholes = texts.filter(spaced).to_pylist()
        head_ids = self.learn(heads)
        for k, text in zip(np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist(), wholes):
            head_ids[k] = self.whole(text)
        pool, starts, sizes = self._distinct(coded.dictionary)
        head_sizes = np.fromiter(map(len, head_ids), np.int64, len(head_ids)) // self.dtype.itemsize
        begins, own = starts[codes], sizes[codes]
        begins[first], own[first] = len(pool) + np.cumsum(head_sizes) - head_sizes, head_sizes
        ids = gathered(np.concatenate([pool, np.frombuffer(b"".join(head_ids), self.dtype)]), begins, own)
        ends = np.cumsum(own)[offsets[1:] - 1].tolist()
        last = 0
        for end in ends:
            yield ids[last:end]
            last = end


class Chunker:
    """Ends of content-defined chunks."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64))])

    def ends(self, ids: np.ndarray) -> list[int]:
        n = len(ids)
        if n <= LEAST:
            return [n]
        self._grow(n)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.cumsum(mixed * self.inverse[:n])
        rolled = sums.copy()
        rolled[WINDOW:] -= sums[:-WINDOW]
        rolled *= self.powers[:n]
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0x94D049BB133111EB)
        marks = (np.flatnonzero(rolled[WINDOW - 1 :] >> np.uint64(64 - BITS) == 0) + WINDOW).tolist()
        found, last = [], 0
        for mark in [*marks, n]:
            while mark - last > MOST:
                last += MOST
                found.append(last)
            if mark - last >= LEAST or mark == n and mark > last:
                last = mark
                found.append(mark)
        return found


_ENCODERS: dict[str, Encoder] = {}


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def _encoded(path: str, end_id: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        chunker, sent, tail = Chunker(), set(), np.array([end_id], encoder.dtype)
        width = encoder.dtype.itemsize
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, ids in zip(ids_of, encoder.encode(batch.column(1))):
                ids = np.concatenate([ids, tail])
                raw, keys, last = ids.tobytes(), [], 0
                for end in chunker.ends(ids):
                    chunk = raw[last * width : end * width]
                    key = digest(chunk)
                    keys.append(key)
                    if key not in sent:
                        sent.add(key)
                        rows.append((1, key, None, end - last, None, chunk))
                    last = end
                rows.append((0, digest(b"".join(keys)), doc_id, last, keys, None))
                if len(sent) > DIGESTS_KEPT:
                    sent.clear()
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write the store to the folder path."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    held = docs.select("doc_id", "text")
    kind = held.schema["doc_id"].dataType
    out = pa.schema([("kind", pa.int8()), ("key", pa.binary()), ("doc_id", to_arrow_type(kind)), ("n_ids", pa.int64()), ("keys", pa.list_(pa.binary())), ("ids", pa.binary())])
    rows = held.mapInArrow(_encoded(tokenizer, end_id, out), f"kind tinyint, key binary, doc_id {kind.simpleString()}, n_ids bigint, keys array<binary>, ids binary")
    # recipes are apart by their rows, so equal documents don't meet; a chunk comes once from each task at most
    rows = rows.withColumn("apart", F.when(F.col("kind") == 0, F.monotonically_increasing_id()))
    once = Window.partitionBy("key", "apart").orderBy("n_ids")
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth", "apart")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/staged")
    whole = f"key binary, doc_id {kind.simpleString()}, n_ids bigint, keys array<binary>, ids binary"
    _move(spark, f"{path}/staged/kind=1", f"{path}/chunks")
    staged = spark.read.schema(whole).parquet(f"{path}/staged/kind=0") if _exists(spark, f"{path}/staged/kind=0") else spark.createDataFrame([], whole)
    n = max(1, -(-staged.count() // DOCS_A_RANGE))
    ranged = materialize(
        staged.select("doc_id", "key", F.col("n_ids").alias("n_tokens"), "keys").repartitionByRange(n, "doc_id", "key").withColumn("part", F.spark_partition_id()), "recipes"
    )
    parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "key")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    recipes = (
        ranged.withColumn("ids_here", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, "part")
        .select("doc_id", (F.col("docs_before") + F.col("nth")).alias("place"), (F.col("ids_before") + F.col("ids_here")).alias("start"), "n_tokens", "keys", "part")
    )
    recipes.repartitionByRange(n, "place").sortWithinPartitions("place").drop("part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _write_manifest(spark, path)
    spark.createDataFrame([(width_of(tokenizer), end_id)], "width long, end_id long").coalesce(1).write.parquet(f"{path}/layout")
    _delete(spark, f"{path}/staged")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, source: str, to: str) -> None:
    if _exists(spark, source):
        fs, at = _fs(spark, source)
        fs.rename(at, _fs(spark, to)[1])


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def width_of(tokenizer: str) -> int:
    """Bytes of an id in the store."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def layout_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes of an id, and the end id."""
    row = spark.read.parquet(f"{path}/layout").first()
    return row["width"], row["end_id"]


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    schema = "key binary, n_ids bigint, ids binary"
    return spark.read.schema(schema).parquet(f"{path}/chunks") if _exists(spark, f"{path}/chunks") else spark.createDataFrame([], schema)


def _leaves(recipes: DataFrame) -> DataFrame:
    keys = F.array_join(F.transform("keys", F.hex), ",")
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string"), F.col("n_tokens").cast("string"), keys), 256)
    return recipes.select(F.col("place").alias("node"), leaf.alias("hash"), F.lit(1).cast("long").alias("count"))


def _levels(recipes: DataFrame) -> list[DataFrame]:
    """Nodes of the manifest above the recipes: level 1 holds the hash of up to FAN_OUT recipes, the last level is one root."""
    out, below, level = [], _leaves(recipes), 0
    while True:
        level += 1
        up = below.groupBy(F.floor(F.col("node") / FAN_OUT).alias("parent")).agg(F.sum("count").alias("count"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("children"))
        nodes = up.select(F.lit(level).alias("level"), F.col("parent").alias("node"), "count", F.sha2(F.array_join(F.transform("children", lambda x: x["hash"]), ""), 256).alias("hash"))
        nodes = materialize(nodes, "manifest")
        out.append(nodes)
        if nodes.limit(2).count() <= 1:
            return out
        below = nodes


def _write_manifest(spark: SparkSession, path: str) -> None:
    levels = _levels(recipes_of(spark, path))
    whole = levels[0]
    for nodes in levels[1:]:
        whole = whole.unionByName(nodes)
    whole.write.parquet(f"{path}/manifest")


def check_manifest(spark: SparkSession, path: str) -> str | None:
    """The root, computed anew from the recipes; an error if any node of the manifest differs."""
    written = spark.read.parquet(f"{path}/manifest").select("level", "node", "count", "hash")
    anew = _levels(recipes_of(spark, path))
    whole = anew[0]
    for nodes in anew[1:]:
        whole = whole.unionByName(nodes)
    whole = whole.select("level", "node", "count", "hash")
    if whole.exceptAll(written).limit(1).count() or written.exceptAll(whole).limit(1).count():
        raise ValueError(f"the manifest of {path} does not match its recipes")
    root = anew[-1].first()
    return root["hash"] if root else None


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for key, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if digest(ids) != key or len(ids) != n * width:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                crcs.append(zlib.crc32(ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["key", "n_ids", "crc"])

    return run


#: The reversed polynomial of CRC-32 (a fixed value of that code).
_POLYNOMIAL = np.uint32(0xEDB88320)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, bits reversed."""
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 n_bytes."""
    if n_bytes not in _SHIFTS:
        out, power, n = np.array([1 << 31], np.uint32), np.array([1 << 30], np.uint32), 8 * n_bytes
        while n:
            if n & 1:
                out = _multiply(power, out)
            power = _multiply(power, power)
            n >>= 1
        _SHIFTS[n_bytes] = int(out[0])
    return _SHIFTS[n_bytes]


def join_crcs(crcs: list[list[int]], sizes: list[list[int]]) -> np.ndarray:
    """The CRC-32 of each list of consecutive parts from the parts' own, and their sizes in bytes."""
    out = np.zeros(len(crcs), np.uint32)
    for k in range(max(map(len, crcs), default=0)):
        at = np.array([i for i, c in enumerate(crcs) if len(c) > k])
        shift = np.array([_shift(sizes[i][k]) for i in at], np.uint32)
        out[at] = _multiply(shift, out[at]) ^ np.array([crcs[i][k] for i in at], np.uint32)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [sorted((p["nth"], p["crc"], p["n_ids"]) for p in row) for row in batch.column("parts").to_pylist()]
        crcs = join_crcs([[c for _, c, _ in row] for row in parts], [[4 * n for _, _, n in row] for row in parts])
        total = [sum(n for _, _, n in row) for row in parts]
        if total != batch.column("n_tokens").to_pylist():
            raise ValueError("chunks are missing")
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document.

    Every chunk is read once, checked against its digest and given a CRC; those of a document's
    chunks are joined in the order of its recipe, so ids need not be sent once a document.
    """
    recipes = recipes_of(spark, path)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    chunks = chunks_of(spark, path).mapInArrow(_checked(layout_of(spark, path)[0]), "key binary, n_ids bigint, crc bigint")
    refs = recipes.select("place", F.posexplode("keys").alias("nth", "key")).join(chunks, "key", "left")
    parts = refs.groupBy("place").agg(F.collect_list(F.struct("nth", "crc", "n_ids")).alias("parts"))
    rows = recipes.select("place", "doc_id", "start", "n_tokens").join(parts, "place").drop("place")
    return rows.mapInArrow(_joined, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, place, start, n_tokens and the ids themselves, as bytes of the store's width."""
    recipes = recipes_of(spark, path)
    refs = recipes.select("place", F.posexplode("keys").alias("nth", "key")).join(chunks_of(spark, path), "key", "left")
    parts = refs.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("nth", "ids"))).alias("parts"))
    ids = F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))")
    return recipes.select("doc_id", "place", "start", "n_tokens").join(parts.select("place", ids.alias("ids")), "place")
