"""WARC archives written from and read to a table of chunks.

A record's payload is never held whole outside of the row that it comes from: rows become chunk rows (record, chunk number,
bytes) of bounded size, which are one table in the shared folder.  A task that makes them carries a SHA-1 and a length from
chunk to chunk and puts both on the last one, so digests are known before headers are written.  Records with equal payloads are
found by digest and length; a record's header row and its chunks then meet by one exchange, and every task
streams its records, chunk by chunk, into one archive: each record a gzip member, or plain.  Readers stream the archives
back to the same chunk rows, with their own digests, and compare them with the headers.

An archive is written under a name of its own attempt and counts only once the table of archives lists it, which Spark
commits as a whole, so lost executors and repeated tasks leave nothing that is read.  Archives go through pyarrow's file systems, so the path
may be any that those open and that all executors share.

Payloads of a third of all rows may be one: firsts of the most frequent digests, fewer than HEAVY by construction, are broadcast; the others
are joined by digest.

Defined cases: a null payload is empty; empty payloads are equal to each other (unless min_bytes is over 0); a null page_id has no
header and comes last when the response is chosen; of equal rows one is the response and the others revisit it; a null url
has no header, and controls, blanks and percent signs of a url are percent-encoded in it; a very long payload is as many chunk rows as it
needs; an empty table gives no archives and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import drop_scratch, materialize

#: Bytes of a chunk, and of what is read from an archive at once.
CHUNK_BYTES = 1 << 20
#: Payloads of fewer bytes are always written whole.
MIN_BYTES = 0
#: Digests of over one in so many rows are sent to all tasks.
HEAVY = 1_000
#: Bytes of payload that one archive should hold; the number of archives follows the table.
ARCHIVE_BYTES = 256 << 20
#: Date of records unless another is given: the archives of equal tables are equal.
DATE = "1970-01-01T00:00:00Z"

_LINE = b"\r\n"
_CHUNK = "record bigint, page_id {kind}, url string, chunk_no int, last boolean, chunk binary, payload_bytes bigint, payload_digest string"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(sha1: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(sha1).decode("ascii")


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows with length and digest of the whole payload on each last chunk; a record's chunks are neighbours."""
    state, size = None, 0
    for batch in batches:
        sizes, digests = [], []
        for chunk, number, last in zip(batch.column("chunk"), batch.column("chunk_no").to_pylist(), batch.column("last").to_pylist()):
            if number == 0:
                state, size = hashlib.sha1(), 0
            state.update(chunk.as_buffer())
            size += len(chunk.as_buffer())
            sizes.append(size if last else None)
            digests.append(digest_text(state.digest()) if last else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "payload_bytes", "payload_digest"])


def chunk_table(pages: DataFrame, payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """record, page_id, url, chunk_no, last, chunk, payload_bytes, payload_digest; written."""
    kind = pages.schema["page_id"].dataType.simpleString()
    whole = pages.select(
        F.monotonically_increasing_id().alias("record"), "page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col(payload).cast("string"), "utf-8"), F.lit(b"")).alias("_b")
    )
    last = F.greatest(F.expr(f"cast((octet_length(_b) - 1) div {chunk_bytes} as int)"), F.lit(0))
    cut = whole.withColumn("_last", last).select("record", "page_id", "url", "_b", "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("chunk_no"))
    rows = cut.select("record", "page_id", "url", "chunk_no", (F.col("chunk_no") == F.col("_last")).alias("last"), F.expr(f"substring(_b, chunk_no * {chunk_bytes} + 1, {chunk_bytes})").alias("chunk"))
    return materialize(rows.mapInArrow(_carried, _CHUNK.format(kind=kind)), "warc-chunks")


def record_types(digests: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """record, page_id, url, payload_bytes, payload_digest, response (null or the struct of the record that is revisited)."""
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("record"), F.col("url"))
    able = digests.where(F.col("payload_bytes") >= min_bytes)
    groups = able.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    groups = materialize(groups, "warc-groups")
    heavy = groups.where(F.col("n") > F.lit(max(1, digests.count() // HEAVY))).drop("n")  # fewer than HEAVY rows
    key = ["payload_digest", "payload_bytes"]
    hot = digests.join(F.broadcast(heavy), key)
    rest = digests.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(groups.drop("n"), key, "left")
    response = F.when(F.col("first.record") != F.col("record"), F.col("first"))
    return hot.unionByName(rest).select("record", "page_id", "url", *key, response.alias("response"))


def record_id(page_id, record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{record}')}>"


def _uri(url: str) -> bytes:
    return re.sub(r"[\x00-\x20%\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url).encode()


def _head(row: dict, date: str) -> tuple[bytes, bytes]:
    """The record's header and that of the HTTP response within it."""
    revisits = row["response"]
    http = _LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % row["payload_bytes"], b"", b""])
    length = len(http) + (0 if revisits else row["payload_bytes"])
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisits else b"response"), b"WARC-Record-ID: " + record_id(row["page_id"], row["record"]).encode(), b"WARC-Date: " + date.encode()]
    if row["url"] is not None:
        lines.append(b"WARC-Target-URI: " + _uri(row["url"]))
    lines.append(b"WARC-Payload-Digest: sha1:" + row["payload_digest"].encode())
    if row["page_id"] is not None:
        lines.append(b"X-Page-ID: %s" % str(row["page_id"]).encode())
    if revisits:
        lines += [b"WARC-Profile: " + _SAME.encode(), b"WARC-Refers-To: " + record_id(revisits["page_id"], revisits["record"]).encode(), b"WARC-Refers-To-Date: " + date.encode()]
        if revisits["url"] is not None:
            lines.append(b"WARC-Refers-To-Target-URI: " + _uri(revisits["url"]))
        if revisits["page_id"] is not None:
            lines.append(b"X-Refers-To-Page-ID: %s" % str(revisits["page_id"]).encode())
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % length, b"", b""]
    return _LINE.join(lines), http


class _Sink:
    """One archive: records as members of a gzip file, or plain."""

    def __init__(self, path: str, level: int) -> None:
        system, place = pafs.FileSystem.from_uri(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._out, self._level, self._member = system.open_output_stream(place, compression=None), level, None
        self.path, self.records, self.size = path, 0, 0

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def begin(self) -> None:
        self._member = zlib.compressobj(self._level, zlib.DEFLATED, 31) if self._level else None

    def write(self, data) -> None:
        self._put(self._member.compress(data) if self._member else data)

    def end(self) -> None:
        self.write(_LINE + _LINE)
        if self._member:
            self._put(self._member.flush())
        self.records += 1

    def close(self) -> None:
        self._out.close()


def _written(path: str, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, revisits = None, False
        for batch in batches:
            heads = batch.select([n for n in batch.schema.names if n != "chunk"]).to_pylist()
            for row, chunk in zip(heads, batch.column("chunk")):
                if sink is None:
                    sink = _Sink(f"{path}/{uuid.uuid4().hex}.warc" + (".gz" if level else ""), level)
                if row["chunk_no"] < 0:
                    revisits = row["response"] is not None
                    sink.begin()
                    for part in _head(row, date):
                        sink.write(part)
                    continue
                if not revisits:
                    sink.write(chunk.as_buffer())
                if row["last"]:
                    sink.end()
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.path]), pa.array([sink.records], pa.int64()), pa.array([sink.size], pa.int64())], ["archive", "records", "bytes"])

    return run


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark sees it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", whole)


def write_archives(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = MIN_BYTES, level: int = 3, date: str = DATE, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archives of all rows (page_id, url and the payload's column) under path/data, and their table under path/archives; level 0 writes no gzip."""
    spark = pages.sparkSession
    chunks = chunk_table(pages, payload, chunk_bytes)
    digests = chunks.where("last").select("record", "page_id", "url", "payload_bytes", "payload_digest")
    size = digests.agg(F.sum("payload_bytes")).first()[0] or 0
    n = max(int(size // ARCHIVE_BYTES) + 1, spark.sparkContext.defaultParallelism)
    # a record's header is a row before its chunks, so payloads move once and are joined to nothing
    heads = record_types(digests, min_bytes).withColumn("chunk_no", F.lit(-1))
    rows = heads.unionByName(chunks.select("record", "chunk_no", "last", "chunk"), allowMissingColumns=True)
    written = rows.repartition(n, "record").sortWithinPartitions("record", "chunk_no").mapInArrow(_written(_qualified(spark, f"{path}/data"), level, date), "archive string, records bigint, bytes bigint")
    written.write.parquet(f"{path}/archives")
    drop_scratch(chunks)


class _Source:
    """Bytes of one archive, in pieces; gzip members are opened one after the other."""

    def __init__(self, path: str) -> None:
        system, place = pafs.FileSystem.from_uri(path)
        self._in, self._zip, self._raw, self._held = system.open_input_stream(place, compression=None), path.endswith(".gz"), b"", bytearray()
        self._member = None

    def _more(self) -> bool:
        """Take in some more bytes; False at the end."""
        if not self._zip:
            data = self._in.read(CHUNK_BYTES)
            self._held += data
            return bool(data)
        while raw := self._raw or self._in.read(CHUNK_BYTES):
            member = self._member or zlib.decompressobj(31)
            data = member.decompress(raw, CHUNK_BYTES)
            self._raw = member.unused_data if member.eof else member.unconsumed_tail
            self._member = None if member.eof else member
            if data:
                self._held += data
                return True
        if self._member is not None:
            raise ValueError("an archive ends within a member")
        return False

    def head(self) -> list[bytes] | None:
        """Lines up to an empty one; None at the end."""
        while (at := self._held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self._held.strip():
                    raise ValueError("an archive ends within a header")
                return None
        lines = bytes(self._held[:at]).split(_LINE)
        del self._held[: at + 4]
        return lines

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            n = min(size, CHUNK_BYTES)
            while len(self._held) < n:
                if not self._more():
                    raise ValueError("an archive ends within a record")
            yield bytes(self._held[:n])
            del self._held[:n]
            size -= n

    def skip(self, mark: bytes) -> None:
        while len(self._held) < len(mark):
            if not self._more():
                break
        if bytes(self._held[: len(mark)]) != mark:
            raise ValueError("a record does not end where its length says")
        del self._held[: len(mark)]


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}


def _records(source: _Source) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Header of each record, with the HTTP header's length of the payload, and its pieces; those are to be read before the next record."""
    while (lines := source.head()) is not None:
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = _fields(lines)
        inner = source.head()
        if inner is None:
            raise ValueError("a record without an HTTP header")
        held = sum(map(len, inner)) + 2 * len(inner) + 2
        head["payload-length"] = int(_fields(inner)["content-length"])
        yield head, source.body(int(head["content-length"]) - held)
        source.skip(_LINE + _LINE)


_READ = "archive string, record_no bigint, record_id string, page_id {kind}, url string, record_type string, refers_to {kind}, chunk_no int, last boolean, chunk binary, payload_bytes bigint, payload_digest string"


def _read(kind: pa.DataType, with_bytes: bool):
    schema = pa.schema(
        [("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", kind), ("chunk_no", pa.int32()),
         ("last", pa.bool_()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )

    def rows(archive: str) -> Iterator[dict]:
        for number, (head, pieces) in enumerate(_records(_Source(archive))):
            state, size, k, held = hashlib.sha1(), 0, 0, None
            row = {
                "archive": archive, "record_no": number, "record_id": head["warc-record-id"], "page_id": head.get("x-page-id"), "url": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None,
                "record_type": head["warc-type"], "refers_to": head.get("x-refers-to-page-id"), "last": False, "chunk": None, "payload_bytes": None, "payload_digest": None,
            }
            for piece in pieces:
                state.update(piece)
                size += len(piece)
                if with_bytes:
                    if held is not None:
                        yield row | {"chunk_no": k, "chunk": held}
                        k += 1
                    held = piece
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if row["record_type"] == "response" and (digest_text(state.digest()) != digest or size != head["payload-length"]):
                raise ValueError(f"{row['record_id']} is not what its header says")
            yield row | {"chunk_no": k, "last": True, "chunk": held, "payload_bytes": head["payload-length"], "payload_digest": digest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for row in rows(archive):
                    for name in ("page_id", "refers_to"):
                        if row[name] is not None and not pa.types.is_string(kind):
                            row[name] = int(row[name])
                    held.append(row)
                    size += len(row["chunk"] or b"")
                    if len(held) >= 10_000 or size >= 16 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _scan(spark: SparkSession, path: str, kind: str, with_bytes: bool) -> DataFrame:
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"page_id as {kind}")
    archives = spark.read.schema("archive string, records bigint, bytes bigint").parquet(f"{path}/archives").select("archive")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # an archive a task: as many tasks as there are archives, dealt out by their names
    n = max(1, archives.count())
    return archives.repartition(n, "archive").mapInArrow(_read(arrow, with_bytes), _READ.format(kind=kind))


def read_chunks(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The archives as chunk rows; kind is the type of page_id. A revisit is one row without bytes."""
    return _scan(spark, path, kind, True)


def read_records(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """One row a record: archive, record_no, record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest; digests are checked."""
    return _scan(spark, path, kind, False).drop("chunk_no", "last", "chunk")
