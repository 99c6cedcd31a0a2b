"""A versioned table of documents: staged writes, published at once, read at a pinned version.

Under the root lie `data`, one folder of Parquet a write, and `versions`, one manifest a version. A manifest lists the layers of its
version in order: what a writer has put in, or the keys that it has taken out (tombstones); of each key the last layer holds.
A writer stages its layer first and then publishes a manifest by a rename that fails if the version is there (which the file system
has to see to; local ones look first and rename then), upon which it takes the next one: so readers see all of a write or nothing, versions never change, and writers never wait. A writer that dies leaves a
folder that no manifest names; nothing reads it, and `vacuum` deletes it.

Reading takes one aggregate of keys over the layers, and none if there is but one, as after `compact`.

Defined cases: rows without a key are refused; of several rows of one key in one write the greatest (as a row) holds; a batch that has
been published already is not published again; a version that is not there is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schema import RequestError, ResolutionError


class Conflict(Exception):
    """The version to be published is there already."""


@dataclass(frozen=True)
class Layer:
    data: str
    deletes: bool
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    layers: tuple[Layer, ...]
    batches: dict[str, int]  # the last batch in it of each stream

    def text(self) -> str:
        return json.dumps({"version": self.version, "batches": self.batches, "layers": [vars(x) for x in self.layers]})

    def has(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and batch[1] <= self.batches.get(batch[0], -1)

    @classmethod
    def of(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["version"], tuple(Layer(**x) for x in raw["layers"]), raw["batches"])


class Snapshot:
    """The table at path; key is its column that names a document."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_key") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder and when they were changed, in milliseconds."""
        where = self._at(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(where)} if self._fs.exists(where) else {}

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or of the last one; before the first there is an empty version 0."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0 and 0 not in have:
            return Manifest(0, (), {})
        if version not in have:
            raise ResolutionError("NotFound", f"no version {version}")
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return Manifest.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, rows: DataFrame, deletes: bool = False) -> Layer:
        """Write a layer that no reader sees yet."""
        if deletes:
            rows = rows.select(self.key).distinct()
        else:
            whole = F.max(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
            rows = rows.groupBy(F.col(self.key).alias("_key")).agg(whole.alias("_row")).select("_row.*")
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        counts = self.spark.read.parquet(f"{self.path}/data/{name}").agg(F.count(F.lit(1)).alias("n"), F.count(self.key).alias("keys")).first()
        if counts["n"] != counts["keys"]:
            raise RequestError("InvalidKey", f"{counts['n'] - counts['keys']} rows without {self.key}")
        return Layer(name, deletes, counts["n"])

    def _publish(self, manifest: Manifest) -> None:
        """All of the manifest or nothing under its version's name."""
        held, name = self._at(f"versions/.{uuid.uuid4().hex}.tmp"), self._at(f"versions/{manifest.version:012d}.json")
        out = self._fs.create(held, False)
        try:
            out.write(bytearray(manifest.text().encode()))
            out.hsync()
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        rename = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
        rename[0] = getattr(options, "Rename").NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(held), self._fs.makeQualified(name), rename)
        except Exception as e:
            self._fs.delete(held, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version}") from None
            raise

    def publish(self, layer: Layer, batch: tuple[str, int] | None = None) -> int:
        """Put a staged layer on top of what is there; returns the version. batch: a stream's name and the batch's number."""
        while True:
            last = self.manifest()
            if last.has(batch):
                return last.version
            try:
                self._publish(Manifest(last.version + 1, (*last.layers, layer), last.batches | (dict([batch]) if batch else {})))
                return last.version + 1
            except Conflict:
                continue

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        last = self.manifest()
        return last.version if last.has(batch) else self.publish(self.stage(rows), batch)

    def delete(self, keys: DataFrame) -> int:
        return self.publish(self.stage(keys, deletes=True))

    def forget_missing(self, listing: DataFrame) -> int:
        """Take out the documents whose keys a complete listing no longer has."""
        return self.delete(self.read().select(self.key).join(listing.select(self.key), self.key, "left_anti"))

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version; later writes don't show in it."""
        layers = self.manifest(version).layers
        puts = [(k, x) for k, x in enumerate(layers) if not x.deletes]
        if not puts:
            raise ResolutionError("NotFound", "the table has no documents yet")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.path}/data/{x.data}").withColumn("_layer", F.lit(k)) for k, x in puts])
        if len(layers) == 1:
            return rows.drop("_layer")
        keys = rows.select(self.key, "_layer")
        for k, x in enumerate(layers):
            if x.deletes:
                keys = keys.unionByName(self.spark.read.parquet(f"{self.path}/data/{x.data}").select(self.key, F.lit(k).alias("_layer")))
        last = keys.groupBy(self.key).agg(F.max("_layer").alias("_layer"))
        return rows.join(last, [self.key, "_layer"], "left_semi").drop("_layer")

    def compact(self) -> int:
        """The last version's documents as one layer of a new one; a write that comes between makes it start again."""
        while True:
            last = self.manifest()
            if len(last.layers) < 2:
                return last.version
            layer = self.stage(self.read(last.version))
            try:
                self._publish(Manifest(last.version + 1, (layer,), last.batches))
                return last.version + 1
            except Conflict:
                continue

    def vacuum(self, keep: int = 1, older_than: float = 86_400) -> list[str]:
        """Delete all but the last versions, and folders that none of those names and that nobody has touched for so many seconds."""
        have = self.versions()
        for v in have[: max(0, len(have) - max(1, keep))]:
            self._fs.delete(self._at(f"versions/{v:012d}.json"), False)
        named = {x.data for v in self.versions() for x in self.manifest(v).layers}
        before = (time.time() - older_than) * 1000
        gone = [n for n, changed in self._names("data").items() if n not in named and changed <= before]
        for n in gone:
            self._fs.delete(self._at(f"data/{n}"), True)
        for n, changed in self._names("versions").items():
            if n.endswith(".tmp") and changed <= before:
                self._fs.delete(self._at(f"versions/{n}"), False)
        return sorted(gone)
