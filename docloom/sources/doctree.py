"""A Spark data source of document trees: `spark.read.format("doctree").load(folder)`, and as a stream of changed files.

The planner opens folders from the root down until it has enough of them for the tasks; the tasks list what is below and read it, so neither
names nor contents of documents go through the driver. Filters on size and suffix are taken into the listing: files that
they leave out are never opened. Trees may lie on any file system that pyarrow opens by its URI.

Options: `partitions` (64) folders are wanted for tasks; `content` (true) reads the bytes. Columns are those of SCHEMA; content of files over
MAX_INPUT_BYTES is null. Of `x.md` and `x.markdown` the first counts. Folders behind links, names with controls and levels below MAX_TREE_DEPTH are left
out; a root that is not there has no rows. The stream's offset is a modification time: each batch has the files that were changed after the last
one's, so a file that is moved in with an older time is not seen.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from docloom.schema import MAX_INPUT_BYTES, MAX_TREE_DEPTH

SCHEMA = "folder string, name string, logical_path string, suffix string, size bigint, modified_ns bigint, path string, content binary"
_DOCUMENT = re.compile(r"(?i)^(.+)\.(md|markdown)$", re.S)


@dataclass
class Below(InputPartition):
    """Documents of a folder (relative to the root), and of all below it if deep; changed after and up to some times, if given."""

    folder: str
    deep: bool
    after: int = -1
    upto: int | None = None

    def __post_init__(self) -> None:
        super().__init__(0)


@dataclass
class Bounds:
    """What filters leave of sizes and suffixes."""

    least: int = 0
    most: int | None = None
    suffixes: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is wholly taken in."""
        name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return name in (("size",), ("suffix",))  # never null
        if name == ("size",) and isinstance(value, int):
            if isinstance(f, (LessThan, LessThanOrEqual)):
                most = value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
                return True
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
                return True
        if name == ("suffix",) and isinstance(f, (EqualTo, In)):
            wanted = {value} if isinstance(f, EqualTo) else set(value)
            self.suffixes = wanted if self.suffixes is None else self.suffixes & wanted
            return True
        return False

    def fit(self, size: int, suffix: str) -> bool:
        return self.least <= size and (self.most is None or size <= self.most) and (self.suffixes is None or suffix in self.suffixes)


@dataclass
class Tree:
    """A root, listed folder by folder."""

    uri: str
    wanted: int = 64
    content: bool = True
    bounds: Bounds = field(default_factory=Bounds)

    def _open(self) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.uri)
        return system, root.rstrip("/")

    def entries(self, system: pafs.FileSystem, root: str, folder: str) -> tuple[list[str], list[pafs.FileInfo]]:
        """Folders in a folder, and its files."""
        found = sorted(system.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True)), key=lambda i: i.base_name)
        fine = [i for i in found if not re.search(r"[\x00-\x1f\x7f]", i.base_name)]
        linked = lambda i: isinstance(system, pafs.LocalFileSystem) and os.path.islink(i.path)
        folders = [f"{folder}/{i.base_name}" if folder else i.base_name for i in fine if i.type == pafs.FileType.Directory and not linked(i)]
        return (folders if folder.count("/") + 1 < MAX_TREE_DEPTH else []), [i for i in fine if i.type == pafs.FileType.File]

    def partitions(self, after: int = -1, upto: int | None = None) -> list[Below]:
        system, root = self._open()
        level, opened = [""], []
        while level and len(opened) + len(level) < self.wanted:
            below = [f for folder in level for f in self.entries(system, root, folder)[0]]
            opened += level
            level = below
        return [Below(f, False, after, upto) for f in opened] + [Below(f, True, after, upto) for f in level]

    def documents(self, part: Below) -> Iterator[tuple[str, str, str, str, pafs.FileInfo]]:
        """(folder, name, logical path, suffix, file) of the documents of a partition within its times."""
        system, root = self._open()
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            below, files = self.entries(system, root, folder)
            if part.deep:
                todo += reversed(below)
            chosen: dict[str, tuple[str, pafs.FileInfo]] = {}
            for info in files:
                m = _DOCUMENT.match(info.base_name)
                if m and (m[1] not in chosen or m[2].lower() == "md"):
                    chosen[m[1]] = (m[2].lower(), info)
            for name, (suffix, info) in chosen.items():
                if part.after < info.mtime_ns and (part.upto is None or info.mtime_ns <= part.upto):
                    yield folder, name, f"{folder}/{name}" if folder else name, suffix, info

    def rows(self, part: Below) -> Iterator[tuple]:
        system, _ = self._open()
        for folder, name, logical, suffix, info in self.documents(part):
            if not self.bounds.fit(info.size, suffix):
                continue
            content = None
            if self.content and info.size <= MAX_INPUT_BYTES:
                with system.open_input_stream(info.path, compression=None) as stream:
                    content = stream.read()
            yield folder, name, logical, suffix, info.size, info.mtime_ns, info.path, content


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.tree.bounds.take(f):
                yield f

    def partitions(self) -> list[Below]:
        return self.tree.partitions()

    def read(self, partition: Below) -> Iterator[tuple]:
        return self.tree.rows(partition)


class TreeStream(DataSourceStreamReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"modified_ns": -1}

    def latestOffset(self) -> dict:
        """The last modification of all documents."""
        times = (info.mtime_ns for *_, info in self.tree.documents(Below("", True)))
        return {"modified_ns": max(times, default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Below]:
        return self.tree.partitions(start["modified_ns"], end["modified_ns"])

    def read(self, partition: Below) -> Iterator[tuple]:
        return self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for earlier batches."""


class DocTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        return Tree(self.options["path"], int(self.options.get("partitions", 64)), str(self.options.get("content", "true")).lower() != "false")

    def reader(self, schema) -> TreeReader:
        return TreeReader(self._tree())

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self._tree())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocTree)
