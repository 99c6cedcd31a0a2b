"""The document tree source and the versioned snapshot."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from docloom.schema import RequestError, ResolutionError
from docloom.sources import doctree
from docloom.sources.snapshot import Conflict, Manifest, Snapshot

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def texts(spark):
    if os.path.exists(DOCUMENTS):
        return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DOCUMENTS).select("doc_id", "text").collect()}
    return {i: f"# Page {i}\n\n" + "word " * (i % 300) for i in range(1000)}


def test_document_tree(spark, tmp_path):
    doctree.register(spark)
    want = {}
    for i, text in texts(spark).items():
        for k, suffix in enumerate(("md", "markdown", "MD") if i % 10 == 0 else ("md",) if i % 2 else ("markdown",)):
            folder = tmp_path / f"a{i % 7}" / f"b{i % 5}" if i % 3 else tmp_path / f"c{i % 11}"
            folder.mkdir(parents=True, exist_ok=True)
            name = f"{'X' if suffix == 'MD' else 'p'}{i}"
            (folder / f"{name}.{suffix}").write_text(text)
            if k != 1:
                want[f"{folder.relative_to(tmp_path)}/{name}"] = (suffix.lower(), len(text.encode()), text)
    (tmp_path / "root.md").write_text("top")
    want["root"] = ("md", 3, "top")
    (tmp_path / "c0" / "other.txt").write_text("no document")
    os.symlink(tmp_path / "a1", tmp_path / "linked")
    source = spark.read.format("doctree").option("partitions", 20).load(str(tmp_path))
    got = {r["logical_path"]: (r["suffix"], r["size"], bytes(r["content"]).decode()) for r in source.collect()}
    assert got == want and len(got) > 1000
    assert source.rdd.getNumPartitions() >= 20
    small = source.where((F.col("size") <= 900) & (F.col("size") > 50) & F.col("suffix").isin("markdown") & F.col("name").startswith("p1"))
    assert {r["logical_path"] for r in small.collect()} == {p for p, (s, n, _) in want.items() if 50 < n <= 900 and s == "markdown" and p.rsplit("/")[-1].startswith("p1")}
    plan = small._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "size" not in "".join(x for x in above.splitlines() if "Filter" in x) and "StartsWith" in above
    bare = spark.read.format("doctree").option("content", "false").load(str(tmp_path))
    assert bare.where("content IS NOT NULL").count() == 0 and bare.count() == len(want)
    assert spark.read.format("doctree").load(str(tmp_path / "none")).count() == 0


def test_bounds_leave_files_unopened(tmp_path, monkeypatch):
    for n in (1, 5, 50):
        (tmp_path / f"f{n}.md").write_text("x" * n)
    tree = doctree.Tree(str(tmp_path))
    kept = list(doctree.TreeReader(tree).pushFilters([doctree.LessThan(("size",), 50), doctree.GreaterThanOrEqual(("size",), 5), doctree.EqualTo(("name",), "f5"), doctree.EqualTo(("suffix",), "md")]))
    assert [f.attribute for f in kept] == [("name",)]
    assert [r[1] for p in tree.partitions() for r in tree.rows(p)] == ["f5"]


def test_document_stream(spark, tmp_path):
    doctree.register(spark)
    home = tmp_path / "home"
    (home / "x").mkdir(parents=True)
    (home / "x" / "one.md").write_text("1")
    (home / "two.markdown").write_text("2")
    seen = []

    def run():
        stream = spark.readStream.format("doctree").load(str(home))
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["logical_path"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert [s for s in seen if s] == [["two", "x/one"]]
    (home / "x" / "three.md").write_text("3")
    later = os.stat(home / "x" / "three.md").st_mtime_ns + 10_000_000
    os.utime(home / "two.markdown", ns=(later, later))
    run()
    assert [s for s in seen if s][1:] == [["two", "x/three"]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, text string")


def contents(df):
    return {r["doc_key"]: r["text"] for r in df.collect()}


def test_snapshot_versions(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "table"))
    with pytest.raises(ResolutionError):
        table.read()
    assert table.upsert(frame(spark, [("a", "1"), ("b", "1"), ("b", "0")])) == 1
    pinned = table.read()
    assert table.upsert(frame(spark, [("b", "2"), ("c", "2")])) == 2 and table.delete(frame(spark, [("a", None), ("zzz", None)])) == 3
    assert contents(pinned) == {"a": "1", "b": "1"} and contents(table.read(2)) == {"a": "1", "b": "2", "c": "2"}
    assert contents(table.read()) == {"b": "2", "c": "2"}
    assert table.upsert(frame(spark, [("a", "4")])) == 4 and contents(table.read()) == {"a": "4", "b": "2", "c": "2"}
    assert table.forget_missing(frame(spark, [("a", None), ("c", None), ("new", None)])) == 5 and contents(table.read()) == {"a": "4", "c": "2"}
    with pytest.raises(RequestError):
        table.upsert(frame(spark, [(None, "x")]))
    with pytest.raises(ResolutionError):
        table.read(77)
    # a stream's batch that comes again is there already
    assert table.upsert(frame(spark, [("s", "0")]), batch=("in", 0)) == 6 and table.upsert(frame(spark, [("s", "again")]), batch=("in", 0)) == 6
    assert contents(table.read())["s"] == "0"
    assert table.compact() == 7 and len(table.manifest().layers) == 1 and contents(table.read()) == {"a": "4", "c": "2", "s": "0"}
    assert table.compact() == 7 and contents(table.read(6)) == contents(table.read(7))
    assert len(table.vacuum(keep=1, older_than=0)) == 7 and table.versions() == [7] and contents(table.read()) == {"a": "4", "c": "2", "s": "0"}


def test_snapshot_writers_that_die_or_meet(spark, tmp_path, monkeypatch):
    table = Snapshot(spark, str(tmp_path / "table"))
    table.upsert(frame(spark, [("a", "1")]))
    # a writer dies after its layer is staged, and one while its manifest is written
    table.stage(frame(spark, [("a", "never")]))
    (tmp_path / "table" / "versions" / ".half.tmp").write_text('{"version": 2, "la')
    again = Snapshot(spark, str(tmp_path / "table"))
    assert contents(again.read()) == {"a": "1"} and again.upsert(frame(spark, [("b", "2")])) == 2
    assert len(again.vacuum(keep=2, older_than=0)) == 1 and [n for n in sorted(os.listdir(tmp_path / "table" / "versions")) if not n.startswith(".")] == [f"{v:012d}.json" for v in (1, 2)]
    assert contents(again.read()) == {"a": "1", "b": "2"}
    # a version is published once; who comes second takes the next
    with pytest.raises(Conflict):
        again._publish(Manifest(2, (), {}))
    layers = [again.stage(frame(spark, [(f"t{i}", str(i))])) for i in range(4)]
    threads = [threading.Thread(target=again.publish, args=(x,)) for x in layers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert again.versions() == [1, 2, 3, 4, 5, 6] and set(contents(again.read())) == {"a", "b", "t0", "t1", "t2", "t3"}
    # a write that comes between makes a compaction start again
    staged, real = [], Snapshot.stage

    def stage(self, rows, deletes=False):
        if not staged:
            staged.append(1)
            Snapshot(spark, self.path).publish(layer)
        return real(self, rows, deletes)

    layer = real(again, frame(spark, [("late", "9")]))
    monkeypatch.setattr(Snapshot, "stage", stage)
    assert again.compact() == 8 and contents(again.read())["late"] == "9" and len(again.manifest().layers) == 1


def test_watched_folder_forgets_deleted_files(spark, tmp_path):
    from docloom.streaming.watch import current, forget_deleted, watch

    home, out = tmp_path / "in", str(tmp_path / "out")
    home.mkdir()
    for n in "ab":
        (home / f"{n}.md").write_text(f"# {n}\n\ntext")
    watch(spark, str(home), out, str(tmp_path / "state")).awaitTermination()
    before = current(spark, out)
    (home / "a.md").unlink()
    assert forget_deleted(spark, str(home), out) == 2
    assert [r["title"] for r in current(spark, out).collect()] == ["b"] and before.count() == 2 and current(spark, out, 1).count() == 2
