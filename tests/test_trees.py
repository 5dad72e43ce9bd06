"""Directory trees: each folder listed once, files dealt by bytes, only routed ones opened, changes as a stream."""

import os
import time
from collections import Counter

from pyspark.sql import functions as F

from repocensus.operators import manifests
from repocensus.plans import scan as plan
from repocensus.sources import filetree
from repocensus.streaming import ingest


def _write(root, path, text="x"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return target


def _paths(df, root):
    return sorted((r.repo_name, os.path.relpath(r.path, root), r.content) for r in df.collect())


def test_every_folder_is_listed_once(spark, tmp_path):
    """Counted in the tasks themselves: each leaves a mark for every folder it lists."""
    root, marks = tmp_path / "root", tmp_path / "marks"
    marks.mkdir()
    for i in range(200):
        _write(root, f"r{i % 3}/a{i % 7}/b{i % 11}/f{i}.txt", str(i))

    def marking(repo, folder):
        with open(f"{marks}/{folder.replace('/', '_')}", "a") as handle:
            handle.write("1")
        return list(filetree.entries(repo, folder))

    assert filetree.listing(spark, str(root), children=True, list_folder=marking).count() == 200
    folders = [d for d, _, _ in os.walk(root) if d != str(root)]
    assert {f: len((marks / f).read_text()) for f in os.listdir(marks)} == {d.replace("/", "_"): 1 for d in folders}


def test_files_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filetree, "TASK_BYTES", 200_000)
    for i in range(60):
        _write(tmp_path, f"a/f{i}", "x" * 20_000)
    _write(tmp_path, "a/large", "y" * 900_000)
    found = filetree.read_directory(spark, str(tmp_path / "a")).withColumn("task", F.spark_partition_id())
    sizes = Counter()
    for r in found.collect():
        sizes[r.task] += len(r.content)
    assert sum(sizes.values()) == 60 * 20_000 + 900_000
    assert max(s for s in sizes.values() if s < 900_000) <= 240_000 and len(sizes) >= 7


def test_only_routed_files_are_opened(spark, tmp_path):
    """An unreadable file that nothing routes fails nothing; a routed one does."""
    _write(tmp_path, "r/go.mod", "require a v1")
    _write(tmp_path, "r/notes.bin", "secret")
    os.symlink(tmp_path / "gone", tmp_path / "r" / "dangling.bin")
    os.symlink(tmp_path / "r", tmp_path / "r" / "loop")
    route = F.col("base_name") == "go.mod"
    rows = {os.path.basename(r.path): r for r in filetree.read_directory(spark, str(tmp_path / "r"), route).collect()}
    assert set(rows) == {"go.mod", "notes.bin", "dangling.bin"}
    assert rows["go.mod"].content == "require a v1" and rows["notes.bin"].content is None
    assert all(r.read_error is None for r in rows.values())
    every = {os.path.basename(r.path): r for r in filetree.read_directory(spark, str(tmp_path / "r")).collect()}
    assert every["dangling.bin"].read_error and every["notes.bin"].content == "secret"
    # Tests on paths are filters of the listing: what they leave out is never opened.
    some = filetree.with_content(filetree.listing(spark, str(tmp_path / "r")).where(F.col("path").endswith("go.mod")))
    assert [r.content for r in some.collect()] == ["require a v1"]
    routed = filetree.read_directory(spark, str(tmp_path / "r"), manifests.go_modules().route)
    assert {r.repo_name for r in plan.scan_repositories(routed, extractors=[manifests.go_modules()]).collect()} == {"r"}


def test_empty_trees(spark, tmp_path):
    (tmp_path / "r" / "empty").mkdir(parents=True)
    assert filetree.read_repositories(spark, str(tmp_path)).collect() == []
    assert filetree.read_directory(spark, str(tmp_path / "r" / "empty")).collect() == []


def _ingested(spark, tmp_path):
    files = filetree.stream_tree(spark, str(tmp_path / "root"), str(tmp_path / "listings"), children=True)
    ingest.ingest(files, str(tmp_path / "out"), str(tmp_path / "state"), [manifests.go_modules()]).awaitTermination()
    return Counter((r.repo_name, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_tree_as_a_stream(spark, tmp_path):
    """New and changed files only; a restarted query repeats nothing."""
    root = tmp_path / "root"
    _write(root, "a/go.mod", "require x v1")
    _write(root, "b/.hidden/go.mod", "require y v1")
    assert _ingested(spark, tmp_path) == Counter({("a", "x"): 1, ("b", "y"): 1})
    assert _ingested(spark, tmp_path) == Counter({("a", "x"): 1, ("b", "y"): 1})
    _write(root, "a/go.mod", "require xx v1\n")
    os.utime(_write(root, "c/sub/go.mod", "require z v1"), (1, 1))  # new, with an old time
    (root / "b" / ".hidden" / "go.mod").unlink()
    want = Counter({("a", "x"): 1, ("b", "y"): 1, ("a", "xx"): 1, ("c", "z"): 1})
    assert _ingested(spark, tmp_path) == want
    assert _ingested(spark, tmp_path) == want


def test_a_stream_is_listed_on_the_executors_before_it_starts(spark, tmp_path, monkeypatch):
    """The listing is stored in parts by tasks, and a listing of many folders has no more tasks than cores need."""
    for i in range(40):
        _write(tmp_path, f"root/r{i}/a/go.mod", f"require x{i} v1")
    kind, asked = type(spark.range(1)), []
    mixed = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *c: asked.append(n) or mixed(df, n, *c))
    monkeypatch.setattr(filetree, "FOLDERS_PER_TASK", 1)
    monkeypatch.setattr(filetree, "TASK_BYTES", 10_000)
    filetree.stream_tree(spark, str(tmp_path / "root"), str(tmp_path / "listings"), children=True)
    assert asked == [1, 14, 14]  # 40 folders a level, at least 4 tasks a core: 3 folders each
    stored = spark.read.parquet(str(tmp_path / "listings"))
    assert stored.count() == 40 and stored.select("part").distinct().count() >= 3
    assert filetree.note_changes(spark, str(tmp_path / "root"), str(tmp_path / "listings"), children=True) == 1


def test_a_file_noted_twice_is_read_once(spark, tmp_path):
    """A query that starts on older listings reads what is there now, once."""
    root, state = tmp_path / "root", str(tmp_path / "listings")
    for i in range(20):
        _write(root, f"r/d{i}/go.mod", f"old {i}")
    filetree.note_changes(spark, str(root), state, children=True)
    _write(root, "r/d3/go.mod", "newer")
    _write(root, "r/d33/go.mod", "added")
    query = filetree.stream_tree(spark, str(root), state, children=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = Counter(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == Counter({f"old {i}": 1 for i in range(20) if i != 3} | {"newer": 1, "added": 1})


def test_a_running_stream_sees_new_files(spark, tmp_path):
    root = tmp_path / "root"
    _write(root, "a/go.mod", "one")
    files = filetree.stream_tree(spark, str(root), str(tmp_path / "listings"), children=True)
    query = files.writeStream.format("memory").queryName("running_tree").trigger(processingTime="0 seconds").start()
    try:
        for rows, path, text in ((1, "a/go.mod", "one"), (2, "b/go.mod", "two"), (3, "a/go.mod", "three")):
            if rows > 1:
                _write(root, path, text)
            end = time.time() + 60
            while len(table := spark.table("running_tree").collect()) < rows:
                assert time.time() < end and query.exception() is None
                time.sleep(0.3)
        assert sorted((r.repo_name, r.content) for r in table) == [("a", "one"), ("a", "three"), ("b", "two")]
    finally:
        query.stop()
