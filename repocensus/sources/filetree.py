"""Directory trees as the FILES table.

Spark's own file sources hide every path with a segment starting with '.' or '_', which
are exactly the CI and tool settings an inventory looks for, so trees are listed and read here.

* :func:`listing` lists each folder once, level by level: the folders of a level are spread over the
  executors, which return files and the folders of the next level.
* :func:`with_content` opens files, and only those the caller left in the listing or routes: tests on paths are ordinary
  filters below it. Files are dealt to tasks by their bytes, so one large repository, or one folder of
  large files, spreads over many tasks.
* :func:`stream_tree` is the same as a stream: :func:`note_changes` lists the tree on the executors and stores what
  differs from the listings before, and the offsets of :class:`TreeStream` count these stored changes.

Roots must be on storage that the driver and all executors see.
"""

from __future__ import annotations

import glob
import itertools
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from repocensus.functions.paths import with_path_columns
from repocensus.operators.ordering import PLACE_BITS, written
from repocensus.schemas import FILES

BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
TASK_BYTES = 32 << 20
FOLDERS_PER_TASK = 64
TASKS_PER_CORE = 4  # a level of more folders is dealt in larger shares, up to MOST_FOLDERS
MOST_FOLDERS = 20_000
LISTED_ROWS = 10_000  # of a listing held at once
FILE_COST = 1024  # bytes that opening a file is worth

LISTING = "repo_name STRING, path STRING, bytes BIGINT, modified BIGINT, read_error STRING"
_ENTRIES = LISTING + ", folder BOOLEAN"
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
_LISTED_NAMES = [f.split()[0] for f in LISTING.split(", ")]
_FILE_NAMES = ["repo_name", "path", "content", "read_error"]


def entries(repo_name: str, folder: str) -> Iterator[tuple]:
    """(repo_name, path, bytes, modified, read_error, folder) of what lies in one folder.

    Links to files are files; links to folders are not followed; a folder that cannot be listed is an error row.
    """
    try:
        found = os.scandir(folder)
    except OSError as failure:
        yield repo_name, folder, 0, 0, str(failure), False
        return
    while True:
        try:
            entry = next(found, None)
        except OSError as failure:
            yield repo_name, folder, 0, 0, str(failure), False
            return
        if entry is None:
            return
        if entry.is_dir(follow_symlinks=False):
            yield repo_name, entry.path, 0, 0, None, True
        elif not entry.is_dir():
            try:
                about = entry.stat()
                yield repo_name, entry.path, about.st_size, about.st_mtime_ns, None, False
            except OSError:  # a dangling link: an error once it is read
                yield repo_name, entry.path, 0, 0, None, False


def _batches(rows: Iterable[tuple], kinds: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, LISTED_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def _listed(list_folder: Callable[[str, str], Iterable[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = (f for batch in batches for f in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = (x for repo, path in folders for x in list_folder(repo, path))
        return _batches(rows, _KINDS, [*_LISTED_NAMES, "folder"])

    return run


def repositories(roots: Iterable[str], children: bool) -> Iterator[tuple[str, str]]:
    """(repo_name, folder): each root, or each folder in it."""
    for root in roots:
        if children:
            yield from ((e.name, e.path) for e in os.scandir(root) if e.is_dir())
        else:
            yield os.path.basename(os.path.abspath(root)), root


def _child_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = (r for batch in batches for r in batch.column(0).to_pylist())
    return _batches(repositories(roots, True), _KINDS[:2], ["repo_name", "path"])


def _checked(roots: Iterable[str]) -> list[str]:
    for root in roots:
        if not os.path.isdir(root):
            raise ValueError(f"no such folder: {root}")
    return list(roots)


def listing(spark: SparkSession, *roots: str, children: bool = False, list_folder: Callable[[str, str], Iterable[tuple]] = entries) -> DataFrame:
    """(repo_name, path, bytes, modified, read_error) of all files below the roots, without opening any.

    ``list_folder`` says what lies in a folder, in the form of :func:`entries`.
    """
    folder, cores = "repo_name STRING, path STRING", spark.sparkContext.defaultParallelism
    if children:
        given = spark.createDataFrame([(r,) for r in _checked(roots)], "path STRING").repartition(max(1, len(roots)))
        level = written(given.mapInArrow(_child_folders, folder), "listing")
    else:
        level = spark.createDataFrame(sorted(repositories(_checked(roots), False)), folder)
    files = [spark.createDataFrame([], LISTING)]
    folders = level.count()
    while folders:
        share = min(max(FOLDERS_PER_TASK, -(-folders // (TASKS_PER_CORE * cores))), MOST_FOLDERS)
        dealt = level.repartition(-(-folders // share))
        found = written(dealt.mapInArrow(_listed(list_folder), _ENTRIES), "listing")
        files.append(found.where("NOT folder").drop("folder"))
        level = found.where("folder").select("repo_name", "path")
        folders = level.count()
    while len(files) > 1:  # a balanced union
        files = [files[i].union(files[i + 1]) if i + 1 < len(files) else files[i] for i in range(0, len(files), 2)]
    return files[0]


def _opened(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """FILES rows of (repo_name, path, read_error, wanted) rows; only wanted files are opened."""
    out: list[tuple] = []
    size = 0
    for repo, path, error, wanted in rows:
        content = None
        if wanted and error is None:
            try:
                with open(path, "rb") as handle:
                    content = handle.read().decode("utf-8", "replace")
            except OSError as failure:
                error = str(failure)
        out.append((repo, path, content, error))
        size += len(content or "")
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _file_batch(out)
            out, size = [], 0
    if out:
        yield _file_batch(out)


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], _FILE_NAMES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _opened(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))


def with_content(listed: DataFrame, route: Column | None = None) -> DataFrame:
    """FILES rows of a listing. With ``route``, a test over path columns, other files keep a row but are not opened."""
    wanted = F.lit(True) if route is None else F.coalesce(route, F.lit(False))
    cost = F.when(wanted, F.col("bytes")).otherwise(0) + FILE_COST
    placed = with_path_columns(listed).select("repo_name", "path", "read_error", wanted.alias("wanted"), cost.alias("cost"))
    table = written(placed.withColumn("place", F.monotonically_increasing_id()), "tree").withColumn("part", F.shiftright("place", PLACE_BITS))
    sizes = table.groupBy("part").agg(F.sum("cost").alias("cost")).collect()  # a number for each task of the listing
    before, offsets = 0, []
    for size in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((size["part"], before))
        before += size["cost"]
    # Where a file's bytes begin in those of all files says which task opens it.
    running = F.sum("cost").over(Window.partitionBy("part").orderBy("place")) - F.col("cost")
    starts = table.withColumn("running", running).join(listed.sparkSession.createDataFrame(offsets, "part BIGINT, before BIGINT"), "part")
    task = F.floor((F.col("before") + F.col("running")) / TASK_BYTES).cast("int")
    dealt = starts.withColumn("task", task).repartitionById(max(1, -(-before // TASK_BYTES)), "task")
    return dealt.select("repo_name", "path", "read_error", "wanted").mapInArrow(_read, FILES)


def read_directory(spark: SparkSession, root: str, route: Column | None = None) -> DataFrame:
    """All files below one directory; the repository is named after it."""
    return with_content(listing(spark, root), route)


def read_repositories(spark: SparkSession, parent: str, route: Column | None = None) -> DataFrame:
    """All files of every child directory of ``parent``, each a repository."""
    return with_content(listing(spark, parent, children=True), route)


class _State:
    """What listings of a stream have found: ``<state>/version=<n>/parts=<m>/part=<k>``, parquet, of new and changed files.

    A part has the files whose path's checksum is in the k-th of m ranges.
    """

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:").replace("//", "/")
        os.makedirs(self.folder, exist_ok=True)
        if any(name.endswith(".json") for name in os.listdir(self.folder)):
            raise ValueError(f"{self.folder} has listings of an earlier release: take a new state, checkpoint and output")

    def place(self, version: int) -> str:
        return f"{self.folder}/version={version:010}"

    def last(self, after: int = 0) -> int:
        while os.path.exists(self.place(after + 1)):
            after += 1
        return after

    def draft(self) -> str:
        return f"{self.folder}/.draft-{uuid.uuid4().hex}"

    def parts(self, version: int) -> dict[tuple[int, int], list[str]]:
        """The files of part k of m, by (m, k)."""
        found: dict[tuple[int, int], list[str]] = {}
        for path in sorted(glob.glob(f"{glob.escape(self.place(version))}/parts=*/part=*/*.parquet")):
            m, k = (int(p.split("=")[1]) for p in path.split("/")[-3:-1])
            found.setdefault((m, k), []).append(path)
        return found


def _parts(cost: int) -> int:
    return max(1, -(-cost // TASK_BYTES))


def note_changes(spark: SparkSession, root: str, state: str, children: bool = False) -> int:
    """List a tree on the executors and store new and changed files for streams with this ``state``; how often it has changed.

    Changed are files whose size or time differs from the listing before. Deleted files are no changes.
    """
    at = _State(state)
    version = at.last()
    found = listing(spark, *[r for r in root.split(",") if r], children=children)
    if version:
        about = F.struct("bytes", "modified", "read_error")
        stored = spark.read.schema(f"{LISTING}, version INT").parquet(f"file://{at.folder}").where(F.col("version") <= version)
        known = stored.groupBy("path").agg(F.max_by(about, "version").alias("known"))
        found = found.join(known, "path", "left").where(~about.eqNullSafe(F.col("known"))).select(*found.columns)
    changed = written(found, "changes")
    cost = changed.agg(F.sum(F.col("bytes") + FILE_COST)).first()[0]
    if cost is None:
        return version
    parts, draft = _parts(cost), at.draft()
    dealt = changed.withColumn("part", F.shiftright(F.crc32("path") * parts, 32).cast("int")).repartitionById(parts, "part")
    dealt.write.partitionBy("part").parquet(f"file://{draft}/parts={parts}")
    os.replace(draft, at.place(version + 1))
    return version + 1


class TreePart(InputPartition):
    def __init__(self, files: list[str], newer: list[str]):
        self.files, self.newer = files, newer


class TreeStreamReader(DataSourceStreamReader):
    """New and changed files of a tree, as stored by :func:`note_changes`.

    An offset is the number of the last stored listing, so a restarted query knows what it has seen. A query that goes on running
    lists the tree itself at each later trigger, in its own process on the driver; what :func:`note_changes` stores meanwhile is seen too.
    """

    def __init__(self, options: dict):
        self.roots = [r for r in options["path"].split(",") if r]
        self.children = options.get("layout") == "children"
        self.state = _State(options["state"])
        self.known: dict[str, tuple] = {}
        self.noted = self.version = 0
        self.started = False

    def _listed(self) -> Iterator[tuple]:
        waiting = list(repositories(_checked(self.roots), self.children))
        while waiting:
            for *row, folder in entries(*waiting.pop()):
                if folder:
                    waiting.append((row[0], row[1]))
                else:
                    yield tuple(row)

    def _list_again(self) -> None:
        for version in range(self.noted + 1, self.version + 1):
            self.known.update({row[1]: row[2:] for files in self.state.parts(version).values() for row in _stored(files)})
        self.noted = self.version
        changed = [row for row in self._listed() if self.known.get(row[1]) != row[2:]]
        if not changed:
            return
        parts, draft, dealt = _parts(sum(row[2] + FILE_COST for row in changed)), self.state.draft(), {}
        for row in changed:
            dealt.setdefault(zlib.crc32(row[1].encode()) * parts >> 32, []).append(row)
        for part, rows in dealt.items():
            os.makedirs(folder := f"{draft}/parts={parts}/part={part}")
            pq.write_table(pa.Table.from_batches(_batches(rows, _KINDS[:-1], _LISTED_NAMES)), f"{folder}/0.parquet")
        try:
            os.replace(draft, self.state.place(self.version + 1))
        except OSError:  # note_changes was first; what it has not seen is found at the next trigger
            if not os.path.exists(self.state.place(self.version + 1)):
                raise

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        self.version = self.state.last(self.version)
        if self.started:
            self._list_again()
            self.version = self.state.last(self.version)
        self.started = True
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        held = [self.state.parts(v) for v in range(start["version"] + 1, end["version"] + 1)]
        return [
            TreePart(files, [f for later in held[i + 1 :] for (n, j), some in later.items() if j * m < (k + 1) * n and k * n < (j + 1) * m for f in some])
            for i, parts in enumerate(held)
            for (m, k), files in parts.items()
        ]

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        rows = {row[1]: row for row in _stored(partition.files)}
        for newer in _stored(partition.newer):  # a file that changed twice is read once
            rows.pop(newer[1], None)
        return _opened((rows[path][0], path, rows[path][4], True) for path in sorted(rows))

    def commit(self, end: dict) -> None:
        pass


def _stored(files: list[str]) -> Iterator[tuple]:
    for file in files:
        with pq.ParquetFile(file) as table:
            for batch in table.iter_batches(columns=_LISTED_NAMES):
                yield from zip(*(batch.column(name).to_pylist() for name in _LISTED_NAMES), strict=True)


class TreeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree_changes"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(dict(self.options))


def stream_tree(spark: SparkSession, root: str, state: str, children: bool = False) -> DataFrame:
    """A stream of new and changed files, listed by :func:`note_changes` first.

    ``state`` is a folder for the listings that driver and executors see, kept with the query's checkpoint.
    """
    note_changes(spark, root, state, children)
    spark.dataSource.register(TreeStream)
    return spark.readStream.format("repo_tree_changes").option("layout", "children" if children else "root").option("state", state).load(root)
