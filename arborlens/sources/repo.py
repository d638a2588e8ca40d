"""Source trees as DataFrames, and where they come from.

Spark's binaryFile source drops names that begin with a dot or an underscore, so a Python data source lists the tree, pruning ignored
directories, and reads contents. The driver lists the first SPREAD directories only; the subtrees below are dealt to tasks, which list and read them.
A root is a path that all machines share, or a URI that pyarrow.fs knows (HDFS, S3, ...). Conditions on name, ext and path reach the source:
files that fail them aren't opened. A file or directory that can't be read has a row with a null content and the reason in `error`. Symbolic
links are not followed; only listings for trees and for imports show them. A root that is missing, or a file, gives no rows; one that the driver has and a task hasn't raises.
The root itself is never pruned, whatever its name.
"""

from __future__ import annotations

import os
import stat
import subprocess
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..durable import new_path
from ..functions import text
from ..rules import CLONE_ERRORS, GIT_PREFIXES, IGNORED_DIRS, OTHER_CLONE_ERROR

FILES_PER_PARTITION, BYTES_PER_PARTITION, SPREAD = 2000, 32 << 20, 64

#: path below the root, kind (dir, file, link to a file, other link), bytes, what went wrong
Entry = tuple[str, str, int, str | None]


class Tree:
    """A directory on a file system: the machine's own, or any that pyarrow.fs knows."""

    def __init__(self, root: str):
        self.root, self.fs = root, None
        if "://" in root or root.startswith("file:"):
            fs, place = pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:/", "file:///", 1))
            self.root, self.fs = place, None if isinstance(fs, pafs.LocalFileSystem) else fs

    def _at(self, path: str) -> str:
        return f"{self.root.rstrip('/') or '/'}/{path}" if path else self.root

    def is_dir(self) -> bool:
        if self.fs is None:
            return os.path.isdir(self.root)
        return self.fs.get_file_info(self.root).type == pafs.FileType.Directory

    def list(self, here: str) -> Iterator[Entry]:
        """What a directory holds."""
        lead = f"{here}/" if here else ""
        if self.fs is not None:
            kinds = {pafs.FileType.Directory: "dir", pafs.FileType.File: "file"}
            for e in self.fs.get_file_info(pafs.FileSelector(self._at(here))):
                if e.type in kinds:
                    yield f"{lead}{e.base_name}", kinds[e.type], e.size or 0, None
            return
        for e in os.scandir(self._at(here)):
            path = f"{lead}{e.name}"
            try:
                mode = e.stat(follow_symlinks=False)
                if stat.S_ISLNK(mode.st_mode):
                    yield path, "link to a file" if os.path.isfile(e.path) else "other link", 0, None
                elif stat.S_ISDIR(mode.st_mode) or stat.S_ISREG(mode.st_mode):
                    yield path, "dir" if stat.S_ISDIR(mode.st_mode) else "file", mode.st_size if stat.S_ISREG(mode.st_mode) else 0, None
            except OSError as x:
                yield path, "file", 0, str(x)

    def walk(self, here: str, prune: bool = True) -> Iterator[Entry]:
        """Everything below a directory; one that can't be listed comes with the reason."""
        stack = [here]
        while stack:
            at = stack.pop()
            try:
                found = sorted(self.list(at))
            except OSError as x:
                yield at, "dir", 0, str(x)
                continue
            for e in found:
                if e[1] == "dir":
                    if prune and e[0].rpartition("/")[2] in IGNORED_DIRS:
                        continue
                    stack.append(e[0])
                yield e

    def read(self, path: str) -> bytes:
        if self.fs is None:
            with open(self._at(path), "rb") as f:
                return f.read()
        with self.fs.open_input_stream(self._at(path)) as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        fs = self.fs or pafs.LocalFileSystem()
        fs.create_dir(self._at(path).rpartition("/")[0], recursive=True)
        with fs.open_output_stream(self._at(path)) as f:
            f.write(content)


def _extension(name: str) -> str:
    head, dot, tail = name.rpartition(".")
    return tail.lower() if dot and head else ""


class _Slice(InputPartition):
    def __init__(self, entries: list[Entry], subtrees: list[str]):
        self.entries, self.subtrees = entries, subtrees


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", ".")
        self.repo = options.get("repoid", self.root)
        self.contents = options.get("contents", "true") == "true"
        self.prune = options.get("prune", "true") == "true"
        self.kinds = tuple(options.get("kinds", "file").split(","))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("name",), ("ext",), ("path",)):
                self.tests.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        tree = Tree(self.root)
        if not tree.is_dir():
            return [_Slice([], [])]
        held: list[list[Entry]] = [[]]
        size, queue, listed = 0, [""], 0
        while queue and listed < SPREAD:
            at, listed = queue.pop(0), listed + 1
            try:
                found = sorted(tree.list(at))
            except OSError as x:
                found = [(at, "dir", 0, str(x))]
            for e in found:
                if e[1] == "dir" and e[3] is None:
                    if self.prune and e[0].rpartition("/")[2] in IGNORED_DIRS:
                        continue
                    queue.append(e[0])
                if len(held[-1]) >= FILES_PER_PARTITION or self.contents and size + e[2] > BYTES_PER_PARTITION and held[-1]:
                    held.append([])
                    size = 0
                held[-1].append(e)
                size += e[2]
        return [*[_Slice(x, []) for x in held], *[_Slice([], [x]) for x in queue]]

    def _entries(self, tree: Tree, partition: _Slice) -> Iterator[Entry]:
        yield from partition.entries
        for at in partition.subtrees:
            yield from tree.walk(at, self.prune)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        tree = Tree(self.root)
        if (partition.entries or partition.subtrees) and not tree.is_dir():
            raise FileNotFoundError(f"{self.root} isn't there on every machine: give a shared path or a URI")
        for path, kind, size, error in self._entries(tree, partition):
            if kind not in self.kinds and not (error and kind == "dir" and self.contents):
                continue
            name = path.rpartition("/")[2]
            ext = _extension(name)
            given = {"name": name, "ext": ext, "path": path}
            if any(given[k] not in values for k, values in self.tests):
                continue
            content = None
            if self.contents and kind == "file" and error is None:
                try:
                    content = tree.read(path)
                except OSError as x:
                    error = str(x)
            yield self.repo, path, kind == "dir", size, content, name, ext, error


class RepoDataSource(DataSource):
    """format("repo"): options path, repoId, contents, prune, kinds (file, dir, link to a file, other link; with commas)."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return "repo_id string, path string, is_dir boolean, length bigint, content binary, name string, ext string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def _load(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoDataSource)
    return spark.read.format("repo").options(path=root, **options).load()


def with_names(df: DataFrame) -> DataFrame:
    """Adds name and ext to a table with a path."""
    return df.withColumn("name", text.file_name(F.col("path"))).withColumn("ext", text.extension(F.col("name")))


def files(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path, is_dir, length, content, name, ext, error) of the scanned files; paths are below the root. A file that can't be read is there without content."""
    return _load(spark, root, repoId=repo_id or root).where("not is_dir")


def unread(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path, is_dir, error) of the files and directories that a scan can't read."""
    return _load(spark, root, repoId=repo_id or root).where("error is not null").select("repo_id", "path", "is_dir", "error")


def paths(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path) of the scanned files, without reading them."""
    return _load(spark, root, repoId=repo_id or root, contents="false").select("repo_id", "path")


def listing(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path) of all files and links to files, pruned directories included: what an import may resolve to."""
    return _load(spark, root, repoId=repo_id or root, contents="false", prune="false", kinds="file,link to a file").select("repo_id", "path")


def entries(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path, is_dir) of files, directories and links, for trees; links are leaves."""
    return _load(spark, root, repoId=repo_id or root, contents="false", kinds="file,dir,link to a file,other link").select("repo_id", "path", "is_dir")


def from_table(df: DataFrame) -> DataFrame:
    """files() from any table with path and content, and repo_id if it has many repositories; pruned like a scan."""
    if "repo_id" not in df.columns:
        df = df.withColumn("repo_id", F.lit(""))
    pruned = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))
    return with_names(df.where(~pruned))


# -- where trees come from -------------------------------------------------------------------------------------------


def is_git_url(s: str) -> bool:
    return s.startswith(GIT_PREFIXES)


def clone_error(message: str, url: str) -> str:
    """What to tell of a failed clone; the first rule that fits."""
    said = next((said for words, said in CLONE_ERRORS if any(w in message for w in words)), OTHER_CLONE_ERROR)
    return said.format(message=message, url=url)


def resolve_input(given: str) -> tuple[str, tempfile.TemporaryDirectory | None]:
    """(root, guard): a clone of depth 1 in a temporary directory, which lives as long as the guard, or the path if it exists."""
    if is_git_url(given):
        guard = tempfile.TemporaryDirectory(prefix="arborlens-")
        done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", given, guard.name], capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        if done.returncode:
            guard.cleanup()
            raise ValueError(clone_error(done.stderr.strip(), given))
        return guard.name, guard
    if "://" not in given and not os.path.exists(given):
        raise ValueError(f"Path not found: '{given}'")
    return given, None


def shared_root(spark: SparkSession, root: str, guard: tempfile.TemporaryDirectory | None) -> str:
    """A root that executors can read: a clone is copied to the shared folder, unless all runs on this machine."""
    if guard is None or spark.sparkContext.master.startswith("local"):
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "clone"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{root}"), path)
    return path.toString()
