"""Directory trees as a data source: a task lists and reads each part of the tree.

The driver lists directories, breadth first, only until it has ``parts`` of them
to hand out; a task lists what is below its own directories itself. Directories
whose files are many can be shared by ``splits`` tasks, each of which reads the
files whose names hash to it.

Read: path (relative to root), text, error_code of each file below root, line
ends as they are. Names that start with a dot are left out, directories with all
they hold; any other name is read. An empty file is an empty text. A text that
is not UTF-8 is null, with document_not_utf8 as its error. A root that is not
there, or is a file, holds nothing. Symbolic links are followed once: a
directory that is its own ancestor is left out.

Roots are local or mounted folders, or addresses that Arrow's file systems know.
"""

from __future__ import annotations

import posixpath
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirelake.functions.workers import workers_see_package

SCHEMA = "path string, text string, error_code string"
BATCH_FILES, BATCH_BYTES = 1_000, 16 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and its own name of a root."""
    return fs.FileSystem.from_uri(root if ":/" in root else posixpath.abspath(root))


def listed(system: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """Names of directories and of files in a folder, without those that start with a dot; none where there is no folder."""
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return [], []
    entries = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    named = [e for e in entries if not e.base_name.startswith(".")]
    return sorted(e.base_name for e in named if e.type == fs.FileType.Directory), sorted(e.base_name for e in named if e.type == fs.FileType.File)


def looped(system: fs.FileSystem, folder: str) -> bool:
    """Whether a local folder is one of its own ancestors, by a link."""
    if not isinstance(system, fs.LocalFileSystem):
        return False
    real = posixpath.realpath(folder)
    up = posixpath.dirname(folder)
    while len(up) > 1:
        if posixpath.realpath(up) == real:
            return True
        up = posixpath.dirname(up)
    return False


def decoded(data: bytes) -> tuple[str | None, str | None]:
    try:
        return data.decode(), None
    except UnicodeDecodeError:
        return None, "document_not_utf8"


class Part(InputPartition):
    """A directory (its names below the root), with or without what is deeper, and which of its shares."""

    def __init__(self, way: tuple[str, ...], deep: bool, share: int) -> None:
        self.way, self.deep, self.share = way, deep, share


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.parts, self.splits = int(options.get("parts", 64)), int(options.get("splits", 1))
        if self.parts < 1 or self.splits < 1:
            raise ValueError("parts and splits are at least 1")

    def partitions(self) -> list[Part]:
        system, base = opened(self.root)
        shallow, deep = [], deque([()])
        while deep and len(shallow) + len(deep) < self.parts:
            way = deep.popleft()
            shallow.append(way)
            deep += [(*way, name) for name in listed(system, posixpath.join(base, *way))[0] if not looped(system, posixpath.join(base, *way, name))]
        return [Part(way, how, k) for ways, how in ((shallow, False), (deep, True)) for way in ways for k in range(self.splits)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, base = opened(self.root)
        held, size, todo = [], 0, [partition.way]
        while todo:
            way = todo.pop()
            folders, files = listed(system, posixpath.join(base, *way))
            if partition.deep:
                todo += [(*way, name) for name in folders if not looped(system, posixpath.join(base, *way, name))]
            for name in files:
                path = "/".join((*way, name))
                if zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.splits != partition.share:
                    continue
                with system.open_input_stream(posixpath.join(base, *way, name)) as stream:
                    data = stream.read()
                held.append((path, *decoded(data)))
                size += len(data)
                if len(held) == BATCH_FILES or size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple[str, str | None, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "text", "error_code"])


class TreeSource(DataSource):
    """spark.read.format("tree").load(root); options parts and splits."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, parts: int = 64, splits: int = 1) -> DataFrame:
    """Every file below root: path, text, error_code."""
    workers_see_package(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(parts=parts, splits=splits).load(root)


def write_tree(files: DataFrame, root: str) -> int:
    """Write each file (path below root, text or bytes as content) and return how many; paths are unlike, and stay below root."""
    workers_see_package(files.sparkSession)
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        made: set[str] = set()
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not below the root: {path}")
                name = posixpath.join(base, path)
                folder = posixpath.dirname(name)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(name) as stream:
                    stream.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("path", content.alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
