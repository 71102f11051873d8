"""Version images as files: ``<dataset>@<ord>.img``, read in splits and written as sparse files.

A data source whose partitions are (path, offset, length): one image is read by many tasks, whatever its
size, and no task holds more than CHUNK bytes of it. Rows are (dataset, ord, cell, payload) as
``images.to_cells`` makes them: the last cell zero-padded, no rows for holes.

Paths are those that Arrow's file systems open from every executor: shared folders, ``s3://``, ``gs://``,
``hdfs://``. What only Spark's own readers can open is read with ``binaryFile`` and ``images.to_cells``, one
image a row.
"""

from __future__ import annotations

import fnmatch
import os
import sys
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.cells import idiv
from ..session import materialise

NAME = "blockhist_images"
SUFFIX = ".img"
SCHEMA = "dataset STRING, ord INT, cell BIGINT, payload BINARY"
#: bytes read at a time, and bytes of a split unless the caller says otherwise
CHUNK, SPLIT = 1 << 22, 1 << 27
#: bytes of an image that one task writes in a row
PIECE = 1 << 23
#: With more splits than this they grow, up to SPLIT: every split is a task with a Python process to feed
MOST_SPLITS = 1 << 12

# tasks receive this module with the job: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner


@dataclass
class Split(InputPartition):
    dataset: str
    ord: int
    path: str
    offset: int
    length: int


def splits(path: str, cell_size: int, split_size: int, pattern: str = "*") -> list[Split]:
    """The splits of all image files of a folder; each begins at a cell."""
    store, folder = file_system(path)
    found = store.get_file_info(fs.FileSelector(folder))
    split_size = max(split_size, min(SPLIT, sum(info.size or 0 for info in found) // MOST_SPLITS))
    step = max(split_size // cell_size, 1) * cell_size
    out = []
    for info in found:
        name = info.base_name
        if info.type != fs.FileType.File or not name.endswith(SUFFIX) or not fnmatch.fnmatchcase(name, pattern):
            continue
        dataset, _, number = unquote(name[:-len(SUFFIX)]).rpartition("@")
        if not dataset or not number.isdigit():
            raise ValueError(f"not an image of a version: {name}")
        out += [Split(dataset, int(number), info.path, at, min(step, info.size - at)) for at in range(0, info.size, step)]
    return out


def _extents(source, local: str | None, offset: int, end: int, cell_size: int):
    """Parts of ``offset .. end`` that can hold data, cut at cells: of local sparse files the holes are left out."""
    if local is None:
        yield offset, end
        return
    fd = os.open(local, os.O_RDONLY)
    try:
        at = offset
        while at < end:
            try:
                start = os.lseek(fd, at, os.SEEK_DATA)
            except OSError:          # nothing but a hole up to the end of the file
                return
            stop = os.lseek(fd, start, os.SEEK_HOLE)
            start = max(start // cell_size * cell_size, at)
            stop = min(-(-stop // cell_size) * cell_size, end)
            if start < stop:
                yield start, stop
            at = max(stop, at + cell_size)
    finally:
        os.close(fd)


def cells_of(split: Split, root: str, cell_size: int):
    """Record batches of the live cells of a split."""
    store, _ = file_system(root)
    local = split.path if isinstance(store, fs.LocalFileSystem) else None
    step = max(CHUNK // cell_size, 1) * cell_size
    with store.open_input_file(split.path) as source:
        for start, stop in _extents(source, local, split.offset, split.offset + split.length, cell_size):
            for at in range(start, stop, step):
                data = source.read_at(min(step, stop - at), at)
                if len(data) < min(step, stop - at):
                    raise OSError(f"{split.path}: {len(data)} bytes at {at}, expected {min(step, stop - at)}")
                data += bytes(-len(data) % cell_size)
                grid = np.frombuffer(data, dtype=np.uint8).reshape(-1, cell_size)
                live = np.flatnonzero(grid.any(axis=1))
                if len(live):
                    yield pa.record_batch(
                        [pa.array([split.dataset] * len(live)), pa.array(np.full(len(live), split.ord, dtype=np.int32)),
                         pa.array(live + at // cell_size), pa.array([grid[i].tobytes() for i in live], pa.binary())],
                        names=["dataset", "ord", "cell", "payload"])


class ImageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.cell_size = options["path"], int(options["cellsize"])
        self.split_size, self.pattern = int(options.get("splitsize", SPLIT)), options.get("files", "*")

    def partitions(self):
        return splits(self.path, self.cell_size, self.split_size, self.pattern) or [Split("", 0, "", 0, 0)]

    def read(self, partition):
        if partition.length:
            yield from cells_of(partition, self.path, self.cell_size)


@dataclass
class Written(WriterCommitMessage):
    files: list


class ImageWriter(DataSourceArrowWriter):
    """Rows (dataset, ord, size, cell, payload) sorted by version and cell; each file gets its name when all are written.

    On local and shared folders any number of tasks write into one file, each at the places of its cells; a task that
    runs again writes the same bytes. Other stores take a file from one task, in order.
    """

    def __init__(self, options):
        self.path, self.cell_size = options["path"], int(options["cellsize"])
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        store, folder = file_system(self.path)
        store.create_dir(folder)
        local = isinstance(store, fs.LocalFileSystem)
        files, current, out, size, at = [], None, None, 0, 0

        def zeros(n):
            while n > 0:
                out.write(bytes(min(n, CHUNK)))
                n -= CHUNK

        def finish():
            if out is not None:
                out.truncate(size) if local else zeros(size - at)
                out.close()
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("dataset", "ord", "size", "cell", "payload")]
            for dataset, ord_, full, cell, payload in zip(*columns):
                if (dataset, ord_) != current:
                    finish()
                    current, size, at = (dataset, ord_), full, 0
                    final = f"{folder}/{quote(dataset, safe='')}@{ord_}{SUFFIX}"
                    part = f"{folder}/.{self.run if local else uuid.uuid4().hex}-{quote(dataset, safe='')}@{ord_}.part"
                    files.append((part, final))
                    out = os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT, 0o666), "wb", CHUNK) if local else store.open_output_stream(part)
                if payload is None:
                    continue
                start = cell * self.cell_size
                piece = payload[:max(size - start, 0)]
                if start < at or not piece:
                    continue
                if start > at or at == 0:
                    out.seek(start) if local else zeros(start - at)
                out.write(piece)
                at = start + len(piece)
        finish()
        return Written(files)

    def commit(self, messages):
        store, _ = file_system(self.path)
        for part, final in sorted({f for m in messages if m for f in m.files}):
            store.move(part, final)

    def abort(self, messages):
        store, _ = file_system(self.path)
        for part in sorted({part for m in messages if m for part, _ in m.files}):
            store.delete_file(part)


class ImageFiles(DataSource):
    """Options: path, cellSize, splitSize (bytes), files (a pattern of file names)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ImageReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return ImageWriter({k.lower(): v for k, v in self.options.items()})


def read_images(spark: SparkSession, path: str, cell_size: int, split_size: int = SPLIT, files: str = "*") -> DataFrame:
    """Live cells ``(dataset, ord, cell, payload)`` of all image files of a folder, or of those whose name fits ``files``."""
    spark.dataSource.register(ImageFiles)
    return (spark.read.format(NAME).option("cellSize", cell_size).option("splitSize", split_size).option("files", files)
            .load(path))


def write_images(cells: DataFrame, versions: DataFrame, path: str, cell_size: int, piece: int = PIECE) -> None:
    """One file per version of ``versions`` (dataset, ord, size) from its live ``cells`` (dataset, ord, cell, payload).

    Cells past the size are cut; holes are left out where the file system knows sparse files. On local and shared
    folders a file is written by many tasks, ``piece`` bytes of it at a time; on other stores by one, in order. Files
    appear under their names when all of them are written.
    """
    spark = cells.sparkSession
    spark.dataSource.register(ImageFiles)
    # written: with their size known the cells need not move to meet them
    sizes = materialise(versions.select("dataset", F.col("ord").cast("int").alias("ord"), F.col("size").cast("long").alias("size")), "image-sizes")
    rows = cells.select("dataset", "ord", F.col("cell").cast("long").alias("cell"), "payload").join(sizes, ["dataset", "ord"])
    # a version without cells has a file, too
    every = rows.unionByName(sizes, allowMissingColumns=True).select("dataset", "ord", "size", "cell", "payload")
    keys = ["dataset", "ord"]
    if isinstance(file_system(path)[0], fs.LocalFileSystem):
        keys.append(F.coalesce(idiv("cell", max(piece // cell_size, 1)), F.lit(0)))
    (every.repartition(*keys).sortWithinPartitions("dataset", "ord", "cell")
     .write.format(NAME).option("cellSize", cell_size).mode("append").save(path))
