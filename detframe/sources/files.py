"""Folders of many small files as rows, through the Python data source API.

Spark's text source drops empty files and its whole-file reader ignores the session's partitioning. Here a task lists a folder once and
deals it into partitions by bytes and by number of files, as Spark's own scans do. The names of a partition are stored in the shared
folder as they are found, so the driver holds none of them; each task then opens its files, all through Arrow's file systems. An empty
file is a row like any other. Two sources share this:

* ``label_files``: ``path, stem, label_text`` of every matching file;
* ``image_headers``: ``path, stem, width, height`` from the first bytes of JPEG, PNG, GIF and BMP files, pixels untouched; a file that
  is none of these has null sizes, so that it can be counted.

The classes travel to the workers as they are, so these need no copy of this package.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from detframe.session import work_dir

#: Most bytes and files of a partition, and what opening a file counts as, in bytes.
PARTITION_BYTES, PARTITION_FILES, OPEN_BYTES = 64 << 20, 4_096, 16 << 10
#: Rows in an output batch, and their text at most.
BATCH_ROWS, BATCH_BYTES = 1_024, 8 << 20
#: Bytes read of an image: enough for the sizes of all but JPEGs with long headers, which are read on in further steps.
HEAD = 4_096


def listed(folder: str, glob: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the matching files of a folder; those of a local folder one by one, others as Arrow lists them, all at once."""
    system, root = _open(folder)
    if isinstance(system, arrow_fs.LocalFileSystem):
        with os.scandir(root) as entries:
            for entry in entries:
                if fnmatch.fnmatchcase(entry.name, glob) and entry.is_file():
                    yield f"{folder.rstrip('/')}/{entry.name}", entry.stat().st_size
        return
    for f in system.get_file_info(arrow_fs.FileSelector(root)):
        if f.is_file and fnmatch.fnmatchcase(f.base_name, glob):
            yield f"{folder.rstrip('/')}/{f.base_name}", f.size


def parts_of(files: Iterable[tuple[str, int]], most_bytes: int, most_files: int) -> Iterator[list[str]]:
    """Neighbouring files put together up to a number of bytes and of files, one part at a time."""
    part: list[str] = []
    held = 0
    for path, size in files:
        cost = size + OPEN_BYTES
        if part and (held + cost > most_bytes or len(part) >= most_files):
            yield part
            part, held = [], 0
        part.append(path)
        held += cost
    if part:
        yield part


def dealt(files: list[tuple[str, int]], most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES) -> list[list[str]]:
    return list(parts_of(files, most_bytes, most_files))


def _lister(folder: str, glob: str, most_bytes: int, most_files: int, shared: str) -> Callable:
    """The listing as a task: a file of names for each part in a folder of the attempt's own; its row tells the folder and the number of parts."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = f"{shared}/listing-{uuid.uuid4().hex}"
        system, root = _open(place)
        system.create_dir(root, recursive=True)
        count = 0
        for part in parts_of(listed(folder, glob), most_bytes, most_files):
            with system.open_output_stream(f"{root}/{count}.json") as out:
                out.write(json.dumps(part).encode())
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([count], pa.int32())], ["place", "parts"])

    return run


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else ""


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path; ``file:/x``, as Hadoop writes local paths, is ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


def image_size(read) -> tuple[int, int] | None:
    """(width, height) of an image by its header; ``read(offset, bytes)`` gives bytes of the file."""
    head = read(0, HEAD)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:  # segments of a JPEG up to the one that begins a frame
        mark = read(at, 9)
        if len(mark) < 9 or mark[0] != 0xFF:
            return None
        if mark[1] == 0xFF:  # fill byte
            at += 1
        elif 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height
        elif mark[1] in (0x01, *range(0xD0, 0xD9)):  # marks without a length
            at += 2
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]


class _Files(InputPartition):
    """A part of a stored listing."""

    def __init__(self, names: str):
        self.names = names

    def paths(self) -> list[str]:
        system, place = _open(self.names)
        with system.open_input_stream(place) as stream:
            return json.loads(stream.read())


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.place, self.parts, self.schema = options["place"], int(options["parts"]), schema

    def partitions(self) -> list[InputPartition]:
        return [_Files(f"{self.place}/{k}.json") for k in range(self.parts)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in partition.paths():
            system, place = _open(path)
            row = self.row(system, place)
            rows.append((path, stem(path), *row))
            size += len(row[0] or "") if isinstance(row[0], str) else 0
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), self.schema)], schema=self.schema)


class _LabelReader(_Reader):
    def row(self, system: arrow_fs.FileSystem, place: str) -> tuple:
        with system.open_input_stream(place) as stream:
            return (stream.read().decode("utf-8", "replace"),)


class _HeaderReader(_Reader):
    def row(self, system: arrow_fs.FileSystem, place: str) -> tuple:
        with system.open_input_file(place) as file:
            end = file.size()
            found = image_size(lambda at, n: file.read_at(min(n, max(0, end - at)), at) if at < end else b"")
        return found if found is not None else (None, None)


class LabelFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "path string, stem string, label_text string"

    def reader(self, schema) -> DataSourceReader:
        return _LabelReader(self.options, pa.schema([("path", pa.string()), ("stem", pa.string()), ("label_text", pa.string())]))


class ImageHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, stem string, width int, height int"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options, pa.schema([("path", pa.string()), ("stem", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))


def read_files(spark: SparkSession, source: type[DataSource], folder: str, glob: str, most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES) -> DataFrame:
    """Rows of ``source`` for the matching files of a folder."""
    spark.dataSource.register(source)
    system, root = _open(folder)
    if system.get_file_info(root).type != arrow_fs.FileType.Directory:
        raise FileNotFoundError(f"no folder {folder}")
    lister = _lister(folder, glob, most_bytes, most_files, f"{work_dir(spark)}/detframe")
    found = spark.range(0, 1, 1, 1).mapInArrow(lister, "place string, parts int").collect()[0]
    if not found.parts:
        return spark.createDataFrame([], source.schema(source))
    return spark.read.format(source.name()).option("place", found.place).option("parts", found.parts).load()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
