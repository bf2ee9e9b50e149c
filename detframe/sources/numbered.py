"""A stream of numbered frames: its position is a frame number, and frames that are to be dropped never leave the source.

``numbered_frames`` reads a Parquet file or folder whose rows carry a number. A batch is a range of numbers; the range is dealt
into parts, each with the files that hold such numbers by their footers. After a restart the stream goes on at the next number.
Frames come in order, so a number below the position that turns up later is not read again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as arrow_dataset
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Frame numbers of a partition.
PART_FRAMES = 100_000


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path; ``file:/x``, as Hadoop writes local paths, is ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


def data_files(path: str) -> list[str]:
    """The files of a table, hidden ones left out; a missing path is an error."""
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"frame source {path} cannot be opened")
    if info.is_file:
        return [place]
    found = system.get_file_info(arrow_fs.FileSelector(place))
    return sorted(f.path for f in found if f.is_file and f.base_name[:1] not in "._")


class _Frames(InputPartition):
    def __init__(self, first: int, end: int, files: list[str]):
        self.first, self.end, self.files = first, end, files


class _FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.number = options["path"], options["number"]
        self.rate, self.part = int(options["droprate"]), int(options["partframes"])
        self.schema = to_arrow_schema(schema)
        self.known: dict[str, tuple[int, int] | None] = {}
        data_files(self.path)

    def spans(self) -> dict[str, tuple[int, int] | None]:
        """Smallest and largest number of each file; a file's footer is read once."""
        system, _ = _open(self.path)
        for file in data_files(self.path):
            if file not in self.known:
                self.known[file] = self.span(parquet.ParquetFile(file, filesystem=system))
        return self.known

    def span(self, file: parquet.ParquetFile) -> tuple[int, int] | None:
        at = file.schema_arrow.get_field_index(self.number)
        low, high = [], []
        for group in range(file.metadata.num_row_groups):
            column = file.metadata.row_group(group).column(at)
            if column.num_values and column.statistics is not None and column.statistics.has_min_max:
                low.append(column.statistics.min)
                high.append(column.statistics.max)
            elif column.num_values:  # a writer without statistics
                values = file.read_row_group(group, [self.number]).column(0).drop_null().to_pylist()
                low += values and [min(values)]
                high += values and [max(values)]
        return (min(low), max(high)) if low else None

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max((span[1] + 1 for span in self.spans().values() if span), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = {file: span for file, span in self.spans().items() if span}
        parts = []
        for first in range(start["next"], end["next"], self.part):
            stop = min(first + self.part, end["next"])
            files = [file for file, (low, high) in spans.items() if low < stop and high >= first]
            if files:
                parts.append(_Frames(first, stop, files))
        return parts or [_Frames(0, 0, [])]

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            return
        system, _ = _open(self.path)
        number = arrow_dataset.field(self.number)
        table = arrow_dataset.dataset(partition.files, filesystem=system, format="parquet")
        inside = (number >= partition.first) & (number < partition.end)
        names = list(dict.fromkeys([*self.schema.names, self.number]))
        for batch in table.to_batches(columns=names, filter=inside):
            kept = batch.column(self.number).to_numpy(zero_copy_only=False) % self.rate == 0
            rows = pa.Table.from_batches([batch.filter(pa.array(kept))]).select(self.schema.names).cast(self.schema)
            yield from rows.to_batches()


class NumberedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_frames"

    def schema(self) -> str:
        raise ValueError("numbered_frames needs a schema")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameReader(self.options, schema)


def numbered_stream(
    spark: SparkSession, path: str, schema: str, drop_rate: int = 1, number: str = "frame_number", part_frames: int = PART_FRAMES
) -> DataFrame:
    """Unbounded frames whose ``number`` is a multiple of ``drop_rate``, with ``frame_count``, their running number.

    A path that cannot be opened and a rate below one raise here, before a query starts.
    """
    if drop_rate <= 0:
        raise ValueError("drop_rate must be greater than 0")
    data_files(path)
    spark.dataSource.register(NumberedFrames)
    reader = spark.readStream.format(NumberedFrames.name()).schema(schema)
    options = {"path": path, "number": number, "dropRate": str(drop_rate), "partFrames": str(part_frames)}
    return reader.options(**options).load().withColumn("frame_count", F.floor(F.col(number) / drop_rate))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
