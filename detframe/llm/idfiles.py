"""Token-id files: one shared zstandard dictionary, every document compressed by itself, an offset index for single reads.

A shard file holds ``MAGIC``, the 32-byte hash of the dictionary, the compressed id arrays (magicless zstandard frames) in ascending doc_id order, one
``INDEX`` entry for each document, then ``TAIL`` (where the index begins, entries, bytes of an id) and ``MAGIC`` again. The
dictionary lies beside the shards as ``<hash>.dict``. Ids are stored in two bytes where all of them fit, else in four.

Defined cases: null text is empty (only the end id); null doc_id comes first and reads back as null; equal doc_ids follow the
order of their texts' hashes; an empty table gives no shard and no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, rows, shared_folder, stored
from detframe.llm.tokens import encoded, in_order

MAGIC = b"IDSHARD1"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("tokens", "<u8")])
TAIL = "<QQB"
#: The dictionary is trained on this many documents, the smallest by a hash of their ids and texts, and a window of so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1_000, 8_192, 65_536, 3


def narrow(ids: bytes) -> tuple[bytes, int]:
    """32-bit ids as 16-bit ones where they fit, and the bytes of an id."""
    wide = np.frombuffer(ids, "<u4")
    return (wide.astype("<u2").tobytes(), 2) if wide.size == 0 or wide.max() < 65_536 else (ids, 4)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary for id arrays; empty if there is too little to train on.

    Tasks keep the smallest hashes, so the driver sees ``SAMPLE_DOCS`` id arrays of at most ``SAMPLE_IDS`` ids, whatever the input.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_texts(column(batch, "text")):
                # the window's place is a hash of the text, so all parts of long texts are alike likely
                for ids in encoded([text], path):
                    begin = zlib.crc32(text) % max(1, len(ids) // 4 - SAMPLE_IDS + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([narrow(ids[4 * begin : 4 * (begin + SAMPLE_IDS)])[0]], pa.binary())], ["ids"])

    sample = [bytes(r[0]) for r in keyed.orderBy("h").limit(SAMPLE_DOCS).mapInArrow(run, "ids binary").collect()]
    size = max(256, min(DICTIONARY_BYTES, sum(map(len, sample)) // 10))
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


def compressor(trained: bytes) -> zstandard.ZstdCompressor:
    """Frames without the marks that every document would repeat: the file names the format and the dictionary once."""
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_dict_id=False, write_content_size=True)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def decompressor(trained: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


SHARD = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_ids(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; one row per shard file (``shard``, ``file``, ``docs``, ``tokens``, ``bytes``).

    A shard is one range of ascending doc_ids. A task writes to a name of its own attempt and renames it when complete, so a lost
    executor leaves nothing half written under a shard's name.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "ids")
    trained = train_dictionary(docs, path)
    name = hashlib.sha256(trained).hexdigest()
    filesystem, root = _open(folder)
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/{name}.dict") as out:
        out.write(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = _open(folder)
        task = TaskContext.get()
        shard = task.partitionId()
        final, own = f"{at}/shard-{shard:06d}.ids", f"{at}/.shard-{shard:06d}.{task.taskAttemptId()}"
        compress = compressor(trained).compress
        entries, position, tokens, out = [], len(MAGIC) + 32, 0, None
        for batch in batches:
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoded(byte_texts(column(batch, "text")), path)):
                if out is None:
                    out = here.open_output_stream(own)
                    out.write(MAGIC + hashlib.sha256(trained).digest())
                data, width = narrow(ids)
                frame = bytes([width]) + compress(data)
                out.write(frame)
                entries.append((doc_id or 0, doc_id is None, position, len(frame), len(ids) // 4))
                position, tokens = position + len(frame), tokens + len(ids) // 4
        if out is None:
            return
        index = np.array(entries, INDEX).tobytes()
        out.write(index + struct.pack(TAIL, position, len(entries), 4) + MAGIC)
        out.close()
        here.move(own, final)
        yield rows(SHARD, shard=[shard], file=[f"shard-{shard:06d}.ids"], docs=[len(entries)], tokens=[tokens], bytes=[position + len(index) + struct.calcsize(TAIL) + len(MAGIC)])

    files = in_order(docs).mapInArrow(run, "shard int, file string, docs long, tokens long, bytes long")
    return stored(files.withColumn("folder", F.lit(folder)), "shards")


class ShardReader:
    """A shard file opened for reading: the index at once, documents one by one."""

    def __init__(self, folder: str, file: str):
        self.filesystem, root = _open(folder)
        self.file = self.filesystem.open_input_file(f"{root}/{file}")
        size, last = self.file.size(), struct.calcsize(TAIL) + len(MAGIC)
        tail = self.file.read_at(last, size - last)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if not tail.endswith(MAGIC) or not head.startswith(MAGIC):
            raise ValueError(f"{file} is not a complete shard")
        begin, count, _ = struct.unpack(TAIL, tail[: struct.calcsize(TAIL)])
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, begin), INDEX)
        name = head[len(MAGIC) :].hex()
        with self.filesystem.open_input_stream(f"{root}/{name}.dict") as stream:
            trained = stream.read()
        if hashlib.sha256(trained).hexdigest() != name:
            raise ValueError(f"the dictionary of {file} has changed")
        self.reader = decompressor(trained)

    def ids(self, place: int) -> bytes:
        """The 32-bit ids of the document at a place of the index; reads only its bytes."""
        entry = self.index[place]
        frame = self.file.read_at(int(entry["size"]), int(entry["offset"]))
        return self._wide(frame)

    def _wide(self, frame: bytes) -> bytes:
        data = self.reader.decompress(frame[1:])
        return np.frombuffer(data, "<u2").astype("<u4").tobytes() if frame[0] == 2 else data

    def documents(self, together: int = 4 << 20) -> Iterator[tuple[np.void, bytes]]:
        """Index entry and ids of every document, in file order, read in stretches of about ``together`` bytes."""
        first = 0
        while first < len(self.index):
            begin, last = int(self.index[first]["offset"]), first
            while last < len(self.index) and int(self.index[last]["offset"]) - begin < together:
                last += 1
            end = self.index[last - 1]
            data = self.file.read_at(int(end["offset"]) + int(end["size"]) - begin, begin)
            for entry in self.index[first:last]:
                at = int(entry["offset"]) - begin
                yield entry, self._wide(data[at : at + int(entry["size"])])
            first = last


def find(shards: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Ids of one document by the offset index of the files; opens the index of each shard, and decompresses that document alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file in zip(column(batch, "folder").to_pylist(), column(batch, "file").to_pylist()):
                reader = ShardReader(folder, file)
                for place in np.flatnonzero((reader.index["doc_id"] == doc_id) & (reader.index["null"] == 0)):
                    yield pa.RecordBatch.from_arrays([pa.array([reader.ids(int(place))], pa.binary())], ["ids"])

    return [np.frombuffer(bytes(r[0]), "<u4") for r in shards.mapInArrow(run, "ids binary").collect()]


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("stored_bytes", pa.int64()), ("shard", pa.int32())])


def read_ids(shards: DataFrame) -> DataFrame:
    """Read the files back: one row per document with the ids of all documents before it, its count and its checksum."""
    spark = shards.sparkSession
    # one row per file, so this window stays small whatever the input
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("shard", "folder", "file", before.alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                start, found = item["base"], []
                for entry, ids in ShardReader(item["folder"], item["file"]).documents():
                    n = len(ids) // 4
                    found.append((None if entry["null"] else int(entry["doc_id"]), start, n, zlib.crc32(ids), int(entry["size"])))
                    start += n
                    if len(found) == 4096:
                        yield _read_rows(found, item["shard"])
                        found = []
                if found:
                    yield _read_rows(found, item["shard"])

    def _read_rows(found, shard):
        a, b, c, d, e = zip(*found)
        return rows(READ, doc_id=list(a), start=list(b), n_tokens=list(c), ids_crc32=list(d), stored_bytes=list(e), shard=[shard] * len(a))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, stored_bytes long, shard int"
    )
