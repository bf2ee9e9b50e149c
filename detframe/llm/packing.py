"""Concatenate and cut: token streams of all documents, laid end to end and cut into windows of one length.

Pass one encodes the documents in ascending doc_id order, range by range, and stores ids with their place inside the range. The
token totals of the ranges, one number each, are summed up to the place where each range begins. Pass two cuts every document
at the multiples of the window length. Only the last window of all can be short.

Defined cases: null text is empty (one piece, the end id); null doc_id comes first; equal doc_ids follow the hashes of their
texts; an empty table gives no pieces; further columns are left out. A document longer than a window gives as many pieces as it
needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detframe.llm.common import column, rows, stored
from detframe.llm.tokens import token_rows

WINDOW = 1024

PIECES = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
]
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def placed_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Stored token rows with ``base``, the ids of all ranges before their own."""
    tokens = stored(token_rows(docs, path), "tokens")
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range of the first pass: bounded by the number of tasks, not by the rows
    return tokens.join(F.broadcast(totals.select("shard", before.alias("base"))), "shard")


def pack(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with ``keep_ids`` their ids too, as little-endian unsigned 32-bit integers."""
    schema = pa.schema([*PIECES, *([("ids", pa.binary())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            places = zip(*(column(batch, n).to_pylist() for n in ("doc_id", "base", "local_start", "n_tokens", "ids")))
            for doc_id, base, local, n, ids in places:
                place, start = base + local, 0
                while start < n:
                    offset = (place + start) % window
                    length = min(window - offset, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(schema.names, (doc_id, start, length, zlib.crc32(piece), n, (place + start) // window, offset, piece)):
                        out[name].append(value)
                    start += length
            yield rows(schema, **out)

    return placed_tokens(docs, path).select("doc_id", "base", "local_start", "n_tokens", "ids").mapInArrow(
        run, PIECES_SQL + ", ids binary" * keep_ids
    )


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Whole sequences (``sequence_id``, ``length``, ``ids``) from pieces with their ids.

    A task puts together the windows whose pieces it holds; the windows at the edges of its rows leave as boundary records, and
    only these are shuffled. A group of records is one window, so it holds at most ``window`` ids. Unpadded: see ``padded_length``.
    """
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def join(parts):  # neighbours within a window become one record
            merged = []
            for offset, ids in parts:
                if merged and merged[-1][0] + len(merged[-1][1]) // 4 == offset:
                    merged[-1] = (merged[-1][0], merged[-1][1] + ids)
                else:
                    merged.append((offset, ids))
            return merged

        def record(sequence, parts):
            found = join(parts)
            return rows(schema, sequence_id=[sequence] * len(found), offset=[x[0] for x in found], length=[len(x[1]) // 4 for x in found], ids=[x[1] for x in found])

        for batch in batches:
            for sequence, offset, ids in zip(*(column(batch, n).to_pylist() for n in ("sequence_id", "offset", "ids"))):
                if sequence != current and parts:
                    yield record(current, parts)
                    parts = []
                current = sequence
                parts.append((offset, ids))
        if parts:
            yield record(current, parts)

    local = pieces.select("sequence_id", "offset", "ids").sortWithinPartitions("sequence_id", "offset")
    found = stored(local.mapInArrow(run, "sequence_id long, offset long, length long, ids binary"), "windows")
    whole = found.filter(F.col("length") == window).select("sequence_id", "length", "ids")
    edges = found.filter(F.col("length") < window).groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.unionByName(edges.select("sequence_id", "length", joined.alias("ids")))


def padded_length(length, window: int = WINDOW):
    """What a sequence takes in a batch: a power of two stays as it is, anything else is padded to the window."""
    return F.when(F.bit_count(length) == 1, F.col(length) if isinstance(length, str) else length).otherwise(F.lit(window))
