"""Best-fit packing by minimum bin slack: each sequence takes the combination of lengths that leaves the least room.

A map over the documents encodes them, cuts what is longer than a sequence, and numbers the pieces of each length inside its task.
How many pieces there are of each length is all the packing needs: at most ``CAPACITY`` counts, whatever the input. On these counts a bin starts
with the longest length left; a bitset dynamic programme over the lengths still available finds the fullest sum that fits the rest,
and the combination is taken as often as its lengths allow, which is what bin-by-bin packing would do. Each step leaves less than
half of one length's pieces, so there are at most CAPACITY * log2(pieces) different combinations. Pieces then find their
sequence by their rank among the pieces of their length: no group is ever gathered.

Defined cases: null text is empty (one piece, the end id); null and repeated doc_ids are documents like others; equal texts are
packed each for itself; an empty table gives no pieces; further columns are left out.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, rows, stored
from detframe.llm.tokens import _byte_letters

CAPACITY = 4096
END = (1).to_bytes(4, "little")
#: Different words whose ids a worker keeps; above it, it forgets all and goes on. Texts put into one output batch.
KEPT_WORDS, TOGETHER = 1_000_000, 256


class _Words(dict):
    """Word (no blank or line end inside) -> its ids as little-endian unsigned 32-bit integers, found when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, word: str) -> bytes:
        packed = self.packed
        if word.isalpha() and (word.isascii() or max(word) < "\u0250" and word.lower().isalpha()):  # one piece of composed Latin letters
            low = word.lower()  # the vocabulary knows lower case only
            piece = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            found = self[low] if low != word else b"".join([packed[x.id] for x in self.merge(piece)])
        elif word[-1:] in (".", ",") and word[:-1].isalpha() and word.lower()[:-1].isalpha():  # letters and signs are never one piece
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = b"".join([packed[x] for x in self.tokenizer.encode(word, add_special_tokens=False).ids])
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


_words: dict[str, _Words] = {}


def encode(text: str, path: str) -> bytes:
    """Ids of a text: the vocabulary drops white space and never joins what stands on both sides of a blank or a line end."""
    if path not in _words:
        _words[path] = _Words(path)
    return b"".join(map(_words[path].__getitem__, text.replace("\n", " ").split(" ")))


PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids, stored, with their task (``shard``) and number among its pieces of that length (``nth``)."""
    schema = pa.schema([*PIECES, ("shard", pa.int32()), ("nth", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            texts, ids = byte_texts(column(batch, "text")), column(batch, "doc_id").to_pylist()
            for first in range(0, len(texts), TOGETHER):
                made: list[tuple] = []
                for doc_id, text in zip(ids[first : first + TOGETHER], texts[first : first + TOGETHER]):
                    data = encode(text.decode("utf-8", "replace"), path) + END
                    for number, begin in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[begin : begin + 4 * capacity]
                        length = len(part) // 4
                        made.append((doc_id, number, begin // 4, length, zlib.crc32(part), shard, seen[length], part))
                        seen[length] += 1
                yield rows(schema, **dict(zip((*(f[0] for f in PIECES), "shard", "nth", "ids"), map(list, zip(*made)))))

    return stored(docs.select("doc_id", "text").mapInArrow(run, PIECES_SQL + ", shard int, nth long" + ", ids binary" * keep_ids), "pieces")


class Slack:
    """Counts of lengths, from which the fullest combinations are taken one after another."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.mask = capacity, (1 << (capacity + 1)) - 1
        self.lengths = sorted(n for n, c in counts.items() if c > 0)
        self.counts = [counts[n] for n in self.lengths]
        #: sums[k]: bit s is set if lengths[:k] can add up to s; the first ``sound`` are up to date.
        self.sums, self.sound = [1] + [0] * len(self.lengths), 1

    def _set(self, k: int, count: int) -> None:
        most = self.capacity // self.lengths[k]
        if min(count, most) != min(self.counts[k], most):
            self.sound = min(self.sound, k + 1)
        self.counts[k] = count

    def _reach(self, upto: int) -> int:
        for k in range(self.sound, upto + 1):
            bits, length, left, step = self.sums[k - 1], self.lengths[k - 1], self.counts[k - 1], 1
            left = min(left, self.capacity // length)
            while left:  # 1, 2, 4, ... copies add up to any number of copies
                step = min(step, left)
                bits |= bits << (step * length)
                left -= step
                step *= 2
            self.sums[k] = bits & self.mask
        self.sound = max(self.sound, upto + 1)
        return self.sums[upto]

    def fullest(self, seed: int) -> dict[int, int]:
        """Length index -> copies: one of ``seed`` and what fills the rest best, long lengths first among equal sums."""
        self._set(seed, self.counts[seed] - 1)
        room = self.capacity - self.lengths[seed]
        upto = bisect_right(self.lengths, room)
        left = (self._reach(upto) & ((1 << (room + 1)) - 1)).bit_length() - 1
        taken = {seed: 1}
        while left:
            upto = bisect_right(self.lengths, left, 0, upto)
            length, below = self.lengths[upto - 1], self.sums[upto - 1]
            copies = min(self.counts[upto - 1], left // length)
            while not below >> (left - copies * length) & 1:
                copies -= 1
            if copies:
                taken[upto - 1] = taken.get(upto - 1, 0) + copies
            left -= copies * length
            upto -= 1
        self._set(seed, self.counts[seed] + 1)
        return taken

    def combinations(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(times, [(length, copies), ...]) until nothing is left."""
        last = len(self.lengths) - 1
        while last >= 0:
            if not self.counts[last]:
                last -= 1
                continue
            taken = self.fullest(last)
            times = min(self.counts[k] // n for k, n in taken.items())
            for k, n in taken.items():
                self._set(k, self.counts[k] - times * n)
            yield times, [(self.lengths[k], n) for k, n in sorted(taken.items(), reverse=True)]


def places(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, copies in a sequence, offset there), ascending by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, taken in Slack(counts, capacity).combinations():
        offset = 0
        for length, copies in taken:
            found.setdefault(length, []).append((used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return {n: np.array(x, np.int64) for n, x in found.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there; with ``keep_ids`` its ids too."""
    pieces = cut(docs, path, capacity, keep_ids)
    held = stored(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    # at most ``capacity`` rows reach the driver
    totals = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(places(totals, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [*(f[0] for f in PIECES), *(["ids"] if keep_ids else [])]
    schema = pa.schema([*PIECES, *([("ids", pa.binary())] if keep_ids else []), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (column(batch, n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                table, rank, length = plan.value[int(lengths[own[0]])], ranks[own], lengths[own]
                at = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
                nth = rank - at[:, 0]
                sequence[own] = at[:, 1] + nth // at[:, 2]
                offset[own] = at[:, 3] + nth % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(sequence), pa.array(offset)], schema=schema)

    ranked = pieces.join(held.select("shard", "length", before.alias("before")), ["shard", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select(*names, "rank").mapInArrow(run, PIECES_SQL + ", ids binary" * keep_ids + ", sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences (``sequence_id``, ``length``, ``ids``) from pieces with their ids; a group holds one sequence at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return grouped.select("sequence_id", "length", joined.alias("ids"))
