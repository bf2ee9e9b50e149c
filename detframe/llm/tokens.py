"""Token ids of whole texts with the tokenizers library, in ascending order of documents.

The vocabulary splits a text into pieces before it merges bytes, and a single space between two other characters always begins
such a piece; so is a single line end a piece of its own. So a text may be cut before each of these; the library's model is asked once for each different part, and
the worker keeps the answers. A text with other white space beside a space is cut only where the rule holds. A written special
token holds no white space and ends no part early, so the library's default holds: it becomes its own id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, rows

#: Different parts whose ids a worker keeps; above it, it forgets all and goes on.
KEPT_PARTS = 1_000_000
#: Texts that are put into one output batch.
TOGETHER = 256
END = b"\x00\x00\x00\x00"

_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, "PartEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Parts(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers, found when first asked for."""

    def __init__(self, tokenizer, prefix: str, first: "_Parts | None" = None):
        super().__init__()
        self.tokenizer, self.prefix, self.first = tokenizer, prefix, first if first is not None else self
        self.merge, self.letters = tokenizer.model.tokenize, _byte_letters()
        self.lead = prefix.translate(self.letters)
        self.packed = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, part: str) -> bytes:
        packed, last = self.packed, part[-1:]
        if part.isalpha() and (part.isascii() or max(part) < "\u0250"):  # one piece of Latin letters
            piece = self.lead + (part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
            found = b"".join([packed[x.id] for x in self.merge(piece)])
        elif last and last in ".," and part[:-1].isalpha():  # letters, then one sign
            found = self[part[:-1]] + packed[self.merge(last)[0].id]
        elif part.startswith("\n") and self.first is not self:  # a line end that is a piece of its own, then the next line's beginning
            found = self.first["\n"] + self.first[part[1:]]
        else:
            found = b"".join([packed[x] for x in self.tokenizer.encode(self.prefix + part, add_special_tokens=False).ids])
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[part] = found
        return found


class PartEncoder:
    """Ids of texts, equal to what the library gives for each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.first = _Parts(tokenizer, "")
        self.later = _Parts(tokenizer, " ", self.first)

    def encode(self, text: str) -> bytes:
        if (
            "  " in text or " \n" in text or "\n " in text or "\n\n" in text
            or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or _WIDE_SPACE.search(text)
        ):
            parts = _CUT.split(text)
        else:
            parts = text.replace("\n", " \n").split(" ")
        head = parts.pop(0)
        return self.first[head] + b"".join(map(self.later.__getitem__, parts))


def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def encoded(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text followed by the end id 0."""
    encode = encoder(path).encode
    for text in texts:
        yield encode(text.decode("utf-8", "replace")) + END


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` dealt into ranges of ascending doc_id (null first), equal ids by their text.

    The text's hash is part of the order, so a third of all rows with one id still spreads over many ranges.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    order = ("doc_id", "tie", "text")
    return keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).select("doc_id", "text")


TOKENS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
TOKENS_SQL = "shard int, doc_id long, local_start long, n_tokens long, ids binary"


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """One row per document in order: its range (``shard``), ids before it there, ids with the end id as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = byte_texts(column(batch, "text")), column(batch, "doc_id").to_pylist()
            for k in range(0, len(texts), TOGETHER):
                data = list(encoded(texts[k : k + TOGETHER], path))
                counts = [len(x) // 4 for x in data]
                starts = []
                for n in counts:
                    starts.append(start)
                    start += n
                yield rows(TOKENS, shard=[shard] * len(data), doc_id=ids[k : k + TOGETHER], local_start=starts, n_tokens=counts, ids=data)

    return in_order(docs).mapInArrow(run, TOKENS_SQL)
