"""Quality rules: fixed rules first, then a length-normalised log-likelihood ratio of hashed byte n-grams.

Two multinomials over hashed n-grams are counted: one over the trusted documents, one over the whole raw corpus. A document's
score is the mean over its n-grams of log(trusted / raw), and every document is held against one threshold; nothing is drawn.

Defined cases: null text has no words, so it fails the rules; a document without n-grams scores 0; without any trusted document
all weights are 0 and the rules alone decide; equal rows get equal verdicts; further columns are left out (``judge``) or kept
(``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, filtered, pick, rows

GRAM_BYTES, BUCKETS = 4, 65_536
#: Mean log ratio of an n-gram below which a document is turned away.
THRESHOLD = -0.5
#: The trusted counts are drawn towards the raw shares by so many n-grams, so that few trusted documents turn little away.
PRIOR_GRAMS = 100_000.0
MIN_WORDS, REPEAT_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_BLANKS, _SYMBOLS = list(b" \t\n\x0b\x0c\r"), list(SYMBOLS)


def gram_buckets(text: bytes) -> np.ndarray:
    """The bucket of each n-gram of a text."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if data.size < GRAM_BYTES:
        return np.empty(0, np.uint32)
    code = data[: data.size - GRAM_BYTES + 1].copy()
    for k in range(1, GRAM_BYTES):
        code = (code << np.uint32(8)) | data[k : data.size - GRAM_BYTES + 1 + k]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all texts: a task sends one row per bucket it met, the driver gets ``BUCKETS`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                counts += np.bincount(gram_buckets(text), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


@dataclass
class Ratio:
    """Log ratio of each bucket, and the threshold."""

    weights: np.ndarray
    threshold: float = THRESHOLD

    def score(self, text: bytes) -> float:
        buckets = gram_buckets(text)
        return float(self.weights[buckets].mean()) if buckets.size else 0.0


def fit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> Ratio:
    """Weights from all documents (raw) and from all whose label says quality 1 (trusted)."""
    trusted = count_grams(pick(docs, labels.filter(F.col("quality") == 1)))
    raw = count_grams(docs)
    if not trusted.sum():
        return Ratio(np.zeros(BUCKETS), threshold)

    share = (raw + 0.01) / (raw.sum() + 0.01 * BUCKETS)
    return Ratio(np.log((trusted + PRIOR_GRAMS * share) / (trusted.sum() + PRIOR_GRAMS) / share), threshold)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``REPEAT_WORDS`` words that the text holds twice or more."""
    n = len(words) - REPEAT_WORDS + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(REPEAT_WORDS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    places: dict[tuple, list[int]] = {}
    for start in np.flatnonzero(np.isin(keys, twice)):  # equal keys are held against the words themselves
        places.setdefault(tuple(words[start : start + REPEAT_WORDS]), []).append(int(start))
    edges = np.zeros(len(words) + 1, np.int64)
    for starts in places.values():
        if len(starts) > 1:
            edges[starts] += 1
            edges[np.array(starts) + REPEAT_WORDS] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(seen[:128].sum() + seen[192:].sum() - seen[_BLANKS].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, failed


VERDICTS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()),
])


def judge(docs: DataFrame, model: Ratio) -> DataFrame:
    """One row per document: what the rules counted, the ratio, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(column(batch, "text"))
            found = [measures(x) for x in texts]
            ratios = [model.score(x) for x in texts]
            words, chars, symbols, lines, repeated, failed = zip(*found) if found else [()] * 6
            yield rows(
                VERDICTS, doc_id=column(batch, "doc_id").to_pylist(), n_words=words, word_chars=chars, n_symbols=symbols, n_dup_lines=lines,
                n_repeat_words=repeated, base_failed=failed, kept=[not f and r >= model.threshold for f, r in zip(failed, ratios)], ratio=ratios,
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"
    )


def keep_good(docs: DataFrame, model: Ratio) -> DataFrame:
    """The rows whose text passes the rules and the ratio, all columns as they are."""

    def keeps(texts: list[bytes]) -> list[bool]:
        return [not measures(x)[5] and model.score(x) >= model.threshold for x in texts]

    return filtered(docs, keeps)
