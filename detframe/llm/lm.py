"""Language-model scores: prediction by partial matching over bytes, beside a smoothed word model.

The byte model is a trie of contexts of up to ``ORDER`` bytes with the counts of what followed them in the training texts. A
symbol is predicted by the longest context that is known; one that the context never saw is reached by an escape (its share: the
different symbols seen there), and shorter contexts leave out what the longer one could have said (symbol exclusion). The
probability of a symbol depends on the ``ORDER`` symbols before it alone, so it is worked out once for each different run of
``ORDER + 1`` symbols that stands anywhere in the corpus, and texts only look it up.

No table of the corpus is sent to every task. Texts are gathered into chunks of ``CHUNK_BYTES``; a chunk asks for its different
words and runs, these are counted over all chunks, and the answers go back to the chunk that asked.

Defined cases: null text is empty (its end alone is scored); a null doc_id belongs to the training rows; without training rows
all symbols are equally likely; equal texts get equal scores; further columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, fold, rows, stored

ORDER, BITS, END = 4, 9, 256
SYMBOLS = END + 1
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES, FLUSH_RUNS, ROWS_OUT = 32 << 20, 1 << 21, 1 << 16


def mask(order: int) -> int:
    """Bits of a symbol and the ``order`` symbols before it."""
    return (1 << (BITS * (order + 1))) - 1


def runs_of(text: bytes) -> np.ndarray:
    """For each symbol of a text and its end, the number of the run of it and the symbols before; ends stand before the text."""
    symbols = np.full(len(text) + ORDER + 1, END, np.int64)
    symbols[ORDER:-1] = np.frombuffer(text, np.uint8)
    found = symbols[ORDER:].copy()
    for k in range(1, ORDER + 1):
        found |= symbols[ORDER - k : symbols.size - k] << (BITS * k)
    return found


def held_out(doc_id: int | None) -> bool:
    return fold(doc_id, FOLDS) == HELD_OUT


class _Chunk:
    """Texts and what they hold: words and runs with their counts in training texts (0: held-out texts only)."""

    def __init__(self):
        self.ids, self.texts, self.bytes = [], [], 0
        self.words, self.other_words = Counter(), set()
        self.waiting, self.waiting_size, self.parts = ([], []), 0, []

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.texts.append(text)
        self.bytes += len(text) + 16
        words, apart = text.lower().split(), held_out(doc_id)
        if apart:
            self.other_words.update(words)
            self.other_words.add(b"")
        else:
            self.words.update(words)
            self.words[b""] += 1
        for k in range(0, len(text) + 1, FLUSH_RUNS):  # a very long text in stretches, each with the symbols before it
            stretch = runs_of(text) if len(text) < FLUSH_RUNS else runs_of(text[max(0, k - ORDER) : k + FLUSH_RUNS])[ORDER if k else 0 :]
            if len(text) >= FLUSH_RUNS and k + FLUSH_RUNS < len(text) + 1:
                stretch = stretch[:FLUSH_RUNS]
            self.waiting[apart].append(stretch)
            self.waiting_size += stretch.size
            if self.waiting_size >= FLUSH_RUNS:
                self._flush()

    def _flush(self) -> None:
        for apart in (0, 1):
            if self.waiting[apart]:
                counts = pd.Series(np.concatenate(self.waiting[apart])).value_counts(sort=False)
                self.parts.append(counts * (1 - apart))
                self.waiting[apart].clear()
        self.waiting_size = 0
        if len(self.parts) > 16:
            self.parts = [self._joined()]

    def _joined(self) -> pd.Series:
        return pd.concat(self.parts).groupby(level=0, sort=False).sum()

    def batches(self, chunk: int) -> Iterator[pa.RecordBatch]:
        self._flush()
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "text": pa.array(self.texts, pa.large_binary())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield rows(CHUNKS, chunk=[chunk], docs=[sink.getvalue().to_pybytes()], word=[None], run=[None], n=[None])
        self.texts, self.ids = [], []
        words = [*self.words, *(self.other_words - self.words.keys())]
        for k in range(0, len(words), ROWS_OUT):
            part = words[k : k + ROWS_OUT]
            yield rows(CHUNKS, chunk=[chunk] * len(part), docs=[None] * len(part), word=part, run=[None] * len(part), n=[self.words[x] for x in part])
        found = self._joined()
        runs, counts = found.index.to_numpy(), found.to_numpy()
        for k in range(0, len(runs), ROWS_OUT):
            part = runs[k : k + ROWS_OUT]
            yield rows(CHUNKS, chunk=[chunk] * len(part), docs=[None] * len(part), word=[None] * len(part), run=part, n=counts[k : k + ROWS_OUT])


CHUNKS = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("word", pa.binary()), ("run", pa.int64()), ("n", pa.int64())])


def chunks(docs: DataFrame) -> DataFrame:
    """Stored: for each chunk one row with its texts, and one for each different word and run with its count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, own = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), byte_texts(column(batch, "text"))):
                own.add(doc_id, text)
                if own.bytes >= CHUNK_BYTES:
                    yield from own.batches((task << 32) + number)
                    number, own = number + 1, _Chunk()
        if own.ids:
            yield from own.batches((task << 32) + number)

    return stored(docs.select("doc_id", "text").mapInArrow(run, "chunk long, docs binary, word binary, run long, n long"), "chunks")


def pair_counts(runs: DataFrame) -> np.ndarray:
    """Training counts of each symbol after each symbol; 257 x 257 at most, whatever the corpus."""
    found = runs.groupBy(F.col("run").bitwiseAND(mask(1)).alias("pair")).agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    counts = np.zeros((1 << BITS) * (1 << BITS))
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(1 << BITS, 1 << BITS)


def log_probabilities(runs: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each run; ``runs`` holds all runs that share their last two context symbols, or more such groups."""
    result, open_ = np.zeros(len(runs)), np.ones(len(runs), bool)
    seen_above = np.zeros(len(runs), bool)  # whether the context one longer was seen
    left_out, left_out_kinds = np.zeros(len(runs)), np.zeros(len(runs))
    keys, counts, longer = None, None, None

    def step(count, total, kinds, seen):
        nonlocal open_, seen_above
        total, kinds = total - np.where(seen_above, left_out, 0), kinds - np.where(seen_above, left_out_kinds, 0)
        hit, escape = open_ & seen & (count > 0), open_ & seen & (count == 0) & (kinds > 0)
        result[hit] += np.log10(count[hit] / (total + kinds)[hit])
        result[escape] += np.log10(kinds[escape] / (total + kinds)[escape])
        open_, seen_above = open_ & ~hit, seen

    for order in range(ORDER, 1, -1):
        keys, inverse = np.unique(runs & mask(order), return_inverse=True)
        counts = np.bincount(inverse, n, len(keys))
        contexts, of = np.unique(keys >> BITS, return_inverse=True)
        total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, counts > 0, len(contexts))
        if longer is not None:  # what the longer context has seen is left out here
            own = counts[np.searchsorted(keys, longer[0] & mask(order))]
            said = np.bincount(longer[2], own * (longer[1] > 0), longer[3])
            left_out, left_out_kinds = said[longer[4]], longer[5][longer[4]]
        context = of[inverse]
        step(counts[inverse], total[context], kinds[context], total[context] > 0)
        longer = (keys, counts, of, len(contexts), context, kinds)
    # order 1 and 0 from the counts of pairs
    last, symbol = (runs >> BITS) & mask(0), runs & mask(0)
    own = pairs[(longer[0] >> BITS) & mask(0), longer[0] & mask(0)]
    left_out, left_out_kinds = np.bincount(longer[2], own * (longer[1] > 0), longer[3])[longer[4]], longer[5][longer[4]]
    totals, kinds = pairs.sum(1), (pairs > 0).sum(1)
    step(pairs[last, symbol], totals[last], kinds[last].astype(float), totals[last] > 0)
    single = pairs.sum(0)
    left_out, left_out_kinds = ((pairs > 0) * single).sum(1)[last], kinds[last].astype(float)
    known = float((single > 0).sum())
    step(single[symbol], np.full(len(runs), single.sum()), np.full(len(runs), known), np.full(len(runs), single.sum() > 0))
    result[open_] -= math.log10(max(1.0, SYMBOLS - known))
    return result


def run_scores(runs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``run`` and the log10 probability of its last symbol, for each different run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(frames)
        if found:
            frame = pd.concat(found)
            yield pd.DataFrame({"run": frame["run"], "value": log_probabilities(frame["run"].to_numpy(), frame["n"].to_numpy(np.float64), pairs)})

    # contexts that share their last two symbols meet in one task: at most 257 ** ORDER different runs, and in practice a few thousand
    suffix = F.shiftright("run", BITS).bitwiseAND(mask(1))
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, suffix).mapInPandas(run, "run long, value double")


SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("word_logs", pa.float64()), ("score", pa.float64()),
    ("n_bytes", pa.int64()),
])
SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, word_logs double, score double, n_bytes long"


def _score_chunk(texts: pa.Table, answers: pa.Table) -> pa.Table:
    is_word = answers.column("word").is_valid()
    words = answers.filter(is_word)
    logs = dict(zip(words.column("word").to_pylist(), np.log10(words.column("value").to_numpy() + 1)))
    runs = answers.filter(answers.column("run").is_valid())
    index, values = pd.Index(runs.column("run").to_numpy()), runs.column("value").to_numpy()
    out = {name: [] for name in SCORES.names}
    for blob in texts.column("docs").to_pylist():
        table = pa.ipc.open_stream(blob).read_all()
        ids, data = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        for doc_id, text in zip(ids, data):
            own = text.lower().split()
            found = np.fromiter(map(logs.__getitem__, [*own, b""]), np.float64, len(own) + 1)
            score = math.fsum(float(values[index.get_indexer(part)].sum()) for part in _stretches(text))
            for name, value in zip(SCORES.names, (doc_id, held_out(doc_id), len(found), int((found > 0).sum()), math.fsum(found), score, len(text))):
                out[name].append(value)
    return pa.table([pa.array(out[f.name], f.type) for f in SCORES], schema=SCORES)


def _stretches(text: bytes) -> Iterator[np.ndarray]:
    runs = runs_of(text)
    for k in range(0, runs.size, FLUSH_RUNS):
        yield runs[k : k + FLUSH_RUNS]


def score(docs: DataFrame) -> DataFrame:
    """Scores of all documents under the models learnt from those that are not held out."""
    gathered = chunks(docs)
    words = gathered.filter("word is not null").select("chunk", "word", "n")
    runs = gathered.filter("run is not null").select("chunk", "run", "n")
    counted = stored(words.groupBy("word").agg(F.sum("n").cast("double").alias("value")), "words")
    size = counted.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("tokens"), F.count_if(F.col("value") > 0).alias("kinds")).first()
    totals = stored(runs.groupBy("run").agg(F.sum("n").alias("n")), "runs")
    scores = run_scores(totals, pair_counts(totals))
    asked = (
        words.join(counted, "word").select("chunk", "word", F.lit(None).cast("long").alias("run"), "value")
        .unionByName(runs.join(scores, "run").select("chunk", F.lit(None).cast("binary").alias("word"), "run", "value"))
    )
    texts = gathered.filter("docs is not null").select(F.col("chunk").alias("own"), "docs")
    found = texts.groupBy("own").cogroup(asked.groupBy("chunk")).applyInArrow(_score_chunk, SCORES_SQL)
    tokens, kinds = int(size["tokens"]), int(size["kinds"])
    base = F.col("word_logs") - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_symbol"),
    )
