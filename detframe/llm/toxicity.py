"""Toxicity: a hashed linear classifier whose score must not move when identity terms are swapped.

A word brings itself and its beginnings as hashed features, and a text is the mean of its words, so that length alone does not
move a score. Only features whose presence goes with the label in the sample (chi-square) get weights. The loss is the logistic one plus ``swap_weight`` times the squared change of the score when an identity term of a labelled sentence is replaced by
another of its group, so that a group's name alone neither raises nor lowers a score.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hashes of their ids; scoring covers
every document whole and shuffles nothing.

Defined cases: null text is empty and gets the score of the intercept alone; without labelled documents of both kinds every
score is 0 and nothing is predicted toxic; labels that are null are no labels; a label given twice counts as toxic if one is;
documents that share a labelled id all count, up to the bound; equal texts get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, filtered, fold, fold_column, pick, rows

SAMPLE_DOCS, FOLDS = 8_000, 5
FEATURES, STEPS, RIDGE, SWAP_WEIGHT = 1 << 18, 150, 1e-5, 1.0
#: Least documents and least chi-square of a feature that gets a weight; what a text's mean is multiplied with.
LEAST_DOCS, LEAST_CHI, SCALE = 3, 10.0, 30.0
BEGINNINGS = (4, 5, 6)
#: Words whose score a worker keeps.
KEPT_WORDS = 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Groups of identity terms that may be swapped for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("deaf", "blind", "disabled", "elderly"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def features(word: bytes) -> list[int]:
    return [zlib.crc32(word, 1) % FEATURES, *(zlib.crc32(word[:n], n) % FEATURES for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Classifier:
    weights: np.ndarray | None = None
    intercept: float = -math.inf
    known: dict[bytes, float] = field(default_factory=dict)

    def word(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = float(self.weights[features(word)].sum())
        return found

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return 0.0
        words = words_of(text)
        z = self.intercept + SCALE * math.fsum(map(self.word, words)) / max(1, len(words))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _packed(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, the text each belongs to, and its share of that text; one text's words at a time."""
    places, sizes = [], []
    for words in texts:
        numbers, counts = np.unique(np.fromiter((f for word in words for f in features(word)), np.int32), return_counts=True)
        places.append(numbers)
        sizes.append((counts * (SCALE / max(1, len(words)))).astype(np.float32))
    owner = np.repeat(np.arange(len(places), dtype=np.int32), [x.size for x in places])
    return np.concatenate(places or [np.empty(0, np.int32)]), owner, np.concatenate(sizes or [np.empty(0, np.float32)])


def telling(place: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each feature, whether its presence in a text goes with the label."""
    n, a = len(y), np.bincount(place, y[owner], FEATURES)
    with_it = np.bincount(place, minlength=FEATURES).astype(np.float64)
    positives = y.sum()
    expected = with_it * positives / n
    spread = expected * (1 - positives / n) * (1 - with_it / n)
    return (with_it >= LEAST_DOCS) & ((a - expected) ** 2 >= LEAST_CHI * np.maximum(spread, 1e-12))


def swaps(texts: Iterable[list[bytes]], identities=IDENTITIES) -> list[tuple[bytes, bytes, float]]:
    """Pairs of terms and how many labelled texts hold the first: a linear score changes by the difference of the two terms.

    Each pair has a weight of one at least, so that terms the sample lacks are held together too.
    """
    held: dict[bytes, int] = {}
    terms = {t.encode() for group in identities for t in group}
    for words in texts:
        for word in terms.intersection(words):
            held[word] = held.get(word, 0) + 1
    return [
        (a.encode(), b.encode(), 1.0 + held.get(a.encode(), 0) + held.get(b.encode(), 0))
        for group in identities for i, a in enumerate(group) for b in group[i + 1 :]
    ]


def train(texts: list[bytes], toxic: list[int], swap_weight: float = SWAP_WEIGHT, identities=IDENTITIES) -> Classifier:
    """Adam on the whole sample at once; the same sample gives the same weights."""
    y = np.array(toxic, np.float64)
    if len(set(toxic)) < 2:
        return Classifier()
    place, owner, size = _packed(map(words_of, texts))
    pairs = swaps(map(words_of, texts), identities)
    firsts, first_of, _ = _packed([[a] for a, _, _ in pairs])
    seconds, second_of, _ = _packed([[b] for _, b, _ in pairs])
    held = np.array([n for _, _, n in pairs])
    chosen = telling(place, owner, y)
    used = chosen[place]
    place, owner, size = place[used], owner[used], size[used]
    # rare positives weigh as much as the negatives do, up to a factor
    side = np.where(y == 1, min(5.0, (len(y) - y.sum()) / y.sum()), 1.0)
    w, c = np.zeros(FEATURES), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    m, v, mc, vc = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[place] * size, len(y)) + c
        error = side * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        grad = np.bincount(place, error[owner] * size, FEATURES) + RIDGE * w
        if swap_weight and pairs:
            moved = np.bincount(first_of, w[firsts], len(pairs)) - np.bincount(second_of, w[seconds], len(pairs))
            pull = swap_weight * held * moved / len(y)
            grad += np.bincount(firsts, pull[first_of], FEATURES) - np.bincount(seconds, pull[second_of], FEATURES)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mc, vc = 0.9 * mc + 0.1 * error.sum(), 0.99 * vc + 0.01 * error.sum() ** 2
        rate = 0.05 * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = np.where(chosen, w - rate * m / (np.sqrt(v) + 1e-8), 0.0)
        c -= rate * mc / (math.sqrt(vc) + 1e-8)
    return Classifier(w.astype(np.float32), float(c))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``SAMPLE_DOCS`` labelled documents, in one partition; with ``folds``, none whose fold is 0."""
    usable = labels.filter("toxic is not null and doc_id is not null")
    if folds:
        usable = usable.filter(fold_column("doc_id", folds) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    return pick(docs, chosen, ("toxic",)).orderBy("doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS).select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS) -> Classifier:
    """Trained in one task on the bounded sample; only the weights that are not zero come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        toxic: list[int] = []
        for batch in batches:
            texts += byte_texts(column(batch, "text"))
            toxic += column(batch, "toxic").to_pylist()
        if not texts:
            return
        model = train(texts, toxic)
        if model.weights is not None:
            used = np.flatnonzero(model.weights).astype(np.int32)
            yield rows(WEIGHTS, intercept=[model.intercept], place=[used.tobytes()], weight=[model.weights[used].tobytes()])

    found = labelled_sample(docs, labels, folds).mapInArrow(run, "intercept double, place binary, weight binary").collect()
    if not found:
        return Classifier()
    weights = np.zeros(FEATURES, np.float32)
    weights[np.frombuffer(found[0]["place"], np.int32)] = np.frombuffer(found[0]["weight"], np.float32)
    return Classifier(weights, found[0]["intercept"])


WEIGHTS = pa.schema([("intercept", pa.float64()), ("place", pa.binary()), ("weight", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def judge(docs: DataFrame, model: Classifier) -> DataFrame:
    """Score of every document, and 1 where it is 0.5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            scores = [model.score(x) for x in byte_texts(column(batch, "text"))]
            yield rows(SCORES, doc_id=ids, held_out=[fold(x, FOLDS) == 0 for x in ids], score=scores, predicted=[int(x >= 0.5) for x in scores])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows that are not predicted toxic, all columns as they are."""
    return filtered(docs, lambda texts: [model.score(x) < 0.5 for x in texts])
