import math
import random

import pytest

from detframe.llm import topk


def by_hand(rows, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("first, block", [(32, 16_384), (2, 40)])
def test_against_brute_force(spark, texts, monkeypatch, first, block):
    monkeypatch.setattr(topk, "FIRST_READ", first)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)]) for k in range(220)]
    rows += [(300 + k, rows[0][1]) for k in range(60)] + [(500, rows[7][1]), (550, [0.5] * 3), (551, [0.25] * 3), (600, None), (650, [0.1, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(700, [float("nan")] * 6), (701, [float("inf")] * 6), (None, [0.1] * 6), (750, [])]
    found = topk.top_k(texts.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, part int"))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [x for x in by_hand(rows) if x[0] != 750]


def test_few_rows_and_none(texts):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert [tuple(r) for r in topk.top_k(texts.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()] == by_hand(rows)
    assert topk.top_k(texts.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components(texts):
    """Components whose integers need more than 32 bits, and products that need more than 64."""
    rng = random.Random(2)
    for top in (1e8, 3e12):
        rows = [(k, [rng.choice([top, -top, 0.5, 1.0]) * rng.random() for _ in range(4)]) for k in range(120)]
        hold = lambda s: max(-(2**63), min(2**63 - 1, s))
        found = topk.top_k(texts.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert sorted(tuple(r) for r in found.collect()) == [(q, n, i, hold(s)) for q, n, i, s in by_hand(rows)]


def test_repeated_rows(texts):
    """A query row that stands seven times is one row; an id with two vectors asks for both."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(1, 80)]
    rows += [(0, rows[5][1])] * 7 + [(200 + k, rows[5][1]) for k in range(3)] + [(201, rows[5][1])] * 4
    found = topk.top_k(texts.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in found.collect()) == by_hand(list({(i, tuple(v)) for i, v in rows}))
    two = [*rows, (100, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0])]
    got = sorted(tuple(r) for r in topk.top_k(texts.createDataFrame(two, "vec_id long, embedding array<double>")).collect() if r.query_id == 100)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in {(i, tuple(v)) for i, v in two}]
    want = []
    for q in ([256, 0, 0], [0, 256, 0]):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ints if i != 100)[:5]
        want += [(100, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want)
