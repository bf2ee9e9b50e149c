import random
from collections import defaultdict

import numpy as np
import pytest
from samples import awkward, empty, frame, sentence

from detframe.llm import jaccard
from detframe.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def by_hand(rows):
    """For each row (class id, links, copies) from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for a, x in enumerate(sets):
        near = {y for y in sets if x and y and y != x and 5 * len(x & y) >= 4 * len(x | y)}
        out.append((len(near), sum(y == x for y in sets) if x else 1))
        for b, y in enumerate(sets):
            if x and (y == x or y in near):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)] += [i] if i is not None else []
    return sorted((i is not None, i or 0, min(least[find(k)], default=-1), *out[k]) for k, (i, _) in enumerate(rows))


def got(found):
    return sorted((r.doc_id is not None, r.doc_id or 0, -1 if r.class_id is None else r.class_id, r.n_links, r.copies) for r in found.collect())


def near_copies(rng, base, n, share):
    for _ in range(n):
        words = base.split(" ")
        for k in range(0, len(words), share):
            words[(k + rng.randrange(share)) % len(words)] = "new%d" % rng.randrange(10**6)
        yield " ".join(words)


def rows_with_copies(seed=6):
    rng = random.Random(seed)
    made, passage = [], sentence(rng, 60)
    for g in range(5):
        base = sentence(rng, 150)
        made += [base, *near_copies(rng, base, 8, 70), "".join(c.upper() if c.isascii() else c for c in base)]
    made += [f"{sentence(rng, 40)} {passage} {sentence(rng, 50)}" for _ in range(25)]
    return [(k, t) for k, t in enumerate(made)]


@pytest.mark.parametrize("bucket, tile", [(2048, 2048), (4, 8)])
def test_links_against_all_pairs(texts, monkeypatch, bucket, tile):
    """With tiny limits the large buckets are split, led in blocks and compared tile by tile."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = rows_with_copies() + [(i if i is None else 1000 + i, t) for i, t in awkward()]
    docs = texts.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "row long, doc_id long, text string").repartition(3)
    assert got(jaccard.links(docs)) == by_hand(rows)


def test_first_of_each_class_stays(texts):
    rows = rows_with_copies() + [(i if i is None else 1000 + i, t) for i, t in awkward()]
    docs = frame(texts, rows)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    hand = by_hand(rows)
    # a class with a null id keeps the row of that id, which comes first
    classes = {c for known, i, c, *_ in hand if known and not any(not k and cc == c for k, _, cc, *_ in hand)}
    empties = {1020, 1021, 1022}
    assert set(ids) >= {c for c in classes if c != -1} and empties <= set(ids) and len([i for i in ids if i < 1000]) == 5 + 25
    assert jaccard.keep_first(empty(texts)).count() == 0


def test_chance_to_share_a_path():
    """Sets at the threshold share a token of the first split in nearly 1 - 1/e of the runs at least."""
    rng = np.random.default_rng(1)
    runs, hits = 400, 0
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    own = [np.unique(np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2)]
    a, b = (jaccard.chosen(x, np.arange(2, 2 + runs, dtype=np.uint64)) for x in own)
    both = set(zip(a[0].tolist(), a[1].tolist())) & set(zip(b[0].tolist(), b[1].tolist()))
    hits = len({run for run, _ in both})
    assert hits / runs > 0.58 and jaccard.runs_needed() == 14


def test_components_of_chains_and_stars(texts):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 300), (5, 5)]
    found = {r.node: r.root for r in components(texts.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300}
