import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import awkward, empty, frame

from detframe.llm import lm


def trie(texts):
    """Counts of what follows each context of up to ORDER symbols."""
    counts = defaultdict(Counter)
    for t in texts:
        s = [lm.END] * lm.ORDER + list(t) + [lm.END]
        for k in range(lm.ORDER, len(s)):
            for j in range(lm.ORDER + 1):
                counts[tuple(s[k - j : k])][s[k]] += 1
    return counts


def probability(counts, context, symbol):
    """One symbol after a context, by walking down the trie with escapes and exclusion."""
    p, out = 1.0, set()
    for j in range(lm.ORDER, -1, -1):
        seen = counts.get(tuple(context[lm.ORDER - j :]))
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in out}
        total, kinds = sum(left.values()), len(left)
        if symbol in left:
            return p * left[symbol] / (total + kinds)
        if kinds:
            p *= kinds / (total + kinds)
        out |= set(seen)
    return p / (lm.SYMBOLS - len(out))


def by_hand(counts, text):
    s = [lm.END] * lm.ORDER + list(text) + [lm.END]
    return sum(math.log10(probability(counts, s[k - lm.ORDER : k], s[k])) for k in range(lm.ORDER, len(s)))


def test_probabilities_sum_to_one():
    texts = [b"abracadabra", b"abra", b"banana band"]
    counts = trie(texts)
    runs = Counter(int(x) for t in texts for x in lm.runs_of(t))
    pairs = np.zeros((512, 512))
    for r, n in runs.items():
        pairs[(r >> 9) & 511, r & 511] += n
    for context in (b"cada", b"nana", b"xxab", b"zzzz", b"bra "):
        code = sum(c << (9 * (4 - k)) for k, c in enumerate(context))
        asked = np.array([code | s for s in range(lm.SYMBOLS)])
        every = np.unique(np.concatenate([asked, np.array(list(runs))]))
        logs = lm.log_probabilities(every, np.array([runs.get(int(x), 0) for x in every], float), pairs)
        mine = logs[np.searchsorted(every, asked)]
        assert sum(10.0 ** mine) == pytest.approx(1)
        assert mine == pytest.approx([math.log10(probability(counts, list(context), s)) for s in range(lm.SYMBOLS)])


@pytest.mark.parametrize("chunk", [200, lm.CHUNK_BYTES])
def test_scores_against_brute_force(texts, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)  # in this process: the number of chunks is checked below by itself
    rows = awkward()
    found = lm.score(frame(texts, rows)).collect()
    data = [(i, (t or "").encode()) for i, t in rows]
    train = [t for i, t in data if not lm.held_out(i)]
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    total, kinds = sum(words.values()), len(words)
    counts = trie(train)
    want = []
    for i, t in data:
        own = [*t.lower().split(), None]
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own)
        want.append((i is not None, i or 0, lm.held_out(i), len(own), sum(w in words for w in own), total, base, by_hand(counts, t)))
    got = [(r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:6] == w[:6] and g[6:] == pytest.approx(w[6:])


def test_long_text_in_stretches(monkeypatch):
    text = bytes(range(97, 123)) * 40
    whole = Counter(lm.runs_of(text).tolist())
    monkeypatch.setattr(lm, "FLUSH_RUNS", 100)
    own = lm._Chunk()
    own.add(0, text)
    own._flush()
    assert own._joined().to_dict() == whole


def test_chunks_follow_their_size():
    own = lm._Chunk()
    own.add(2, b"a b")
    own.add(5, b"a c")
    made = list(own.batches(7))
    assert made[0].column(1)[0].is_valid and {b.column(0)[0].as_py() for b in made} == {7}


def test_nothing_to_learn_from(texts):
    assert lm.score(empty(texts)).count() == 0
    apart = next(k for k in range(100) if lm.held_out(k))
    row = lm.score(texts.createDataFrame([(apart, "ab")], "doc_id long, text string")).first()
    assert row.n_known == 0 and row.score == pytest.approx(-3 * math.log10(lm.SYMBOLS)) and row.base_score == pytest.approx(0)
