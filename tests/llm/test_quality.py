import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from samples import awkward, empty, frame, sentence

from detframe.llm import quality


def by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    dups = sum(line in lines[:k] for k, line in enumerate(lines))
    chars = sum(len(w.decode()) for w in words)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text.decode()), dups, len(covered), failed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "$", "\n", " ", "\t", "中", "x y z"]), max_size=80), st.integers(1, 3))
def test_measures(parts, times):
    text = (" ".join(parts) * times).encode()
    assert quality.measures(text) == by_hand(text)


def test_every_row_is_judged(texts):
    rows = awkward()
    labels = texts.createDataFrame([(k, 1, 0) for k in range(8)] + [(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(texts, rows)
    model = quality.fit(docs, labels)
    found = quality.judge(docs, model).collect()
    key = lambda t: (t[0] is not None, *(x or 0 for x in t))
    want = [(i, *quality.measures((t or "").encode()), not by_hand((t or "").encode())[5] and model.score((t or "").encode()) >= model.threshold) for i, t in rows]
    assert sorted([tuple(r)[:8] for r in found], key=key) == sorted(want, key=key)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_junk_goes_and_clean_stays(texts):
    rng = random.Random(3)
    clean = [(k, sentence(rng, 200)) for k in range(60)]
    junk = [(100 + k, "!! ".join(sentence(rng, 150).upper().split(" "))) for k in range(20)]
    docs = texts.createDataFrame(clean + junk, "doc_id long, text string")
    labels = texts.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    model.threshold = -0.2  # the trusted set is tiny here
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {k for k, _ in clean}


def test_without_trusted_documents_and_empty(texts):
    labels = texts.createDataFrame([(1, 0)], "doc_id long, quality int")
    model = quality.fit(frame(texts, awkward()), labels)
    assert not model.weights.any()
    assert quality.judge(empty(texts), model).count() == 0 and quality.keep_good(empty(texts), model).count() == 0
    assert not quality.fit(empty(texts), labels.filter("false")).weights.any()
