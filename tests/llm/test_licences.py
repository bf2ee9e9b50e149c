import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from samples import awkward, empty, frame

from detframe.llm import licences
from detframe.llm.licences import Automaton

OWN = Automaton()
SMALL = Automaton(phrases={"a b": "ab", "b": "b", "a b a": "aba"}, notices={"one": "a b a a c b a b c c", "two": "c c b a a a b"})


def places(words, phrases):
    return sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_statistics_against_brute_force(letters):
    words = [x.encode() for x in letters]
    runs, found = SMALL.statistics(words)
    assert sorted(found) == places(words, SMALL.phrases)
    sources = [licences.words_of(x.encode()) for x in [*SMALL.notices.values(), *SMALL.phrases]]
    inside = lambda run: any(run == s[k : k + len(run)] for s in sources for k in range(len(s)))
    want = []
    for end in range(1, len(words) + 1):
        length = max((n for n in range(1, end + 1) if inside(words[end - n : end])), default=0)
        longer = max((n for n in range(1, end + 2) if end < len(words) and inside(words[end + 1 - n : end + 1])), default=0)
        if length >= licences.MIN_RUN and longer != length + 1:
            want.append((end - length, length))
    assert [r[:2] for r in runs] == want


def test_notices_are_found_with_gaps():
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["thon", "erin", "alder"]) for _ in range(n))
    for name, notice in licences.NOTICES.items():
        words = notice.split()
        words[len(words) // 2] = "changed"
        text = f"{filler(30)} {' '.join(words)} {filler(30)}".encode()
        n, _, spans = OWN.scan(text)
        best = {label: (first, size, covered) for label, first, size, covered in spans}
        assert best[name][2] >= 0.5 and best[name][0] >= 20 and n > 60
    assert OWN.scan(filler(200).encode())[1:] == ([], [])


def test_query_columns_on_awkward_rows(texts):
    rows = awkward() + [(40, "CC BY cc-by Cc  by"), (41, "the General Public License, all rights\nreserved"), (42, licences.NOTICES["mit"] * 3)]
    found = sorted(licences.scan(frame(texts, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_words))
    assert len(found) == len(rows)
    want = []
    for i, t in rows:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        want.append((i, len(words), places(words, licences.PHRASES)))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.n_words, sorted((p["first"], p["label"]) for p in r.places)) for r in found] == want
    assert {s["label"] for r in found if r.doc_id == 42 for s in r.spans if s["covered"] >= 0.5} == {"mit"}
    assert licences.scan(empty(texts)).count() == 0
