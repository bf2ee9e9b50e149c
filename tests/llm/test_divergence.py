import random
import re
from collections import Counter, defaultdict

import pytest
from samples import awkward

from detframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, terms int, member int, p int, v long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, 1, 2, 3, 4, 5) for k, (t, lang, source) in enumerate(rows)], SCHEMA).repartition(3)


def by_hand(rows, least, top=10):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low))
        docs[lang].update(found.keys())
        groups[lang, source].update(found)
    out = []
    for lang in docs.keys() | {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(sorted(found)[:n])]
    return sorted(out)


def planted(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "THE", "there", "thereby", "a", "ab", "abc", "abcd", "abcde", "élan", "éla", "ñandú", "中文", "x" * 40, "x" * 41, "x" * 33 + "y", "don't", "e2e"]
    own = lambda: [rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 12))] + ["w%s" % "abcdefghij"[rng.randrange(10)]]
    rows = [(" ".join(own()), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for _ in range(n)]
    rows += [(None, "fr", "lonely"), ("", "fr", "other"), (rows[0][0], "en", "s1"), ("one word", "xx", "only"), ("1 2 3", "en", "no words")]
    return rows + [(t, "en", "s9") for _, t in awkward()]


@pytest.mark.parametrize("least, tile, block", [(10, 64, 4096), (2, 2, 3), (1, 1, 5)])
def test_against_brute_force(texts, monkeypatch, least, tile, block):
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TOGETHER", 100)
    rows = planted(least)
    found = sorted(tuple(r) for r in divergence.audit(frame(texts, rows), least).collect())
    assert found == by_hand(rows, least)


def test_a_full_filter_changes_nothing(texts, monkeypatch):
    """With 64 bits nearly every prefix passes; exact counts still decide."""
    monkeypatch.setattr(divergence, "FILTER_BITS", 64)
    rows = planted(5, 60)
    assert sorted(tuple(r) for r in divergence.audit(frame(texts, rows), 3).collect()) == by_hand(rows, 3)


def test_kept_terms_by_levels(texts):
    rows = [("aaaa aaab", "en", "s")] * 9 + [("aaaa", "en", "s"), ("zz" * 40, "en", "s")] + [("zz" * 40 + "q", "en", "t")] * 10
    kept = divergence.kept_terms(divergence.document_terms(frame(texts, rows)), 10)
    assert sorted(r.term.decode() for r in kept.collect()) == ["aaaa", "zz" * 40 + "q"]


def test_empty_table(texts):
    assert divergence.audit(texts.createDataFrame([], SCHEMA)).count() == 0
    assert divergence.audit(frame(texts, [("short text", "en", "a")])).count() == 0
