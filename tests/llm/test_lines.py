import random

import pytest
from samples import awkward, empty, frame

from detframe.llm import lines


def by_hand(rows, least):
    """Texts without later copies: for each line, whether a run of at least so many words holds it and stands earlier."""
    docs = []
    for i, t in rows:
        docs.append([x.strip(lines.BLANKS) for x in t.split("\n")] if t is not None else [])
    kept = [[x for x in d if x] for d in docs]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    first, gone = {}, [set() for _ in rows]
    for k in order:
        d = kept[k]
        for s in range(len(d)):
            for e in range(s + 1, len(d) + 1):
                run = tuple(d[s:e])
                if run in first:
                    if sum(x.count(" ") + 1 for x in run) >= least:
                        gone[k] |= set(range(s, e))
                else:
                    first[run] = (k, s)
    return [None if t is None else lines.without_lines(t, g) for (_, t), g in zip(rows, gone)]


@pytest.mark.parametrize("least, seed", [(1, 0), (3, 1), (6, 2), (7, 3)])
def test_runs_against_brute_force(texts, least, seed):
    rng = random.Random(seed)
    pool = ["a", "b c", "d e f", "g", "h i", "", "  "]
    rows = [(k // 2 if k % 5 else None, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(14)]
    rows += [(99, "\n".join(["a", "b c"] * 8)), (98, None), (5, rows[3][1])]
    docs = texts.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one task: the rows' numbers are their order
    found = lines.dedup(docs, least).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in found)
    want = sorted((i is not None, i or 0, t is not None, t or "") for (i, _), t in zip(rows, by_hand(rows, least)))
    assert got == want


def test_passages_go_and_clean_documents_stay(texts):
    rng = random.Random(4)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    passage = [line(30), line(25)]
    clean = [(k, "\n".join(line(20) for _ in range(5))) for k in range(10)]
    hit = [(20 + k, "\n".join([line(12), *passage, line(9)])) for k in range(6)]
    found = {r.doc_id: r for r in lines.dedup(texts.createDataFrame(clean + hit, "doc_id long, text string")).collect()}
    assert all(found[k].text == t and not found[k].removed for k, t in clean) and found[20].text == hit[0][1]
    for k, t in hit[1:]:
        assert found[k].text.split("\n") == [t.split("\n")[0], t.split("\n")[3]] and [tuple(x) for x in found[k].removed] == [(1, 2)]


def test_runs_of_twenty_words_by_white_space(texts):
    words = lambda start, n, gap=" ": gap.join("w%d" % k for k in range(start, start + n))
    runs = {"twenty": words(0, 12) + "\n" + words(12, 8), "nineteen": words(100, 19), "wide": words(200, 19, "   "), "mixed": words(300, 20, "\t\u3000"), "odd": "\u3000\n" + words(400, 19)}
    docs = [(2 * k + n, "own %d %s\n%s\nend %d %s" % (n, name, run, n, name)) for k, (name, run) in enumerate(runs.items()) for n in (0, 1)]
    found = {r.doc_id: [tuple(x) for x in r.removed] for r in lines.dedup(texts.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {k: [] for k in range(10)} | {1: [(1, 2)], 7: [(1, 1)], 9: [(1, 2)]}


def test_awkward_rows_keep_their_columns(texts):
    docs = frame(texts, awkward())
    found = lines.dedup(docs, 5)
    assert found.columns[:-1] == docs.columns and found.count() == docs.count()
    emptied = lines.drop_emptied(found)
    assert emptied.columns == docs.columns
    ids = [r.doc_id for r in emptied.collect()]
    assert {20, 21, 22, 23} <= set(ids) and ids.count(None) == 2 and 0 not in ids  # a null id comes before the copy with id 0
    assert lines.drop_emptied(lines.dedup(empty(texts))).count() == 0
