import hashlib
import itertools
import random
import re
import zlib

import pytest

from detframe.llm import turns

SCHEMA = "conv_id long, turn int, role string, text string, block int, shard int, audit string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv_id, turn, "user" if kind == 4 else role, text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired_by_hand(rows):
    """Every choice of edits and insertions over (role, text, fault); the least cost, then the least audit."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(x != "D" and r[2] in ("blank", "duplicate") for x, r in zip(letters, rows)):
            continue
        for roles in itertools.product(("user", "assistant"), repeat=letters.count("R")):
            new, kept = iter(roles), []
            for letter, (role, text, fault) in zip(letters, rows):
                kept.append(("D",) if letter == "D" else (letter, next(new) if letter == "R" else role, text))
            cost = sum({"D": 4, "K": 0, "R": 3}[x] + 3 * (x != "D" and r[2] == "truncated") for x, r in zip(letters, rows))
            # rows inserted before, between and after: two at most anywhere are of any use
            gaps = len(kept) + 1
            for inserted in itertools.product(((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")), repeat=gaps):
                more = cost + 3 * sum(map(len, inserted))
                if best and more > best[0]:
                    continue
                line = []
                for k in range(gaps):
                    line += [("I", r, "") for r in inserted[k]] + ([kept[k]] if k < len(kept) else [])
                said = [x for x in line if x[0] != "D"]
                if re.fullmatch("(s?(ua)+)?", "".join(x[1][:1] or "-" for x in said)):
                    found = (more, "".join(x[0] for x in line), hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest())
                    best = min(best or found, found)
    return best


def by_hand(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        known = sorted({r[1] for r in own} - {None})
        count = lambda x: sum(f[2] == x for f in faulty)
        illegal = sum((a[0][:1], b[0][:1]) not in turns.LEGAL for a, b in itertools.pairwise(faulty))
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        cost, audit, sha = repaired_by_hand(faulty)
        out.append((conv_id, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv_id in range(n):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", " ", "", None, "So it is. \n", "é!"])
            rows.append((conv_id, rng.choice([turn, turn, turn, None, turn + 3, 0]), role, text))
    rows += [(None, None, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, 2, "user", "Hi."), (900, 2, "user", "Hi."), (900, 2, "user", "Hi.")]
    return rows


@pytest.mark.parametrize("block", [32, 1, 2])
def test_against_brute_force(texts, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = [r for r in conversations(block) if True]
    short = {}
    for r in rows:  # brute force tries every choice, so conversations stay short
        short.setdefault(r[0], []).append(r)
    rows = [r for own in short.values() for r in own[:3]]
    table = frame(texts, rows)
    found = sorted((tuple(r) for r in turns.digest(table, turns.damage(table)).collect()), key=repr)
    assert found == by_hand(rows)


def stepwise(rows):
    """Least (cost, audit) by one pass over the rows, for conversations that brute force can't try."""
    best = {0: (0, "")}

    def insert(best):
        for _ in range(3):
            for p, (c, a) in list(best.items()):
                q = 2 if p != 2 else 3
                best[q] = min(best.get(q, (9e9, "")), (c + 3, a + "I"))
        return best

    for role, _, fault in rows:
        out = {}
        late = 3 * (fault == "truncated")
        for p, (c, a) in insert(best).items():
            ways = [(p, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                q = 2 if p != 2 else 3
                ways.append((q, c + 3 + late, a + "R"))
                if role[:1] == "us"[0] and q == 2 or role[:1] == "a" and q == 3:
                    ways.append((q, c + late, a + "K"))
                if role[:1] == "s" and p == 0:
                    ways.append((1, c + late, a + "K"))
            for q, cost, audit in ways:
                out[q] = min(out.get(q, (9e9, "")), (cost, audit))
        best = out
    return min(x for q, x in insert(best).items() if q in (0, 3))


def test_long_conversations_in_blocks():
    rng = random.Random(4)
    for _ in range(30):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), "t", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randint(1, 90))]
        symbols = [(r[0][:1] if r[0][:1] in "sua" else "", {"": "", "truncated": "t", "blank": "d"}[r[2]], 1) for r in rows]
        for size in (5, 32):
            spans = [turns.parsed(tuple(symbols[k : k + size])) for k in range(0, len(symbols), size)]
            assert turns.best(turns.combined(spans)) == stepwise(rows)


def test_one_giant_conversation(texts):
    """All rows in one conversation over several ranges: blocks of many tasks make one result."""
    rng = random.Random(6)
    rows = [(7, k // 2, rng.choice(["user", "assistant"]), rng.choice(["Right %d." % k, "cut %d" % k, "Same."])) for k in range(1500)]
    table = frame(texts, rows)
    texts.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, mended = turns.repair(table)
        (row,), lines = summary.collect(), mended.orderBy("shard", "block", "nth", "step").collect()
    finally:
        texts.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({s.shard for s in row.spans}) > 1
    own, seen, faulty = sorted(rows, key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).digest())), set(), []
    for _, _, role, text in own:
        faulty.append((role, text, "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"))
        seen.add((role, text))
    assert (row.cost, row.audit) == stepwise(faulty)
    assert [r.role for r in lines] == ["user", "assistant"] * (len(lines) // 2)
    assert [r.edit for r in lines] == [x for x in row.audit if x != "D"]
    kept = [t for (_, t, _), x in zip(faulty, row.audit.replace("I", "")) if x != "D"]
    assert [r.text for r in lines if r.edit != "I"] == kept


def test_empty_table(texts):
    table = texts.createDataFrame([], SCHEMA)
    assert turns.digest(table, turns.damage(table)).count() == 0
