"""Small tables with awkward rows, for all operators of the folder."""

import random

LETTERS = ["en", "tha", "re", "on", "die", "é", "ña", "ßu"]


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def text(rng, lines=4, words=14):
    return "\n".join(sentence(rng, rng.randint(3, words)) for _ in range(lines))


def awkward(seed=1):
    """(doc_id, text): nulls, empty texts, blanks, ties, repeated rows, a long text, signs outside ASCII."""
    rng = random.Random(seed)
    base = [text(rng) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, "  \n \t "), (23, "one"), (None, base[0]), (None, None), (3, base[3]), (3, base[4]), (24, base[1])]
    rows += [(25, base[2].replace("en", "EN")), (26, "a  b\n\nc 　 d\te"), (27, sentence(rng, 3000)), (28, "x" * 5000), (29, "中文字 русский 🙂 ▁ ￿")]
    return rows


def frame(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    schema = "doc_id long, text string, row long, node string, runs int, shard int, removed string, n_chars int, size double"
    return spark.createDataFrame([(i, t, 7, "n", 1, 2, None, len(t or ""), 0.5) for i, t in rows], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, row long, node string, runs int, shard int, removed string, n_chars int, size double")
