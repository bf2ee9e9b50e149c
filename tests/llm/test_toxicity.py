import random
import zlib

from samples import awkward, empty, frame, sentence

from detframe.llm import toxicity


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        words = sentence(rng, rng.randint(30, 200)).split(" ")
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "loweipf", "lostraso"])
        made.append((k, " ".join(words), toxic))
    return made


def test_held_out_accuracy(texts):
    rows = corpus()
    docs, labels = texts.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), texts.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.judge(docs, toxicity.fit(docs, labels)).collect()}
    apart = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(found[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    right = sum(found[r[0]].predicted == r[2] for r in apart)
    assert right >= 0.95 * len(apart) and all(found[r[0]].predicted == int(found[r[0]].score >= 0.5) for r in rows)
    kept = toxicity.keep_civil(docs, toxicity.fit(docs, labels))
    assert kept.count() == sum(1 for r in found.values() if not r.predicted)


def test_held_out_labels_are_never_used(texts):
    rows = corpus(150)
    docs = texts.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    turned = [(i, 1 - x if toxicity.fold(i, 5) == 0 else x) for i, _, x in rows]
    a, b = (toxicity.fit(docs, texts.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, x) for i, _, x in rows], turned))
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


def test_swaps_lower_false_positives_on_neutral_mentions():
    rng = random.Random(9)
    made, toxic = [], []
    for k in range(300):
        words = sentence(rng, 40).split(" ")
        bad = k % 3 == 0
        if bad:
            words[3], words[17] = "scum", "muslim"  # a biased sample: the group is named beside insults only
        elif k % 3 == 1:
            words[5] = "christian"
        made.append(" ".join(words).encode())
        toxic.append(int(bad))
    neutral = (sentence(rng, 12) + " muslim neighbours " + sentence(rng, 12)).encode()
    swapped = neutral.replace(b"muslim", b"christian")
    free, held = toxicity.train(made, toxic, swap_weight=0.0), toxicity.train(made, toxic, swap_weight=5.0)
    assert free.score(neutral) > 0.5 > held.score(neutral)
    assert abs(held.score(neutral) - held.score(swapped)) < abs(free.score(neutral) - free.score(swapped)) / 2
    assert held.score(made[0]) > 0.5


def test_awkward_rows_and_no_labels(texts):
    none = texts.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(texts, awkward())
    found = toxicity.judge(docs, toxicity.fit(docs, none)).collect()
    assert len(found) == len(awkward()) and {r.score for r in found} == {0.0} and {r.predicted for r in found} == {0}
    assert toxicity.judge(empty(texts), toxicity.Classifier()).count() == 0
    assert toxicity.keep_civil(docs, toxicity.fit(docs, none)).columns == docs.columns
