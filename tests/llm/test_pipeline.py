import random

import corpus_pipeline
from samples import sentence

from detframe.llm import packing


def test_stages_on_planted_cases(texts, tmp_path):
    rng = random.Random(8)
    fresh = lambda n: " ".join("%s%d" % (sentence(rng, 1), rng.randrange(1000)) for _ in range(n))
    clean = {k: "\n".join(fresh(30) for _ in range(4)) for k in range(60)}
    passage = fresh(80)
    planted = {
        100: clean[0], 101: " ".join(w if k % 60 else "other%d" % k for k, w in enumerate(clean[1].replace("\n", " ").split(" "))),
        102: "too short", 103: (fresh(8) + " ") * 30, 104: "\n".join([fresh(30), passage, fresh(30)]), 105: "\n".join([fresh(30), passage, fresh(30)]),
        106: "\n".join(fresh(25) + " idiot scum" for _ in range(4)), 107: None,
    }
    labelled = {200 + k: fresh(60) + (" idiot scum moron" if k % 4 == 0 else "") for k in range(80)}
    docs = [(i, t, "en", "s", len(t or "")) for i, t in [*clean.items(), *planted.items(), *labelled.items()]]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    texts.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    texts.createDataFrame([(i, 1, int(k % 4 == 0)) for k, i in enumerate(labelled)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = texts.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(texts, table, str(tmp_path))
        if number < 4:
            assert made.columns == table.columns
        made.write.parquet(f"{tmp_path}/{name}")
        table = texts.read.parquet(f"{tmp_path}/{name}")
        left[name] = table.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in left.items()}
    assert set(clean) <= ids["quality"] and not {102, 103, 107} & ids["quality"]
    assert 106 not in ids["toxicity"] and set(clean) <= ids["toxicity"]
    by_id = {r.doc_id: r for r in left["line_dedup"]}
    assert 100 not in by_id and passage in by_id[104].text and passage not in by_id[105].text and by_id[105].n_chars == len(by_id[105].text)
    assert all(by_id[k].text == t for k, t in clean.items())
    assert ids["near_duplicates"] == set(by_id) - {101} and set(clean) <= ids["near_duplicates"]
    assert ids["packing"] == ids["near_duplicates"]
    last = left["packing"]
    assert sum(r.length for r in last) == max(r.sequence_id * packing.WINDOW + r.offset + r.length for r in last)
