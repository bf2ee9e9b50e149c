import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import awkward, empty, frame
from tokenizers import Tokenizer

from detframe.llm import idfiles, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab,.é ñ\n\t 　!'s1\x1c\x85中A")), max_size=40))
def test_parts_equal_whole(text):
    assert own(text) == plain(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "a\n<|endoftext|>\nb", "x<|endoftext|>y. ", "a  <|endoftext|>\n\n<|endoftext|>", "a \n<|endoftext|>", "<|endoftext|><|endoftext|> c", "<|ENDOFTEXT|> <|endoftext"])
def test_written_special_token(text):
    assert own(text) == plain(text)


def test_many_parts_forget(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PARTS", 3)
    fresh = tokens.PartEncoder(PATH)
    for text in ("one two three four. five,\nsix", "one two seven\n\neight  nine", "<|endoftext|> x"):
        assert np.frombuffer(fresh.encode(text), "<u4").tolist() == plain(text)


def expected(rows):
    """Ids with the end id of each row, in the order of the operators."""
    return [(i, [*plain(t or ""), 0]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_packing_cuts_everything_once(texts):
    rows = awkward()
    pieces = packing.pack(frame(texts, rows), PATH, 64, keep_ids=True)
    found = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    stream = []
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.sequence_id * 64 + r.offset == len(stream) and len(ids) == r.length and r.offset + r.length <= 64
        assert zlib.crc32(r.ids) == r.ids_crc32
        stream += ids.tolist()
    want = expected(rows)
    assert len(stream) == sum(len(x) for _, x in want)
    by_doc = {}
    for r in found:
        if r.start == 0:
            by_doc.setdefault(r.doc_id, []).append([])
        by_doc[r.doc_id][-1].append(r)
    for doc_id in {i for i, _ in want}:
        got = sorted(sum((np.frombuffer(r.ids, "<u4").tolist() for r in p), []) for p in by_doc[doc_id])
        assert got == sorted(x for i, x in want if i == doc_id)
        for p in by_doc[doc_id]:
            assert [r.start for r in p] == np.cumsum([0] + [r.length for r in p[:-1]]).tolist() and {r.doc_tokens for r in p} == {sum(r.length for r in p)}
    whole = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    assert sorted(whole) == list(range(-(-len(stream) // 64)))
    for k, r in whole.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == stream[64 * k : 64 * (k + 1)] and r.length == len(stream[64 * k : 64 * (k + 1)])


def test_padding_only_where_no_power_of_two(texts):
    made = texts.createDataFrame([(1,), (3,), (512,), (1000,), (1024,)], "n long").select(packing.padded_length("n").alias("p"))
    assert [r.p for r in made.collect()] == [1, 1024, 512, 1024, 1024]


def test_files_read_back(texts):
    rows = awkward()
    shards = idfiles.write_ids(frame(texts, rows), PATH)
    found = sorted(idfiles.read_ids(shards).collect(), key=lambda r: r.start)
    want = expected(rows)
    assert [r.doc_id for r in found] == [i for i, _ in want]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()
    key = lambda i, n, c: (i is not None, i or 0, n, c)  # noqa: E731  rows of one id in the order of their hashes
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(key(r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted(key(i, len(x), crc(x)) for i, x in want)
    assert [x.tolist() for x in idfiles.find(shards, 24)] == [x for i, x in want if i == 24]
    assert idfiles.find(shards, 999) == []


def test_short_documents_gain_from_the_dictionary(texts):
    rows = [(k, "the same kind of short notice, number %d of many that are alike" % k) for k in range(400)]
    shards = idfiles.write_ids(texts.createDataFrame(rows, "doc_id long, text string"), PATH)
    sizes = [r.stored_bytes / (2 * r.n_tokens) for r in idfiles.read_ids(shards).collect()]
    assert len(sizes) == 400 and np.mean(sizes) < 0.8


@pytest.mark.parametrize("call", [lambda d: packing.pack(d, PATH), lambda d: idfiles.read_ids(idfiles.write_ids(d, PATH))])
def test_empty_table(texts, call):
    assert call(empty(texts)).count() == 0


def test_wide_ids():
    assert idfiles.narrow(np.array([1, 70_000], "<u4").tobytes())[1] == 4 and idfiles.narrow(np.array([1, 65_535], "<u4").tobytes())[1] == 2
