import copy

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import awkward, empty, frame

from detframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PLAIN, DROPPED = pieces.PieceCoder(PATH, 0.0, 0), pieces.PieceCoder(PATH, 0.3, 5)
SIGNS = st.text(alphabet=st.sampled_from(list("abethn  \n.é中🙂\t\x00")), max_size=70)


@settings(max_examples=200, deadline=None)
@given(SIGNS)
def test_without_dropout_the_librarys_ids(text):
    text = text.replace("\x00", "x")
    assert np.frombuffer(PLAIN.encode(text, 1), "<u2").tolist() == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abe  \n中▁￿\x00")), max_size=60), st.integers(0, 5))
def test_lossless(text, key):
    for coder in (PLAIN, DROPPED):
        assert coder.decode(coder.encode(text, key)) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abethnion.")), min_size=1, max_size=30), st.integers(0, 3))
def test_list_and_heap_agree(word, variant):
    word = pieces.BLANK + word
    assert DROPPED.merged(word, variant) == DROPPED._merged_long(list(word), variant)


def test_segmentations_vary_and_repeat():
    text = " ".join(["internationalization"] * 40)
    one, again, other = (pieces.PieceCoder(PATH, 0.2, s).encode(text, 3) for s in (1, 1, 2))
    assert one == again != other and len(one) > len(PLAIN.encode(text, 3))
    words = {DROPPED.word("▁internationalization", v) for v in range(pieces.VARIANTS)}
    assert len(words) > 1


def test_each_occurrence_has_draws_of_its_own():
    coder = pieces.PieceCoder(PATH, 0.1, 3)
    assert len({coder.encode("internationalization", key) for key in range(300)}) > 20
    words = ["internationalization", "the", "antidisestablishmentarianism", "nationhood", "x" * 60, "été"] * 60
    text, first = " ".join(words), []
    for key in (1, 2, 1):
        keys = coder.occurrences(key, 0, len(words)).tolist()
        alone = [coder.word(pieces.BLANK + w, k) for w, k in zip(words, keys)]
        assert coder.encode(text, key) == b"".join(alone)
        first.append(alone)
    assert first[0] == first[2] and len(set(first[0][::6])) > 10
    plain = [PLAIN.word(pieces.BLANK + w, 0) for w in words]
    assert any(a == b for a, b in zip(first[0], plain)) and first[0] != plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abethnion.é中🙂￿\x00")), min_size=1, max_size=55), min_size=1, max_size=40), st.integers(0, 3))
def test_agendas_run_together_give_the_ids_of_each_alone(words, key):
    coder = copy.copy(DROPPED)
    coder.kept = {}
    texts = [" ".join(w.replace("￿", "x") for w in words), " ".join(words[::-1]), words[0] * 3]
    for _ in range(2):  # nothing kept, then some
        for text, ids in zip(texts, coder.encode_all(texts, [key, key + 1, key + 2])):
            assert coder.decode(ids) == text
        keys = coder.occurrences(key, 0, len(words)).tolist()
        alone = [coder.word(pieces.BLANK + w.replace("￿", "x"), k) for w, k in zip(words, keys)]
        assert coder.encode_all(texts[:1], [key])[0] == b"".join(alone)


def test_rows(texts):
    rows = awkward()
    made = pieces.encode(frame(texts, rows), PATH, keep_ids=True)
    found = made.collect()
    assert len(found) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) // 2 for r in found)
    back = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in pieces.decode(made, PATH).collect())
    assert back == sorted((i is not None, i or 0, t or "") for i, t in rows)
    assert pieces.encode(empty(texts), PATH).count() == 0
