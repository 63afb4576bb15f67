import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import pieces

SP = sentencepiece.SentencePieceProcessor(model_file=P.path(pieces.MODEL))
TEXTS = ["", " ", "  a  b\t c\n d ﬁ ", "▁x▁", "日本語 テスト 😀😀 zzz", "a" * 700, " " * 90, "<s> </s> <unk> <0x41>", "x" * 60 + " " + "the" * 40, "\n\n\n", "é ñ — “q”", "The quick brown fox; naïve café 12345,678"]


def test_against_the_library():
    e = pieces.Encoder()
    ids, off = e.encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == SP.encode(TEXTS)
    again, _ = e.encode(TEXTS)
    assert (again == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcdeth ▁\n.é日", max_size=90), max_size=6))
def test_any_text(texts):
    ids, off = pieces.Encoder().encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == SP.encode(texts)


def test_round_trip(docs, odd, prose):
    rows = [(k, t) for k, t in odd if k not in (None, 4)] + [(20 + k, prose(200, k)) for k in range(5)] + [(40, " lead"), (41, "tail ")]
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs(rows))).collect()}
    assert back == {k: t or "" for k, t in rows}
    found = {r.doc_id: r for r in pieces.digest(docs(rows)).collect()}
    assert all(r.round_trip for r in found.values()) and found[1].n_ids == 0 and found[2].n_ids == 0
    assert pieces.digest(docs([])).count() == 0 and pieces.digest(docs(odd)).count() == len(odd)


def test_suffix_array():
    import numpy as np

    codes = np.array([ord(c) for c in "banana\0bandana\0"], np.uint32)
    text = "banana\0bandana\0"
    order = pieces.suffix_array(codes, 16)
    assert [text[i : i + 16] for i in order] == sorted(text[i : i + 16] for i in range(len(text)))


@pytest.mark.parametrize("word", ["the" * 30, "abcabcabc" * 9])
def test_long_words_use_the_heap(word):
    ids, _ = pieces.Encoder().encode([word])
    assert ids.tolist() == SP.encode(word)
