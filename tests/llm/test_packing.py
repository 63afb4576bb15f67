import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioforge.llm import packing


def check(found, capacity):
    found = found.sort_values(["sequence_id", "offset"])
    assert (found.groupby("sequence_id").length.sum() <= capacity).all()
    assert (found.offset == found.groupby("sequence_id").length.cumsum() - found.length).all()


def test_pieces_are_those_of_the_tokenizer(docs, prose, odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = odd + [(10 + k, prose(n, k)) for k, n in enumerate((3, 400, 900, 2500))] + [(90, "a<|endoftext|>b"), (91, " <|endoftext|><|endoftext|> x<|endoftext|"), (92, "<|endoftext|>")]
    found = packing.pack_documents(docs(rows)).toPandas()
    check(found, 1024)
    for doc, text in rows:
        if doc in (None, 4):
            continue
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = found[found.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert (own.length.iloc[1:] == 1024).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert len(found[found.doc_id == 4]) == 2 and len(found[found.doc_id.isna()]) == 1


def test_ids_round_trip(docs, prose):
    text = prose(3000, 5)
    found = packing.pack_documents(docs([(1, text)]), with_ids=True).toPandas().sort_values("piece")
    ids = np.concatenate([np.array(x) for x in found.ids])
    assert packing.encoder("byte_bpe_50k.tiktoken").decode(ids[:-1].tolist()) == text


@pytest.mark.parametrize("seed", [1, 2])
def test_as_tight_as_sequential_best_fit(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 101, 300), [100] * 20, [7] * 80]).tolist()
    df = spark.createDataFrame([(k, 0, int(n), 0) for k, n in enumerate(lengths)], "doc_id long, piece int, length long, ids_crc32 long")
    found = packing.pack(df, 100).toPandas()
    check(found, 100)
    assert len(found) == len(lengths)
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(100 - n)
    assert found.sequence_id.nunique() <= len(gaps) + 1


def test_empty(docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_head_piece_is_the_short_one():
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1, 1024) == [(0, 1)]
