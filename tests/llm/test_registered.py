"""The registered queries over the smallest tables: names and types of their contracts, their SQL, and brute-force versions."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from folioforge.llm import quality, registry
from folioforge.llm.common import bytes_of, labelled_sample, read
from tests.conftest import SF
from tests.test_queries import table

SCORES = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
CONTRACTS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_toxicity": SCORES,
    "op5_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_quality_classifier": SCORES,
    "op10_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    assert CONTRACTS[name].items() <= dict(registry.QUERIES[name](spark, SF).dtypes).items()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE[name])
    assert table(df.collect(), df.columns) == table(found.fetchall(), [d[0] for d in found.description])


def test_pieces_fill_their_sequences(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = registry.QUERIES["op1_best_fit_packing"](spark, SF).collect()
    of, held = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(of) == set(ids)
    for doc, pieces in of.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[doc][at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids[doc])
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024
    assert len(held) <= 1.02 * -(-sum(map(len, ids.values())) // 1024)


def test_quality_votes_by_brute_force(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality.fit(labelled_sample(docs, labels, "quality", quality.MODULUS, quality.HELD_OUT, quality.SAMPLE))
    got = {r.doc_id: r.score for r in registry.QUERIES["op9_quality_classifier"](spark, SF).collect()}
    texts = docs.select("doc_id", "text").toArrow()
    of = quality.terms(*bytes_of(texts.column("text").combine_chunks()))
    known = model.vectors.astype(np.float64)
    for doc, x in zip(texts.column("doc_id").to_pylist(), of):
        z = (quality.weighted(x[None], model.idf) @ model.project)[0].astype(np.float64)
        cos = np.array([z @ v for v in known]) / max(np.linalg.norm(z), 1e-12)
        near = sorted(range(len(cos)), key=lambda k: -cos[k])[: quality.NEIGHBOURS]
        weights = [max(cos[k], 0.0) ** 8 for k in near]
        assert got[doc] == pytest.approx(sum(w * model.labels[k] for w, k in zip(weights, near)) / sum(weights), abs=1e-3), doc


def test_shards_are_even_and_gapless(spark):
    rows = registry.QUERIES["op7_sharding"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    shards = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    assert {r.law for r in rows} == {"rows"} and len(rows) == len(texts) and set(shards) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
