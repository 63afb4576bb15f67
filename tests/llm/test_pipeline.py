from collections import Counter

import pyarrow as pa

import corpus_pipeline as P
from folioforge.llm import chunkdedup, jaccardjoin, quality, registry, toxicity


def test_stages_act_on_what_came_before(spark, sf):
    docs = P.read(spark, sf, "documents")
    for name, step in P.STAGES[:-1]:
        kept = P.stage(step(spark, docs, sf), name)
        assert kept.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in df.collect()} for df in (docs, kept))
        assert set(after) <= set(before)
        if name != "repeated_passages":
            assert all(before[k] == t for k, t in after.items())
        if name == "quality":
            bad = {r.doc_id for r in quality.classify(docs, P.read(spark, sf, "labels")).where("predicted = 0").collect()}
        elif name == "toxicity":
            bad = {r.doc_id for r in toxicity.classify(P.read(spark, sf, "documents"), P.read(spark, sf, "labels")).where("predicted = 1").collect()} & set(before)
        elif name == "near_duplicates":
            found = jaccardjoin.near_duplicates(docs).collect()
            assert sorted(r.class_id for r in found if r.doc_id in after) == sorted({r.class_id for r in found})
            bad = set(before) - set(after)
        else:
            # Of every chunk that documents share, one copy is left in all.
            bad = set(before) - set(after)
            assert all(before[k] and k not in after for k in bad)
            cut = {k: [raw[a:b] for (raw, ends) in chunkdedup.chunked(pa.array([t])) for a, b in zip([0, *ends], ends) if b - a >= chunkdedup.LEAST] for k, t in before.items() if t}
            chunks = {c for own in cut.values() for c in own}
            left = Counter(c for k, own in cut.items() for c in set(own) if k in after and c in after[k].encode())
            assert all(left[c] >= 1 for c in chunks)
            assert sum(len(t.encode()) for t in after.values() if t) == sum(len(t.encode()) for t in before.values() if t) - sum(len(c) for own in cut.values() for c in own) + sum(map(len, chunks))
        assert set(before) - set(after) == bad
        docs = kept
    packed = P.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == set(r.doc_id for r in docs.select("doc_id").collect())


def test_one_of_each_group_by_brute_force(spark, sf):
    from tests.llm.test_jaccardjoin import brute

    docs = P.read(spark, sf, "documents")
    classes = {doc: least for doc, least, _ in brute([(r.doc_id, r.text) for r in docs.collect()])}
    kept = [classes[r.doc_id] for r in P.keep_one_of_each(spark, docs, sf).collect()]
    assert sorted(kept) == sorted(set(classes.values())) and len(kept) < len(classes)


def test_stages_on_odd_rows(spark, docs, odd, sf):
    from pyspark.sql import functions as F

    df = docs(odd).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "node")
    for rows in (df, df.limit(0)):
        for name, step in P.STAGES:
            out = step(spark, rows, sf)
            out.count()
            if name != "packing":
                assert out.columns == df.columns


def test_rows_that_share_an_id(spark, docs, prose):
    from pyspark.sql import functions as F

    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, a), (1, b), (None, c), (None, c), (None, None), (2, a + " end"), (1, ""), (1, "")]
    df = docs(rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "node")
    kept = [r.text for r in P.keep_one_of_each(spark, df, "").collect()]
    assert sorted(t or "" for t in kept if t in (b, c, "", None)) == sorted([b, c, "", "", ""])
    assert len([t for t in kept if t and t.startswith(a)]) == 1
    cut = [r.text for r in P.cut_repeats(spark, df.where("text IS NULL OR text <> ''"), "").collect()]
    assert sum(map(len, filter(None, cut))) < len(a + b + c) + 80 and None in cut


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert [name for name, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "repeated_passages", "packing"]
