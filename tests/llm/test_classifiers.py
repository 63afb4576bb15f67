import pytest
from pyspark.sql import functions as F

from folioforge.llm import quality, toxicity
from folioforge.llm.toxicity import EXACT, LOOSE, MISS, NEAR, STEM, LexiconAutomaton, Reader


def edits(a, b):
    """Edit distance with exchanged neighbours as one edit."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    import random

    terms = ["idiot", "moron", "stupid", "scum", "degenerate", "ass"]
    auto = LexiconAutomaton(terms, [])
    words = terms + ["idiott", "idot", "iddiot", "moran", "stupit", "stupd", "skum", "scu", "idi", "", "clean", "morons", "stuped", "xdiot", "ido", "stpuid", "scvm", "cmus", "degnerat", "as"]
    r = random.Random(1)
    for w in terms * 150:
        w = list(w)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(w)) if w else 0
            w[k : k + r.randint(0, 2)] = r.choice([[], ["x"], w[k : k + 2][::-1], [r.choice("idostum")]])
        words.append("".join(w))
    for w in words:
        allowed = [t for t in terms if edits(w, t) <= (2 if len(t) >= 9 else 1 if len(t) >= 4 else 0)]
        sure = any(len(t) >= 5 and w[:1] == t[:1] and edits(w[1:], t[1:]) <= 1 and len(w) != len(t) for t in allowed)
        got = auto.read(w)
        assert (got != MISS) == bool(allowed), w
        assert (got == EXACT) == (w in terms), w
        assert not sure or got in (EXACT, NEAR, LOOSE), w
    assert [auto.read(w) for w in ("idot", "moran", "stpuid", "xdiot", "diot", "scvm", "degnerat")] == [NEAR, NEAR, LOOSE, LOOSE, LOOSE, LOOSE, LOOSE]


def test_marks_and_digits_that_stand_for_letters():
    reader = Reader(LexiconAutomaton(["idiot", "asshole", "stupid"], []))
    for token in ("1diot", "1d10t", "id1ot", "$tupid", "@sshole", "stup!d", "*diot", "xdiot", "(idiot)"):
        assert reader.kind(token) != MISS, token
    assert [reader.kind(t) for t in ("$5", "100", "1st", "@home", "3.14", "wow!")] == [MISS] * 6


def test_stems_begin_words():
    auto = LexiconAutomaton(["scum"], ["lowe"])
    assert auto.read("loweichen") == STEM and auto.read("lowe") == STEM and auto.read("flowe") == MISS and auto.read("low") == MISS


def test_quotation_lowers_the_window_score():
    reader = Reader(LexiconAutomaton(["idiot", "moron"], []))
    plain, told = reader.features("you are an idiot and a moron"), reader.features('he said the word "idiot" and the word "moron" are insults')
    assert plain[5] > told[5] and plain[6] == 1 and told[6] == 0
    assert (reader.features("") == 0).all() and reader.features("1d10t")[2] > 0 and reader.features("id1ot")[2] > 0


@pytest.mark.parametrize("module, label, most_wrong", [(quality, "quality", 0.04), (toxicity, "toxic", 0.04)])
def test_held_out_accuracy(spark, module, label, most_wrong):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = module.classify(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = scored.where("held_out").join(labels, "doc_id")
    n = held.count()
    assert n > 50 and held.where(F.col("predicted") != F.col(label)).count() <= most_wrong * n
    # Labels of the held-out fold are not learned from: without them the scores are the same.
    less = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % module.MODULUS != module.HELD_OUT)
    again = module.classify(docs, less)
    assert scored.select("doc_id", "score").exceptAll(again.select("doc_id", "score")).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, docs, odd, module):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    found = module.classify(docs(odd), labels).collect()
    assert len(found) == len(odd) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 4}) == 1
    assert module.classify(docs([]), labels).count() == 0
    assert module.classify(docs(odd), labels.limit(0)).count() == len(odd)


def test_neighbours_vote_by_similarity():
    import numpy as np

    model = quality.Model(np.ones(quality.BUCKETS + quality.SHAPES, np.float32), np.eye(quality.BUCKETS + quality.SHAPES, 2, dtype=np.float32), np.array([[1, 0], [0, 1]], np.float32), np.array([1, 0], np.float32), 0.25)
    x = np.zeros((2, quality.BUCKETS + quality.SHAPES), np.float32)
    x[0, 0] = 1
    assert quality.vote(model, x).tolist() == [1.0, 0.25]
