import numpy as np
import pytest

from folioforge.operators import regions as R
from folioforge.operators.lines import lines
from folioforge.sources import images as I


def pgm(x):
    return b"P5\n# c\n%d %d\n255\n" % x.shape[::-1] + x.tobytes()


def test_images(spark):
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([("a", bytearray(pgm(x))), ("b", bytearray(b"GIF"))], "path string, content binary")
    got = {r.path: r for r in I.images(df, longest=2, target=1).collect()}
    assert (got["a"].width, got["a"].height) == (2, 2) and got["b"].error and got["b"].pixels is None
    v = I.variants(I.images(df, longest=9, target=1)).collect()
    assert [r.variant for r in sorted(v, key=lambda r: r.ord)] == list(I.VARIANTS) and bytes(v[0].pixels) == x.tobytes()
    assert I.sized(x, 100, 8).shape == (6, 8)


def test_grids_and_ink():
    x = np.full((61, 41), 255, np.uint8)
    x[::20] = 0
    x[:, ::20] = 0
    assert I.empty_grids(x) == (2, 3) and not I.has_ink(x[1:19])
    x[5:15, 5:15] = 0
    assert I.empty_grids(x) is None and I.has_ink(x[1:19])
    assert I.empty_grids(np.full((5, 5), 255, np.uint8)) is None
    assert set(np.unique(I.threshold(np.array([[10, 20], [200, 210]], np.uint8)))) == {0, 255}


def test_regions(spark):
    text = "City school\nName: A\nI. Read\n1. a\n2. b\n3. c ____\n\nsome words\n[[GRID: 2x2]]\nx || y"
    got = [(r.kind, r.n_lines) for r in R.regions(lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("region").collect()]
    assert got == [("header", 1), ("field", 1), ("section", 1), ("question", 2), ("fill_blank", 1), ("paragraph", 1), ("grid", 1), ("two_column", 1)]


def test_bounds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("0,0,500,500",), ("1,2,3",), ("900,0,200,1",)], "s string").select(R.scaled_bounds(F.col("s"), 200, 100).alias("b"))
    assert [tuple(r.b) if r.b else None for r in df.collect()] == [(0, 0, 100, 50), None, None]


@pytest.mark.parametrize("text, want", [
    ("Class: 5\nName: ______\nI. a\nClass: 6\nI. b", "Class: 5\nName: ______\nI. a\n[[PAPER_BREAK]]\nClass: 6\nI. b"),
    ("Subject: Maths\n1. a\nSubject: Maths\n2. b", "Subject: Maths\n1. a\n2. b"),
    ("[[BANNER: 1,1,2,2]]\nx", "x"),
])
def test_exam_content(text, want):
    assert R.exam_content(text) == want == R.exam_content(want)


def test_layout_adds_one_rule():
    once = R.laid_out("I. Answer these\n1. Why?\n2. How? ____\nII. Match\n1. a")
    assert once == "I. Answer these\n1. Why?\n[[ANSWER_LINES: 1]]\n2. How? ____\nII. Match\n1. a" == R.laid_out(once)


def test_edits():
    row = "[[MATCH_ROW: the cat || sat down]]"
    assert R.apply_edits(row, "the dog | sat down") == "[[MATCH_ROW: the dog || sat down]]"
    assert R.apply_edits(row, "the cat sat right down") == "[[MATCH_ROW: the cat || sat right down]]"
    assert R.apply_edits(row, "nothing like it at all here") is None and R.apply_edits(row, "the [[X: cat]]") is None
