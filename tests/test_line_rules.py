"""Line and text rules on small papers."""

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import lines as L


def paper(spark, text):
    return L.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_blocks(spark):
    text = "[[PICTURE: a]]\n\n\n[[PICTURE_OPTION: b]]\n\nII. Write it (5 x 2 = 10)\n[[BRANCH_ROOT: r]]\n[[BRANCH_ITEM: a || b]]\n[[PICTURE: in]]\n[[BRANCH_END]]\n[[BRANCH_ROOT: s]]\n[[BRANCH_ITEM: c || d]]\nlast"
    found = [(r.kind, r.n_lines, r.text) for r in L.blocks(paper(spark, text)).orderBy("line_no").collect()]
    assert found == [("picture_grid", 2, "[[PICTURE: a]]"), ("blank", 1, ""), ("section", 1, "II. Write it"), ("branch", 1, "r"), ("branch", 1, "s")]


def test_short_runs_become_grids(spark):
    run = lambda *x: [(r.n, r.columns, r.rows, r.cells) for r in L.short_runs(paper(spark, "\n".join(x))).collect()]
    assert run("1", "2", *"abcdef", "", "9", "a long line", "x") == [(6, 3, 2, "a|b|c|d|e|f")]
    assert run(*"abcdefg") == [] and run(*"12abcde34") == [] and run(*"12345678") == []


def test_prelude(spark):
    text = "Answer the following\n\n[[SECTION_ROW: II. Answer  the following: || 5M]]\nsame\nsame\nI. Answer the following\n[[SECTION_ROW: III. Answer the following || 1M]]"
    assert [r.line for r in L.dedupe_prelude(paper(spark, text)).orderBy("line_no").collect()] == ["", *text.split("\n")[1:]]


def test_print_issues(spark):
    docs = spark.createDataFrame([(1, "[[SECTION_ROW: II. Do || 2x2=5]]\n1. a\n[[SOURCE_FIGURE_ROW: a || b || c || d || e || f]]", True), (2, "II. Do\nIV. Go [unclear]", False), (3, None, None)], "doc_id long, text string, continuation boolean")
    found = {}
    for r in L.print_issues(docs).orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append((r.category, r.evidence))
    assert found[1] == [("images", "[[SOURCE_FIGURE_ROW: a || b || c || d || e || f]]"), ("marks", "2x2=5")]
    assert found[2] == [("sections", "Bit I"), ("ocr", "[unclear]"), ("questions", "Question numbering"), ("sections", "IV. Go [unclear]")]
    assert found[3] == [("sections", "Bit I"), ("questions", "Question numbering")]


def test_proposed_issues(spark):
    issue = "array<struct<severity: string, category: string, evidence: string, detail: string>>"
    docs = spark.createDataFrame([(1, "I. Do\n1. one", [("critical", "marks", "one", "d"), ("odd", "odd", "Do", "x" * 300), ("critical", "marks", "none", "d"), ("critical", "marks", "one", None), (None, None, None, None)])], f"doc_id long, text string, issues {issue}")
    assert [(r.ord, r.severity, r.category, r.evidence, len(r.detail)) for r in L.supported_issues(docs).collect()] == [(1, "critical", "marks", "one", 1), (2, "review", "alignment", "Do", 250)]
    assert [r.evidence for r in L.reviewed(docs, 1).collect()] == ["one"]


def test_places_for_responses(spark):
    texts = ["I. Fill in the blanks\n1. a\n2. b", "I. Fill in the blanks\n1. a ____\n2. b", "I. Write true or false\n1. a ( )\n2. b\n3. c", "I. Write true or false\n1. a\n( )\n2. b ( )", "Class: 4\n1. a\n2. b", "I. Choose the right answer\n1. a", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    assert [r.v for r in df.select("id", T.lacks_responses(F.col("text")).alias("v")).orderBy("id").collect()] == [True, False, True] + [False] * 5
    stems = spark.createDataFrame([(1, "1. seven = ____\n2. ____ x\n[[MATCH_ROW: 3. a __ || 4) b]]")], "id int, text string")
    assert stems.select(T.blank_stems(F.col("text")).alias("n")).first().n == 2
