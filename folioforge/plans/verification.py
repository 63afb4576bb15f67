"""Two-reading guards over fixtures and over marker papers against a changed second reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import guards as G
from folioforge.plans import fixtures
from folioforge.plans.scalars import FIXED_READINGS_SQL, fixed_readings
from folioforge.session import table

#: Papers: label sequences per order; the second reading drops, repeats or swaps by key.
LABELS = "SELECT l_orderkey AS id, l_linenumber AS ord, CAST(l_linenumber + l_suppkey % 2 AS VARCHAR(9)) AS lab, l_partkey % 13 = 0 AS dropped FROM lineitem"


def paper_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(LABELS.replace("lineitem", "{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "lab")))), lambda x: F.concat(x["lab"], F.lit(". item"))), "\n")
    return rows.groupBy("id").agg(F.concat(F.lit("I. Read\n"), text(F.lit(True))).alias("a"), F.concat(F.lit("I. Read\n"), text(~F.col("dropped"))).alias("b"))


_STRINGS = f"p AS (SELECT id, list(lab ORDER BY ord, lab) AS a, coalesce(list(lab ORDER BY ord, lab) FILTER (NOT dropped), []) AS b FROM ({LABELS}) q GROUP BY id)"
MARKERS = [
    (1, "[[FIGURE: 1,2,3,4|cap]]"), (2, "[[FIGURE: 900,2,300,4|cap]]"), (3, "[[UNKNOWN: x]]"), (4, "[[QUESTION_ROW: x]]"), (5, "[[QUESTION_ROW: x || 2]]"), (6, "[[GRID: 5x4]]"), (7, "[[GRID: 60x4]]"),
    (8, "[[TABLE_ROW: a || [[GRID: 2x2]] || b]]"), (9, "open [[STRIKE: x"), (10, "[[COUNT_OBJECTS: apple,5|1.|box|1,1,5,5]]"), (11, "[[COUNT_OBJECTS: pear,5|1.|box|1,1,5,5]]"), (12, "[[ABACUS: T=1,O=2|2)|none|1,1,5,5]]"),
    (13, "[[ABACUS: T=1,T=2|2)|none|1,1,5,5]]"), (14, "[[SOURCE_PAGE: 12]]"), (15, "[[SOURCE_PAGE: 0]]"), (16, "plain"), (17, "[[CHECKBOX]] [[BRANCH_END]]"), (18, "[[FIGURE: 0,0,1000,700|big]]"), (19, "[[TABLE_ROW: [[FIGURE: 1,1,5,5|x]] || b]]"),
]
CROPS = [(1, "a [[FIGURE: 1,1,5,5|A]] b [[FIGURE_ROW: 2,2,5,5|B || 3,3,5,5|C]]", "[[FIGURE: 9,9,8,8|a]] [[FIGURE_ROW: 7,7,8,8|b || 6,6,8,8|c]]"), (2, "[[FIGURE: 1,1,5,5|A]]", "[[FIGURE: 1,1,5,5|B]]"), (3, "no figure", "[[FIGURE: 1,1,5,5|B]]")]
MARKED = [(1, "[[SECTION_ROW: I. Read || 5M]]\nI. Read\n[[QUESTION_ROW: 1. a || 3M]]", "[[SECTION_ROW: I. Read || 5M]]\nI. Read\n[[QUESTION_ROW: 1. a || 4M]]"), (2, "I. Read 3x2=6", "I. Read 3x2=6M"), (3, "I. Read 3x2=6", "I. Read 3x2=6"), (4, "I. x 5 Marks", "I. x")]
META = "structuredLayout boolean, multiColumnRows int, denseOptionRows int, longHorizontalRules int, longVerticalRules int, lineCount int, scanStrategy string, difficulty string, score double, edgeRatio double, contrast double, pageNumber int"
NO_META = (False, 0, 0, 0, 0, 0, None, None, 0.0, 0.0, 0.0, 2)


#: Papers with counted figures, with and without bounds, by order: what is shown, and two readings of it.
_COUNTED = lambda n: ("'Count' || chr(10) || '1. [[COUNT_OBJECTS: apple,' || CAST(" + n + " AS VARCHAR(9)) || ' | 1. |box' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '| ' ELSE ' | 1,1,5,' || CAST(o_custkey % 9 AS VARCHAR(9)) || ' ' END || ']] or "  # noqa: E731
                      "[[abacus:T=1,O=' || CAST(o_custkey % 5 AS VARCHAR(9)) || '|2)|none|7,7,9,9' || CASE WHEN o_orderkey % 2 = 0 THEN '|more' ELSE '' END || ']]' || chr(10) || '[[FIGURE: 1,1,2,2|x]]'")
COUNTED = f"SELECT o_orderkey AS id, {_COUNTED('o_custkey % 7')} AS a, {_COUNTED('o_custkey % 7 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END')} AS b, o_orderkey % 11 <> 0 AS completed FROM orders"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COUNTED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def fixture(data, schema, value):
    return lambda s, _: fixtures.frame(s, data, schema).select("id", value().alias("v"))


def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["", "No text detected.", "short", "A perfectly readable line of text", "a\nb", "x [unclear] y and more text here", "[[STRIKE: a]] and some more text"]
    rows = [(k, t, NO_META) for k, t in enumerate(texts)] + [(100, "A perfectly readable line of text", (True, *NO_META[1:])), (101, "ab", (*NO_META[:8], 1.0, *NO_META[9:]))]
    return spark.createDataFrame(rows, f"id int, t string, m struct<{META.replace(' ', ': ').replace(',:', ',')}>").select("id", G.should_verify(F.col("t"), F.col("m")).alias("v"))


def accept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures.frame(spark, [r for r in fixtures.READINGS], "id long, a string, b string, page int")
    names = [p.split()[0] for p in META.split(", ")]
    meta = F.struct(*(F.lit(v).cast(p.split()[1]).alias(n) for n, v, p in zip(names, NO_META, META.split(", "))))
    return df.select("id", G.accept_second(F.col("a"), F.col("b"), meta).alias("v"))


QUERIES = {
    "p5_invalid_markers": fixture(MARKERS, "id int, t string", lambda: G.invalid_markers(F.col("t"))),
    "p6_verified_crops": fixture(CROPS, "id int, a string, b string", lambda: G.verified_crops(F.col("a"), F.col("b"))),
    "p11_question_inventory": lambda s, d: paper_readings(s, d).select("id", F.array_join(F.transform(G.question_inventory(F.col("b")), lambda x: F.concat(x["bit"], F.lit(":"), x["item"])), ",").alias("v")),
    "p12_loses_questions": lambda s, d: paper_readings(s, d).select("id", G.loses_questions(F.col("b"), F.col("a")).alias("back"), G.loses_questions(F.col("a"), F.col("b")).alias("v")),
    "p12_loses_questions_fixtures": lambda s, d: fixed_readings(s, d).select("id", G.loses_questions(F.col("a"), F.col("b")).alias("v")),
    "p13_loses_marks": fixture(MARKED, "id int, a string, b string", lambda: G.loses_marks(F.col("a"), F.col("b"))),
    "p14_should_verify": verify_rows,
    "p15_accept_second": accept_rows,
    "f24_quantities": lambda s, d: counted(s, d).select("id", F.array_join(G.quantities(F.col("b")), ";;").alias("v")),
    "f24_reconciled": lambda s, d: counted(s, d).select("id", G.reconciled(F.col("a"), F.col("a"), F.col("b"), F.col("completed")).alias("r")).select("id", "r.*"),
    "p19_clean_hints": lambda s, d: s.createDataFrame([(1, [(" a ", "b", 500), ("x", "x", 1), ("", "q", 1)]), (2, [("<b>", "c", 1), ("d", "e", None)])], "id int, h array<struct<wrong: string, right: string, count: int>>").select("id", F.to_json(G.clean_hints(F.col("h"))).alias("v")),
    "p20_clean_views": lambda s, d: s.createDataFrame([(1, [(2_000_000, 0, 0, 10, 10), (2_000_000, 0, 0, 10, 10), (2_000_000, 0, 0, 10, 10), (10, 0, 0, 10, 10)]), (2, [(10, 0, 0, 2000, 1), (10, 5, 5, 5, 5)])], "id int, h array<struct<size: long, x: int, y: int, w: int, h: int>>").select("id", G.clean_views(F.col("h")).alias("v")),
}
#: A marker's parts, trimmed; the texts between the markers, and what stands for each where the readings differ.
_MARKER = r"(?i)\[\[(COUNT_OBJECTS|ABACUS):\s*([^\]\n]+)\]\]"
_BODIES = lambda t: f"list_transform(regexp_extract_all({t}, '{_MARKER}', 2), lambda x: list_transform(string_split(x, '|'), lambda y: trim(y)))"
_COUNTS = lambda t: f"array_to_string(list_transform(list_zip(regexp_extract_all({t}, '{_MARKER}', 1), {_BODIES(t)}), lambda z: upper(z[1]) || ':' || array_to_string(z[2][1:3], '|')), ';;')"
_BAD = {2, 3, 4, 7, 8, 9, 11, 13, 15, 18}
ORACLE = {
    "f24_quantities": f"SELECT id, {_COUNTS('b')} AS v FROM ({COUNTED}) t",
    "f24_reconciled": f"""
        WITH t AS (SELECT *, NOT (completed AND {_COUNTS('a')} = {_COUNTS('b')}) AS disagreement FROM ({COUNTED}) t0),
        g AS (SELECT *, string_split_regex(a, '{_MARKER}') AS gaps, list_transform({_BODIES('a')}, lambda z: CASE WHEN coalesce(z[4], '') <> '' THEN '[[FIGURE: ' || z[4] || '|' || z[2] || '|' || z[3] || ']]' ELSE '[unclear]' END) AS parts FROM t)
        SELECT id, CASE WHEN disagreement THEN array_to_string(list_transform(list_zip(gaps, parts), lambda z: z[1] || coalesce(z[2], '')), '') ELSE a END AS text, disagreement FROM g""",
    "p19_clean_hints": """SELECT * FROM (VALUES (1, '[{"wrong":"a","right":"b","count":99}]'), (2, '[{"wrong":"d","right":"e","count":1}]')) f(id, v)""",
    "p6_verified_crops": "SELECT * FROM (VALUES (1, 'a [[FIGURE: 9,9,8,8|A]] b [[FIGURE_ROW: 7,7,8,8|B || 6,6,8,8|C]]'), (2, '[[FIGURE: 1,1,5,5|A]]'), (3, 'no figure')) f(id, v)",
    "p14_should_verify": "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, true), (6, true), (100, true), (101, true)) f(id, v)",
    "p20_clean_views": "SELECT * FROM (VALUES (1, [0, 1]), (2, [1])) f(id, v)",
    "p5_invalid_markers": f"SELECT id, v FROM ({fixtures.values_sql([(k, k in _BAD) for k, _ in MARKERS])}) f(id, v)",
    "p11_question_inventory": f"WITH {_STRINGS} SELECT id, array_to_string(list_transform(b, lambda x: 'I:' || x), ',') AS v FROM p",
    "p12_loses_questions": f"WITH {_STRINGS} SELECT id, false AS back, NOT regexp_matches(',' || array_to_string(b, ',') || ',', ',' || array_to_string(a, ',(?:.*,)?') || ',') AS v FROM p",
    "p13_loses_marks": f"SELECT id, v FROM ({fixtures.values_sql([(1, True), (2, True), (3, False), (4, True)])}) f(id, v)",
    "p12_loses_questions_fixtures": f"SELECT id, id IN (4, 5, 9) AS v FROM {FIXED_READINGS_SQL} r",
    "p15_accept_second": f"SELECT id, v FROM ({fixtures.values_sql([(k, v) for k, v in zip(range(1, 14), (False, True, True, False, False, True, False, False, False, False, False, False, True))])}) f(id, v)",
}
