"""Queries of the further page operators over papers, tables and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import layout as P
from folioforge.operators import lines as L
from folioforge.operators import markers as M
from folioforge.operators import regions as R
from folioforge.plans import fixtures
from folioforge.plans.papers import LINES_SQL, paper_docs, paper_lines
from folioforge.plans.records import made

RESPONSES = [
    (1, "I. Fill in the blanks\n1. The cat\n2. The dog\nII. Read\n1. a\n2. b"), (2, "I. Fill in the blanks\n1. The cat ____\n2. The dog"), (3, "I. Write true or false\n1. a ( )\n2. b\n3. c ( )"),
    (4, "I. Write true or false\n1. a\n( )\n2. b ( )"), (5, "I. Choose the correct option\n1. a\n2. b"), (6, "I. खाली स्थान भरो\n1. क\n2. ख"), (7, ""),
]
IDENTITIES = [(1, "Class: 5\nSubject: Maths"), (2, "कक्षा: ३ | विषय: हिन्दी"), (3, "nothing"), (4, "[[TABLE_ROW: Class: V || Sub: EVS]]")]
HEADS = [(1, "I. Answer these 5x2=10 M"), (2, "[[SECTION_ROW: IV. Write || 3½M]]"), (3, "f(5)"), (4, "(2, 3)"), (5, "II) Read ५ अंक"), (6, "plain")]
FORMATS = [(1, "I. Label the diagram\n1. a"), (2, "I. Write an essay"), (3, "I. Match\nII. Tick"), (4, "I. Answer\n1. draw a diagram"), (5, "")]
BOUNDS = [(1, "0,0,500,500"), (2, "1,2,3"), (3, "900,0,200,1")]
CANONICAL = [(1, "1. a || none"), (2, "1. a || 3M"), (3, "a || b")]
LAYERS = [(1, "fine text"), (2, "bad "), (3, "x �"), (4, "कि ठीक"), (5, " ि्")]
ENGINES = "SELECT l_orderkey * 10 + l_linenumber AS line, l_suppkey % 5 * 1000000 + l_partkey AS engine, CASE l_suppkey % 3 WHEN 0 THEN 'Same  text' WHEN 1 THEN 'same text' ELSE 'other' END AS text, CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence FROM lineitem"
PAGES = "SELECT user_id AS job, event_id AS page, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence FROM events"
SAVED = "SELECT user_id AS key, event_id AS page, CAST(floor(value) AS BIGINT) AS size, ts FROM events"
WORDS = "SELECT a.c_custkey AS id, a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey * 7 % 1500"
ANTONYMS = [(1, "I. Write the opposites\n[[MATCH_ROW: big || small ✓]]\nII. Match\n[[MATCH_ROW: a || b]]"), (2, "text")]
BRACKETS = [(1, "1. The sun rises\n( )\n2. It sets\n[ ]\nx"), (2, "( )\na")]
NOTES = [(1, "I. Name these\nduck pic\nFish picture\nII. Look\nkite pic\n[[FIGURE: 1,1,2,2|k]]")]


def rows(data, value):
    return lambda s, _: fixtures.frame(s, data, "doc_id long, text string").select(F.col("doc_id").alias("id"), value().alias("v"))


def by_lines(data, op):
    return lambda s, _: op(L.lines(fixtures.frame(s, data, "doc_id long, text string")))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images made of the documents' bytes, as square as they get, the last row filled up with black."""
    df = made("SELECT doc_id AS id, text FROM documents")(spark, sf_dir).withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.octet_length("text")))).cast("int"))
    sized = df.withColumn("height", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.col("width"))).cast("int"))
    return P.image_measures(sized.select("id", "width", "height", F.expr("rpad(cast(text AS binary), width * height, X'00')").alias("pixels")))


QUERIES = {
    "p8_missing_responses": by_lines(RESPONSES, P.missing_responses),
    "m2_identity": lambda s, _: P.identity(fixtures.frame(s, IDENTITIES, "doc_id long, text string")),
    "m5_section_heading": lambda s, d: paper_lines(s, d).select("doc_id", "line_no", P.section_heading(F.col("line")).alias("h")).where("h IS NOT NULL").select("doc_id", "line_no", "h.*"),
    "m5_section_heading_fixtures": rows(HEADS, lambda: F.to_json(P.section_heading(F.col("text")))),
    "m6_text_layer": rows(LAYERS, lambda: P.text_layer_reliable(F.col("text"))),
    "m7_automatic_format": lambda s, d: P.automatic_format(fixtures.frame(s, FORMATS, "doc_id long, text string")),
    "m8_repair_antonyms": by_lines(ANTONYMS, P.repair_antonyms),
    "m9_join_brackets": by_lines(BRACKETS, P.join_brackets),
    "m11_captions": rows([(1, "[[FIGURE: 1,1,2,2|3) What do you see here]]"), (2, "[[FIGURE: 1,1,2,2|cat]]")], lambda: P.captions_as_text(F.col("text"))),
    "m12_picture_notes": by_lines(NOTES, P.picture_notes),
    "m25_renamed_media": rows([(1, "m1 [[SOURCE_FIGURE: m1]] m1 [[SOURCE_FIGURE_ROW: m1 || m2]]")], lambda: P.renamed_media(F.col("text"), F.lit("m1"), F.lit("n9"))),
    "a5_page_confidence": lambda s, d: P.page_confidence(made(PAGES)(s, d)),
    "a16_merged_engines": lambda s, d: P.merged_engines(made(ENGINES)(s, d)),
    "t11_checkpoints": lambda s, d: P.checkpoints_kept(made(SAVED)(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), 240, 500),
    "f2_levenshtein": lambda s, d: made(WORDS)(s, d).select("id", F.levenshtein("a", "b").alias("v")),
    "f20_section_ordinal": lambda s, d: paper_lines(s, d).select("doc_id", "line_no", T.section_ordinal(F.regexp_extract("line", r"^([IVX]+)\.", 1)).alias("v")).where("v IS NOT NULL"),
    "f19_field_labels": rows(IDENTITIES, lambda: F.array_join(F.array_compact(F.array(*(F.when(F.col("text").rlike("(?iu)" + p), F.lit(k)) for k, p in M.FIELDS.items()))), ",")),
    "f42_styled_runs": rows([(1, "a [[UNDERLINE: b]] c [[CIRCLED: d]]"), (2, "plain")], lambda: M.over_texts(lambda t: repr(M.styled_runs(t)))("text")),
    "f44_image_measures": rasters,
    "f23_regions": lambda s, d: R.regions(paper_lines(s, d)),
    "m3_exam_content": lambda s, d: paper_docs(s, d).select("doc_id", F.md5(M.over_texts(R.exam_content)("text")).alias("v")),
    "m13_laid_out": lambda s, d: paper_docs(s, d).select("doc_id", F.md5(M.over_texts(R.laid_out)("text")).alias("v")),
    "m16_scaled_bounds": rows(BOUNDS, lambda: F.to_json(R.scaled_bounds(F.col("text"), 200, 100))),
    "f7_branches": rows([(1, "[[BRANCH_ROOT: R]]\n[[BRANCH_ITEM: a || x]]\n[[BRANCH_ITEM: b || ]]\n[[BRANCH_END]]\nz")], lambda: M.over_texts(M.branches)("text")),
    "f11_canonical_rows": rows(CANONICAL, lambda: M.over_texts(lambda t: M.canonical_row("QUESTION_ROW", t))("text")),
    "f13_pipe_tables": rows([(1, "| a | b |\n|---|---|\n| 1 | 2 |"), (2, "| | |\n| | |")], lambda: M.over_texts(M.pipe_tables)("text")),
    "f14_native_rows": rows([(1, "Class: 5 || Subject: Maths\n1. a ____ || 2. b ( )")], lambda: M.over_texts(M.native_rows)("text")),
    "f15_writing_boxes": rows([(1, "Write the letters A to L"), (2, "Fill the letters A to L")], lambda: M.over_texts(M.writing_boxes)("text")),
    "f16_closed_lines": rows([(1, "[TABLE_ROW: a || \n[[GRID: 2x2]]")], lambda: M.over_texts(M.closed_lines)("text")),
    "f17_maths_rows": rows([(1, "1 | 2 | 3 | 4 | 5\nWrite numbers from 1 to 20")], lambda: M.over_texts(M.maths_rows)("text")),
    "f12_markup": rows([(1, "<table><tr><td>a</td><th>b</th></tr></table>"), (2, "<table>x</table>")], lambda: M.over_texts(M.recognised_markup)("text")),
}
_EXPECTED = {
    "m5_section_heading_fixtures": [(1, '{"ordinal":1,"instruction":"Answer these","marks":"5x2=10 M"}'), (2, '{"ordinal":4,"instruction":"Write","marks":"3½M"}'), (3, None), (4, None), (5, '{"ordinal":2,"instruction":"Read","marks":"५ अंक"}'), (6, None)],
    "f19_field_labels": [(1, "class,subject"), (2, "class,subject"), (3, ""), (4, "class,subject")],
    "f7_branches": [(1, "     ↗ a ───────── x\n○ R → b\nz")],
    "f11_canonical_rows": [(1, "1. a"), (2, "[[QUESTION_ROW: 1. a || 3M]]"), (3, "a b")],
    "f13_pipe_tables": [(1, "[[TABLE_ROW: a || b]]\n[[TABLE_ROW: 1 || 2]]"), (2, "[[GRID: 2x2]]")],
    "f14_native_rows": [(1, "[[TABLE_ROW: Class: 5 || Subject: Maths]]\n[[MATCH_ROW: 1. a ____ || 2. b ( )]]")],
    "f15_writing_boxes": [(1, "Write the letters A to L\n[[GRID: 10x1]]\n[[GRID: 2x1]]"), (2, "Fill the letters A to L")],
    "f16_closed_lines": [(1, "[[TABLE_ROW: a]]\n[[GRID: 2x2]]")],
    "f17_maths_rows": [(1, "[[GRID_ROW: 1 || 2 || 3 || 4 || 5]]\nWrite numbers from 1 to 20\n[[GRID: 10x2]]")],
    "f12_markup": [(1, "[[TABLE_ROW: a || b]]"), (2, "<table>x</table>")],
    "m16_scaled_bounds": [(1, '{"x":0,"y":0,"w":100,"h":50}'), (2, None), (3, None)],
    "f42_styled_runs": [(1, "[('', 'a '), ('underline', 'b'), ('', ' c '), ('circled', 'd')]"), (2, "[('', 'plain')]")],
}
ORACLE = {name: f"SELECT * FROM ({fixtures.values_sql(data)}) f(id, v)" for name, data in _EXPECTED.items()}
ORACLE |= {
    "m2_identity": "SELECT * FROM (VALUES (1, '5', 'Maths'), (2, '३', 'हिन्दी'), (3, NULL, NULL), (4, 'V', 'EVS')) f(doc_id, class, subject)",
    "m9_join_brackets": "SELECT * FROM (VALUES (1, 0, '1. The sun rises ( )'), (1, 2, '2. It sets [ ]'), (1, 4, 'x'), (2, 0, '( )'), (2, 1, 'a')) f(doc_id, line_no, line)",
    "m12_picture_notes": "SELECT 1 AS doc_id, 'I. Name these' AS section, '[[PICTURE_ROW: duck || fish]]' AS line",
    "m8_repair_antonyms": "SELECT * FROM (VALUES (1, 0, 'I. Write the opposites'), (1, 1, 'big - small'), (1, 2, 'II. Match'), (1, 3, '[[MATCH_ROW: a || b]]'), (2, 0, 'text')) f(doc_id, line_no, line)",
    "p8_missing_responses": "SELECT doc_id, sec, items, with_place FROM (VALUES (1, 1, 2, 0), (3, 1, 3, 2), (5, 1, 2, 0), (6, 1, 2, 0)) f(doc_id, sec, items, with_place)",
    "m6_text_layer": "SELECT id, v FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false)) f(id, v)",
    "m7_automatic_format": "SELECT doc_id, format FROM (VALUES (1, 'science'), (2, 'humanities'), (3, 'worksheet'), (4, 'compact'), (5, 'compact')) f(doc_id, format)",
    "a5_page_confidence": f"SELECT job, count(*) AS pages, round(avg(confidence)::DECIMAL(18,9), 4)::DOUBLE AS average FROM ({PAGES}) p GROUP BY job",
    "a16_merged_engines": f"WITH p AS (SELECT *, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM ({ENGINES}) e), b AS (SELECT line, arg_max(text, (confidence, engine)) AS text, arg_max(plain, (confidence, engine)) AS plain, max(confidence) AS c FROM p GROUP BY line) SELECT b.line, any_value(b.text) AS text, round(least(1.0, any_value(c) + 0.03 * (count(*) - 1)), 6) AS confidence FROM b JOIN p ON p.line = b.line AND p.plain = b.plain GROUP BY b.line",
    "t11_checkpoints": f"SELECT key, page, total FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY key ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ({SAVED}) s WHERE ts + INTERVAL 240 HOUR > TIMESTAMP '2024-01-15 00:00:00') q WHERE total <= 500",
    "f2_levenshtein": f"SELECT id, levenshtein(a, b) AS v FROM ({WORDS}) w",
    "f20_section_ordinal": f"SELECT doc_id, line_no, list_position(['I','II','III','IV','V','VI','VII'], regexp_extract(line, '^([IVX]+)\\.', 1)) AS v FROM {LINES_SQL} l WHERE regexp_extract(line, '^([IVX]+)\\.', 1) <> ''",
    "m25_renamed_media": "SELECT 1 AS id, 'm1 [[SOURCE_FIGURE: n9]] m1 [[SOURCE_FIGURE_ROW: n9 || m2]]' AS v",
    "m11_captions": "SELECT id, v FROM (VALUES (1, '3) What do you see here'), (2, '[[FIGURE: 1,1,2,2|cat]]')) f(id, v)",
    "m5_section_heading": f"""
        WITH x AS (SELECT doc_id, line_no, regexp_replace(line, '^\\[\\[SECTION_ROW: (.*)\\]\\]$', '\\1') AS x FROM {LINES_SQL} l WHERE regexp_matches(line, '^(\\[\\[SECTION_ROW: )?[IVX]+\\. ')),
        p AS (SELECT doc_id, line_no, split_part(split_part(x, ' || ', 1), '. ', 1) AS label, regexp_replace(split_part(x, ' || ', 1), '^[IVX]+\\. ', '') AS said, split_part(x, ' || ', 2) AS cell FROM x)
        SELECT doc_id, line_no, list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'], label) AS ordinal, regexp_replace(said, ' [0-9]+x[0-9]+=[0-9]+ ?(M|Marks?)$', '') AS instruction,
            CASE WHEN cell <> '' THEN cell ELSE nullif(regexp_extract(said, ' ([0-9]+x[0-9]+=[0-9]+ ?(?:M|Marks?))$', 1), '') END AS marks FROM p""",
    "f23_regions": f"""
        WITH t AS (SELECT doc_id, line_no, trim(line) AS x FROM {LINES_SQL} l WHERE trim(line) <> ''),
        k AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(x, '(?i)^\\[\\[(?:GRID|GRID_ROW|TABLE_ROW)') THEN 'grid' WHEN x ILIKE '[[MATCH_ROW%' THEN 'matching'
            WHEN len(x) <= 90 AND regexp_matches(x, '(?i)\\b(?:school|vidyalaya|examination|assessment)\\b') THEN 'header'
            WHEN regexp_matches(x, '(?i)^(?:name|class|roll|date|subject|time|marks)\\b[^:]{{0,20}}:') THEN 'field'
            WHEN x ILIKE '[[SECTION_ROW:%' OR regexp_matches(x, '^[IVXivx]{{1,6}}[.)]\\s+\\S') THEN 'section' WHEN len(x) <= 20 AND regexp_matches(x, '{T.MARKS}') THEN 'marks'
            WHEN contains(x, '___') OR regexp_matches(x, '\\(\\s*\\)') THEN 'fill_blank' WHEN regexp_matches(x, '^(?:[0-9०-९]+|[a-z])[.)]\\s*\\S') THEN 'question'
            WHEN contains(x, '||') THEN 'two_column' ELSE 'paragraph' END AS kind FROM t),
        s AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS starts FROM k),
        r AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS region FROM s)
        SELECT doc_id, region, min(kind) AS kind, min(line_no) AS first_line, count(*) AS n_lines FROM r GROUP BY doc_id, region""",
}
