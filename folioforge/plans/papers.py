"""Line and block queries over marker papers, one per order, and over documents.

Each order is a paper, each line item a question: the marker text is built from the columns in the same way for both engines,
with repeated, dropped and reordered parts by key, so that parsing has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import lines as L
from folioforge.plans.scalars import DWS
from folioforge.session import table

#: Lines of a paper by place; both engines read this SQL.
PAPER = """
    SELECT o_orderkey AS doc_id, 0 AS place, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'CLASS: ' || CAST(o_custkey % 8 + 1 AS VARCHAR(9)) END AS line FROM orders
    UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'ANNUAL EXAMINATION ' || o_orderpriority END FROM orders
    UNION ALL SELECT o_orderkey, 2, '' FROM orders
    UNION ALL SELECT l_orderkey, l_linenumber * 10 - 1, CASE WHEN l_suppkey % 3 = 0 THEN 'Answer  the following:' WHEN l_suppkey % 3 = 1 THEN 'Answer some' ELSE '' END FROM lineitem WHERE l_partkey % 5 = 0
    UNION ALL SELECT l_orderkey, l_linenumber * 10, CASE WHEN l_partkey % 5 = 0 THEN '[[SECTION_ROW: ' || CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'II' ELSE 'IV' END WHEN 5 THEN 'V' WHEN 6 THEN 'VI' ELSE 'VII' END || '. Answer the following || 5x1=5]]'
        ELSE CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'II' ELSE 'IV' END WHEN 5 THEN 'V' WHEN 6 THEN 'VI' ELSE 'VII' END || '. Answer the following ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || 'x' || CAST(l_linenumber AS VARCHAR(9)) || CASE WHEN l_orderkey % 3 = 1 THEN '' ELSE '=' || CAST(CAST(l_quantity AS INT) * l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) END END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 1, CASE l_suppkey % 4 WHEN 0 THEN '[[PICTURE: item]]' WHEN 1 THEN '[[MATCH_ROW: left || right]]' WHEN 2 THEN '[[FIGURE: 1,2,3,4|fig]]' ELSE '1. Name the part' END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 2, CASE l_suppkey % 4 WHEN 0 THEN CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '[[PICTURE_OPTION: item]]' END WHEN 1 THEN '[[MATCH_ROW: up || down]]' WHEN 2 THEN '[[FIGURE: 5,6,7,8|fig]]' ELSE CASE WHEN l_partkey % 7 = 0 THEN '[[SOURCE_FIGURE_ROW: a || b || c || d || e || f]]' ELSE '[[SOURCE_FIGURE_ROW: a || b || c]]' END END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 3, CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 3 = 0 THEN '[[PICTURE: other]]' ELSE CASE l_suppkey % 3 WHEN 0 THEN '[[CHECKBOX]]' WHEN 1 THEN '[[OPTION_ROW: a || b]]' ELSE '' END END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 4, CASE WHEN l_partkey % 6 = 0 THEN '[[PAGEBREAK]]' WHEN l_partkey % 6 = 1 THEN '[[PAGE_BREAK]]' ELSE '' END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 5, CASE WHEN l_partkey % 12 < 2 THEN 'Class: ' || CAST(l_partkey % 3 + 1 AS VARCHAR(9)) ELSE 'ab' END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 6, '[[BRANCH_ROOT: stem]]' FROM lineitem WHERE l_partkey % 8 = 0
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 7, '[[BRANCH_ITEM: leaf || green]]' FROM lineitem WHERE l_partkey % 8 = 0
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 8, '[[BRANCH_END]]' FROM lineitem WHERE l_partkey % 8 = 0 AND l_partkey % 64 <> 0
"""
#: The line number follows the place, ties by the line itself: a line number can occur twice in an order.
NUMBERED = "(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, line) - 1 AS INT) AS line_no, line FROM ({}) q)"
LINES_SQL = NUMBERED.format(PAPER)
#: Short lines, as a letter grid is read, with numbers and longer lines among them.
SHORT_SQL = NUMBERED.format("""
    SELECT l_orderkey AS doc_id, l_linenumber * 10 AS place, CASE WHEN l_partkey % 9 = 0 THEN 'a longer line' WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 100 AS VARCHAR(9)) ELSE 'abc' END AS line FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 1, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' xy' ELSE '12' END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 2, CASE WHEN l_suppkey % 7 = 0 THEN 'क' WHEN l_suppkey % 7 = 1 THEN '[[x' WHEN l_suppkey % 7 = 2 THEN '7' ELSE 'q' || CAST(l_linenumber AS VARCHAR(9)) END FROM lineitem
""")
#: Lines of one character, as a grid read letter by letter, with blank and longer ones among them.
LETTERS_SQL = NUMBERED.format("""
    SELECT l_orderkey AS doc_id, l_linenumber * 10 AS place, CASE WHEN l_partkey % 11 = 0 THEN 'a longer line' ELSE CAST(l_linenumber AS VARCHAR(9)) END AS line FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 1, CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE ' z ' END FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber * 10 + 2, 'क' FROM lineitem
""")
DOC_LINES_SQL = r"(SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents))"


def lines_from(sql: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")}
        return spark.sql(f"SELECT * FROM {sql.replace('orders', '{orders}').replace('lineitem', '{lineitem}')}", **{n: v for n, v in views.items() if n in sql})

    return build


paper_lines = lines_from(LINES_SQL)


def paper_docs(spark: SparkSession, sf_dir: str, lines=paper_lines) -> DataFrame:
    rows = lines(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def paper_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks(paper_lines(spark, sf_dir))


# DuckDB forms of the shared steps.
_P = {k: v for k, v in L.BLOCKS.items()}
_KIND = f"""CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{_P['pagebreak']}') THEN 'pagebreak'
    WHEN regexp_matches(line, '{L.CLASS}') AND len(line) <= 80 AND NOT contains(line, '____') THEN 'title'
    WHEN regexp_matches(line, '{L.TITLE}') AND len(line) <= 90 AND NOT contains(line, '____') THEN 'title'
    WHEN regexp_matches(line, '{_P['branch']}') THEN 'branch' WHEN regexp_matches(line, '{_P['picture']}') THEN 'picture_grid' WHEN regexp_matches(line, '{_P['checkboxes']}') THEN 'checkboxes'
    WHEN regexp_matches(line, '{_P['option_row']}') THEN 'option_row' WHEN regexp_matches(line, '{_P['match_table']}') THEN 'match_table'
    WHEN (regexp_matches(line, '{L.PART}') OR regexp_matches(line, '{L.HEADING}')) AND NOT regexp_matches(line, '{L.QUESTION}') THEN 'section' ELSE 'text' END"""


_BARE = f"regexp_replace(regexp_replace(raw, '{L.HEADING_MARKS}', ''), '^[ .\\t]+|[ .\\t]+$', '', 'g')"


def blocks_cte(source: str) -> str:
    return f"""t AS (SELECT doc_id, line_no, trim(line) AS line FROM {source} s), k0 AS (SELECT *, {_KIND} AS own FROM t),
        k1 AS (SELECT *, max(CASE WHEN own = 'branch' THEN line_no END) OVER above AS root, coalesce(max(CASE WHEN regexp_matches(line, '{_P['branch_end']}') THEN line_no END) OVER above, -1) AS ended,
            last_value(CASE WHEN own <> 'blank' THEN own END IGNORE NULLS) OVER above AS solid, first_value(CASE WHEN own <> 'blank' THEN own END IGNORE NULLS) OVER below AS following
            FROM k0 WINDOW above AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), below AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        k AS (SELECT *, own = 'branch' AND NOT coalesce(root > ended, false) AS opens, CASE WHEN root > ended THEN 'branch' WHEN own = 'blank' AND solid = 'picture_grid' AND following = 'picture_grid' THEN 'picture_grid' ELSE own END AS kind FROM k1),
        g AS (SELECT *, CASE WHEN kind IN ('picture_grid', 'match_table', 'branch') AND NOT opens AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = kind THEN 0 ELSE 1 END AS starts FROM k),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM g),
        b0 AS (SELECT doc_id, block, min(line_no) AS line_no, min(kind) AS kind, CAST(count_if(CASE WHEN kind = 'branch' THEN regexp_matches(line, '{_P['branch_item']}') ELSE kind = 'blank' OR own <> 'blank' END) AS BIGINT) AS n_lines, arg_min(line, line_no) AS raw FROM n GROUP BY doc_id, block),
        b AS (SELECT *, CASE WHEN kind = 'section' THEN regexp_replace(CASE WHEN {_BARE} <> '' THEN {_BARE} ELSE raw END, '\\.+$', '') WHEN kind = 'branch' THEN trim(regexp_extract(raw, '{_P['branch']}', 1)) ELSE raw END AS text FROM b0)"""


_WEIGHT = "CASE WHEN kind = 'picture_grid' THEN 4.5 WHEN kind = 'match_table' THEN n_lines + 0.5 WHEN kind = 'branch' THEN n_lines + 1.5 WHEN kind = 'title' THEN 1.6 WHEN kind = 'section' THEN 1.5 WHEN kind IN ('checkboxes', 'option_row') THEN 1.4 ELSE 1.0 END"
_CLASSES = f"""c AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'title' AND regexp_matches(text, '{L.CLASS}') THEN upper(regexp_extract(text, '{L.CLASS}', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS class_key FROM b),
    p AS (SELECT *, CASE WHEN lag(class_key) OVER (PARTITION BY doc_id ORDER BY line_no) <> class_key THEN 1 ELSE 0 END AS ch FROM c),
    papers AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no) AS paper FROM p)"""
_COLLAPSE = """i AS (SELECT *, min(CASE WHEN kind <> 'blank' THEN line_no END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN kind <> 'blank' THEN line_no END) OVER (PARTITION BY doc_id) AS hi FROM {0}),
    j AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM i WHERE line_no BETWEEN lo AND hi),
    {1} AS (SELECT doc_id, line_no, kind, n_lines, text FROM j WHERE NOT (kind = 'blank' AND coalesce(before, '') = 'blank'))"""
_NUMBER = r"list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], regexp_extract(line, '^\s*(?:\[\[SECTION_ROW:\s*)?([IVX]+)[.)]?\s+', 1))"
_SECTIONED = f"""s AS (SELECT *, CASE WHEN regexp_matches(line, '{L.SECTION_ROW}') THEN trim(regexp_extract(line, '{L.SECTION_ROW}', 1)) WHEN regexp_matches(line, '{L.SECTION_PLAIN}') THEN trim(line) END AS title FROM {LINES_SQL} l),
    w AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM s)"""
_SIZES = lambda p: f"list_transform(regexp_extract_all(line, '{p}', 1), lambda x: len(list_filter(string_split_regex(x, '\\s*\\|\\|\\s*'), lambda y: y <> '')))"
_EVIDENCE = f"""{_SECTIONED}, evidence AS (SELECT doc_id, section, min(line_no) AS first_line, CAST(least(100, sum(coalesce(list_sum({_SIZES(chr(92) + '[' + chr(92) + '[SOURCE_FIGURE(?:_ROW)?:' + chr(92) + 's*([^' + chr(92) + ']' + chr(92) + 'n]+)' + chr(92) + ']' + chr(92) + ']')}), 0))) AS INT) AS images,
    max(coalesce(list_max({_SIZES(chr(92) + '[' + chr(92) + '[SOURCE_FIGURE_ROW:' + chr(92) + 's*([^' + chr(92) + ']' + chr(92) + 'n]+)' + chr(92) + ']' + chr(92) + ']')}), 0)) AS widest FROM w WHERE section IS NOT NULL GROUP BY doc_id, section)"""
#: Layout proposals: kinds by key, two for some titles, and titles that no section has.
PROPOSALS = """SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 9 = 0 THEN 'No such title' ELSE CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' ELSE 'V' END || '. Answer the following ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || 'x' || CAST(l_linenumber AS VARCHAR(9)) || CASE WHEN l_orderkey % 3 = 1 THEN '' ELSE '=' || CAST(CAST(l_quantity AS INT) * l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) END END AS title,
    CASE l_suppkey % 5 WHEN 0 THEN 'pictures' WHEN 1 THEN 'mcq' WHEN 2 THEN 'unknown' ELSE 'written' END AS kind, CASE WHEN l_suppkey % 3 = 0 THEN CAST(NULL AS INT) ELSE CAST(l_partkey % 9 AS INT) END AS columns FROM lineitem"""


def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows can share an order and line number; the SQL's join lists such rows latest first, so their place in the input goes along.
    placed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    proposals = spark.sql(PROPOSALS.replace(" FROM lineitem", ", place FROM {lineitem}"), lineitem=placed)
    return L.safe_layout(proposals, L.section_evidence(paper_lines(spark, sf_dir)))


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers with issues as a reviewer may propose them: the checks' own, some with other severities and categories, without detail, or with evidence that isn't there."""
    changed = lambda x, i: F.struct(
        F.when(i % 2 == 0, "critical").otherwise("odd").alias("severity"), F.when(i % 3 == 0, "layout").otherwise(x["category"]).alias("category"),
        F.when(i % 4 == 3, F.lit("nowhere")).otherwise(x["evidence"]).alias("evidence"), F.when(i % 5 == 4, "").otherwise(x["detail"]).alias("detail"))
    return paper_docs(spark, sf_dir).withColumn("issues", F.transform(L.issues_of(F.col("text")), changed))


QUERIES = {
    "d3_lines": lambda s, d: L.lines(documents(s, d)),
    "w1_sections": lambda s, d: L.with_section(paper_lines(s, d)).select("doc_id", "line_no", "section"),
    "w2_sequence_findings": lambda s, d: L.sequence_findings(paper_lines(s, d)).drop("line"),
    "w3_out_of_order": lambda s, d: L.out_of_order_sections(paper_lines(s, d)),
    "w4_blocks": lambda s, d: paper_blocks(s, d).select("doc_id", "line_no", "kind", "n_lines", "text"),
    "w5_split_by_class": lambda s, d: L.split_by_class(paper_blocks(s, d)).select("doc_id", "line_no", "class_key", "paper"),
    "w6_collapse_blanks": lambda s, d: L.collapse_blanks(paper_blocks(s, d)).select("doc_id", "line_no", "kind"),
    "w11_short_runs": lambda s, d: L.short_runs(lines_from(SHORT_SQL)(s, d)),
    "w14_dedupe_prelude": lambda s, d: L.dedupe_prelude(paper_lines(s, d)),
    "w15_page_breaks": lambda s, d: L.with_page_break(paper_blocks(s, d)).select("doc_id", "line_no", "break_before"),
    "a6_marks_totals": lambda s, d: L.marks_totals(paper_blocks(s, d)),
    "a7_page_estimate": lambda s, d: L.page_estimate(L.split_by_class(paper_blocks(s, d)), ["doc_id", "paper"]),
    "a18_block_counts": lambda s, d: paper_blocks(s, d).groupBy("kind").agg(F.count("*").alias("n")),
    "a19_section_evidence": lambda s, d: L.section_evidence(paper_lines(s, d)),
    "f40_smart_fit": lambda s, d: L.smart_fit(paper_blocks(s, d).select("doc_id", "line_no", "kind", "n_lines", "text"), 1).select("doc_id", "line_no", "kind"),
    "m4_compact_pages": lambda s, d: L.compact_pages(paper_lines(s, d)),
    "m10_pack_figures": lambda s, d: L.pack_figures(paper_lines(s, d)),
    "p16_print_issues": lambda s, d: L.print_issues(paper_docs(s, d).withColumn("continuation", F.col("doc_id") % 2 == 0)),
    "p17_supported_issues": lambda s, d: L.supported_issues(proposed(s, d), 2),
    "o6_all_issues": lambda s, d: L.reviewed(proposed(s, d)),
    "p18_safe_layout": layout_plan,
}
_DETAIL = {k: f"'{v}'" for k, v in L.DETAILS.items()}
_SUM = r"(\d+)\s*[x×]\s*(\d+)\s*=\s*(\d+)"
_WIDE = r"(?i)\[\[SOURCE_FIGURE(?:_ROW)?:\s*([^\]]+)\]\]"


def issues_cte(goes_on: str) -> str:
    """goes_on: whether a document continues another page."""
    factor = lambda k: f"TRY_CAST(regexp_extract(line, '{_SUM}', {k}) AS BIGINT)"
    return f"""l AS (SELECT * FROM {LINES_SQL} l0), d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l GROUP BY doc_id),
    h AS (SELECT doc_id, line_no, line, {_NUMBER} AS number FROM l WHERE {_NUMBER} > 0), hp AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous FROM h),
    wide AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '{_WIDE}')))) AS k, unnest(regexp_extract_all(text, '{_WIDE}')) AS m, unnest(regexp_extract_all(text, '{_WIDE}', 1)) AS body FROM d),
    f AS (SELECT doc_id, 0 AS place, -1 AS line_no, 'sections' AS category, 'Bit I' AS evidence, {_DETAIL['opening']} AS detail FROM d WHERE NOT ({goes_on}) AND NOT regexp_matches(text, '(?i)\\[\\[SECTION_ROW:\\s*I(?:[.)\\s]|\\s*\\|\\|)') AND NOT regexp_matches(text, '(?m)^\\s*I[.)\\s]+\\S')
        UNION ALL SELECT doc_id, 1, -1, 'ocr', '[unclear]', {_DETAIL['unclear']} FROM d WHERE regexp_matches(text, '(?i)\\[unclear(?::[^\\]\\n]*)?\\]|\\x{{FFFD}}')
        UNION ALL SELECT doc_id, 2, -1, 'images', '[[PICTURE: …]]', {_DETAIL['picture']} FROM d WHERE regexp_matches(text, '(?i)\\[\\[PICTURE(?:_ROW|_OPTION)?:')
        UNION ALL SELECT doc_id, 3, k, 'images', substring(m, 1, 100), {_DETAIL['wide']} FROM wide WHERE len(list_filter(string_split_regex(body, '\\s*\\|\\|\\s*'), lambda x: x <> '')) > 5
        UNION ALL SELECT doc_id, 4, -1, 'questions', 'Question numbering', {_DETAIL['unnumbered']} FROM d WHERE NOT regexp_matches(text, '(?im)^\\s*(?:[0-9०-९]+[.)]|\\[\\[(?:QUESTION_ROW|MATCH_ROW|CHOICE_ROW|QA_ROW):)')
        UNION ALL SELECT doc_id, 5, line_no, 'sections', substring(line, 1, 140), {_DETAIL['sequence']} FROM hp WHERE number <> previous + 1
        UNION ALL SELECT doc_id, 5, line_no, 'marks', regexp_extract(line, '{_SUM}', 0), {_DETAIL['marks']} FROM l WHERE {factor(1)} * {factor(2)} <> {factor(3)}),
    issues AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, line_no, category DESC) AS INT) AS ord, 'review' AS severity, category, evidence, detail FROM f QUALIFY ord <= 20)"""


def supported_cte(most: int) -> str:
    """The usable ones of the proposed issues."""
    return f"""p AS (SELECT i.doc_id, ord, CASE WHEN ord % 2 = 1 THEN 'critical' ELSE 'review' END AS severity, CASE WHEN ord % 3 = 1 THEN 'alignment' ELSE category END AS category,
        CASE WHEN ord % 4 = 0 THEN 'nowhere' ELSE evidence END AS evidence, CASE WHEN ord % 5 = 0 THEN '' ELSE detail END AS detail FROM issues i WHERE ord <= {3 * most}),
    s AS (SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY ord) AS INT) AS ord, severity, category, evidence, detail FROM p JOIN d ON d.doc_id = p.doc_id WHERE detail <> '' AND contains(text, evidence) QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY ord) <= {most})"""


_ROMANS = "[" + ", ".join(f"'{x}'" for x in L.T.ROMAN) + "]"
_NUMBERED = lambda c: f"list_contains({_ROMANS}, upper(regexp_extract({c}, '{L.ORDINAL}', 1)))"
_HEADED = lambda c: f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{L.SECTION_OPEN}\\s*', ''), '(?s)\\s*\\|\\|.*$', ''), '(?i)^\\s*[IVX]{{1,6}}[.)\\s]+', ''), '[^A-Za-z0-9]+', ' ', 'g')))"
ORACLE = {
    "d3_lines": f"SELECT doc_id, line_no, line FROM {DOC_LINES_SQL} l",
    "w1_sections": f"WITH {_SECTIONED} SELECT doc_id, line_no, section FROM w",
    "w2_sequence_findings": f"WITH h AS (SELECT doc_id, line_no, {_NUMBER} AS number FROM {LINES_SQL} l), p AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous FROM h WHERE number > 0) SELECT * FROM p WHERE number <> previous + 1",
    "w3_out_of_order": f"WITH e AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^\\s*Class\\s*[:：-]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS epoch FROM {LINES_SQL} l), h AS (SELECT doc_id, line_no, epoch, {_NUMBER} AS number FROM e), p AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, epoch ORDER BY line_no) AS previous FROM h WHERE number > 0) SELECT doc_id, line_no, number, previous FROM p WHERE number < previous",
    "w4_blocks": f"WITH {blocks_cte(LINES_SQL)} SELECT doc_id, line_no, kind, n_lines, text FROM b",
    "w5_split_by_class": f"WITH {blocks_cte(LINES_SQL)}, {_CLASSES} SELECT doc_id, line_no, class_key, CAST(paper AS BIGINT) AS paper FROM papers",
    "w6_collapse_blanks": f"WITH {blocks_cte(LINES_SQL)}, {_COLLAPSE.format('b', 'c')} SELECT doc_id, line_no, kind FROM c",
    "w11_short_runs": f"""WITH l AS (SELECT doc_id, line_no, trim(line) AS cell FROM {SHORT_SQL} l0 WHERE trim(line) <> ''), s AS (SELECT *, len(cell) <= 4 AND NOT starts_with(cell, '[[') AS short FROM l),
        i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, short ORDER BY line_no) AS g FROM s),
        r AS (SELECT doc_id, g, min(line_no) AS first_line, min(CASE WHEN NOT regexp_matches(cell, '^[0-9]+$') THEN line_no END) AS lo, max(CASE WHEN NOT regexp_matches(cell, '^[0-9]+$') THEN line_no END) AS hi FROM i WHERE short GROUP BY doc_id, g HAVING count(*) >= 8),
        c AS (SELECT r.doc_id, r.first_line, CAST(count(*) AS INT) AS n, string_agg(cell, '|' ORDER BY line_no) AS cells FROM r JOIN i ON i.doc_id = r.doc_id AND i.g = r.g AND short AND line_no BETWEEN lo AND hi GROUP BY r.doc_id, r.g, r.first_line HAVING count(*) >= 6)
        SELECT doc_id, first_line, n, CAST(ceil(sqrt(n)) AS INT) AS columns, CAST(ceil(n / ceil(sqrt(n))) AS INT) AS rows, cells FROM c""",
    "w14_dedupe_prelude": f"""WITH b AS (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM {LINES_SQL} l)
        SELECT doc_id, line_no, CASE WHEN trim(line) <> '' AND NOT starts_with(ltrim(line), '[[') AND NOT {_NUMBERED('line')} AND regexp_matches(below, '{L.SECTION_OPEN}') AND {_NUMBERED('below')} AND len({_HEADED('line')}) >= 12 AND {_HEADED('line')} = {_HEADED('below')} THEN '' ELSE line END AS line FROM b""",
    "w15_page_breaks": f"WITH {blocks_cte(LINES_SQL)}, l AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'pagebreak', false) AS break_before FROM b) SELECT doc_id, line_no, break_before FROM l WHERE kind <> 'pagebreak'",
    "a6_marks_totals": f"WITH {blocks_cte(LINES_SQL)}, m AS (SELECT doc_id, line_no, trim(regexp_extract(raw, '{L.T.MARKS}', 0)) AS shown, TRY_CAST(regexp_extract(raw, '{L.T.MARKS}', 1) AS BIGINT) * TRY_CAST(regexp_extract(raw, '{L.T.MARKS}', 2) AS BIGINT) AS computed, TRY_CAST(nullif(regexp_extract(raw, '{L.T.MARKS}', 4), '') AS BIGINT) AS printed FROM b WHERE kind = 'section' AND regexp_matches(raw, '{L.T.MARKS}')) SELECT doc_id, CAST(sum(coalesce(printed, computed)) AS BIGINT) AS grand_total, coalesce(count_if(printed <> computed), 0) AS n_wrong, coalesce(string_agg(CASE WHEN printed <> computed THEN shown END, '; ' ORDER BY line_no), '') AS wrong FROM m GROUP BY doc_id",
    "a7_page_estimate": f"WITH {blocks_cte(LINES_SQL)}, {_CLASSES} SELECT doc_id, CAST(paper AS BIGINT) AS paper, count(*) AS n_blocks, round(CAST(sum({_WEIGHT}) AS DOUBLE), 1) AS weight, CAST(greatest(1, ceil(round(CAST(sum({_WEIGHT}) AS DOUBLE), 1) / 40)) AS INT) AS pages FROM papers GROUP BY doc_id, paper",
    "a18_block_counts": f"WITH {blocks_cte(LINES_SQL)} SELECT kind, count(*) AS n FROM b GROUP BY kind",
    "a19_section_evidence": f"WITH {_EVIDENCE} SELECT * FROM evidence",
    "f40_smart_fit": f"WITH {blocks_cte(LINES_SQL)}, e AS (SELECT doc_id, greatest(1, ceil(round(CAST(sum({_WEIGHT}) AS DOUBLE), 1) / 40)) > 1 AS over FROM b GROUP BY doc_id), big AS (SELECT b.* FROM b JOIN e USING (doc_id) WHERE over), {_COLLAPSE.format('big', 'c')}, e2 AS (SELECT doc_id, greatest(1, ceil(round(CAST(sum({_WEIGHT}) AS DOUBLE), 1) / 40)) > 1 AS over FROM c GROUP BY doc_id) SELECT doc_id, line_no, kind FROM b JOIN e USING (doc_id) WHERE NOT over UNION ALL SELECT doc_id, line_no, kind FROM c JOIN e2 USING (doc_id) WHERE NOT over OR kind <> 'blank'",
    "m4_compact_pages": f"WITH n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM {LINES_SQL} l) SELECT doc_id, line_no, line FROM n WHERE trim(line) <> '[[PAGE_BREAK]]' OR coalesce(regexp_matches(nxt, '(?i)^\\s*Class\\s*[:：-]'), false)",
    "m10_pack_figures": f"WITH f AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\\s*\\[\\[FIGURE:\\s*(.*?)\\]\\]\\s*$') THEN 1 ELSE 0 END AS fig FROM {LINES_SQL} l), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, fig ORDER BY line_no) AS g FROM f), r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1) // 5 AS r FROM i WHERE fig = 1) SELECT doc_id, min(line_no) AS line_no, count(*) AS n, '[[FIGURE_ROW: ' || string_agg(regexp_extract(line, '(?i)^\\s*\\[\\[FIGURE:\\s*(.*?)\\]\\]\\s*$', 1), ' || ' ORDER BY line_no) || ']]' AS line FROM r GROUP BY doc_id, g, r",
    "p16_print_issues": f"WITH {issues_cte('doc_id % 2 = 0')} SELECT * FROM issues",
    "p17_supported_issues": f"WITH {issues_cte('false')}, {supported_cte(2)} SELECT * FROM s",
    "o6_all_issues": f"""WITH {issues_cte('false')}, {supported_cte(8)}, n AS (SELECT doc_id, max(ord) AS n FROM issues GROUP BY doc_id),
        u AS (SELECT * FROM issues UNION ALL SELECT s.doc_id, CAST(n + ord AS INT) AS ord, severity, category, evidence, detail FROM s JOIN n ON n.doc_id = s.doc_id) SELECT * FROM u WHERE ord <= 18""",
    "p18_safe_layout": f"WITH {_EVIDENCE}, q AS (SELECT p.*, images, widest FROM ({PROPOSALS}) p JOIN evidence e ON e.doc_id = p.doc_id AND e.section = p.title WHERE kind IN ('pictures', 'matching', 'mcq', 'true_false', 'fill_blanks', 'translation', 'written', 'table', 'other') QUALIFY row_number() OVER (PARTITION BY p.doc_id, title ORDER BY ord) = 1) SELECT doc_id, title, CASE WHEN kind = 'pictures' AND images = 0 THEN 'other' ELSE kind END AS kind, CAST(CASE WHEN images = 0 THEN 5 WHEN images = 1 THEN 1 WHEN widest >= 2 THEN least(5, widest) WHEN columns IS NOT NULL THEN greatest(2, least(5, images, columns)) ELSE least(5, images) END AS INT) AS columns FROM q",
}
