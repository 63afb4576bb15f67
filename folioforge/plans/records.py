"""Queries over records: values, samples, usage, profiles. Inputs that the tables lack are made from their columns, by the same SQL for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import corpus as C
from folioforge.operators import findings as N
from folioforge.operators import learning as E
from folioforge.operators import usage as U
from folioforge.plans import fixtures
from folioforge.plans.papers import LINES_SQL, blocks_cte, documents, paper_blocks
from folioforge.plans.scalars import TEXTS_SQL, texts
from folioforge.session import TABLES, table


def made(sql: str):
    """A frame from SQL over the tables; reads only those it names."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        return spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql), **{t: table(spark, sf_dir, t) for t in used})

    return build


#: Field values: customers' names by nation and segment, and a second line each, the name again for every fifth, so that frequencies differ.
VALUES = """SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_mktsegment AS field, substring(c_name, 14, 5) AS value, CAST(c_custkey AS INT) AS line_no FROM customer
    UNION ALL SELECT CAST(c_nationkey AS BIGINT), c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN substring(c_name, 14, 5) ELSE 'account ' || CAST(c_custkey * 7919 AS VARCHAR(12)) END, CAST(c_custkey AS INT) + 1000000 FROM customer"""
FIELD_LINES = """SELECT c_custkey AS doc_id, 0 AS line_no, 'Name: ' || c_name AS line FROM customer UNION ALL SELECT c_custkey, 1, '  Segment - ' || c_mktsegment || ' ' FROM customer
    UNION ALL SELECT c_custkey, 2, 'no field here ' || CAST(c_nationkey AS VARCHAR(9)) FROM customer UNION ALL SELECT c_custkey, 3, 'Balance2: 5' FROM customer"""
YEAR_DOCS = "SELECT s_suppkey AS doc_id, 'Built ' || CAST(1500 + s_suppkey % 400 AS VARCHAR(9)) || ' and ' || CAST(1500 + (s_suppkey * 7) % 500 AS VARCHAR(9)) || ', ' || CAST(1560 + s_suppkey % 300 AS VARCHAR(9)) || ' ' || CAST(1500 + s_suppkey % 400 AS VARCHAR(9)) || ' or ' || CAST(1506 + s_suppkey % 400 AS VARCHAR(9)) AS text FROM supplier"
CONFUSED = "SELECT * FROM (VALUES (1000001, '1811 and 1871 or 1817, 1877'), (1000002, '1717 1711 1777'), (1000003, '1600 1601'), (1000004, '1911, 1971, 1911')) f(doc_id, text)"
READ_SAMPLES = "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS language, text AS raw_ocr FROM documents"
VERIFIED = "SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN doc_id % 3 = 0 THEN 'te' END AS language, 'checked ' || CAST(quality AS VARCHAR(9)) AS verified_text FROM labels"
CORRECTIONS = "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS original, split_part(p_name, ' ', 2) AS corrected, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS language FROM part"
TOKENS = "SELECT event_id, user_id, event_id % 97 AS request_id, CAST(round(value * 100) AS BIGINT) AS read_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS written_tokens FROM events"
COSTS = "SELECT CAST(ts AS DATE) AS day, user_id % 7 AS key, ts, event_id, CAST(100 + (event_id * 37) % 900 AS BIGINT) AS cost FROM events"
VISITS = "SELECT user_id AS room, ts, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta FROM events"
RESULTS = "SELECT event_id % 500 AS request_id, event_type AS provider, ts AS finished_at, value > 5 AS valid FROM events"
SPANS = "SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS span, l_orderkey % 50 AS file, l_linenumber % 4 + 9 AS size, l_returnflag = 'R' AS bold, l_shipdate, CAST(l_linenumber * 12 AS DOUBLE) + l_discount AS y, CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_partkey % 300 AS DOUBLE) + l_quantity AS x1, l_linestatus || l_returnflag AS text FROM lineitem"
NAMES = "SELECT o_custkey % 20 AS grp, CASE WHEN o_orderkey % 9 = 0 THEN 'cover' ELSE 'page_' || CAST(o_orderkey % 1000 AS VARCHAR(9)) END || '.' || CAST(o_orderkey AS VARCHAR(9)) AS name FROM orders"
PAPER_PAGES = "SELECT l_orderkey AS paper, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) AS INT) AS arrival, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN NULL ELSE CAST(l_linenumber AS INT) END AS number FROM lineitem"
VARIANTS = "SELECT l_orderkey AS page, l_linenumber AS ord, CASE l_suppkey % 3 WHEN 0 THEN 'good text 12' WHEN 1 THEN '@@ ## text' ELSE 'another reading of it' END AS text, CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) q"
HISTORY = "SELECT CASE WHEN event_id % 50 = 0 THEN 1000000 + event_id ELSE user_id END AS key, event_id AS ord, CAST(CAST(floor(value * 4) AS BIGINT) % 101 AS DOUBLE) AS accuracy FROM events"
QUOTA = "SELECT event_id AS id, CAST(CAST(floor(value) AS BIGINT) % 130 - 10 AS DOUBLE) AS percent, event_id % 5 = 0 AS flagged, event_id % 3 = 0 AS estimated, CAST(ts AS DATE) + INTERVAL 1 DAY AS reset_at, ts + INTERVAL 6 HOUR AS now FROM events"
PICTURES = "SELECT split_part(p_name, ' ', 2) AS query, CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 4 = 1 THEN p_name || ' outline' ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN 'http' ELSE 'https' END || '://pic/' || CAST(p_partkey AS VARCHAR(9)) AS url, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'cc0' END AS licence, CASE WHEN p_size % 11 = 0 THEN 'text/html' ELSE 'image/png' END AS mime, p_size * 20 AS w, 300 AS h FROM part"
BOXES = "SELECT l_orderkey AS page, l_linenumber AS box, CAST(min(l_partkey) % 700 AS DOUBLE) AS x, CAST(min(l_suppkey) % 90 AS DOUBLE) * 10 AS y, CAST(max(l_quantity) AS DOUBLE) AS w, 20.0 AS h FROM lineitem GROUP BY l_orderkey, l_linenumber"
MESSAGES = ["3036: daily cap", "you used up your daily free allocation", "5035 requires a workers paid plan", "408 Request Timeout", "aborted", "HTTP 503", "rate limit exceeded", "504: gateway timeout", "Bad Gateway", "unknown", "", "13036 x"]
MESSAGE_ROWS = list(enumerate(MESSAGES))
SUGGESTIONS = [(1, '["a", " b ", "a", ""]'), (2, '{"suggestions": ["x", "y"]}'), (3, 'text ```json\n["q"]\n``` end'), (4, "none"), (5, 'say {"suggestions": ["one\\ntwo", "three"]} ok'), (6, "")]
PAYLOADS = [(1, '{"response": " hi "}'), (2, '{"choices": [{"message": {"content": "there"}}]}'), (3, '{"result": {"response": "deep"}, "text": "t"}'), (4, '{"text": ""}'), (5, "no json")]
ESCAPES = [(1, r"a\(b\)c"), (2, r"line\nnext\\n"), (3, r"tab\there"), (4, "plain")]
NAMED_FILES = [(k, n) for k, n in enumerate(["a.PDF", "b.docx", "c.xlsx", "d.png", "e.txt", "f", "g.tar.gz", "h.json", "i.ods"])]
PLACEHOLDERS = [(1, "[[PICTURE: duck]]"), (2, "[[PICTURE_OPTION: मछली]]"), (3, "a duck"), (4, "[[PICTURE: tree]]"), (5, "x [[PICTURE: Kite ]] y")]


def rows(data: list[tuple], schema: str):
    return lambda spark, _: fixtures.frame(spark, data, schema)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.upsert_verified(E.collected(made(READ_SAMPLES)(spark, sf_dir)), made(VERIFIED)(spark, sf_dir))


def md5_of(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.md5(n) for n in names})


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corrections that the store lists, at most 1,000, the most frequent first, replayed in order over the parts' names."""
    rules = [(r.original, r.corrected) for r in E.ranked_pairs(E.pair_counts(made(CORRECTIONS)(spark, sf_dir)), 1000).collect()]
    return E.replay(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), rules)


def agreement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made("SELECT d.doc_id AS id, d.text AS a, e.text AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1")(spark, sf_dir)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set((F.col("l_partkey") % 9).cast("int")).alias("used"), F.collect_set((F.col("l_suppkey") % 5).cast("int")).alias("defined"))
    return C.missing_references(items)


def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers' blocks as another rendering has them: without some check boxes, and with titles as text."""
    return paper_blocks(spark, sf_dir).where("NOT (kind = 'checkboxes' AND doc_id % 3 = 0)").withColumn("kind", F.when((F.col("kind") == "title") & (F.col("doc_id") % 4 == 0), "text").otherwise(F.col("kind")))


def docs_of_papers(spark: SparkSession, sf_dir: str, change: bool) -> DataFrame:
    df = paper_blocks(spark, sf_dir).select("doc_id", F.col("block").cast("int").alias("ord"), "text")
    return df.withColumn("text", F.when((F.col("doc_id") % 5 == 0) & (F.col("ord") % 4 == 0), F.upper("text")).otherwise(F.col("text"))) if change else df


QUERIES = {
    "f25_fields": lambda s, d: N.fields(made(FIELD_LINES)(s, d)),
    "a4_value_counts": lambda s, d: N.value_counts(made(VALUES)(s, d)),
    "j2_inconsistent_fields": lambda s, d: N.inconsistent_fields(made(VALUES)(s, d)),
    "j3_similar_values": lambda s, d: N.similar_values(made(VALUES)(s, d)),
    "j4_year_confusions": lambda s, d: N.year_confusions(made(f"{YEAR_DOCS} UNION ALL {CONFUSED}")(s, d)),
    "j7_duplicate_of": lambda s, d: N.duplicate_of(documents(s, d)),
    "d9_collected": lambda s, d: md5_of(E.collected(made(READ_SAMPLES)(s, d)), "raw_ocr", "corrected_text"),
    "j5_upsert_verified": lambda s, d: md5_of(samples(s, d), "raw_ocr", "corrected_text"),
    "a1_sample_stats": lambda s, d: E.sample_stats(samples(s, d)),
    "k1_export_samples": lambda s, d: E.export_samples(samples(s, d), "te", True, 100).select(
        "id", *(F.get_json_object("json", f"$.{k}").alias(k) for k in ("target_text", "language", "verified", "weight"))),
    "a3_pair_counts": lambda s, d: E.pair_counts(made(CORRECTIONS)(s, d)),
    "o1_top_pairs": lambda s, d: E.ranked_pairs(E.pair_counts(made(CORRECTIONS)(s, d)), 20),
    "o2_ranked_pairs": lambda s, d: E.ranked_pairs(E.pair_counts(made(CORRECTIONS)(s, d))),
    "f31_replay": replayed,
    "j9_token_agreement": lambda s, d: E.token_agreement(agreement_pairs(s, d)),
    "f27_word_accuracy": lambda s, d: agreement_pairs(s, d).select("id", E.word_accuracy(F.col("a"), F.col("b")).alias("v")),
    "f27_sequence_similarity": lambda s, d: made("SELECT p_partkey AS id, p_name AS a, p_type || ' ' || p_brand || ' ' || p_name AS b FROM part")(s, d).select("id", E.sequence_similarity("a", "b").alias("v")),
    "a12_accuracy_summary": lambda s, d: E.accuracy_summary(made(HISTORY)(s, d)),
    "a13_language_counts": lambda s, d: E.language_counts(made(CORRECTIONS)(s, d)),
    "a15_best_variant": lambda s, d: E.best_variant(made(VARIANTS)(s, d)),
    "f32_token_cost": lambda s, d: made(TOKENS)(s, d).select("event_id", F.round(U.token_cost(F.col("read_tokens"), F.col("written_tokens")), 6).alias("cost")),
    "f33_reservation": lambda s, d: made(TOKENS)(s, d).select("event_id", U.reservation(F.col("read_tokens") * 40, F.col("event_id") % 4, F.col("written_tokens") * 50).alias("reserve")),
    "f34_utc_day": lambda s, d: table(s, d, "events").select("event_id", U.utc_day(F.col("ts")).alias("day"), U.retry_after(F.col("ts"), F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("retry_after")),
    "t1_daily_totals": lambda s, d: U.daily_totals(table(s, d, "events")),
    "w9_admitted": lambda s, d: U.admitted(made(COSTS)(s, d)).select("event_id", "key", "booked"),
    "a17_merged_usage": lambda s, d: U.merged_usage(made(TOKENS)(s, d), ["read_tokens", "written_tokens"]),
    "t4_first_per_request": lambda s, d: U.first_per_request(made(TOKENS.replace("event_id, user_id", "event_id, ts, user_id"))(s, d)).select("request_id", "event_id"),
    "t5_unexpired": lambda s, d: U.unexpired(table(s, d, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id"),
    "t6_presence": lambda s, d: U.presence(made(VISITS)(s, d)).select("event_id", "room", "open"),
    "t7_first_valid": lambda s, d: U.first_valid(made(RESULTS)(s, d)).select("request_id", "provider"),
    "a20_latency": lambda s, d: U.latency(made("SELECT event_type AS grp, value AS ms FROM events")(s, d)),
    "m21_quota_view": lambda s, d: U.quota_view(made(QUOTA)(s, d)),
    "p26_error_kind": lambda s, d: rows(MESSAGE_ROWS, "id int, m string")(s, d).select("id", T.error_kind(F.col("m")).alias("v")),
    "f29_parse_suggestions": lambda s, d: rows(SUGGESTIONS, "id int, m string")(s, d).select("id", T.parse_suggestions(F.col("m")).alias("v")),
    "f37_first_text": lambda s, d: rows(PAYLOADS, "id int, m string")(s, d).select("id", T.first_text(F.col("m")).alias("v")),
    "s4_pdf_escapes": lambda s, d: rows(ESCAPES, "id int, m string")(s, d).select("id", T.expand_pdf_escapes(F.col("m")).alias("v")),
    "s1_format": lambda s, d: rows(NAMED_FILES, "id int, m string")(s, d).select("id", C.natural_format(F.col("m")).alias("v")),
    "m23_picture_subject": lambda s, d: rows(PLACEHOLDERS, "id int, m string")(s, d).select("id", C.picture_subject(F.col("m")).alias("v")),
    "f43_picture_query": lambda s, d: rows([(1, " ｄｕｃｋ "), (2, "x"), (3, "red kite"), (4, "<b>")], "id int, m string")(s, d).select("id", T.picture_query(F.col("m")).alias("v")),
    "p21_clean_suggestions": lambda s, d: made("SELECT p_size AS id, collect_list(p_name) AS items FROM (SELECT * FROM part ORDER BY p_partkey) q GROUP BY p_size")(s, d).select("id", F.size(T.clean_suggestions(F.array_sort("items"))).alias("n"), F.element_at(T.clean_suggestions(F.array_sort("items")), 1).alias("head")),
    "a8_most_common": lambda s, d: C.most_common(made("SELECT p_brand AS category, p_name AS value FROM part")(s, d), 5),
    "a9_weighted_histogram": lambda s, d: C.weighted_histogram(made(SPANS)(s, d)),
    "a11_margins": lambda s, d: C.margins(made(SPANS)(s, d)),
    "o3_natural_order": lambda s, d: C.natural_order(made(NAMES)(s, d)),
    "o4_reading_order": lambda s, d: C.reading_order(made(SPANS)(s, d)).groupBy("page").agg(F.count("*").alias("n"), F.min_by("span", "ord").alias("head")),
    "o9_missing_references": references,
    "p27_block_differences": lambda s, d: C.block_differences(paper_blocks(s, d), changed_blocks(s, d)),
    "p27_first_difference": lambda s, d: C.first_difference(docs_of_papers(s, d, False), docs_of_papers(s, d, True)),
    "m1_order_pages": lambda s, d: C.order_pages(made(PAPER_PAGES)(s, d)).select("paper", "arrival", "number", "ord"),
    "m24_picture_candidates": lambda s, d: C.picture_candidates(made(PICTURES)(s, d), ["cc0"]).select("query", "url", "rank"),
    "m26_scale_boxes": lambda s, d: C.scale_boxes(made(BOXES)(s, d), 595.0, 842.0, 36.0).select("page", "box", F.round("x", 1).alias("x"), F.round("w", 1).alias("w")),
    "k7_public_fields": lambda s, d: C.public_fields(table(s, d, "customer"), ["c_acctbal", "c_mktsegment"]),
}

_WORDS = lambda t: f"list_filter(string_split_regex(lower(trim({t})), '\\s+'), lambda w: w <> '')"
_TOK = lambda t: f"list_filter(string_split_regex(trim(regexp_replace({t}, '[|()\\[\\]{{}}.,;:!?/\\\\]+', ' ', 'g')), '\\s+'), lambda w: w <> '')"
_PAIRS = "(SELECT d.doc_id AS id, d.text AS a, e.text AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1)"
_SAMPLES = f"""c AS (SELECT id, coalesce(language, 'hi') AS language, raw_ocr, raw_ocr AS corrected_text, 'auto_collect' AS source, false AS verified, 0.5::DOUBLE AS weight FROM ({READ_SAMPLES}) q WHERE raw_ocr <> ''),
    v AS ({VERIFIED}), s AS (SELECT coalesce(c.id, v.id) AS id, coalesce(v.language, c.language, 'hi') AS language, coalesce(raw_ocr, '') AS raw_ocr, coalesce(verified_text, corrected_text) AS corrected_text,
    CASE WHEN verified_text IS NOT NULL THEN 'human_verified' ELSE source END AS source, CASE WHEN verified_text IS NOT NULL THEN true ELSE verified END AS verified, CASE WHEN verified_text IS NOT NULL THEN 1.0 ELSE weight END::DOUBLE AS weight FROM c FULL JOIN v ON c.id = v.id)"""
_FIELD = N.FIELD.replace("\\x{0900}-\\x{097F}", "\\x{0900}-\\x{097F}")
_NEAR = "levenshtein(a, b) <= 2 AND levenshtein(a, b) < least(len(a), len(b)) * 0.3"
_COUNTED = f"c AS (SELECT doc_id, field, value, count(*) AS n, min(line_no) AS first_line FROM ({VALUES}) v GROUP BY ALL)"
_RANK = "SELECT original, corrected, count(*) AS n FROM (" + CORRECTIONS + ") c WHERE original <> '' AND corrected <> '' GROUP BY ALL"
_VR = "(CASE WHEN len(regexp_replace(text, '\\s', '', 'g')) > 0 THEN len(regexp_replace(text, '[^\\x{0900}-\\x{097F}A-Za-z0-9]', '', 'g'))::DOUBLE / len(regexp_replace(text, '\\s', '', 'g')) ELSE 0 END)"
_EXPECTED = {
    "f29_parse_suggestions": [(1, ["a", "b"]), (2, ["x", "y"]), (3, ["q"]), (4, []), (5, ["three"]), (6, [])],
    "f37_first_text": [(1, "hi"), (2, "there"), (3, "deep"), (4, None), (5, None)],
    "s4_pdf_escapes": [(1, "a(b)c"), (2, "line\nnext\\n"), (3, "tab\there"), (4, "plain")],
    "m23_picture_subject": [(1, "duck"), (2, "fish"), (3, None), (4, None), (5, "kite")],
    "f43_picture_query": [(1, "duck"), (2, None), (3, "red kite"), (4, None)],
}
ORACLE = {name: f"SELECT * FROM ({fixtures.values_sql(data)}) f(id, v)" for name, data in _EXPECTED.items()}
ORACLE |= {
    "f25_fields": f"SELECT doc_id, line_no, trim(regexp_extract(trim(line), '{_FIELD}', 1)) AS field, trim(regexp_extract(trim(line), '{_FIELD}', 2)) AS value FROM ({FIELD_LINES}) q WHERE regexp_matches(trim(line), '{_FIELD}')",
    "a4_value_counts": f"WITH {_COUNTED} SELECT * FROM c",
    "j2_inconsistent_fields": f"WITH {_COUNTED} SELECT x.doc_id, x.field, x.value AS a, y.value AS b, CASE WHEN x.n > y.n THEN x.value WHEN y.n > x.n THEN y.value END AS suggestion FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.field = y.field AND (x.first_line, x.value) < (y.first_line, y.value) WHERE {_NEAR.replace('a,', 'x.value,').replace(' b)', ' y.value)').replace('len(a)', 'len(x.value)').replace('len(b)', 'len(y.value)')}",
    "j3_similar_values": f"WITH c AS (SELECT doc_id, value, min(line_no) AS first_line FROM ({VALUES}) v GROUP BY ALL) SELECT x.doc_id, x.value AS a, y.value AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND (x.first_line, x.value) < (y.first_line, y.value) WHERE {_NEAR.replace('a,', 'x.value,').replace(' b)', ' y.value)').replace('len(a)', 'len(x.value)').replace('len(b)', 'len(y.value)')}",
    "j4_year_confusions": f"WITH y AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(1[5-9]\\d{{2}})\\b', 1)) AS year, unnest(range(len(regexp_extract_all(text, '\\b(1[5-9]\\d{{2}})\\b', 1)))) AS at FROM ({YEAR_DOCS} UNION ALL {CONFUSED}) q) SELECT x.doc_id, x.year AS a, y.year AS b, count(*) AS n FROM y x JOIN y ON x.doc_id = y.doc_id AND x.at < y.at WHERE hamming(x.year, y.year) = 1 AND replace(x.year, '7', '1') = replace(y.year, '7', '1') GROUP BY ALL",
    "j7_duplicate_of": "SELECT doc_id, sha256(text) AS digest, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents",
    "d9_collected": f"SELECT id, coalesce(language, 'hi') AS language, md5(raw_ocr) AS raw_ocr, md5(raw_ocr) AS corrected_text, 'auto_collect' AS source, false AS verified, 0.5::DOUBLE AS weight FROM ({READ_SAMPLES}) q WHERE raw_ocr <> ''",
    "j5_upsert_verified": f"WITH {_SAMPLES} SELECT id, language, md5(raw_ocr) AS raw_ocr, md5(corrected_text) AS corrected_text, source, verified, weight FROM s",
    "a1_sample_stats": f"WITH {_SAMPLES} SELECT language, count(*) AS total, count_if(verified) AS verified, count(*) - count_if(verified) AS auto_collected FROM s GROUP BY ROLLUP (language)",
    "k1_export_samples": f"WITH {_SAMPLES} SELECT id, corrected_text AS target_text, language, CAST(verified AS VARCHAR) AS verified, CAST(weight AS VARCHAR) AS weight FROM s WHERE language = 'te' AND verified ORDER BY id LIMIT 100",
    "a3_pair_counts": _RANK,
    "o1_top_pairs": f"SELECT * FROM ({_RANK}) q ORDER BY n DESC, original, corrected LIMIT 20",
    "o2_ranked_pairs": f"SELECT * FROM ({_RANK}) q ORDER BY n DESC, original, corrected",
    "f31_replay": f"WITH RECURSIVE p AS (SELECT original, corrected, row_number() OVER (ORDER BY n DESC, original, corrected) AS k FROM ({_RANK}) q QUALIFY k <= 1000), r AS (SELECT p_partkey AS doc_id, p_name AS text, p_name AS start, 0 AS k FROM part UNION ALL SELECT doc_id, CASE WHEN p.original <> p.corrected THEN replace(text, p.original, p.corrected) ELSE text END, start, p.k FROM r JOIN p ON p.k = r.k + 1) SELECT doc_id, text AS corrected, text <> start AS changed FROM r WHERE k = (SELECT max(k) FROM p)",
    "j9_token_agreement": f"WITH p AS {_PAIRS}, x AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOK('a')}) AS t FROM p) q GROUP BY ALL), y AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOK('b')}) AS t FROM p) q GROUP BY ALL), z AS (SELECT coalesce(x.id, y.id) AS id, sum(CASE WHEN x.n > 0 AND y.n > 0 THEN least(x.n, y.n) ELSE 0 END) AS shared, sum(x.n) AS a, sum(y.n) AS b FROM x FULL JOIN y ON x.id = y.id AND x.t = y.t GROUP BY 1) SELECT p.id, coalesce(CASE WHEN z.a > 0 AND z.b > 0 THEN round(shared::DOUBLE / greatest(z.a, z.b), 6) END, 0) AS agreement FROM p LEFT JOIN z ON z.id = p.id",
    "f27_word_accuracy": f"SELECT id, round(len(list_intersect(list_distinct({_WORDS('a')}), list_distinct({_WORDS('b')})))::DOUBLE / greatest(len(list_distinct({_WORDS('b')})), 1) * 100, 2) AS v FROM {_PAIRS} p",
    "a12_accuracy_summary": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS r FROM ({HISTORY}) h), s AS (SELECT key, count(*) AS n, round(avg(accuracy)::DECIMAL(18,8), 2)::DOUBLE AS mean, round((avg(accuracy) FILTER (r <= 20))::DECIMAL(18,8), 2)::DOUBLE AS recent, avg(accuracy) FILTER (r <= 10) AS new, avg(accuracy) FILTER (r BETWEEN 11 AND 20) AS old FROM r GROUP BY key) SELECT key, n, mean, recent, CASE WHEN n < 10 THEN 'insufficient_data' WHEN new > (CASE WHEN n >= 20 THEN old ELSE new END) + 2 THEN 'improving' WHEN new < (CASE WHEN n >= 20 THEN old ELSE new END) - 2 THEN 'declining' ELSE 'stable' END AS trend FROM s",
    "a13_language_counts": f"SELECT coalesce(language, 'unknown') AS language, count(*) AS n FROM ({CORRECTIONS}) c GROUP BY 1",
    "a15_best_variant": f"WITH s AS (SELECT *, round(confidence * 0.5 + {_VR} * 30 + least(len(text) / 10.0, 20), 6) AS score FROM ({VARIANTS}) v) SELECT page, ord, score FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) = 1",
    "f32_token_cost": f"SELECT event_id, round(coalesce(read_tokens, 0) * (9091 / 1e6) + coalesce(written_tokens, 0) * (27273 / 1e6), 6) AS cost FROM ({TOKENS}) t",
    "f33_reservation": f"SELECT event_id, CAST(greatest(1000, ceil((read_tokens * 40 + event_id % 4 * 16384) * 9091 / 1e6 + coalesce(written_tokens * 50, 6144) * 27273 / 1e6)) AS BIGINT) AS reserve FROM ({TOKENS}) t",
    "f34_utc_day": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(greatest(1, ceil(epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) / 1e6 - epoch_us(ts) / 1e6)) AS BIGINT) AS retry_after FROM events",
    "t1_daily_totals": "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, value, sum(value) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events WHERE value > 0) SELECT day, count(*) AS requests, round(least(10000.0, sum(value)), 2) AS used, strftime(min(CASE WHEN running >= 10000 THEN ts END), '%Y-%m-%d %H:%M:%S') AS reached_at FROM r GROUP BY day",
    "w9_admitted": f"WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY day, key ORDER BY ts, event_id) AS k FROM ({COSTS}) c), r AS (SELECT day, key, k, event_id, cost <= 9500 AS fits, CASE WHEN cost <= 9500 THEN cost ELSE 0 END AS booked FROM o WHERE k = 1 UNION ALL SELECT o.day, o.key, o.k, o.event_id, r.booked + o.cost <= 9500, CASE WHEN r.booked + o.cost <= 9500 THEN r.booked + o.cost ELSE r.booked END FROM r JOIN o ON o.day = r.day AND o.key = r.key AND o.k = r.k + 1) SELECT event_id, key, booked FROM r WHERE fits",
    "a17_merged_usage": f"SELECT request_id, CAST(nullif(sum(coalesce(read_tokens, 0)), 0) AS BIGINT) AS read_tokens, CAST(nullif(sum(coalesce(written_tokens, 0)), 0) AS BIGINT) AS written_tokens FROM ({TOKENS}) t GROUP BY request_id",
    "t4_first_per_request": "SELECT request_id, event_id FROM (SELECT event_id % 97 AS request_id, event_id, ts FROM events) q QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) = 1",
    "t5_unexpired": "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15 00:00:00'",
    "t6_presence": f"SELECT event_id, room, CAST(sum(delta) OVER (PARTITION BY room ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM ({VISITS}) v",
    "t7_first_valid": f"SELECT request_id, arg_min(provider, (finished_at, provider)) AS provider FROM ({RESULTS}) r WHERE valid GROUP BY request_id",
    "a20_latency": "SELECT event_type AS grp, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS most FROM events GROUP BY 1",
    "m21_quota_view": f"SELECT id, CASE WHEN percent BETWEEN 0 AND 100 THEN percent END AS percent, CASE WHEN flagged AND now < reset_at THEN 'exhausted' WHEN estimated AND now < reset_at THEN 'estimated' ELSE 'open' END AS state FROM ({QUOTA}) q",
    "p26_error_kind": f"SELECT id, CASE WHEN regexp_matches(m, '\\b3036\\b') OR contains(m, 'daily free allocation') THEN 'daily_limit' WHEN contains(m, '5035') THEN 'paid' WHEN regexp_matches(m, '3007|3008|timed out|timeout|aborted|408') THEN 'timeout' WHEN regexp_matches(m, '\\b(?:3040|429|502|503|504)\\b|rate limit|bad gateway') THEN 'transient' ELSE 'other' END AS v FROM (SELECT id, lower(m) AS m FROM ({fixtures.values_sql(MESSAGE_ROWS)}) f(id, m)) q",
    "s1_format": f"SELECT id, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e = 'docx' THEN 'office' WHEN e IN ('xlsx', 'ods') THEN 'sheet' WHEN e = 'png' THEN 'image' WHEN e IN ('txt', 'json') THEN 'text' ELSE 'unknown' END AS v FROM (SELECT id, lower(regexp_extract(m, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM ({fixtures.values_sql(NAMED_FILES)}) f(id, m)) q",
    "p21_clean_suggestions": "SELECT p_size AS id, CAST(least(8, count(DISTINCT trim(p_name))) AS INT) AS n, min(trim(p_name)) AS head FROM part GROUP BY p_size",
    "a8_most_common": "SELECT p_brand AS category, p_name AS value, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY p_brand, p_name QUALIFY rank <= 5",
    "a9_weighted_histogram": f"SELECT file, size, CAST(sum(len(text)) AS BIGINT) AS chars, count(*) AS spans, count_if(bold) AS bold FROM ({SPANS}) s GROUP BY ALL",
    "a11_margins": f"WITH l AS (SELECT page, round(y) AS y, min(x) AS x, max(x1) AS x1 FROM ({SPANS}) s GROUP BY ALL), g AS (SELECT *, lead(y) OVER (PARTITION BY page ORDER BY y) - y AS gap FROM l) SELECT page, min(x) AS \"left\", max(x1) AS \"right\", count(*) AS n_lines, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS usual_gap FROM g GROUP BY page",
    "o3_natural_order": f"SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY regexp_extract(name, '^(\\D*)', 1), coalesce(CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS BIGINT), 0), name) AS ord FROM ({NAMES}) n",
    "o4_reading_order": f"SELECT page, count(*) AS n, arg_min(span, (round(y), x, span)) AS head FROM ({SPANS}) s GROUP BY page",
    "o9_missing_references": "SELECT id, list_sort(m) AS missing FROM (SELECT l_orderkey AS id, list_filter(list(DISTINCT CAST(l_partkey % 9 AS INT)), lambda x: NOT list_contains(list(DISTINCT CAST(l_suppkey % 5 AS INT)), x)) AS m FROM lineitem GROUP BY 1) q WHERE len(m) > 0",
    "p27_block_differences": f"WITH {blocks_cte(LINES_SQL)}, o AS (SELECT doc_id, CASE WHEN kind = 'title' AND doc_id % 4 = 0 THEN 'text' ELSE kind END AS kind FROM b WHERE NOT (kind = 'checkboxes' AND doc_id % 3 = 0)), x AS (SELECT doc_id, kind, count(*) AS n FROM b GROUP BY ALL), y AS (SELECT doc_id, kind, count(*) AS n FROM o GROUP BY ALL) SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.kind, y.kind) AS kind, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.kind = y.kind WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)",
    "p27_first_difference": f"WITH {blocks_cte(LINES_SQL)}, c AS (SELECT doc_id, CAST(block AS INT) AS ord, text AS a, upper(text) AS b FROM b WHERE doc_id % 5 = 0 AND block % 4 = 0 AND upper(text) <> text) SELECT doc_id, min(ord) AS ord, arg_min(a, ord) AS a, arg_min(b, ord) AS b FROM c GROUP BY doc_id",
    "m1_order_pages": f"WITH p AS ({PAPER_PAGES}), s AS (SELECT *, count(number) OVER w = count(*) OVER w AND len(list_distinct(list(number) OVER w)) = count(*) OVER w AS sound FROM p WINDOW w AS (PARTITION BY paper)) SELECT paper, arrival, number, row_number() OVER (PARTITION BY paper ORDER BY CASE WHEN sound THEN number ELSE arrival END, arrival) AS ord FROM s",
    "m24_picture_candidates": f"SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY (lower(title) = lower(query)) DESC, regexp_matches(lower(title), 'outline|line art|drawing') DESC, title, url) AS rank FROM ({PICTURES}) p WHERE starts_with(url, 'https://') AND licence = 'cc0' AND starts_with(mime, 'image/') AND least(w, h) >= 200 QUALIFY rank <= 24",
    "m26_scale_boxes": f"WITH b AS ({BOXES}), k AS (SELECT *, least(523.0 / greatest(max(x + w) OVER p - min(x) OVER p, 1), 770.0 / greatest(max(y + h) OVER p - min(y) OVER p, 1)) AS k, min(x) OVER p AS lx FROM b WINDOW p AS (PARTITION BY page)) SELECT page, box, round(round((x - lx) * k + 36, 3), 1) AS x, round(round(w * k, 3), 1) AS w FROM k",
    "k7_public_fields": "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer",
}
