"""One query per scalar text function, over all documents or pages and the literal fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans import fixtures
from folioforge.session import table

#: The white space class in DuckDB's regular expressions.
DWS = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TEXTS_SQL = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM ({fixtures.values_sql(fixtures.ROWS)}) f(id, text))"
PAGES_SQL = f"(SELECT page_id AS id, html AS text FROM pages UNION ALL SELECT * FROM ({fixtures.values_sql(fixtures.ROWS)}) f(id, text))"
FIXED_READINGS_SQL = f"(SELECT * FROM ({fixtures.values_sql(fixtures.READINGS)}) f(id, a, b, page))"
#: For every line item a reading in native script, with sections, with figures or with numbers, and a second one that keeps it, miscounts,
#: adds words, is in another language or loses a section or a row. Both engines read this SQL.
_FIRST = f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, CASE l_suppkey % 4 WHEN 0 THEN '{fixtures.NATIVE} ' || CAST(l_linenumber AS VARCHAR(9))
    WHEN 1 THEN 'I. Read' || chr(10) || '1. a' || chr(10) || 'II. Write' || chr(10) || CAST(l_linenumber AS VARCHAR(9)) || '. b'
    WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'I. Read' ELSE 'V. Draw' END || chr(10) || '[[QUESTION_ROW: 1. c || 2M]]' || chr(10) || 'II. Write' || chr(10) || '[[FIGURE_ROW: 1,1,5,5|a || 9,9,5,5|b]]'
    ELSE 'Add 12.5 and $x^2$ to ' || CAST(l_orderkey AS VARCHAR(20)) || ' = ____ ( ) × 3' END AS a, CAST(l_linenumber % 2 + 1 AS INT) AS page FROM lineitem"""
PAIRS = f"""SELECT id, a, CASE l_partkey % 6 WHEN 0 THEN a WHEN 1 THEN replace(a, '1', '2') WHEN 2 THEN a || ' with more words' WHEN 3 THEN 'This is a long sentence in another language'
    WHEN 4 THEN replace(replace(a, 'II. Write', 'Write'), '[[FIGURE_ROW: 1,1,5,5|a || 9,9,5,5|b]]', '[[FIGURE: 1,1,5,5|a]]') ELSE replace(replace(a, ' x', ' y'), ' = ', ' + ') END AS b, page FROM ({_FIRST}) q
    UNION ALL SELECT doc_id, text, replace(replace(text, 'the', 'THE'), ', ', ' 5 '), 1 FROM documents"""
READINGS_SQL = f"(SELECT * FROM {FIXED_READINGS_SQL} f0 UNION ALL {PAIRS})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionAll(fixtures.frame(spark, fixtures.ROWS, "id long, text string"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")).unionAll(fixtures.frame(spark, fixtures.ROWS, "id long, text string"))


def fixed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, fixtures.READINGS, "id long, a string, b string, page int")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal pairs, two readings for every line item, and every document against its text with some words and commas changed."""
    views = {n: table(spark, sf_dir, n) for n in ("lineitem", "documents")}
    return fixed_readings(spark, sf_dir).unionAll(spark.sql(PAIRS.replace("FROM lineitem", "FROM {lineitem}").replace("FROM documents", "FROM {documents}"), **views))


def scalar(source, value: Callable[[], Column]):
    return lambda spark, sf_dir: source(spark, sf_dir).select("id", value().alias("v"))


def in_duck(code: str) -> str:
    lo, hi = T.LANGUAGE_RANGES[T.SHARED_RANGES.get(code, code)]
    return f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def trim(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{DWS}+', ''), '{DWS}+$', '')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{DWS}+', ' ', 'g'))"


def entities(t: str) -> str:
    for a, b in T.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return t


_LANG = "list_sort([" + ", ".join([f"{{'n': {count('text', '[A-Za-z]')}, 'place': 0, 'code': 'en'}}"] + [
    f"{{'n': CASE WHEN {count('text', in_duck(c))} >= 3 THEN {count('text', in_duck(c))} ELSE -1 END, 'place': -{k}, 'code': '{c}'}}" for k, c in enumerate(T.LANGUAGE_RANGES, 1)]) + "], 'DESC')[1].code"
_UNCLEAR = count("text", r"(?i)\[unclear(?::[^\]\n]*)?\]")
_SECTION = r"(?m)^\s*(?:\[\[SECTION_ROW:\s*)?([IVXLCDM]+)[.)]?\s+[^\n]+"
_LABELS = lambda t: f"regexp_extract_all({t}, '{_SECTION}', 1)"
_MARKS = T.MARKS
_ONE = lambda k: f"TRY_CAST(nullif(regexp_extract(text, '{_MARKS}', {k}), '') AS BIGINT)"
_LOST = " OR ".join(f"({count('a', chr(92) + 'p{' + s + '}')} >= 20 AND {count('b', chr(92) + 'p{' + s + '}')} < {count('a', chr(92) + 'p{' + s + '}')} * 0.5)" for s in T.NATIVE_SCRIPTS)
_RATIO = lambda t: f"(CASE WHEN len(regexp_replace({t}, '\\s', '', 'g')) > 0 THEN len(regexp_replace({t}, '[^\\x{{0900}}-\\x{{097F}}A-Za-z0-9]', '', 'g'))::DOUBLE / len(regexp_replace({t}, '\\s', '', 'g')) ELSE 0 END)"
_FIG = r"(?i)\[\[(FIGURE(?:_ROW)?):\s*([^\]\n]*?)\]\]"
_WIDTHS = lambda t: (f"list_transform(list_zip(regexp_extract_all({t}, '{_FIG}', 1), regexp_extract_all({t}, '{_FIG}', 2)), "  # noqa: E731
                     r"lambda z: CASE WHEN upper(z[1]) = 'FIGURE_ROW' THEN len(list_filter(string_split_regex(z[2], '\s*\|\|\s*'), lambda y: y <> '')) ELSE 1 END)")

_LATIN = "list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w))"
_KNOWN, _TELUGU = (fixtures.sql_value(list(x)) for x in (T.TELUGU_WORDS, T.TELUGU_WORDS.values()))

#: What recognition makes of a word, after every text one of them, between marks.
_SEEN = ["मगंल पांडे", "झांसी की रानी लक्मीबाई", "बहादर शाह", "स्वतन्त्रता|क्रांती", "रेम्युलटिग रेँ्युलेटिंग एक्ट", "बैटिक, बेंटिक", "मैकले चारपकर चारपेकर", "बंदुओं", "रैड जार्ज", "--- ?? -=- a1"]
_MENDED = f"regexp_replace(regexp_replace(text || ' [' || {fixtures.sql_value(_SEEN)}[id % {len(_SEEN)} + 1] || ']', '{T.STRAY_MARKS}', ' ', 'g'), '{T.RULED_LINES}', ' ', 'g')"
for _from, _to in T.MISREAD:
    _MENDED = f"regexp_replace({_MENDED}, '{_from}', '{_to}', 'g')"


def _with_misread():
    return F.concat("text", F.lit(" ["), F.get(F.array(*map(F.lit, _SEEN)), (F.col("id") % len(_SEEN)).cast("int")), F.lit("]"))


#: name: (input, makes the Spark column, DuckDB input, DuckDB expression or None)
SCALARS = {
    "f1_detect_language": (texts, lambda: T.detect_language(F.col("text")), TEXTS_SQL, _LANG),
    "f3_clean_control": (texts, lambda: F.md5(T.clean_control(F.col("text"))), TEXTS_SQL, "md5(nfc_normalize(regexp_replace(replace(text, chr(0), ''), '^\\x{FEFF}', '')))"),
    "f4_unfence": (texts, lambda: F.md5(T.unfence(F.col("text"))), TEXTS_SQL, f"md5({trim('regexp_replace(regexp_replace(text, ' + chr(39) + r'(?i)^```(?:text|markdown)?\s*\n?' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + r'\n?```\s*$' + chr(39) + ', ' + chr(39) * 2 + ')')})"),
    "f9_count_regions": (texts, lambda: T.count_regions(F.col("text")), TEXTS_SQL, f"CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: len({trim('x')}) > 0))) END"),
    "f26_years": (texts, lambda: T.years(F.col("text")), TEXTS_SQL, r"regexp_extract_all(text, '\b(1[5-9]\d{2})\b', 1)"),
    "f30_native_roman": (texts, lambda: T.native_roman(F.col("text")), TEXTS_SQL, f"CASE WHEN len({_LATIN}) > 0 AND len(list_filter({_LATIN}, lambda w: NOT list_contains({_KNOWN}, w))) = 0 THEN array_to_string(list_transform({_LATIN}, lambda w: {_TELUGU}[list_position({_KNOWN}, w)]), ' ') ELSE '' END"),
    "f39_squeeze": (texts, lambda: F.md5(T.squeeze(F.col("text"))), TEXTS_SQL, f"md5({squeeze('text')})"),
    "f41_valid_ratio": (texts, lambda: F.round(T.valid_ratio(F.col("text")), 6), TEXTS_SQL, f"round({_RATIO('text')}, 6)"),
    "f28_readable_tokens": (texts, lambda: F.md5(T.readable_tokens(_with_misread())), TEXTS_SQL, f"md5(array_to_string(list_filter(string_split_regex({_MENDED}, '{DWS}+'), lambda x: len(x) > 0 AND {_RATIO('x')} >= 0.3), chr(10)))"),
    "f38_dictionary": (texts, lambda: F.to_json(T.dictionary_check(F.substring_index("text", "\n", 1)), {"ignoreNullFields": "false"}), TEXTS_SQL,
                       f"""'{{"known":' || CASE WHEN len({trim('split_part(text, chr(10), 1)')}) > 0 THEN 'true' ELSE 'false' END || ',"is_valid":true,"suggested_correction":null,"reason":"literal_transcription_mode"}}'"""),
    "p1_degenerate": (texts, lambda: T.degenerate(F.col("text")), TEXTS_SQL, r"len(text) > 30000 OR regexp_matches(text, '_{200}|\.{200}| {200}|─{200}|-{200}') OR len(list_filter(list_distinct(string_split(text, '')), lambda c: c <> '' AND NOT regexp_matches(c, '\s') AND contains(text, repeat(c, 80)))) > 0"),
    "p2_blank_safe": (texts, lambda: F.md5(T.blank_safe(F.col("text"))), TEXTS_SQL, f"md5(substring(regexp_replace(text, '_{{81,}}', '{'_' * 28}', 'g'), 1, 12000))"),
    "p3_review_warnings": (texts, lambda: F.array_join(T.review_warnings(F.col("text")), ","), None, None),
    "p22_matches_script": (texts, lambda: F.concat_ws(",", *(T.matches_script(F.col("text"), F.lit(c)).cast("string") for c in ("en", "hi", "mr", "te", "ur", "zz"))), TEXTS_SQL,
                           "array_to_string([" + ", ".join([f"CAST(regexp_matches(text, '{p}') AS VARCHAR)" for p in ("[A-Za-z]", in_duck("hi"), in_duck("mr"), in_duck("te"), in_duck("ur"))] + ["'true'"]) + "], ',')"),
    "s8_strip_tags": (pages, lambda: F.md5(T.strip_tags(F.col("text"))), PAGES_SQL, f"md5({squeeze('replace(' + entities('regexp_replace(text, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')') + ', ' + chr(39) + '&nbsp;' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')})"),
    "s9_strip_office": (pages, lambda: F.md5(T.strip_office(F.col("text"))), PAGES_SQL, "md5(" + trim("regexp_replace(regexp_replace(" + entities(r"regexp_replace(regexp_replace(regexp_replace(text, '(?i)<w:tab\s*/>', chr(9), 'g'), '(?i)<[wa]:br\s*/>|</(?:w|a|text):p>', chr(10), 'g'), '<[^>]+>', '', 'g')") + ", '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + ")"),
    "f21_parse_marks": (texts, lambda: F.struct(*(T.parse_marks(F.col("text"))[c].cast("string").alias(c) for c in ("n", "per", "denom", "total", "computed", "mismatch"))).cast("string"), None, None),
    "p4_loses_script": (readings, lambda: T.loses_script(F.col("a"), F.col("b")), READINGS_SQL, _LOST),
    "p7_figure_layout_changed": (readings, lambda: T.figure_layout_changed(F.col("a"), F.col("b")), READINGS_SQL, f"len({_WIDTHS('a')}) > 0 AND len({_WIDTHS('b')}) > 0 AND {_WIDTHS('a')} <> {_WIDTHS('b')}"),
    "p9_missing_opening": (readings, lambda: T.missing_opening(F.col("a"), F.col("page")), READINGS_SQL, f"coalesce(page = 1 AND len({_LABELS('a')}) > 0 AND {_LABELS('a')}[1] <> 'I' AND regexp_matches(a, '(?m)^\\s*(?:\\[\\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW):\\s*)?[0-9०-९]+[.)]\\s*\\S'), false)"),
    "p10_loses_sections": (readings, lambda: T.loses_sections(F.col("a"), F.col("b")), READINGS_SQL, f"len({_LABELS('a')}) >= 2 AND len(list_filter({_LABELS('a')}, lambda x: NOT list_contains({_LABELS('b')}, x))) > 0"),
    "p24_keeps_numbers": (readings, lambda: T.keeps_numbers(F.col("a"), F.col("b")), READINGS_SQL, " AND ".join(f"regexp_extract_all(a, '{p}') = regexp_extract_all(b, '{p}')" for p in (r"[\p{N}]+(?:[.,][\p{N}]+)*", r"\$[^$]+\$", r"_{2,}|\.{3,}|…+|\(\s*\)", "[+×÷=^_≤≥≠∑∫√−/]"))),
    "p25_within_selection": (readings, lambda: T.within_selection(F.col("a"), F.col("b")), READINGS_SQL, "len(regexp_extract_all(b, '[\\p{L}\\p{M}\\p{N}]+')) <= len(regexp_extract_all(a, '[\\p{L}\\p{M}\\p{N}]+')) + greatest(2, ceil(len(regexp_extract_all(a, '[\\p{L}\\p{M}\\p{N}]+')) * 0.2))"),
    "p23_matches_context": (readings, lambda: T.matches_context(F.col("b"), F.col("a"), F.lit("ab")), READINGS_SQL,
                            "len(regexp_extract_all(b, '\\p{L}')) > 0 AND len(list_filter(list_distinct(regexp_extract_all(b, '\\p{L}')), lambda x: NOT (contains(a, x) OR " + " OR ".join(f"(regexp_matches(x, '{r}') AND regexp_matches(a || ' ab', '{r}'))" for r in (r"[A-Za-z\x{00C0}-\x{024F}]", *(in_duck(c) for c in T.LANGUAGE_RANGES))) + "))) = 0"),
}

QUERIES = {name: scalar(source, value) for name, (source, value, _, _) in SCALARS.items()}
ORACLE = {name: f"SELECT id, {expr} AS v FROM {view} t" for name, (_, _, view, expr) in SCALARS.items() if expr}
ORACLE["f21_parse_marks"] = f"""
    SELECT id, CASE WHEN hit THEN '{{' || n || ', ' || per || ', ' || coalesce(denom::VARCHAR, 'null') || ', ' || coalesce(printed, n * per) || ', ' || n * per || ', ' || CAST(coalesce(printed, n * per) <> n * per AS VARCHAR) || '}}' ELSE '{{null, null, null, null, null, null}}' END AS v
    FROM (SELECT id, regexp_matches(text, '{_MARKS}') AS hit, {_ONE(1)} AS n, {_ONE(2)} AS per, {_ONE(3)} AS denom, {_ONE(4)} AS printed FROM {TEXTS_SQL} t) q
"""


def _asked(pattern: str) -> str:
    return f"regexp_matches(ins, '(?i){pattern}')"


#: Sections by line, questions by part, each counted.
ORACLE["p3_review_warnings"] = f"""
    WITH t AS (SELECT * FROM {TEXTS_SQL} t0), l AS (SELECT id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT id, string_split(text, chr(10)) AS x FROM t) q),
    h AS (SELECT *, regexp_matches(line, '(?i)^{T.SECTION_HEAD}') OR regexp_matches(line, '(?i)^{T.SECTION_BREAK}') AS head FROM l), c AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS sec FROM h),
    s AS (SELECT id, sec, coalesce(max(CASE WHEN head THEN regexp_extract(line, '(?i)^{T.SECTION_HEAD}', 1) || regexp_extract(line, '(?i)^{T.SECTION_HEAD}', 2) END), '') AS ins, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '') AS body FROM c GROUP BY id, sec),
    a AS (SELECT *, {_asked(T.ASKS_TRUTH)} OR {_asked(T.ASKS_CHOICE)} AS uneven, {_asked(T.ASKS_BLANK)} AS blank, len(regexp_extract_all(body, '{T.ITEM}')) >= 2 AS several FROM s),
    p AS (SELECT id, sec, n, unnest(range(len(x))) AS k, unnest(x) AS part FROM (SELECT id, sec, n, string_split_regex(regexp_replace(regexp_replace(line, '(?i)^\\s*\\[\\[(?:MATCH_ROW|TABLE_ROW|QUESTION_ROW):\\s*', ''), '\\]\\]\\s*$', ''), '\\s*\\|\\|\\s*') AS x FROM c WHERE NOT head) q),
    i AS (SELECT *, sum(CASE WHEN regexp_matches(part, '{T.ITEM_START}') THEN 1 ELSE 0 END) OVER (PARTITION BY id, sec ORDER BY n, k) AS item FROM p),
    o AS (SELECT id, sec, item, bool_or((regexp_matches(part, '{T.ITEM_START}') OR regexp_matches(part, '{T.PLACE_START}')) AND regexp_matches(part, '{T.PLACE}')) AS open FROM i WHERE item > 0 GROUP BY id, sec, item),
    q AS (SELECT id, sec, count(*) AS items, count_if(open) AS open FROM o GROUP BY id, sec),
    m AS (SELECT a.id, bool_or((uneven OR blank) AND several AND (NOT regexp_matches(body, '{T.PLACE}') OR uneven AND coalesce(items >= 2 AND open > 0 AND open < items, false))) AS lacks FROM a LEFT JOIN q ON q.id = a.id AND q.sec = a.sec GROUP BY a.id)
    SELECT t.id, array_to_string(list_filter([CASE WHEN {_UNCLEAR} > 0 THEN 'unclear_source:' || {_UNCLEAR} END, CASE WHEN contains(text, chr(65533)) THEN 'invalid_character' END,
        CASE WHEN regexp_matches(text, '(?i)\\[\\[PICTURE(?:_OPTION|_ROW)?:') THEN 'missing_source_picture' END, CASE WHEN lacks AND len(text) <= 80000 THEN 'missing_answer_spaces' END], lambda x: x IS NOT NULL), ',') AS v FROM t LEFT JOIN m ON m.id = t.id"""
