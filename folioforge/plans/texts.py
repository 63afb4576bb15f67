"""Marker rules over papers and documents, Word rendering read back, and the streaming ledger over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import markers as M
from folioforge.plans.papers import LETTERS_SQL, LINES_SQL, blocks_cte, lines_from, paper_blocks, paper_docs
from folioforge.session import scratch, table
from folioforge.sources import binary, sinks
from folioforge.streaming import usage

#: Events as reservations, settlements and uses by key.
LEDGER_EVENTS = "SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'reserve' WHEN 1 THEN 'settle' ELSE 'add' END AS op, CAST(value AS DOUBLE) AS amount, CAST(1000 + event_id % 50 AS DOUBLE) AS reserve FROM {events}"


def ruled(rule):
    return lambda s, d: paper_docs(s, d).select("doc_id", F.md5(M.over_texts(rule)("text")).alias("v"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[K2, S12, P27] The papers as Word files, read back: what the blocks say in order."""
    packages = sinks.render_packages(paper_blocks(spark, sf_dir))
    named = packages.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "content")
    return binary.word_blocks(named).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "ord", "text")


def streamed(make, mode: str = "append"):
    """The events table put in a landing folder, a stream over it run until all that is there is done, its output read back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, at = table(spark, sf_dir, "events"), scratch(spark, "stream")
        events.write.parquet(f"{at}/landing")
        usage.run_available(make(spark.readStream.schema(events.schema).parquet(f"{at}/landing")), f"{at}/rows", f"{at}/checkpoint", mode)
        return spark.read.parquet(f"{at}/rows")

    return run


def ledger_events(events: DataFrame) -> DataFrame:
    """The stream's form of LEDGER_EVENTS."""
    op = F.when(F.col("event_id") % 4 == 0, "reserve").when(F.col("event_id") % 4 == 1, "settle").otherwise("add")
    return events.select("event_id", "ts", op.alias("op"), F.col("value").alias("amount"), (1000 + F.col("event_id") % 50).cast("double").alias("reserve"))


def request_events(events: DataFrame) -> DataFrame:
    """Requests that repeat within a few hours: one id per user and day."""
    return events.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("request_id"), "ts")


QUERIES = {
    "t2_ledger_stream": streamed(lambda events: usage.ledger(ledger_events(events))),
    "t4_requests_stream": streamed(lambda events: usage.once_per_request(request_events(events), "48 hours").select("request_id")),
    "f18_normalise": ruled(M.normalise),
    "f10_clean": ruled(M.clean),
    "f6_plain": ruled(M.plain),
    "w12_grid_cells": lambda s, d: paper_docs(s, d, lines_from(LETTERS_SQL)).select("doc_id", F.md5(M.over_texts(M.grid_cells)("text")).alias("v")),
    "w13_headers": ruled(M.without_repeated_headers),
    "f8_protect_restore": lambda s, d: table(s, d, "documents").select("doc_id", (M.over_texts(lambda t: M.restore(*M.protect(t)))("text") == F.col("text")).alias("v")),
    "k2_word_round_trip": rendered,
    "k3_preview": lambda s, d: sinks.preview(paper_blocks(s, d)).select("doc_id", F.md5("preview").alias("v")),
    "t2_ledger": lambda s, d: usage.ledger_of(s.sql(LEDGER_EVENTS, events=table(s, d, "events"))),
}
_EVENTS = LEDGER_EVENTS.replace("{events}", "events")
_STEP = """CASE WHEN op = 'add' AND amount > 0 THEN least(10000.0, {used} + amount) ELSE {used} END AS used,
    CASE WHEN op = 'reserve' AND greatest({booked}, {used}) + greatest(1000, ceil(reserve)) <= 9500 THEN greatest({booked}, {used}) + greatest(1000, ceil(reserve))
         WHEN op = 'settle' AND amount > 0 THEN greatest({used}, greatest({booked}, {used}) - greatest(1000, ceil(reserve)) + amount) ELSE greatest({booked}, {used}) END AS booked,
    {requests} + CASE WHEN op = 'add' AND amount > 0 THEN 1 ELSE 0 END AS requests, CASE WHEN op = 'reserve' THEN greatest({booked}, {used}) + greatest(1000, ceil(reserve)) <= 9500 END AS allowed"""
ORACLE = {
    "t4_requests_stream": "SELECT DISTINCT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id FROM events",
    "t2_ledger": f"""WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, op, amount, reserve, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM ({_EVENTS}) q),
        r AS (SELECT day, k, event_id, {_STEP.format(used='0.0::DOUBLE', booked='0.0::DOUBLE', requests='0')} FROM e WHERE k = 1
              UNION ALL SELECT e.day, e.k, e.event_id, {_STEP.format(used='r.used', booked='r.booked', requests='r.requests')} FROM r JOIN e ON e.day = r.day AND e.k = r.k + 1)
        SELECT day, event_id, allowed, used, booked, CAST(requests AS BIGINT) AS requests, false AS exhausted FROM r""",
    "k2_word_round_trip": f"WITH {blocks_cte(LINES_SQL)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS ord, text FROM b WHERE kind <> 'pagebreak'",
    "w12_grid_cells": f"""WITH l AS (SELECT *, len(trim(line)) = 1 AS one FROM {LETTERS_SQL} t),
        r AS (SELECT *, CASE WHEN one THEN line_no - row_number() OVER (PARTITION BY doc_id, one ORDER BY line_no) ELSE line_no + 1000000 END AS run FROM l),
        g AS (SELECT doc_id, min(line_no) AS first_line, CASE WHEN bool_and(one) AND count(*) >= 8 THEN '[[GRID_ROW: ' || string_agg(trim(line), ' || ' ORDER BY line_no) || ']]' ELSE string_agg(line, chr(10) ORDER BY line_no) END AS said FROM r GROUP BY doc_id, run)
        SELECT doc_id, md5(string_agg(said, chr(10) ORDER BY first_line)) AS v FROM g GROUP BY doc_id""",
    "f8_protect_restore": "SELECT doc_id, true AS v FROM documents",
}
ORACLE["t2_ledger_stream"] = ORACLE["t2_ledger"]
