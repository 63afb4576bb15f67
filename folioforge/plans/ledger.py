"""Usage-ledger queries over the events table (value stands in for request cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.usage import with_running
from folioforge.session import table

#: The daily allowance and the share that may be booked.
DAILY_ALLOWANCE = 10_000
DAILY_CAP = 9_500


def ledger_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: use so far that UTC day, held at the allowance, and the percentage of it (T1, W8, F34, F35).

    Null or non-positive values add nothing and are left out. Events are put in order within their minute only.
    """
    events = table(spark, sf_dir, "events").where("value > 0")
    day = F.date_trunc("day", "ts")
    cents = events.select("event_id", "ts", day.alias("day"), F.date_trunc("minute", "ts").alias("minute"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return (
        with_running(cents, "cents")
        .withColumn("used", F.least(F.lit(DAILY_ALLOWANCE * 100), "running"))
        .select(
            "event_id",
            F.date_format("day", "yyyy-MM-dd").alias("day"),
            "used",
            (F.floor((F.col("used") + 50) / 100) / 100).alias("percent"),
            F.date_format(F.col("day") + F.expr("interval 1 day"), "yyyy-MM-dd").alias("resets_on"),
        )
    )


QUERIES = {"ledger_running": ledger_running}
ORACLE = {
    "ledger_running": """
        WITH e AS (SELECT event_id, ts, date_trunc('day', ts) AS day, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value > 0),
        r AS (SELECT event_id, day, least(1000000, CAST(sum(cents) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS used FROM e)
        SELECT event_id, strftime(day, '%Y-%m-%d') AS day, used, floor((used + 50) / 100) / 100 AS percent,
               strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS resets_on FROM r
    """
}
