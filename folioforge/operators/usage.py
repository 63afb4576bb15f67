
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units per million tokens read and written, the least reservation, the daily allowance and cap, bytes an image counts for.
READ_PRICE, WRITE_PRICE, LEAST_RESERVE, ALLOWANCE, CAP, IMAGE_BYTES = 9_091, 27_273, 1_000, 10_000, 9_500, 16_384


def token_cost(read: Column, written: Column) -> Column:
    """[F32] Units for tokens."""
    return F.coalesce(read, F.lit(0)) * (READ_PRICE / 1e6) + F.coalesce(written, F.lit(0)) * (WRITE_PRICE / 1e6)


def reservation(n_bytes: Column, images: Column, most_written: Column) -> Column:
    """Units to book before a call."""
    return F.greatest(F.lit(LEAST_RESERVE), F.ceil((n_bytes + images * IMAGE_BYTES) * READ_PRICE / 1e6 + F.coalesce(most_written, F.lit(6144)) * WRITE_PRICE / 1e6)).cast("long")


def utc_day(ts: Column) -> Column:
    """The day, as text; a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd")


def retry_after(now: Column, reset: Column) -> Column:
    """Whole seconds until reset, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.unix_micros(reset) / 1e6 - F.unix_micros(now) / 1e6)).cast("long")


def minute_sums(rows: DataFrame, amount: str) -> DataFrame:
    """Per day and minute of (day, minute, amount): count, sum, and before, the sum of the day's minutes before. A day has 1,440 minutes at most, so the window is small whatever the rows."""
    sums = rows.groupBy("day", "minute").agg(F.count("*").alias("n"), F.sum(amount).alias("sum"))
    earlier = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0).cast(sums.schema["sum"].dataType)))


def with_running(rows: DataFrame, amount: str) -> DataFrame:
    """Adds running: the sum of amount over the day up to each row of (day, minute, ts, event_id). Rows meet in the order of their minute only, and minutes by their sums."""
    inside = F.sum(amount).over(Window.partitionBy("day", "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    before = minute_sums(rows, amount).select("day", "minute", "before")
    return rows.withColumn("inside", inside).join(before, ["day", "minute"]).withColumn("running", F.col("before") + F.col("inside")).drop("before", "inside")


def daily_totals(events: DataFrame) -> DataFrame:
    """[T1] Per UTC day of (ts, value): requests, units used up to the allowance, and the time at which the allowance was reached (T3).

    Days are summed by minutes; only the events of the minute in which a day's sum reaches the allowance are put in order.
    """
    dated = events.where("value > 0").select("event_id", "ts", "value", utc_day(F.col("ts")).alias("day"), F.date_trunc("minute", "ts").alias("minute"))
    minutes = minute_sums(dated, "value")
    reached = minutes.where((F.col("before") < ALLOWANCE) & (F.col("before") + F.col("sum") >= ALLOWANCE)).select("day", "minute", "before")
    inside = F.sum("value").over(Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    when = dated.join(reached, ["day", "minute"]).withColumn("running", F.col("before") + inside).where(F.col("running") >= ALLOWANCE).groupBy("day").agg(F.min("ts").alias("at"))
    totals = minutes.groupBy("day").agg(F.sum("n").alias("requests"), F.round(F.least(F.lit(float(ALLOWANCE)), F.sum("sum")), 2).alias("used"))
    return totals.join(when, "day", "left").select("day", "requests", "used", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("reached_at"))


def admitted(requests: DataFrame, cap: int = CAP) -> DataFrame:
    """[W9, T9] Greedy admission per (day, key): in order of (ts, event_id), a request is let in if its cost still fits under the cap.

    Rejected requests use nothing up, so this is a fold over the ordered requests of one day and key, not a running sum.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("booked"), F.array().cast("array<struct<event_id: bigint, booked: bigint>>").alias("let_in"))

    def step(state: Column, r: Column) -> Column:
        fits = state["booked"] + r["cost"] <= cap
        booked = F.when(fits, state["booked"] + r["cost"]).otherwise(state["booked"])
        return F.struct(booked.alias("booked"), F.when(fits, F.concat(state["let_in"], F.array(F.struct(r["event_id"].alias("event_id"), booked.alias("booked"))))).otherwise(state["let_in"]).alias("let_in"))

    folded = requests.groupBy("day", "key").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("day", "key", F.explode("s.let_in").alias("x")).select("day", "key", "x.event_id", "x.booked")


def merged_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """[A17] Token counts of all calls of a request, null where they are zero."""
    return calls.groupBy("request_id").agg(*(F.nullif(F.sum(F.coalesce(k, F.lit(0))), F.lit(0)).alias(k) for k in keys))


def presence(visits: DataFrame) -> DataFrame:
    """[T6] Running number of open connections per room from (room, ts, event_id, delta)."""
    return visits.withColumn("open", F.sum("delta").over(Window.partitionBy("room").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))


def first_valid(results: DataFrame) -> DataFrame:
    """[T7] Per request the provider whose valid result came first."""
    return results.where("valid").groupBy("request_id").agg(F.min_by("provider", F.struct("finished_at", "provider")).alias("provider"), F.min("finished_at").alias("finished_at"))


def first_per_request(requests: DataFrame) -> DataFrame:
    """[T4] Of requests with one id, the first."""
    return requests.withColumn("rn", F.row_number().over(Window.partitionBy("request_id").orderBy("ts", "event_id"))).where("rn = 1").drop("rn")


def unexpired(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """[T5, K4, N15] Rows written less than hours ago."""
    return rows.where(F.col("ts") + F.make_interval(hours=F.lit(hours)) > now)


def latency(rows: DataFrame) -> DataFrame:
    """[A20] Per group of (grp, ms): number, exact median and 95th percentile, largest."""
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.percentile("ms", 0.5), 4).alias("p50"), F.round(F.percentile("ms", 0.95), 4).alias("p95"), F.max("ms").alias("most"))


def quota_view(reports: DataFrame) -> DataFrame:
    """[M21] Status from (id, percent, flagged, estimated, reset_at, now): the provider's flag beats the estimate, ends at reset; a percentage outside 0 to 100 is null."""
    live = F.col("now") < F.col("reset_at")
    percent = F.when(F.col("percent").between(0, 100), F.col("percent"))
    state = F.when(F.col("flagged") & live, "exhausted").when(F.col("estimated") & live, "estimated").otherwise("open")
    return reports.select("id", percent.alias("percent"), state.alias("state"))
