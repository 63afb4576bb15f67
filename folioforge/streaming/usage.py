"""

State is one small value per day or request, kept by Spark's state store with a checkpoint, so a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators.usage import ALLOWANCE, CAP, LEAST_RESERVE

EVENTS = "event_id long, ts timestamp, op string, amount double, reserve double"
STATE = "used double, booked double, requests long, exhausted boolean, history string"
LEDGER = "day string, event_id long, allowed boolean, used double, booked double, requests long, exhausted boolean"


def ledger_step(state: tuple, op: str, amount: float, reserve: float, history: list[tuple[str, float]], at: str) -> tuple[tuple, bool | None]:
    """[T2, T3, W10] One event on (used, booked, requests, exhausted): the new state, and whether a reservation was let in."""
    used, booked, requests, exhausted = state
    booked = max(booked, used)
    allowed = None
    cost = max(LEAST_RESERVE, -(-int(reserve * 1e6) // 10**6) if reserve == reserve else 0)
    if op == "reserve":
        allowed = not exhausted and booked + cost <= CAP
        booked += cost if allowed else 0
    elif op == "settle" and amount > 0:
        booked = max(used, booked - cost + amount)
    elif op == "add" and amount > 0:
        used = min(ALLOWANCE, used + amount)
        requests += 1
        history.append((at, round(used, 2)))
        if len(history) > 144:
            last = history[-1]
            history[:] = history[::2]
            if history[-1] != last:
                history.append(last)
            del history[:-144]
    elif op == "exhausted":
        exhausted = True
    return (used, booked, requests, exhausted), allowed


def fold_day(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events of a day in order of (ts, event_id), folded into the day's state; a row per event."""
    import json

    used, booked, requests, exhausted, kept = state.get if state.exists else (0.0, 0.0, 0, False, "[]")
    now, history = (used, booked, requests, exhausted), [tuple(x) for x in json.loads(kept)]
    out = []
    for e in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
        now, allowed = ledger_step(now, e.op, 0.0 if pd.isna(e.amount) else e.amount, 0.0 if pd.isna(e.reserve) else e.reserve, history, str(e.ts))
        out.append((key[0], e.event_id, allowed, *map(float, now[:2]), int(now[2]), bool(now[3])))
    state.update((float(now[0]), float(now[1]), int(now[2]), bool(now[3]), json.dumps(history)))
    yield pd.DataFrame(out, columns=["day", "event_id", "allowed", "used", "booked", "requests", "exhausted"]).astype({"allowed": "boolean"})


def ledger(events: DataFrame) -> DataFrame:
    """[T1, T2] The ledger after each event of a stream (or table) of EVENTS; the day in UTC is the key, so days run in parallel."""
    dated = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dated.groupBy("day").applyInPandasWithState(fold_day, LEDGER, STATE, "append", GroupStateTimeout.NoTimeout)


def ledger_of(events: DataFrame) -> DataFrame:
    """[T2] The same ledger over a table. Days are dealt over tasks and read in order as a stream of batches, so
    memory is one batch and one state, however long a day is; the events of one day are a sequence by nature."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, state, history = None, None, []
        for pdf in frames:
            out = []
            for e in pdf.itertuples():
                if e.day != day:
                    day, state, history = e.day, (0.0, 0.0, 0, False), []
                state, allowed = ledger_step(state, e.op, 0.0 if pd.isna(e.amount) else e.amount, 0.0 if pd.isna(e.reserve) else e.reserve, history, str(e.ts))
                out.append((day, e.event_id, allowed, *map(float, state[:2]), int(state[2]), bool(state[3])))
            yield pd.DataFrame(out, columns=["day", "event_id", "allowed", "used", "booked", "requests", "exhausted"]).astype({"allowed": "boolean"})

    dated = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dated.repartition("day").sortWithinPartitions("day", "ts", "event_id").mapInPandas(run, LEDGER)


def once_per_request(requests: DataFrame, delay: str = "24 hours") -> DataFrame:
    """[T4, T5] Requests of a stream, each id once; ids are forgotten when the watermark passes delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def daily_use(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """[T1] Requests and units per day of a stream, closed once the watermark has passed the day."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("requests"), F.least(F.lit(float(ALLOWANCE)), F.sum("amount")).alias("used")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests", "used")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that has arrived, as one job, into Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)
