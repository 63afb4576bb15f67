"""Sharding by a two-pass external shuffle.

First pass: records go to buckets by a seeded hash of their content and, for equal records, of a number, as many buckets as keep one in memory.
Second pass: each bucket is put in a fixed order and shuffled by Fisher-Yates with a seed of its own. The buckets
one after the other are the shuffled table; dealing its places round-robin gives shards whose row counts differ
by one at most (law ``rows``), each in random order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import read, stage

SHARDS = 16
SEED = 20_240_601
#: Bytes of records that one bucket holds on average, and the least number of buckets.
BUCKET_BYTES = 8 << 20
PAYLOAD = ["doc_id", "text", "size", "text_crc32"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of n places: numpy's shuffle is Fisher-Yates from the last place down."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def scatter(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Pass 1: a bucket for each record. Equal records are numbered, so that copies scatter too."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sized = numbered(sized.withColumn("key", F.xxhash64("doc_id", "text", "size")))
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "copy")
    return sized.withColumn("place", hashed).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(buckets)).cast("int"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds copy: how many equal keys stand before the row in its partition, and where that isn't 0, which partition that is.

    Which of several equal records gets which number makes no difference, so a task that runs again deals them alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            copies = np.zeros(batch.num_rows, np.int64)
            for k, key in enumerate(batch.column("key").to_numpy().tolist()):
                n = met.get(key, 0)
                met[key] = n + 1
                copies[k] = n and n << 24 | part
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAYLOAD), pa.array(copies)], [*PAYLOAD, "copy"])

    return rows.mapInArrow(run, "doc_id long, text string, size long, text_crc32 long, copy long")


def shuffle_pass(scattered: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Pass 2: the records of each bucket in shuffled order, with their index there."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("copy", pa.int64()), ("place", pa.int64()), ("bucket", pa.int32())])

    def flush(rows: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        whole = whole.sort_by([(c, "ascending") for c in ("place", "doc_id", "text_crc32", "size", "copy")])
        order = fisher_yates(len(whole), seed * 1_000_003 + bucket)
        out = whole.take(pa.array(order)).drop_columns(["place", "copy"]).append_column("at", pa.array(np.arange(len(whole)), pa.int64()))
        yield from out.to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            batch = batch.cast(schema) if batch.schema != schema else batch
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if held and ids[a] != now:
                    yield from flush(held, now)
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held, now)

    return (
        scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(run, "doc_id long, text string, size long, text_crc32 long, bucket int, at long"))


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, size, text_crc32, shard, slot of every record.

    Deterministic for a given content and bucket count. Null text keeps being null and counts no bytes; null ids and
    repeated rows are records like others; other columns are left out; an empty table gives no rows. Only
    the number of rows per bucket reaches the driver.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    buckets = max(8, -(-total // bucket_bytes))
    shuffled = stage(shuffle_pass(scatter(docs, seed, buckets), seed, buckets), "shuffled")
    counted = {r.bucket: r.n for r in shuffled.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    base, before = [], 0
    for bucket in sorted(counted):
        base.append((bucket, before))
        before += counted[bucket]
    at = F.col("at") + F.col("base")
    return (
        shuffled.join(F.broadcast(docs.sparkSession.createDataFrame(base, "bucket int, base long")), "bucket")
        .select(*PAYLOAD, (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The shards as folders shard=N of Parquet files, in slot order within each file."""
    external_shuffle(docs, shards, seed).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE: dict = {}
