"""Best-fit packing of tokenised documents into sequences, by bulk-synchronous rounds.

Documents are range-sorted by length, which gives each piece a rank within its length. Then rounds follow:
every unplaced piece looks for its successor, the smallest gap that holds it; the sweep that finds the
successors works on counts per length and per gap size, of which there are at most ``capacity`` each,
whatever the corpus; conflicts for the gaps of one size are settled by rank, losers try the next larger gap;
the pieces and gaps themselves are then matched by a distributed join on (gap size, rank), and the gaps
shrink. Pieces that fit no gap open new sequences, as many as their tokens need at the least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import stage, text_column

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
_ENCODER: dict = {}


def encoder(vocabulary: str):
    """byte_bpe_50k by its ranks: the same ids as byte_bpe_50k.json under tokenizers gives (tested), several times faster.

    Tokens that the json file adds to the vocabulary are cut out of a text first, as tokenizers does.
    """
    if vocabulary not in _ENCODER:
        import base64
        import json

        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        ranks = {b: r for b, r in ranks.items() if r not in added.values()}
        _ENCODER[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODER[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of capacity, but for the first."""
    head = n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document. Null text counts as empty: one piece that holds the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_column(batch)):
                ids = np.append(enc.encode_to_numpy(text.as_py(), allowed_special="all"), END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces in range order of (length, doc_id, piece), with each one's rank within its length from 0.

    The partitions follow each other in that order, so a rank is a place in the partition plus the count in
    earlier ones; a length that very many pieces share is dealt over several partitions. Only counts per
    (partition, length) reach the driver: at most the lengths plus the partitions.
    """
    spark = pieces.sparkSession
    order = ["length", "doc_id", "piece", "ids_crc32"]
    placed = stage(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order)  # as many tasks as the bytes ask for
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    runs = placed.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    before: dict[int, int] = {}
    base = []
    for r in sorted(runs, key=lambda r: (r.part, r.length)):
        base.append((r.part, r.length, before.get(r.length, 0) - r["first"]))
        before[r.length] = before.get(r.length, 0) + r.n
    table = spark.createDataFrame(base, "part int, length long, base long")
    return placed.join(F.broadcast(table), ["part", "length"]).withColumn("rank", F.col("at") + F.col("base")).drop("part", "at", "base")


def sweep(items: dict[int, list[int]], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """One successor sweep over counts. items: length -> [first unplaced rank, end]; gaps: free -> count.

    Longest pieces first, each to the smallest gap that holds it and is not yet taken in this round; rank
    settles conflicts. Returns runs (length, first rank, how many, gap size, first gap rank); each run uses up
    the pieces of a length or the gaps of a size, so there are no more runs than lengths and sizes together.
    """
    free = sorted(gaps)
    taken = dict.fromkeys(free, 0)
    nxt = {g: (free[k + 1] if k + 1 < len(free) else 0) for k, g in enumerate(free)}
    alias: dict[int, int] = {}

    def open_from(g: int) -> int:
        path = []
        while g and taken[g] >= gaps[g]:
            path.append(g)
            g = alias.get(g, nxt[g])
        for p in path:
            alias[p] = g
        return g

    out = []
    for length in sorted(items, reverse=True):
        lo, hi = items[length]
        k = int(np.searchsorted(free, length))
        g = open_from(free[k]) if k < len(free) else 0
        while lo < hi and g:
            n = min(hi - lo, gaps[g] - taken[g])
            out.append((length, lo, n, g, taken[g]))
            taken[g] += n
            lo += n
            g = open_from(g)
        items[length][0] = lo
    return out


RUNS = "length long, rank0 long, n long, gap long, gap0 long, left long, left0 long"


def between(rows: DataFrame, runs: list[tuple]) -> DataFrame:
    """Length and rank of the pieces whose lengths the runs span; the files are in order of length, so the scan skips the rest."""
    return rows.where(F.col("length").between(min(r[0] for r in runs), max(r[0] for r in runs))).select("length", "rank")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    No sequence holds more than capacity tokens, and offsets are gapless from 0. Equal lengths are dealt by
    (doc_id, piece), so the result does not depend on partitioning; repeated rows are packed each on its own.
    """
    spark = pieces.sparkSession
    rows = ranked(pieces)
    items = {r.length: [0, r.n] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    sequences = 0
    gaps: dict[int, int] = {}
    bins: DataFrame | None = None  # (seq, free, rank): the open gaps
    placed: list[DataFrame] = []
    while any(lo < hi for lo, hi in items.values()):
        runs = sweep(items, gaps) if gaps else []
        if runs:
            left: dict[int, int] = {}
            taken: dict[int, int] = {}
            table = []
            for length, lo, n, g, g0 in runs:
                left0 = left.get(g - length, 0)
                left[g - length] = left0 + n
                taken[g] = taken.get(g, 0) + n
                table.append((length, lo, n, g, g0, g - length, left0))
            # Untaken gaps of a size keep their order behind the newly left ones of that size.
            keep = [(g, taken.get(g, 0), left.get(g, 0)) for g in gaps]
            small = F.broadcast(spark.createDataFrame(table, RUNS))
            won = (
                between(rows, table).join(small, "length").where("rank >= rank0 AND rank < rank0 + n")
                .select("length", "rank", F.col("gap").alias("free"), (F.col("gap0") + F.col("rank") - F.col("rank0")).alias("gap_rank"),
                        "left", (F.col("left0") + F.col("rank") - F.col("rank0")).alias("left_rank"))
            )
            hit = won.join(bins.withColumnRenamed("rank", "gap_rank"), ["free", "gap_rank"]).select("length", "rank", "seq", "free", "left", "left_rank")
            rest = bins.join(F.broadcast(spark.createDataFrame(keep, "free long, used long, base long")), "free").where("rank >= used").select(
                F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("rank"), "seq", F.lit(None).cast("long").alias("free"), F.col("free").alias("left"), (F.col("rank") - F.col("used") + F.col("base")).alias("left_rank"))
            # One table a round: the pieces placed in it, and all gaps after it.
            state = stage(hit.unionAll(rest), "round")
            placed.append(state.where("length IS NOT NULL").select("length", "rank", "seq", (F.lit(capacity) - F.col("free")).alias("offset")))
            bins = state.where("left > 0").select("seq", F.col("left").alias("free"), F.col("left_rank").alias("rank"))
            gaps = {g: n for g in {*gaps, *left} if g and (n := gaps.get(g, 0) - taken.get(g, 0) + left.get(g, 0))}
        top = max(gaps, default=0)
        unfit = {k: hi - lo for k, (lo, hi) in items.items() if k > top and lo < hi}
        if unfit:
            # Two of more than half a sequence never share one; else the tokens say how many are needed at least.
            n = max(-(-sum(k * v for k, v in unfit.items()) // capacity), sum(v for k, v in unfit.items() if 2 * k > capacity))
            table = []
            for k in sorted(unfit, reverse=True):
                m = min(n, unfit[k])
                if m:
                    table.append((k, items[k][0], m, 0, sequences, capacity - k, gaps.get(capacity - k, 0)))
                    gaps[capacity - k] = gaps.get(capacity - k, 0) + m
                    items[k][0] += m
                    sequences += m
                    n -= m
            small = F.broadcast(spark.createDataFrame(table, RUNS))
            seeds = (
                between(rows, table).join(small, "length").where("rank >= rank0 AND rank < rank0 + n")
                .select("length", "rank", (F.col("gap0") + F.col("rank") - F.col("rank0")).alias("seq"), F.lit(0).cast("long").alias("offset"),
                        "left", (F.col("left0") + F.col("rank") - F.col("rank0")).alias("left_rank"))
            )
            placed.append(seeds.select("length", "rank", "seq", "offset"))
            fresh = seeds.where("left > 0").select("seq", F.col("left").alias("free"), F.col("left_rank").alias("rank"))
            bins = fresh if bins is None else bins.unionAll(fresh)
            gaps.pop(0, None)
    if not placed:
        return rows.drop("rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    found = placed[0]
    for more in placed[1:]:
        found = found.unionAll(more)
    return rows.join(found.withColumnRenamed("seq", "sequence_id"), ["length", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with_ids adds the token ids of each piece.

    Null or empty text: one piece that holds the end id. Null doc_id is kept. Columns other than doc_id and
    text are not looked at. An empty table gives no rows.
    """
    pieces = tokenise(docs, capacity, with_ids=with_ids)
    pieces = pieces if with_ids else pieces.drop("ids")
    pieces = stage(pieces, "tokens")  # else the range sort's sampling would tokenise everything once more
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLE: dict = {}
