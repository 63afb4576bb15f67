"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes decides where chunks end: after the white space whose hash is the largest
around, or the character where no white space is near, so that an insertion shifts the cuts only near itself. Equal chunks are found by digest: the first one in (doc_id, place) order stays, the
others are cut out of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioforge.llm.common import _SPACE, bytes_of, read, row_blocks, stage

#: Bytes: a chunk's least and most, and how far around itself a cut's hash must be the largest.
LEAST, MOST, REACH = 24, 512, 28
GEAR_SEED = 7
_GEAR = np.random.Generator(np.random.PCG64(GEAR_SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each place, h = (h << 1) + gear[b], for all places at once by doubling."""
    h = _GEAR[data]
    for k in range(4):
        n = 1 << k
        if len(h) > n:
            h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places after those candidates whose hash is the largest of all within REACH bytes: they depend on little more.

    Candidates are white spaces, and the ends of characters that have none within REACH bytes. Of equal hashes
    each is a cut, so repetitive text is cut in step with what it repeats. Zeros stand between texts.
    """
    space = _SPACE[data]
    seen = np.concatenate([[0], np.cumsum(space)])
    place = np.arange(len(data))
    alone = seen[np.minimum(place + REACH + 1, len(data))] == seen[np.maximum(place - REACH, 0)]
    ended = np.append((data[1:] & 0xC0) != 0x80, True) & (data != 0)
    at = np.flatnonzero(space | alone & ended)
    h = gear(data)[at]
    best = np.ones(len(at), bool)
    for k in range(1, REACH + 1):
        near = at[k:] - at[:-k] <= REACH
        if not near.any():
            break
        best[:-k] &= ~near | (h[:-k] >= h[k:])
        best[k:] &= ~near | (h[k:] >= h[:-k])
    return at[best] + 1


def chunk_ends(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, which cover it. A chunk without a cut ends at MOST bytes, at a character."""
    if not len(data):
        return [[] for _ in off[1:]]
    # Zeros between the texts, so that a text's cuts don't depend on its neighbours.
    pad = REACH + 16
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    apart = np.zeros(len(data) + pad * len(off), np.uint8)
    apart[np.arange(len(data)) + (row + 1) * pad] = data
    cuts = cut_points(apart)
    cuts -= (np.searchsorted(off[1:] + np.arange(1, len(off)) * pad, cuts, "left") + 1) * pad
    bounds = np.searchsorted(cuts, off)
    out = []
    for a, b, lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        ends, start = [], a
        for c in [*cuts[lo:hi].tolist(), b]:
            while c - start > MOST:
                start = letter_end(data, start + MOST, b)
                ends.append(start)
            if c - start >= LEAST and (b - c >= LEAST or c == b):
                ends.append(c)
                start = c
        if start < b:
            if ends and b - start < LEAST:
                ends.pop()
            ends.append(b)
        out.append(ends)
    return out


def letter_end(data: np.ndarray, at: int, end: int) -> int:
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunked(texts: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    """Each text's bytes and the ends of its chunks in them."""
    data, off = bytes_of(texts)
    for a, b in row_blocks(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        raw = part.tobytes()
        for s, e, ends in zip(o[:-1].tolist(), o[1:].tolist(), chunk_ends(part, o)):
            yield raw[s:e], [x - s for x in ends]


#: Stands for a null id: before all others.
NO_ID = -(1 << 63)


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_digests(docs: DataFrame) -> DataFrame:
    """(h1, h2, did): the two halves of the digest of every chunk of at least LEAST bytes, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            found: list[bytes] = []
            per: list[int] = []
            done = 0

            def out() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)] + [pa.array(np.repeat(ids[done : done + len(per)], per))], ["h1", "h2", "did"])

            for raw, ends in chunked(batch.column("_text")):
                own = {digest(raw[a:b]) for a, b in zip([0, *ends], ends) if b - a >= LEAST}
                found.extend(own)
                per.append(len(own))
                if len(found) >= 100_000:
                    yield out()
                    done += len(per)
                    found, per = [], []
            if found:
                yield out()

    return docs.select("did", "_text").mapInArrow(run, "h1 long, h2 long, did long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(did, drop): per document the digests (first halves) of its chunks that a document with a smaller id has."""
    chunks = chunk_digests(docs)
    # Counted before the shuffle too, so a chunk that very many documents share meets in one row per task.
    first = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("did").alias("first")).where("n > 1").drop("n")
    return chunks.join(first, ["h1", "h2"]).where("did > first").groupBy("did").agg(F.collect_list("h1").alias("drop"))


def without_repeats(raw: bytes, ends: list[int], gone: set[int]) -> tuple[bytes, int]:
    """The bytes without the runs of chunks that are in gone or came before in this text, and the number of chunks cut out."""
    seen: set[bytes] = set()
    runs: list[list[int]] = []  # start, end, chunks
    for a, b in zip([0, *ends], ends):
        if b - a < LEAST:
            continue
        chunk = raw[a:b]
        if chunk in seen or gone and int.from_bytes(digest(chunk)[:8], "little", signed=True) in gone:
            if runs and runs[-1][1] == a:
                runs[-1][1:] = b, runs[-1][2] + 1
            else:
                runs.append([a, b, 1])
        seen.add(chunk)
    kept = [raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)])]
    return b"".join(kept), sum(r[2] for r in runs)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs with text deduplicated, and n_bytes, n_chunks, n_removed_chunks, n_removed.

    Of equal chunks the first one in (doc_id, place) order stays, a null id before all others; the
    others are cut out. Chunks of fewer
    than LEAST bytes (only whole texts are that short) stay. Rows that share an id, repeated rows too, don't
    take chunks from each other. Null text stays null and removes nothing; empty text stays empty. Columns of
    docs keep their names, whatever those are; the four above are added. An empty table gives no rows.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # so that no name can clash with those used here
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rows = rows.withColumn("did", F.coalesce(doc_id, F.lit(NO_ID))).withColumn("_text", F.coalesce(text, F.lit("")))
    drops = stage(repeated_chunks(rows), "drops")

    @arrow_udf("text string, n_bytes long, n_chunks int, n_removed_chunks int, n_removed long")
    def cut(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for (raw, ends), gone in zip(chunked(texts), dropped):
            gone = set(gone.as_py() or ())
            left, n = without_repeats(raw, ends, gone)
            out.append((left.decode(), len(raw), len(ends), n, len(raw) - len(left)))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["text", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed"])

    joined = rows.join(drops, "did", "left").withColumn("_cut", cut("_text", "drop"))
    return joined.select(
        *(F.when(F.col(f"c{k}").isNotNull(), F.col("_cut.text")).alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(names)),
        "_cut.n_bytes", "_cut.n_chunks", "_cut.n_removed_chunks", "_cut.n_removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE: dict = {}
