"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents is turned into hashed byte-trigram counts (on the executors), weighted by
inverse document frequency, and decomposed; its latent vectors, whose number and width are parameters, are
broadcast. Every document is projected into the same space, its cosine with every labelled vector is computed in
blocks, and the nearest ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioforge.llm.common import SpanHash, bytes_of, crc_of_id, labelled_sample, read, row_blocks, word_spans

#: At most so many labelled rows are fitted on (and broadcast, as vectors of RANK floats: 1.5 MB).
SAMPLE = 6000
BUCKETS = 2048
RANK = 64
NEIGHBOURS = 24
#: The held-out fold, by crc32 of the id as text, and the score from which a document passes.
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7


#: Shape terms: a text has the k-th term of a kind if its share lies above the k-th step.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.7], np.float32)
SHAPES = 4 * len(STEPS)


def shapes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Terms for the shape of each text: words equal to the one before, marks, capitals, digits, as shares."""
    n = len(off) - 1
    starts, ends, row = word_spans(data, off)
    words = SpanHash(data)(starts, ends)
    again = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    of = lambda rows, per: np.bincount(rows, minlength=n) / np.maximum(per, 1)
    size, at = np.diff(off), np.repeat(np.arange(n), np.diff(off))
    mark = (data < 128) & ~_LETTER[data] & ~_DIGIT[data] & (data > 32)
    shares = [of(row[1:][again], np.bincount(row, minlength=n)), of(at[mark], size), of(at[(data >= 65) & (data <= 90)], size), of(at[_DIGIT[data]], size)]
    return np.concatenate([(s[:, None] > STEPS) for s in shares], axis=1).astype(np.float32)


_LETTER, _DIGIT = (np.array([f(chr(c)) and c < 128 for c in range(256)]) for f in (str.isalpha, str.isdigit))


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of TERMS per text."""
    return np.concatenate([counts(data, off), shapes(data, off)], axis=1)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log counts of hashed byte trigrams, one row of BUCKETS per text; trigrams don't cross texts."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    d = data.astype(np.uint32)
    gram = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    bucket = (gram * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(off))
    inside = row[:-2] == row[2:]
    flat = np.bincount((row[:-2] * BUCKETS + bucket)[inside], minlength=n * BUCKETS)
    return np.log1p(flat.astype(np.float32)).reshape(n, BUCKETS)


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled x rank, of unit length
    labels: np.ndarray
    prior: float


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights: trigrams of unit length together, then the shape terms beside them."""
    return unit(np.concatenate([unit(x[:, :BUCKETS] * idf[:BUCKETS]), x[:, BUCKETS:] * (idf[BUCKETS:] / 8)], axis=1))


def leading(blocks: Callable[[], Iterator[np.ndarray]], shape: tuple[int, int], rank: int, seed: int = 17, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of the matrix that the blocks of rows make up, by subspace iteration from a fixed start, with fixed signs.

    Each round asks for the blocks anew, so one block at a time is held in double precision.
    """
    q = np.random.Generator(np.random.PCG64(seed)).standard_normal((shape[1], min(rank + 16, *shape)))
    for _ in range(rounds):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in map(np.float64, blocks())))[0]
    _, _, turn = np.linalg.svd(np.concatenate([x @ q for x in blocks()]), full_matrices=False)
    basis = q @ turn[:rank].T
    return basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])


def fit(sample: DataFrame, rank: int = RANK, rows: int = 512) -> Model | None:
    """The model from (doc_id, text, label); None if there is no labelled row.

    The driver holds the sample's terms once, as the halves that the executors send, and widens and weights that many rows at a time.
    """

    @arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        data, off = bytes_of(texts)
        return pa.array([r.tobytes() for a, b in row_blocks(off, rows=256) for r in terms(data[off[a] : off[b]], off[a : b + 1] - off[a]).astype(np.float16)], pa.binary())

    found = sample.select("doc_id", "label", vector("text").alias("v")).toArrow()
    n, width = len(found), BUCKETS + SHAPES
    if not n:
        return None
    order = pc.sort_indices(found, sort_keys=[("doc_id", "ascending"), ("v", "ascending")]).to_numpy()
    labels = found.column("label").to_numpy().astype(np.float32)[order]
    sent = [v.as_buffer() for v in found.column("v")]

    def blocks(weigh: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
        for a in range(0, n, rows):
            yield weigh(np.stack([np.frombuffer(sent[k], np.float16) for k in order[a : a + rows]]).astype(np.float32))

    own = sum((x > 0).sum(0) for x in blocks(lambda x: x))
    idf = np.log((1 + n) / (1 + own)).astype(np.float32) + 1
    each = lambda: blocks(lambda x: weighted(x, idf))
    project = leading(each, (n, width), min(rank, n)).astype(np.float32)
    return Model(idf, project, np.concatenate([unit(x @ project) for x in each()]), labels, float(labels.mean()))


def vote(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores from log counts; a text with no trigram gets the share of label 1."""
    z = unit(weighted(x, model.idf) @ model.project)
    cos = z @ model.vectors.T
    k = min(neighbours, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8
    total = w.sum(1)
    return np.where((total > 1e-12) & x.any(1), np.clip((w * model.labels[near]).sum(1) / np.maximum(total, 1e-12), 0, 1), model.prior)


def with_score(docs: DataFrame, model: Model | None, column: str = "quality_score") -> DataFrame:
    """docs with a score column. Null text counts as empty; without a model every score is 0.5."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            data, off = bytes_of(texts)
            found = [vote(shared.value, terms(data[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in row_blocks(off, rows=256)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, score(F.coalesce("text", F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Only labels of the other folds are learned from. Null or empty text gets a score too; null doc_id counts as
    not held out; repeated rows get equal scores; an empty table gives no rows.
    """
    model = fit(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, SAMPLE))
    return with_score(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", F.coalesce(crc_of_id() % MODULUS == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE: dict = {}
