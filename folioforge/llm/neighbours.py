"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split into balanced clusters, whose centroids are broadcast with a neighbour graph over them.
Every vector goes to the posting list of its nearest centroid, and boundary vectors, almost as near to others, to
those lists too. A query walks the centroid graph, in which a path that comes nearer with every step leads from any
centroid to any other, and the ratio of a centroid's distance to the nearest one's decides whether its list is read;
how large a ratio, is fitted on the sample by such walks, against brute force there. Lists and the queries on them meet in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import read, stage
from folioforge.llm.vectors import USABLE_SQL, matrix, usable

#: At most so many sampled vectors (and bytes of them) are fitted on, and so many lists made of them.
SAMPLE, SAMPLE_BYTES, MOST_LISTS = 16_384, 32 << 20, 512
#: Vectors of a list to aim at, while MOST_LISTS allows.
LIST = 400
#: A vector goes to further lists whose centroid is at most so much farther, at most so many.
COPY_RATIO, COPIES = 1.06, 3
#: A query reads the lists up to a ratio of distances too: the least one here with which AUDIT queries of the sample reach RECALL.
READ_RATIOS, AUDIT, RECALL = tuple(1 + 0.02 * k for k in range(1, 60)), 256, 0.96
#: Centroid graph: neighbours of a node, and the least number of centroids that a search keeps.
DEGREE, BEAM = 24, 64
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
NEAREST = 10


@dataclass
class Lists:
    centroids: np.ndarray
    graph: list[np.ndarray]
    entry: int
    ratio: float = READ_RATIOS[-1]


def balanced_leaves(x: np.ndarray, leaves: int, seed: int = 3) -> np.ndarray:
    """Centroids of leaves equal parts: the largest part is split at the median of its projection on a two-means axis."""
    rng = np.random.Generator(np.random.PCG64(seed))
    parts = [(-len(x), 0, np.arange(len(x)))]
    serial = 1
    while len(parts) < leaves and -parts[0][0] >= 2:
        _, _, rows = heapq.heappop(parts)
        y = x[rows]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(4):
            near = ((y - a) ** 2).sum(1) < ((y - b) ** 2).sum(1)
            if near.any() and not near.all():
                a, b = y[near].mean(0), y[~near].mean(0)
        order = np.argsort(y @ (a - b), kind="stable")
        for half in (rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]):
            heapq.heappush(parts, (-len(half), serial, half))
            serial += 1
    return np.stack([x[rows].mean(0) for _, _, rows in sorted(parts, key=lambda p: p[1])])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def navigable(c: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each of the different centroids: the DEGREE nearest, edges that lead nearer to every other one, and all of these reversed.

    A centroid needs no edge to another if one of its edges ends nearer to that, so walks get from anywhere to anywhere.
    """
    d = squared(c, c)
    np.fill_diagonal(d, np.inf)
    linked = np.zeros(d.shape, bool)
    for p, order in enumerate(np.argsort(d, axis=1, kind="stable")[:, :-1]):
        linked[p, order[:DEGREE]] = True
        led = (d[order[:DEGREE]] < d[p]).any(0)
        led[order[:DEGREE]] = True
        for t in order[DEGREE:]:
            if not led[t]:
                linked[p, t] = led[t] = True
                led |= d[t] < d[p]
    return [np.flatnonzero(r) for r in linked | linked.T]


def build(sample: np.ndarray, rows: int) -> Lists:
    leaves = int(min(MOST_LISTS, max(1, rows // LIST), max(1, len(sample) // 8)))
    c = np.unique(balanced_leaves(sample, leaves), axis=0)
    lists = Lists(c, navigable(c), int(squared(c, c.mean(0)[None])[:, 0].argmin()))
    lists.ratio = calibrated(lists, sample)
    return lists


def posted(centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every posting of the vectors."""
    d = np.sqrt(squared(x, centroids))
    near = np.argsort(d, axis=1, kind="stable")[:, : min(COPIES, d.shape[1])]
    far = np.take_along_axis(d, near, 1)
    row, col = np.nonzero(far <= np.maximum(COPY_RATIO * far[:, :1], 1e-12))
    return row, near[row, col]


def calibrated(lists: Lists, sample: np.ndarray) -> float:
    """The least read ratio with which some of the sample find RECALL of their nearest others in it by search(), against brute force.

    Where none of READ_RATIOS is enough, all lists are read.
    """
    queries = np.linspace(0, len(sample) - 1, min(AUDIT, len(sample))).astype(int)
    parts = [(a, *posted(lists.centroids, sample[a : a + 2048])) for a in range(0, len(sample), 2048)]
    row, of = np.concatenate([r + a for a, r, _ in parts]), np.concatenate([k for _, _, k in parts])
    order = np.argsort(row, kind="stable")
    of, bounds = of[order], np.searchsorted(row[order], np.arange(len(sample) + 1))
    needed, wanted = [], []
    for q in queries:
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(NEAREST, len(sample) - 1)]
        c = np.sqrt(((lists.centroids - sample[q]) ** 2).sum(1))
        c = c / max(c.min(), 1e-12)
        wanted.append([of[bounds[n] : bounds[n + 1]] for n in near])
        needed.extend(c[w].min() for w in wanted[-1])
    if not needed:
        return READ_RATIOS[-1]

    def recall(ratio: float) -> float:
        hits = 0
        for q, lists_of in zip(queries, wanted):
            found = set(search(lists, sample[q], ratio))
            hits += sum(not found.isdisjoint(w.tolist()) for w in lists_of)
        return hits / len(needed)

    # What a ratio holds at best is cheap to tell, so walks begin with the first that may be enough.
    return next((r for r in READ_RATIOS if (np.array(needed) <= r).mean() >= RECALL and recall(r) >= RECALL), float("inf"))


def search(lists: Lists, q: np.ndarray, ratio: float | None = None, beam: int = BEAM) -> list[int]:
    """Centroids within ratio times the nearest distance, by best-first search over the graph.

    A node is expanded if it is within the ratio of the best so far, or among the beam nearest met.
    """
    ratio = ratio or lists.ratio
    met = np.zeros(len(lists.centroids), bool)
    dist: dict[int, float] = {}

    def visit(nodes: np.ndarray) -> None:
        fresh = nodes[~met[nodes]]
        met[fresh] = True
        for k, v in zip(fresh.tolist(), np.sqrt(((lists.centroids[fresh] - q) ** 2).sum(1)).tolist()):
            dist[k] = v
            heapq.heappush(todo, (v, k))
            heapq.heappush(kept, -v)
            if len(kept) > beam:
                heapq.heappop(kept)

    todo: list[tuple[float, int]] = []
    kept: list[float] = []
    visit(np.array([lists.entry]))
    best = dist[lists.entry]
    while todo:
        v, k = heapq.heappop(todo)
        best = min(best, v)
        if v > ratio * best and v > -kept[0]:
            break
        visit(lists.graph[k])
    best = min(dist.values())
    return [k for k, v in dist.items() if ratio == float("inf") or v <= max(ratio * best, 1e-12)]


def enough(lists: Lists, q: np.ndarray, found: list[int], ids: dict[int, int], k: int) -> list[int]:
    """found, and while their lists may have fewer than k ids besides the query's own, the next nearest lists too."""
    have = sum(max(ids.get(f, 0) - 1, 0) for f in found)
    if have < k:
        met = set(found)
        for c in np.argsort(((lists.centroids - q) ** 2).sum(1), kind="stable").tolist():
            if have >= k:
                break
            if c not in met:
                found = [*found, c]
                have += max(ids.get(c, 0) - 1, 0)
    return found


def sample_of(rows: DataFrame) -> np.ndarray:
    """At most SAMPLE vectors, those whose ids hash lowest."""
    width = rows.select(F.size("v").alias("d")).first()
    n = min(SAMPLE, SAMPLE_BYTES // (8 * width.d)) if width else 0
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(n, 1)).select("v").toArrow()
    return matrix(got.column("v"))


def nearest(table: DataFrame, k: int = NEAREST, every: int = 100, ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors whose id is divisible by every, against all others.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Which vectors take part,
    see usable(). Of repeated rows each is a candidate, but a row's own id never; fewer than k candidates
    only where the table has no more. Columns other than vec_id and embedding are not looked at; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows = stage(usable(table), "vectors")
    sample = sample_of(rows)
    out = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    lists = spark.sparkContext.broadcast(build(sample, rows.count()))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = lists.value.centroids
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, of = posted(c, matrix(part.column("v")))
                first = np.append(True, row[1:] != row[:-1])  # each vector's nearest list
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(first), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "first", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            found = [enough(lists.value, q, search(lists.value, q, ratio), ids, k) for q in x]
            row = np.repeat(np.arange(len(x)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for f in found for k in f], pa.int32()), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["list", "query_id", "q"])

    posts = stage(rows.mapInArrow(post, "list int, first boolean, vec_id long, v array<double>"), "posts")
    # Counts per list: at most MOST_LISTS rows. An id counts in the lists that are its vectors' nearest.
    held = {r.list: r.n for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect()}
    ids = {r.list: r.n for r in posts.where("first").select("list", "vec_id").distinct().groupBy("list").agg(F.count("*").alias("n")).collect()}
    asks = stage(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).mapInArrow(ask, "list int, query_id long, q array<double>"), "asks")
    asked = {r.list: r.n for r in asks.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(i, -(-n // BLOCK_VECTORS), -(-asked[i] // BLOCK_QUERIES)) for i, n in held.items() if i in asked], "list int, vb int, qb int"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posts.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), "vb").cast("int").alias("i"), to("qb").alias("j"), "vec_id", "v")
    right = asks.join(blocks, "list").select("list", to("vb").alias("i"), F.pmod(F.xxhash64("query_id"), "qb").cast("int").alias("j"), "query_id", "q")

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.stack(vectors.v.to_numpy()), vectors.vec_id.to_numpy()
        q, own = np.stack(queries.q.to_numpy()), queries.query_id.to_numpy()
        got = []
        for a in range(0, len(q), 128):
            d = squared(q[a : a + 128], x)
            d[own[a : a + 128, None] == ids[None]] = np.inf
            m = min(k, d.shape[1])
            edge = np.partition(d, m - 1, axis=1)[:, m - 1]
            for r in range(len(d)):
                # All that may be among the nearest k, with slack for rounding, then exact distances.
                near = np.flatnonzero((d[r] <= edge[r] + 1e-9 * (1 + edge[r])) & np.isfinite(d[r]))
                # Summed from the first component to the last, as SQL engines do.
                exact = np.sqrt(np.add.accumulate((x[near] - q[a + r]) ** 2, axis=1)[:, -1])
                best = np.lexsort((ids[near], exact))[:k]
                got.append(pd.DataFrame({"query_id": own[a + r], "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(got)

    found = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(meet, "query_id long, vec_id long, score double")
    # Copies of a vector in several lists are one candidate; of one list's vectors only the best k were returned.
    # In two steps, so that what very many blocks found for a query is cut down on the way.
    first = lambda df, *keys: df.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("near"))
    some = first(found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))), "query_id", "salt")
    best = first(some.select("query_id", F.explode("near").alias("n")).select("query_id", "n.*"), "query_id")
    return best.select("query_id", F.posexplode("near").alias("pos", "n")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
#: All pairs; the approximate search agrees where it reads all lists, as it does in small tables.
ORACLE = {"op6_nearest_neighbours": f"""
    WITH {USABLE_SQL}, q AS (SELECT DISTINCT ON (vec_id) vec_id, v FROM u WHERE vec_id % 100 = 0),
    n AS (SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, u.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM q JOIN u ON q.vec_id <> u.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM n QUALIFY rank <= {NEAREST}"""}
