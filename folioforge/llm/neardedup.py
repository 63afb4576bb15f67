"""Embedding near-dedup by NN-descent.

Equal vectors are one node from the start. A first neighbour graph comes from random-projection buckets. Then, again and
again, each node's neighbours and reverse neighbours meet in a local join, where neighbours of neighbours are
compared and the lists improve. Edges at the threshold are kept; what they connect is a group. Where such edges fill a
node's list, the list is too short for its links: such groups get lists of other groups' nodes only, and what those
link is joined, until nothing more is. An audit of a bounded sample of nodes against all vectors says whether another
round is needed. Groups are compared in blocks, in double precision, so that links are counted whole without writing out pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioforge.llm.common import discard, read, shuffle_width, stage
from folioforge.llm.graph import components
from folioforge.llm.jaccardjoin import spanning
from folioforge.llm.vectors import USABLE_SQL, matrix, usable

THRESHOLD = 0.95
#: Neighbours in a list, reverse neighbours that join them, and what a local join offers each member.
LIST, REVERSE, OFFER = 10, 10, 6
#: Random-projection tables, and the vectors of a bucket to aim at.
TABLES, BUCKET = 8, 48
LEAST_ROUNDS, MOST_ROUNDS = 2, 6
#: Nodes that the audit compares with all vectors, and the share of their links that must be in the graph.
AUDIT, RECALL = 256, 0.995
BLOCK = 1024
SEED = 5
#: Nodes of a full group that start its lists of other groups' nodes, on average, and rounds of these.
HEADS, APART_ROUNDS = 8, 2
GRAPH = "node long, nbr array<long>, sim array<float>"


def contracted(rows: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, v): the digest that equal vectors share."""

    @arrow_udf("struct<h1: bigint, h2: bigint>")
    def digest(vectors: pa.Array) -> pa.Array:
        x = matrix(vectors) + 0.0  # no negative zeros
        halves = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x), np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)], ["h1", "h2"])

    return rows.withColumn("d", digest("v")).select("vec_id", "d.h1", "d.h2", "v")


def buckets(nodes: DataFrame, count: int, width: int, turn: int = 0) -> DataFrame:
    """(t, code, fine, node): each node's code per table, the signs of random projections, and a finer projection."""
    bits = max(1, int(np.ceil(np.log2(max(2, count / BUCKET)))))
    planes = np.random.Generator(np.random.PCG64(SEED + turn)).standard_normal((width, TABLES * (bits + 1))).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            p = (x.astype(np.float32) @ planes).reshape(len(x), TABLES, bits + 1)
            code = ((p[:, :, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
            fine = p[:, :, bits]
            row = np.repeat(np.arange(len(x)), TABLES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TABLES), len(x)), pa.int32()), pa.array(code.ravel()), pa.array(fine.ravel(), pa.float32()), batch.column("node").take(pa.array(row))], ["t", "code", "fine", "node"])

    return nodes.select("node", "x").mapInArrow(run, "t int, code long, fine float, node long")


def top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[list, list]:
    """The k largest similarities, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -sims))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order].tolist(), sims[order].tolist()


def offers(groups: DataFrame, offer: int, own: str = "node") -> DataFrame:
    """From rows (members array<struct<node, x>>), to each member its nearest there with another own: (node, nbr, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            node, apart = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", own))
            x = matrix(flat.field("x")).astype(np.float32)
            off = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))])
            who, near, how = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                s[apart[a:b, None] == apart[None, a:b]] = -2
                k = min(offer, b - a - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                who.append(node[a:b])
                near.append([node[a + r] for r in best])
                how.append([s[r, c] for r, c in enumerate(best)])
            if who:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(who)), pa.array([r for g in near for r in g], pa.list_(pa.int64())), pa.array([r for g in how for r in g], pa.list_(pa.float32()))], ["node", "nbr", "sim"])

    return groups.select("members").mapInArrow(run, GRAPH)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Per node the k best of all its lists. In two steps, so that what very many joins offer one node is cut down on the way."""

    @arrow_udf("struct<nbr: array<bigint>, sim: array<float>>")
    def best(nbrs: pa.Array, sims: pa.Array) -> pa.Array:
        out = []
        for n, s in zip(nbrs.to_pylist(), sims.to_pylist()):
            ids, vals = np.concatenate([np.array(x, np.int64) for x in n]), np.concatenate([np.array(x, np.float32) for x in s])
            keep = vals > -1.5
            ids, vals = top(ids[keep], vals[keep], k)
            out.append({"nbr": ids, "sim": vals})
        return pa.array(out, pa.struct([("nbr", pa.list_(pa.int64())), ("sim", pa.list_(pa.float32()))]))

    def step(df: DataFrame, *keys) -> DataFrame:
        grouped = df.groupBy(*keys).agg(F.collect_list("nbr").alias("n"), F.collect_list("sim").alias("s"))
        return grouped.select("node", best("n", "s").alias("b")).select("node", "b.nbr", "b.sim")

    salted = lists.withColumn("salt", F.pmod(F.xxhash64("nbr"), F.lit(16)))
    return step(step(salted, "node", "salt"), "node")


def first_graph(nodes: DataFrame, count: int, width: int, k: int = LIST, turn: int = 0, own: str = "node") -> DataFrame:
    """Lists from random projections: in range order of code and finer projection, runs of BUCKET places compare, however many share a code."""
    keyed = stage(buckets(nodes, count, width, turn), "codes")
    order = ["t", "code", "fine", "node"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            t = batch.column("t").to_numpy()
            at = np.arange(serial, serial + batch.num_rows) // BUCKET
            serial += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at * TABLES + t), batch.column("node")], ["run", "node"])

    ranged = keyed.repartitionByRange(shuffle_width(nodes.sparkSession), *order).sortWithinPartitions(*order)
    placed = stage(ranged.select("t", "node").mapInArrow(runs, "run long, node long").withColumn("p", F.spark_partition_id()), "runs")
    fields = list(dict.fromkeys(["node", own, "x"]))
    groups = placed.join(nodes.select(*fields), "node").groupBy("p", "run").agg(F.collect_list(F.struct(*fields)).alias("members"))
    return merged(offers(groups, OFFER, own), k)


def improved(graph: DataFrame, nodes: DataFrame, turn: int, k: int = LIST, own: str = "node", inner: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of a node (in inner's lists too), and as many reverse neighbours as REVERSE on average, meet in a local join."""
    edges = graph.select("node", F.explode("nbr").alias("nbr"))
    if inner is not None:
        edges = edges.unionAll(inner.select("node", F.explode("nbr").alias("nbr")))
    indegree = edges.groupBy("nbr").agg(F.count("*").alias("n"))
    back = edges.join(indegree, "nbr").where(F.pmod(F.xxhash64("node", "nbr", F.lit(turn)), F.ceil(F.col("n") / REVERSE)) == 0).select(F.col("nbr").alias("at"), F.col("node").alias("member"))
    ahead = edges.select(F.col("node").alias("at"), F.col("nbr").alias("member"))
    selves = edges.select(F.col("node").alias("at"), F.col("node").alias("member"))
    meeting = ahead.unionAll(back).unionAll(selves).distinct()
    fields = list(dict.fromkeys(["node", own, "x"]))
    groups = meeting.join(nodes.select(*fields).withColumnRenamed("node", "member"), "member").groupBy("at").agg(
        F.collect_list(F.struct(*(F.col("member").alias("node") if f == "node" else F.col(f) for f in fields))).alias("members"))
    return merged(offers(groups, OFFER, own).unionAll(graph.select("node", "nbr", "sim")), k)


def edges_of(graph: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): the lists' entries at the threshold, with slack for single precision."""
    return graph.select("node", F.explode(F.arrays_zip("nbr", "sim")).alias("e")).where(F.col("e.sim") >= threshold - 1e-4).select(F.col("node").alias("src"), F.col("e.nbr").alias("dst"))


def joined_groups(graph: DataFrame, nodes: DataFrame, width: int, threshold: float, k: int, turn: int) -> DataFrame:
    """(node, root): what threshold edges connect, also across groups whose nodes' lists they fill.

    Of a link that no list holds both ends' lists are full, so both are in full groups. Those get lists of other groups'
    nodes only, from a few nodes of each group first, then from their neighbours in both kinds of lists; groups that
    a threshold edge joins are one from then on, until no edge leads out of a full group.
    """
    edges = stage(edges_of(graph, threshold), "links")
    groups = stage(components(edges), "groups")
    filled = stage(graph.where((F.size("nbr") >= k) & F.forall("sim", lambda v: v >= threshold - 1e-4)).select("node"), "full")
    again = 0
    while True:
        roots = groups.join(filled, "node").select("root").distinct()
        members = stage(groups.join(roots, "root").join(nodes.select("node", "x"), "node").select("node", "root", "x"), "members")
        sizes = members.groupBy("root").agg(F.count("*").alias("n"))
        if sizes.limit(2).count() < 2:
            return groups
        thin = F.pmod(F.xxhash64("node", F.lit(turn + 100 * again)), F.ceil(F.col("n") / HEADS)) == 0
        heads = stage(members.join(sizes, "root").where(thin | (F.col("node") == F.col("root"))).select("node", "root", "x"), "heads")
        across = stage(first_graph(heads, heads.count(), width, LIST, turn + 100 * (again + 1), "root"), "across")
        inner = graph.join(members.select("node"), "node", "left_semi").select("node", "nbr")
        for t in range(APART_ROUNDS):
            across = stage(improved(across, members, turn + t, LIST, "root", inner), "across")
        more = stage(edges_of(across, threshold), "links")
        if not more.limit(1).count():
            return groups
        edges = stage(edges.unionAll(more), "links")
        groups = stage(components(edges), "groups")
        again += 1


def linked_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other) from (grp, size, node, copies, x): whole counts within each group, and forest edges."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (
        members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        a, b = pdf[pdf.own == i], pdf[pdf.own == j]
        if a.empty or b.empty:
            return pd.DataFrame({"node": [], "links": [], "other": []})
        linked = np.stack(a.x.to_numpy()) @ np.stack(b.x.to_numpy()).T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        rows = [(int(n), int(c), None) for n, c in zip(a.node, linked @ b.copies.to_numpy()) if c]
        if i != j:
            rows += [(int(n), int(c), None) for n, c in zip(b.node, a.copies.to_numpy() @ linked) if c]
        rows += [(p, 0, q) for p, q in spanning(linked, a.node.to_numpy(), b.node.to_numpy() if i != j else None)]
        return pd.DataFrame(rows, columns=["node", "links", "other"]).astype({"other": "Int64"})

    return dealt.groupBy("grp", "i", "j").applyInPandas(run, "node long, links long, other long")


def audit(graph_groups: DataFrame, nodes: DataFrame, threshold: float) -> float:
    """The share of the nodes with threshold links whose links all lead into their own group, estimated against all vectors.

    Nodes without a group, in small and in large groups are sampled apart, AUDIT of each and four times as many without
    one, and count by their kinds' numbers: pairs weigh as much as two nodes of thousands of copies.
    """
    grouped = graph_groups.dropDuplicates(["node"])
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"))
    size = F.coalesce("size", F.lit(1))
    kinds = nodes.select("node", "x").join(grouped, "node", "left").join(sizes, "root", "left").select(
        "node", "x", F.coalesce("root", "node").alias("root"), F.when(size == 1, 0).when(size <= LIST, 1).otherwise(2).alias("kind"))
    number = {r.kind: r.n for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    tables = [kinds.where(F.col("kind") == k).orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(4 * AUDIT if k == 0 else AUDIT).toArrow() for k in sorted(number)]
    ids, roots, kind = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("node", "root", "kind"))
    x = np.concatenate([matrix(t.column("x")) for t in tables])
    shared = nodes.sparkSession.sparkContext.broadcast((ids, roots, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, of, own = shared.value
        linked, left = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                near = (own @ matrix(part.column("x")).T >= threshold) & (who[:, None] != part.column("node").to_numpy()[None])
                linked += near.sum(1)
                left += (near & (of[:, None] != part.column("root").to_numpy()[None])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(linked), pa.array(left)], ["node", "linked", "out"])

    counts = kinds.select("node", "root", "x").mapInArrow(run, "node long, linked long, out long").groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("out").alias("out")).collect()
    of_kind = dict(zip(ids.tolist(), kind.tolist()))
    weight = {k: number[k] / t.num_rows for k, t in zip(sorted(number), tables)}
    linked = sum(weight[of_kind[r.node]] for r in counts if r.linked)
    missed = sum(weight[of_kind[r.node]] for r in counts if r.out)
    return 1 - missed / linked if linked else 1.0


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    n_links counts the other rows with a cosine of at least threshold; component_id is the smallest vec_id that
    links reach; kept marks it. Which vectors take part, see usable(); the others have no links and are components
    of their own. Repeated rows are rows, linked with each other; a null id gives a null component that is not kept. Columns
    other than vec_id and embedding are not looked at; an empty table gives no rows.
    """
    rows = usable(table)
    keyed = stage(contracted(rows), "vectors")
    alike = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    heads = keyed.select("h1", "h2", F.col("vec_id").alias("node"), "v").join(alike, ["h1", "h2", "node"]).dropDuplicates(["h1", "h2"])
    # An id that stands for two different vectors can't name a node: the digest does, by rank of its own.
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    nodes = stage(heads.select("h1", "h2", F.col("node").alias("rep"), "copies", F.transform("v", lambda y: y / length).alias("x")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    first = nodes.select(F.size("x").alias("d")).first()
    count = nodes.count() if first else 0
    empty = table.sparkSession.createDataFrame([], "node long, root long")
    found = table.sparkSession.createDataFrame([], "node long, links long, other long")
    if count > 1:
        k = LIST
        graph = stage(first_graph(nodes, count, first.d), "graph")
        for turn in range(MOST_ROUNDS):
            if turn >= LEAST_ROUNDS:
                # The audit has failed: longer lists, and candidates from other projections.
                k += LIST
                graph = stage(merged(graph.unionAll(first_graph(nodes, count, first.d, k, turn)), k), "graph")
            nxt = stage(improved(graph, nodes, turn, k), "graph")
            discard(graph)
            graph = nxt
            if turn + 1 < LEAST_ROUNDS:
                continue
            groups = joined_groups(graph, nodes, first.d, threshold, k, turn)
            if audit(groups, nodes, threshold) >= RECALL:
                break
        else:
            # No graph has passed: all nodes are compared with all, in the same blocks.
            groups = nodes.select("node", F.lit(0).cast("long").alias("root"))
        sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
        members = groups.join(sizes, "root").join(nodes, "node").select(F.col("root").alias("grp"), "size", "node", "copies", "x")
        found = stage(linked_in_blocks(members, threshold), "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst"))) if count > 1 else empty
    rooted = nodes.select("node", "rep", "copies", "h1", "h2").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    part = keyed.select("vec_id", "h1", "h2").join(of, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = table.select("vec_id", "embedding").join(keyed.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return part.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
#: All pairs, and what links connect.
ORACLE = {"op10_embedding_near_dedup": f"""
    WITH RECURSIVE {USABLE_SQL}, r AS (SELECT row_number() OVER () AS r, vec_id, v FROM u),
    l AS (SELECT a.r AS a, b.r AS b FROM r a JOIN r b ON a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
    c AS (SELECT r AS a, r AS b FROM r UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
    k AS (SELECT c.a, min(r.vec_id) AS component_id FROM c JOIN r ON r.r = c.b GROUP BY c.a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.r) AS n_links, component_id, vec_id = component_id AS kept FROM r JOIN k ON k.a = r.r
    UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE vec_id IS NULL OR vec_id NOT IN (SELECT vec_id FROM u)"""}
