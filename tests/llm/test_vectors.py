import numpy as np
import pytest

from folioforge.llm import neardedup, neighbours

NAN, INF = float("nan"), float("inf")
ODD = [(1, None), (2, []), (3, [0.0] * 8), (4, [NAN] + [1.0] * 7), (5, [INF] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, [1.0, 2.0]), (None, [1.0] * 8)]


@pytest.fixture
def table(spark):
    def make(x, extra=(), first=100):
        rows = [(first + k, [float(np.float32(v)) for v in r], 0) for k, r in enumerate(x)]
        return spark.createDataFrame(rows + [(k, v, 0) for k, v in extra], "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "node")

    return make


def groups(seed=0, d=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((220, d))
    near = [x[3] + 0.05 * rng.standard_normal(d) for _ in range(25)] + [x[9] + 0.01 * rng.standard_normal(d) for _ in range(4)]
    return np.concatenate([x, near, x[5:6], x[5:6]]).astype(np.float32)


def test_links_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(neardedup, "BLOCK", 8)
    x = groups().astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    root = np.arange(len(x))
    while True:
        low = np.array([root[linked[k]].min() for k in range(len(x))])
        if (low == root).all():
            break
        root = low
    found = neardedup.near_duplicates(table(groups(), ODD)).collect()
    own = {r.vec_id: r for r in found if r.vec_id is not None and r.vec_id >= 100}
    assert len(found) == len(x) + len(ODD)
    for k in range(len(x)):
        r = own[100 + k]
        assert (r.n_links, r.component_id, r.kept) == (linked[k].sum() - 1, 100 + root[k], root[k] == k)
    for r in found:
        if r.vec_id is None or r.vec_id < 100:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (r.vec_id is not None)


def test_near_dedup_small_tables(table):
    assert neardedup.near_duplicates(table([])).count() == 0
    assert [tuple(r) for r in neardedup.near_duplicates(table([[1.0, 0.0]])).collect()] == [(100, 0, 100, True)]
    assert sorted(tuple(r) for r in neardedup.near_duplicates(table([[1.0, 0.0], [1.0, 0.0]])).collect()) == [(100, 1, 100, True), (101, 1, 100, False)]


def exact(x, ids, every=100, k=10):
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[int(q)] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out


def test_search_recall_and_exact_scores(table, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 40)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32).astype(np.float64)
    x[50:80] = x[50]  # ties
    ids = np.arange(100, 1000)
    want = exact(x, ids)
    rows = neighbours.nearest(table(x, ODD)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and [r["rank"] for r in rows if r.query_id == 100] and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, near in got.items():
        for i, s in near:
            assert s == pytest.approx(np.sqrt(((x[i - 100] - x[q - 100]) ** 2).sum()), abs=1e-12)
        assert near == sorted(near, key=lambda t: (t[1], t[0]))


def test_search_small_tables(table):
    assert neighbours.nearest(table([])).count() == 0
    assert neighbours.nearest(table([[1.0, 0.0]])).count() == 0
    assert [tuple(r) for r in neighbours.nearest(table([[1.0, 0.0], [0.0, 0.0], [1.0, 1.0]])).collect()] == [(100, 1, 102, 1.0)]


def test_leaves_are_balanced():
    x = np.random.default_rng(2).standard_normal((640, 4))
    assert len(neighbours.balanced_leaves(x, 16)) == 16


def test_walks_reach_every_cluster_of_many_lists(monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 20)
    rng = np.random.default_rng(4)
    # Three clusters and a group of copies, each of which would fill more than DEGREE lists.
    x = np.concatenate([100 * rng.standard_normal(16) + rng.standard_normal((800, 16)) for _ in range(3)] + [np.full((800, 16), 300.0)])
    lists = neighbours.build(x, len(x))
    assert len(lists.centroids) > 3 * 25 and len(np.unique(lists.centroids, axis=0)) == len(lists.centroids)
    for q in x[::50]:
        d = np.sqrt(((lists.centroids - q) ** 2).sum(1))
        assert int(d.argmin()) in neighbours.search(lists, q)
    assert set(neighbours.search(lists, x[0], float("inf"))) == set(range(len(lists.centroids)))


def test_all_candidates_are_found_across_lists(table, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 8)
    # Tiny far apart groups: a query's own list has fewer than k others.
    x = np.repeat(1000.0 * np.eye(8), 8, axis=0) + np.random.default_rng(5).standard_normal((64, 8))
    got = neighbours.nearest(table(x), every=1, ratio=1.02).groupBy("query_id").count().collect()
    assert len(got) == 64 and all(r["count"] == 10 for r in got)


@pytest.mark.parametrize("parts", [3, 50])
def test_tight_parts_of_a_group_are_linked(table, parts):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    mids = centre / np.linalg.norm(centre) + 0.02 * rng.standard_normal((parts, 32))
    x = (mids[:, None] + 1e-4 * rng.standard_normal((parts, 20, 32))).reshape(-1, 32).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (u @ u.T >= 0.95).all()
    found = neardedup.near_duplicates(table(x)).collect()
    assert {r.component_id for r in found} == {100} and {r.n_links for r in found} == {len(x) - 1}


def test_audit_sees_missed_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal(16) + 1e-3 * rng.standard_normal((600, 16)), np.repeat(rng.standard_normal((40, 16)), 2, axis=0) + 1e-3 * rng.standard_normal((80, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "node long, x array<double>")
    groups = spark.createDataFrame([(k, 0) for k in range(600)], "node long, root long")
    assert neardedup.audit(groups, nodes, 0.95) < neardedup.RECALL
    whole = groups.unionAll(spark.createDataFrame([(k, k - k % 2) for k in range(600, 680)], "node long, root long"))
    assert neardedup.audit(whole, nodes, 0.95) == 1


def test_graph_that_never_passes_is_not_used(table, monkeypatch):
    monkeypatch.setattr(neardedup, "MOST_ROUNDS", 2)
    monkeypatch.setattr(neardedup, "improved", lambda graph, *a: graph.where("node < 0"))
    x = np.repeat(np.eye(6), 2, axis=0) + 1e-3 * np.random.default_rng(8).standard_normal((12, 6))
    monkeypatch.setattr(neardedup, "discard", lambda df: None)
    found = neardedup.near_duplicates(table(x)).collect()
    assert {r.n_links for r in found} == {1} and sum(r.kept for r in found) == 6
