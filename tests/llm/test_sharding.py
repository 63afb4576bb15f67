import zlib
from collections import Counter

from folioforge.llm import sharding


def test_shards_hold_every_row_once(docs, odd, prose):
    rows = odd + [(100 + k, prose(30, k)) for k in range(200)]
    found = sharding.external_shuffle(docs(rows), bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in found)
    per = Counter(r.shard for r in found)
    assert max(per.values()) - min(per.get(k, 0) for k in range(16)) <= 1
    for k, n in per.items():
        assert sorted(r.slot for r in found if r.shard == k) == list(range(n))


def test_deterministic_and_seeded(docs, prose):
    rows = [(k, prose(10, k)) for k in range(80)]
    place = lambda seed, parts: {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs(rows).repartition(parts), seed=seed).collect()}
    assert place(1, 1) == place(1, 5) != place(2, 1)


def test_order_is_shuffled(docs, prose):
    rows = [(k, prose(5, k)) for k in range(160)]
    order = [r.doc_id for r in sorted(sharding.external_shuffle(docs(rows)).collect(), key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:])) in range(55, 105)


def test_written_shards(spark, docs, prose, tmp_path):
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs([(k, prose(5, k)) for k in range(50)]), path, shards=4)
    back = spark.read.parquet(path)
    assert back.count() == 50 and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def test_equal_rows_scatter(docs, prose):
    text = prose(5, 1)
    scattered = sharding.scatter(docs([(None, text)] * 600 + [(1, "x")] * 3).repartition(3), 1, 32)
    per = Counter(r.bucket for r in scattered.collect())
    assert len(per) == 32 and max(per.values()) < 60
    found = sharding.external_shuffle(docs([(None, text)] * 600), bucket_bytes=500).collect()
    assert len(found) == 600 and len({(r.shard, r.slot) for r in found}) == 600


def test_empty(docs):
    assert sharding.external_shuffle(docs([])).count() == 0
