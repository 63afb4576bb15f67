"""Rules that hold at any size."""

import random

from pyspark.sql import functions as F

from folioforge.operators import findings as N
from folioforge.operators import lines as L


def test_layout_ties(spark):
    evidence = spark.createDataFrame([(1, "I. Do", 2, 0)], "doc_id long, section string, images int, widest int")
    rows = [(1, 1, "I. Do", "mcq", 2, 0), (1, 1, "I. Do", "table", 2, 2), (1, 1, "I. Do", "written", 2, 1), (1, 2, "I. Do", "other", 2, 3)]
    for order in (rows, rows[::-1]):
        proposals = spark.createDataFrame(order, "doc_id long, ord int, title string, kind string, columns int, place int")
        assert [r.kind for r in L.safe_layout(proposals, evidence).collect()] == ["table"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_near_values_by_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abक") for _ in range(n)) for n in [0, 1, 2, 3, *range(4, 32)] * 2]
    texts = set(base)
    for t in base:
        for _ in range(3):
            c = list(t)
            for _ in range(r.randint(1, 3)):
                k = r.randint(0, len(c))
                c[k : k + r.randint(0, 1)] = r.choice(["", "a", "b"])
            texts.add("".join(c))
    rows = [(d, t, k) for d in (1, 2) for k, t in enumerate(sorted(texts, key=lambda t: (hash(t) if d == 1 else 0, t)))] + [(None, "abcdefg", 1), (None, "abcdefh", 2), (1, None, 999)]
    found = N.similar_values(spark.createDataFrame(rows, "doc_id long, value string, line_no int"))
    at = {(d, t): k for d, t, k in rows}
    close = {(d, *sorted((a, b), key=lambda t: at[d, t])) for d in (1, 2) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= 2 and (e := edits(a, b)) <= 2 and e < min(len(a), len(b)) * 0.3}
    pairs = [tuple(x) for x in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == close


def test_values_meet_only_where_they_can_be_near(spark):
    values = spark.range(3000).select(F.lit(1).alias("doc_id"), F.format_string("account %d", F.col("id") * 7919).alias("value"), F.lit(1).alias("n"), F.col("id").alias("first_line")).withColumn("own", F.col("first_line"))
    assert N.candidates(values, ["doc_id"]).count() < 30_000  # of 4.5 million


def test_smart_fit_reads_blocks_once(spark):
    spark.sparkContext.setLogLevel("ERROR")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    big = [(1, k, "text", 1) for k in range(0, 38)] + [(1, 38, "blank", 1), (1, 39, "blank", 1), (1, 40, "text", 1), (1, 41, "blank", 1)]
    rows = [*big, *((2, k, ("text", "blank")[k % 2], 1) for k in range(80)), *((3, k, "blank", 1) for k in range(50)), (4, 0, "blank", 1), (4, 1, "text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, kind string, n_lines long").withColumn("kind", counted("kind"))
    found = sorted(map(tuple, L.smart_fit(df, 1).select("doc_id", "line_no", "kind").collect()))
    # 40 lines are left of the first; of the second, blanks go too; the third has nothing else; the fourth fits as it is.
    assert found == sorted([(1, k, "text") for k in range(38)] + [(1, 38, "blank"), (1, 40, "text")] + [(2, k, "text") for k in range(0, 80, 2)] + [(4, 0, "blank"), (4, 1, "text")])
    assert seen.value == len(rows)


def test_values_meet_without_the_driver(spark, tmp_path):
    spark.range(2000).select(F.lit(1).alias("doc_id"), F.format_string("account %d", F.col("id") * 7919).alias("value"), F.col("id").cast("int").alias("line_no")).write.parquet(f"{tmp_path}/values")
    values = spark.read.parquet(f"{tmp_path}/values")  # a few KB, far under the size that is broadcast
    for found in (N.similar_values(values), N.inconsistent_fields(values.withColumn("field", F.lit("name")))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
