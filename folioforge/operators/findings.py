"""Inconsistent and near-equal values within documents.

Pairs are compared only inside a document (or a field of one), and only distinct values that share a key: texts within two edits
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T

#: The pattern of a field and its value.
FIELD = r"^([A-Za-z\x{0900}-\x{097F}\x{0C00}-\x{0C7F}\s./#()-]{1,30}?)\s*[:\-]\s*(.+)$"


def fields(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, field, value of lines such as "Name: Asha"."""
    line = F.trim("line")
    return rows.where(line.rlike(FIELD)).select(
        "doc_id", "line_no", F.trim(F.regexp_extract(line, FIELD, 1)).alias("field"), F.trim(F.regexp_extract(line, FIELD, 2)).alias("value"))


def value_counts(values: DataFrame) -> DataFrame:
    """[A4] n and the first line of each value of a field."""
    return values.groupBy("doc_id", "field", "value").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def near(a: Column, b: Column) -> Column:
    """Within two edits, and within three tenths of the shorter length."""
    d = F.levenshtein(a, b, 2)
    return (d >= 0) & (d < F.least(F.length(a), F.length(b)) * 0.3)


#: Values of up to so many characters are keyed by what is left of them without two characters, longer ones by thirds.
SHORT = 24


def edit_keys(value: Column) -> Column:
    """Keys of a value, of which any two values that are near have one in common.

    Up to SHORT + 2 characters: the value, and it without one character and (from seven on, as fewer allow one edit) without two. Values that two edits
    part have such a rest in common. From SHORT + 1 characters on: of three thirds of the longer value, one stands in the other too, two places off at most; each
    value gives its pieces at those places for its own length and the next two. Under four characters nothing is near: no keys.
    """
    n = F.length(value)
    without = lambda v, k: F.concat(F.substr(v, F.lit(1), k - 1), F.substr(v, k + 1))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: without(value, i))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: without(without(value, i), j))))
    rests = F.concat(F.array(value), one, F.when(n >= 7, two).otherwise(F.array().cast("array<string>")))

    def third(length: Column, k: int) -> Column:
        at, end = (F.floor(length * j / 3).cast("int") for j in (k, k + 1))
        return F.transform(F.sequence(F.greatest(at - 2, F.lit(0)), at + 2), lambda s: F.concat_ws("|", length, F.lit(k), F.substr(value, s + 1, end - at)))

    thirds = lambda length: F.concat(*(third(length, k) for k in range(3)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(
        F.when((n >= 4) & (n <= SHORT + 2), rests).otherwise(none),
        F.when(n > SHORT, F.concat(thirds(n), thirds(n + 1), thirds(n + 2))).otherwise(none)))


def candidates(values: DataFrame, keys: list[str]) -> DataFrame:
    """(x, y): numbers of the values (own) that share a key, each pair once. Numbers and keys are hashes: pairs are still to be compared."""
    spark = values.sparkSession
    # A value gives up to a few hundred keys, so few bytes of values are much work: dealt over all cores, whatever their size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    keyed = values.repartition(tasks, "own").select("own", F.explode(F.transform(edit_keys(F.col("value")), lambda k: F.xxhash64(*keys, k))).alias("key"))
    x, y = keyed.select(F.col("own").alias("x"), "key"), keyed.select(F.col("own").alias("y"), "key")
    # Values that happen to share a number are candidates as well.
    same = values.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select(F.col("own").alias("x"), F.col("own").alias("y"))
    # Sizes are estimated before keys are made, so the planner would send a side of hundreds of rows a value through the driver.
    return x.join(y.hint("merge"), "key").where("x < y").select("x", "y").distinct().unionAll(same)


def close_pairs(values: DataFrame, keys: list[str]) -> DataFrame:
    """[J2, J3] Pairs of distinct values (value, n, first_line) of the same keys that are near: first one first.

    Values meet by edit_keys, and what meets is compared whole. Null keys and values pair with nothing.
    """
    values = values.dropna(subset=[*keys, "value"]).withColumn("own", F.xxhash64(*keys, "value"))
    side = lambda own, c: values.select(F.col("own").alias(own), F.struct("first_line", "value", "n").alias(c), F.struct(*keys).alias(f"of_{c}"))
    met = candidates(values, keys).join(side("x", "l").hint("merge"), "x").join(side("y", "r").hint("merge"), "y").where("of_l = of_r AND (x < y OR l < r)")
    a, b = F.least("l", "r"), F.greatest("l", "r")
    return met.where((F.col("l.value") != F.col("r.value")) & near(F.col("l.value"), F.col("r.value"))).select(
        "of_l.*", a["value"].alias("a"), a["n"].alias("n_a"), a["first_line"].alias("at_a"), b["value"].alias("b"), b["n"].alias("n_b"), b["first_line"].alias("at_b"))


def inconsistent_fields(values: DataFrame) -> DataFrame:
    """[J2, N11] Near values within a field; suggestion is the more frequent one, null on a tie."""
    pairs = close_pairs(value_counts(values), ["doc_id", "field"])
    return pairs.select("doc_id", "field", "a", "b", F.when(F.col("n_a") > F.col("n_b"), F.col("a")).when(F.col("n_b") > F.col("n_a"), F.col("b")).alias("suggestion"))


def similar_values(values: DataFrame) -> DataFrame:
    """[J3] Near values anywhere in a document."""
    whole = values.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    return close_pairs(whole, ["doc_id"]).select("doc_id", "a", "b")


def year_confusions(docs: DataFrame) -> DataFrame:
    """[J4] Years of a document that differ in one digit, 1 against 7: a occurs first; n is how often such a pair occurs."""
    found = docs.select("doc_id", F.posexplode(T.years(F.col("text"))).alias("at", "year"))
    a, b = found.toDF("doc_id", "at_a", "a"), found.toDF("doc_id", "at_b", "b")
    # Three digits are shared: join on the year with one digit left out, so only candidates meet.
    hole = lambda y: F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(k.alias("k"), F.concat(F.substr(y, F.lit(1), k - 1), F.lit("_"), F.substr(y, k + 1)).alias("rest"), F.substr(y, k, F.lit(1)).alias("digit"))))
    left = a.withColumn("h", hole(F.col("a"))).select("doc_id", "at_a", "a", F.col("h.k").alias("k"), F.col("h.rest").alias("rest"), F.col("h.digit").alias("da"))
    right = b.withColumn("h", hole(F.col("b"))).select("doc_id", "at_b", "b", F.col("h.k").alias("k"), F.col("h.rest").alias("rest"), F.col("h.digit").alias("db"))
    pairs = left.join(right, ["doc_id", "k", "rest"]).where("at_a < at_b AND ((da = '1' AND db = '7') OR (da = '7' AND db = '1'))")
    return pairs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("n"))


def duplicate_of(docs: DataFrame) -> DataFrame:
    """[J7] For each document the first one with the same digest, null for that one itself.

    The first of each digest is found by an aggregate, which combines before the shuffle, and joined back, so a text that very many documents share can be split over tasks.
    """
    own = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return own.join(first, "digest").select("doc_id", "digest", F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("duplicate_of"))
