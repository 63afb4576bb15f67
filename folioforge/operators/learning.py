
from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


def collected(readings: DataFrame) -> DataFrame:
    """[D9] Samples from readings (id, language, raw_ocr): unverified, at half weight."""
    return readings.where("raw_ocr IS NOT NULL AND raw_ocr <> ''").select(
        "id", F.coalesce("language", F.lit("hi")).alias("language"), "raw_ocr", F.col("raw_ocr").alias("corrected_text"),
        F.lit("auto_collect").alias("source"), F.lit(False).alias("verified"), F.lit(0.5).alias("weight"))


def upsert_verified(samples: DataFrame, verified: DataFrame) -> DataFrame:
    """[J5] Samples with verified ones (id, language, verified_text) put over them; unknown ids become new samples."""
    both = samples.alias("s").join(verified.select("id", F.col("language").alias("new_language"), "verified_text").alias("v"), "id", "full_outer")
    now = F.col("verified_text").isNotNull()
    return both.select(
        "id", F.coalesce("new_language", "language", F.lit("hi")).alias("language"), F.coalesce("raw_ocr", F.lit("")).alias("raw_ocr"),
        F.coalesce("verified_text", "corrected_text").alias("corrected_text"), F.when(now, "human_verified").otherwise(F.col("source")).alias("source"),
        F.coalesce(F.when(now, F.lit(True)), "verified").alias("verified"), F.coalesce(F.when(now, F.lit(1.0)), "weight").alias("weight"))


def sample_stats(samples: DataFrame) -> DataFrame:
    """[A1, A2] Per language and over all (null): samples, verified ones, the rest."""
    return samples.rollup("language").agg(F.count("*").alias("total"), F.count_if("verified").alias("verified")).withColumn("auto_collected", F.col("total") - F.col("verified"))


def export_samples(samples: DataFrame, language: str, verified_only: bool, most: int) -> DataFrame:
    """[K1, O5, N4] The first samples of a language by id, as the fields and the JSON line that training takes: filtered, then limited."""
    kept = samples.where((F.col("language") == language) & (F.col("verified") | F.lit(not verified_only)))
    row = F.struct("raw_ocr", F.col("corrected_text").alias("target_text"), "language", "verified", "weight")
    return kept.orderBy("id").limit(most).select("id", F.to_json(row).alias("json"))


def pair_counts(corrections: DataFrame) -> DataFrame:
    """[A3] How often each correction (original, corrected) was made."""
    return corrections.where("original <> '' AND corrected <> ''").groupBy("original", "corrected").agg(F.count("*").alias("n"))


def ranked_pairs(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """[O1, O2] Most frequent first, ties by the pair; all, or the top few."""
    ordered = pairs.orderBy(F.desc("n"), "original", "corrected")
    return ordered.limit(most) if most else ordered


def replay(texts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Texts (doc_id, text) after the rules in order, each a literal replacement that sees what earlier ones made.

    The rules are few and come from ranked_pairs(); they are folded inside one expression per row.
    """
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules if a and b and a != b))
    out = F.aggregate(table, F.col("text"), lambda s, r: F.replace(s, r["a"], r["b"])) if rules else F.col("text")
    return texts.select("doc_id", out.alias("corrected"), (out != F.col("text")).alias("changed"))


def token_agreement(pairs: DataFrame) -> DataFrame:
    """[J9] Per id of (id, a, b): shared tokens, counted as often as both have them, over the larger token number."""
    def bag(side: str) -> DataFrame:
        plain = F.regexp_replace(F.col(side), r"[|()\[\]{}.,;:!?/\\]+", " ")
        return pairs.select("id", F.explode(F.filter(F.split(F.trim(plain), r"\s+"), lambda t: t != "")).alias("token")).groupBy("id", "token").agg(F.count("*").alias(f"n_{side}"))

    both = bag("a").join(bag("b"), ["id", "token"], "full_outer")
    summed = both.groupBy("id").agg(F.coalesce(F.sum(F.least("n_a", "n_b").cast("long") * (F.col("n_a").isNotNull() & F.col("n_b").isNotNull()).cast("int")), F.lit(0)).alias("shared"), F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))
    return pairs.select("id").join(summed, "id", "left").select("id", F.coalesce(F.when((F.col("a") > 0) & (F.col("b") > 0), F.round(F.col("shared") / F.greatest("a", "b"), 6)), F.lit(0.0)).alias("agreement"))


def word_accuracy(text: Column, expected: Column) -> Column:
    """[F27, O7] Share of the distinct expected words that the text has, in percent."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.trim(t)), r"\s+"), lambda w: w != ""))
    return F.round(F.size(F.array_intersect(words(text), words(expected))) / F.greatest(F.size(words(expected)), F.lit(1)) * 100, 2)


@arrow_udf(DoubleType())
def sequence_similarity(texts: pa.Array, expected: pa.Array) -> pa.Array:
    """[F27, N17] difflib's ratio in percent."""
    out = []
    for t, e in zip(texts.to_pylist(), expected.to_pylist()):
        out.append(None if t is None or e is None else round(difflib.SequenceMatcher(None, e.lower().strip(), t.lower().strip()).ratio() * 100, 2))
    return pa.array(out, pa.float64())


def accuracy_summary(history: DataFrame) -> DataFrame:
    """[A12, A14, N8] From (key, ord, accuracy): mean over all, mean of the last twenty, and the trend of the last ten against the ten before."""
    back = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ord")))
    mean = lambda lo, hi: F.avg(F.when(F.col("r").between(lo, hi), F.col("accuracy")))
    out = history.withColumn("r", back).groupBy("key").agg(
        F.count("*").alias("n"), F.round(F.avg("accuracy"), 2).alias("mean"), F.round(mean(1, 20), 2).alias("recent"), mean(1, 10).alias("new"), mean(11, 20).alias("old"))
    old = F.when(F.col("n") >= 20, F.col("old")).otherwise(F.col("new"))
    trend = F.when(F.col("n") < 10, "insufficient_data").when(F.col("new") > old + 2, "improving").when(F.col("new") < old - 2, "declining").otherwise("stable")
    return out.select("key", "n", "mean", "recent", trend.alias("trend"))


def language_counts(corrections: DataFrame) -> DataFrame:
    """[A13, N7] Corrections per language, unknown where there is none."""
    return corrections.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


def best_variant(variants: DataFrame) -> DataFrame:
    """[A15, N16] Per page of (page, ord, text, confidence) the reading with the best score, the earlier one on a tie.

    Half the confidence, the valid share times thirty, and up to twenty for length.
    """
    from folioforge.functions.text import valid_ratio

    score = F.col("confidence") * 0.5 + valid_ratio(F.col("text")) * 30 + F.least(F.length("text") / 10, F.lit(20.0))
    best = F.max_by(F.struct("ord", "text"), F.struct(F.round(score, 6), -F.col("ord")))
    return variants.groupBy("page").agg(best.alias("best"), F.max(F.round(score, 6)).alias("score")).select("page", F.col("best.ord").alias("ord"), "score")
