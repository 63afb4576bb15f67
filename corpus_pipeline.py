"""A training corpus from documents: five stages, each over all that the one before it kept.

quality -> toxicity -> near duplicates -> repeated passages -> packing. The first four return the columns of
documents; the last returns the pieces of the packed sequences. SQL can't express the stages' models, so there is no
ORACLE_SQL: tests hold the near duplicates and the repeated passages against brute-force versions, the classifiers' stages
against the scores of their operators, and the packing against the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import chunkdedup, jaccardjoin, packing, quality, toxicity
from folioforge.llm.common import labelled_sample, read, stage

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier scores under its threshold. The model is fitted on the labels of sf_dir outside the held-out fold.

    Null text counts as empty; rows are judged each on its own, whatever their ids; an empty table gives no rows.
    """
    sample = labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", quality.MODULUS, quality.HELD_OUT, quality.SAMPLE)
    scored = quality.with_score(docs, quality.fit(sample), "_quality")
    return scored.where(F.col("_quality") >= quality.THRESHOLD).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity model scores at its threshold or above.

    Null text counts as empty; rows are judged each on its own, whatever their ids; an empty table gives no rows.
    """
    sample = labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", toxicity.MODULUS, toxicity.HELD_OUT, toxicity.SAMPLE)
    scored = toxicity.with_score(docs, toxicity.fit(sample), "_toxic")
    return scored.where(F.col("_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with columns c0, c1 ... and a number of their own, written once, so that numbers stay what they are."""
    return stage(docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id()), name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of the Jaccard join connect, one row.

    Rows are told apart by numbers of their own: ids that are null or repeat drop no row and keep no second one of a group. Null,
    empty and blank texts are groups of their own and stay; an empty table gives no rows; further columns, whatever their names, stay as they are.
    """
    rows = numbered(docs, "numbered")
    text = f"c{docs.columns.index('text')}"
    heads = jaccardjoin.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).where("doc_id = class_id").select(F.col("doc_id").alias("row"))
    return rows.join(heads, "row", "left_semi").drop("row").toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks out of the texts; n_chars follows the text, and texts with nothing left go.

    The first of equal chunks stays, by a number that each row gets, so rows with null or repeated ids take chunks from each other
    too. Null and empty texts stay; an empty table gives no rows; further columns, whatever their names, stay as they are.
    """
    rows = numbered(docs, "numbered")
    text, chars = (docs.columns.index(c) for c in ("text", "n_chars"))
    cut = chunkdedup.dedup_substrings(rows.withColumnsRenamed({"row": "doc_id", f"c{text}": "text"})).where("text IS NULL OR n_removed = 0 OR n_removed < n_bytes")
    own = [F.col("text") if k == text else F.length("text").cast("long") if k == chars else F.col(f"c{k}") for k in range(len(docs.columns))]
    return cut.select(*(c.alias(n) for c, n in zip(own, docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in the sequences; null and empty texts, repeated ids and long texts as pack_documents says."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
