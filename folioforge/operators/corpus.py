
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_common(values: DataFrame, k: int) -> DataFrame:
    """[A8] The k most frequent values of each category of (category, value), ties by value."""
    counted = values.groupBy("category", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def weighted_histogram(spans: DataFrame) -> DataFrame:
    """[A9, A10] Characters, spans and share of bold ones per (file, size) of (file, size, bold, text)."""
    return spans.groupBy("file", "size").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("spans"), F.count_if("bold").alias("bold"))


def margins(spans: DataFrame) -> DataFrame:
    """[A11, W16] Per page of (page, y, x, x1): margins, and the upper median of the gaps between neighbouring lines."""
    line = spans.groupBy("page", F.round("y").alias("y")).agg(F.min("x").alias("x"), F.max("x1").alias("x1"))
    gap = F.lead("y").over(Window.partitionBy("page").orderBy("y")) - F.col("y")
    gaps = line.withColumn("gap", gap)
    return gaps.groupBy("page").agg(
        F.min("x").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n_lines"),
        F.get(F.array_sort(F.collect_list("gap")), (F.count("gap") / 2).cast("int")).alias("usual_gap"))


def reading_order(spans: DataFrame) -> DataFrame:
    """[O4] Spans of a page by rounded height, then from the left: adds ord."""
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy(F.round("y"), "x", "span")))


def natural_order(names: DataFrame) -> DataFrame:
    """[O3] Names of a group by their prefix and number: page_2 before page_10. Adds ord."""
    number = F.coalesce(F.nullif(F.regexp_extract("name", r"(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return names.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy(F.regexp_extract("name", r"^(\D*)", 1), number, "name")))


def missing_references(parts: DataFrame) -> DataFrame:
    """[O9] References (id, used) of a part that its definitions (defined) lack, per part."""
    return parts.select("id", F.array_sort(F.array_except("used", "defined")).alias("missing")).where(F.size("missing") > 0)


def block_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """[P27, J8] Numbers of blocks per (doc_id, kind) that differ between two renderings."""
    count = lambda df, n: df.groupBy("doc_id", "kind").agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), ["doc_id", "kind"], "full_outer").fillna(0, ["n_a", "n_b"])
    return both.where("n_a <> n_b")


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """[P27] Per document the first place at which the texts of two renderings (doc_id, ord, text) differ."""
    both = a.withColumnRenamed("text", "a").join(b.withColumnRenamed("text", "b"), ["doc_id", "ord"], "full_outer").where("NOT a <=> b")
    return both.groupBy("doc_id").agg(F.min("ord").alias("ord"), F.min_by("a", "ord").alias("a"), F.min_by("b", "ord").alias("b"))


def order_pages(pages: DataFrame) -> DataFrame:
    """[M1, O10] Pages (paper, arrival, number) by number; by arrival in papers where a number is missing or twice."""
    paper = Window.partitionBy("paper")
    sound = (F.count("number").over(paper) == F.count("*").over(paper)) & (F.size(F.collect_set("number").over(paper)) == F.count("*").over(paper))
    place = F.when(F.col("sound"), F.col("number")).otherwise(F.col("arrival"))
    flagged = pages.withColumn("sound", sound).withColumn("place", place)
    return flagged.withColumn("ord", F.row_number().over(Window.partitionBy("paper").orderBy("place", "arrival"))).drop("place")


def scale_boxes(boxes: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """[M26, M16] Boxes (page, box, x, y, w, h) of a page scaled alike into the margins."""
    page = Window.partitionBy("page")
    right, bottom = F.max(F.col("x") + F.col("w")).over(page), F.max(F.col("y") + F.col("h")).over(page)
    left, top = F.min("x").over(page), F.min("y").over(page)
    k = F.least((width - 2 * margin) / F.greatest(right - left, F.lit(1.0)), (height - 2 * margin) / F.greatest(bottom - top, F.lit(1.0)))
    moved = boxes.withColumns({"k": k, "left": left, "top": top})
    return moved.select("page", "box", *(F.round((F.col(c) - F.col(o)) * F.col("k") + margin, 3).alias(c) for c, o in (("x", "left"), ("y", "top"))), *(F.round(F.col(c) * F.col("k"), 3).alias(c) for c in "wh"))


#: Subjects by the words that name them.
SUBJECTS = {"బాతు": "duck", "చేప": "fish", "बत्तख": "duck", "मछली": "fish", "पतंग": "kite", "duck": "duck", "fish": "fish", "kite": "kite"}


def picture_subject(line: Column) -> Column:
    """[M23] The subject that an explicit placeholder names; null for other lines and words."""
    name = F.lower(F.trim(F.regexp_extract(line, r"(?i)\[\[PICTURE(?:_OPTION)?:\s*([^\]]+)\]\]", 1)))
    return F.create_map(*[F.lit(x) for p in SUBJECTS.items() for x in p])[name]


def picture_candidates(found: DataFrame, licences: list[str], least: int = 200, most: int = 24) -> DataFrame:
    """[M24, S16] Usable pictures (query, title, url, licence, mime, w, h), best first: https, allowed licence, image, large enough; title match, then outlines."""
    fine = found.where(F.col("url").startswith("https://") & F.col("licence").isin(licences) & F.col("mime").startswith("image/") & (F.least("w", "h") >= least))
    exact = F.lower("title") == F.lower("query")
    outline = F.lower("title").rlike("outline|line art|drawing")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(exact), F.desc(outline), "title", "url"))
    return fine.withColumn("rank", rank).where(F.col("rank") <= most)


def public_fields(results: DataFrame, hidden: list[str]) -> DataFrame:
    """[K7] Results without hidden columns."""
    return results.drop(*hidden)


def natural_format(kind: Column) -> Column:
    """[S1, S2] How a file is read, by its extension."""
    ext = F.lower(F.regexp_extract(kind, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext == "pdf", "pdf").when(ext.isin("docx", "pptx", "odt", "odp", "doc", "ppt"), "office").when(ext.isin("xlsx", "ods", "xls"), "sheet")
        .when(ext.isin("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), "image").when(ext.isin("txt", "md", "csv", "json", "html", "xml", "sql", "log", "yaml", "yml"), "text").otherwise("unknown"))
