
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.lines import UP_TO_HERE, by_line, with_section

#: Instructions that ask for a blank, a truth value or a choice.
ASKS_BLANK = r"(?iu)खाली स्थान|रिक्त स्थान|ఖాళీ|கோடிட்ட|ಖಾಲಿ|ഒഴിഞ്ഞ|শূন্যস্থান|ਖਾਲੀ|خالی|\bfill\b[^\n]{0,90}\bblanks?\b|\bquestion\s+tags?\b"
ASKS_TRUTH = r"(?iu)\b(?:true\s*(?:or|/|and)?\s*false|yes\s*(?:or|/|and)?\s*no)\b|सही.*गलत|हाँ.*नहीं|అవును.*కాదు|ஆம்.*இல்லை|ಹೌದು.*ಇಲ್ಲ|അതെ.*അല്ല|হ্যাঁ.*না|ہاں.*نہیں"
ASKS_CHOICE = r"(?iu)\b(?:choose|tick|select)\b[^\n]{0,90}\b(?:correct|right|answer|option)\b|సరైన.*ఎంచుకో|சரியான.*தேர்ந்தெடு|ಸರಿಯಾದ.*ಆಯ್ಕೆ"
#: Patterns of places for a response, numbered items and headings.
RESPONSE = r"(?:_{2,}|\.{3,}|…|[─━—]{2,}|\(\s*\)|\[\s*\]|□|☐|\[\[(?:ANSWER_LINES|GRID|GRID_ROW|CHECKBOX|BOXED):?)"
NUMBERED = r"^\s*(?:\[\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW):\s*)?\p{Nd}+[.)।]\s*\S"
HEAD = r"(?i)^\s*(?:\[\[SECTION_ROW:\s*[^\n]*?(?:\|\||\]\])|[IVXLCDM]+[.)]\s+.+)"


def missing_responses(rows: DataFrame) -> DataFrame:
    """[P8, M14] Per document and section with two numbered items or more that asks for responses: how many items have a place for one; kept where none has, or, for truth and choice sections, where some lack it."""
    heading = F.col("line").rlike(HEAD)
    sec = F.sum(F.when(heading, 1).otherwise(0)).over(by_line().rowsBetween(*UP_TO_HERE))
    marked = rows.withColumn("sec", sec).withColumn("numbered", ~heading & F.col("line").rlike(NUMBERED))
    # A continuation line belongs to the item above it.
    item = F.sum(F.when(F.col("numbered"), 1).otherwise(0)).over(by_line("sec").rowsBetween(*UP_TO_HERE))
    items = marked.withColumn("item", item).groupBy("doc_id", "sec", "item").agg(
        F.max(F.when(heading, F.col("line"))).alias("head"), F.bool_or(~heading & F.col("line").rlike(RESPONSE)).alias("open"), F.bool_or("numbered").alias("numbered"))
    found = items.groupBy("doc_id", "sec").agg(F.max("head").alias("head"), F.count_if("numbered").alias("items"), F.count_if(F.col("numbered") & F.col("open")).alias("with_place"), F.bool_or("open").alias("any_place"))
    uneven = F.col("head").rlike(ASKS_TRUTH) | F.col("head").rlike(ASKS_CHOICE)
    asks = uneven | F.col("head").rlike(ASKS_BLANK)
    return found.where(asks & (F.col("items") >= 2) & (~F.col("any_place") | uneven & (F.col("with_place") > 0) & (F.col("with_place") < F.col("items")))).select("doc_id", "sec", "items", "with_place")


def page_confidence(pages: DataFrame) -> DataFrame:
    """[A5] Mean confidence per job of (job, page, confidence), four decimals."""
    return pages.groupBy("job").agg(F.count("*").alias("pages"), F.round(F.avg("confidence"), 4).alias("average"))


def merged_engines(readings: DataFrame) -> DataFrame:
    """[A16] Per line of (line, engine, text, confidence) the most confident text, raised by 0.03 for each other engine that agrees, 1 at most."""
    plain = F.lower(T.squeeze(F.col("text")))
    best = readings.withColumn("plain", plain).groupBy("line").agg(F.max_by(F.struct("text", "plain", "confidence"), F.struct("confidence", F.col("engine"))).alias("b"), F.collect_list("plain").alias("all"))
    agree = F.size(F.filter("all", lambda x: x == F.col("b.plain"))) - 1
    return best.select("line", F.col("b.text").alias("text"), F.round(F.least(F.lit(1.0), F.col("b.confidence") + 0.03 * agree), 6).alias("confidence"))


def identity(docs: DataFrame) -> DataFrame:
    """[M2] Class and subject that a paper names, in the scripts it may use."""
    klass = F.regexp_extract("text", r"(?iu)(?:\bclass|कक्षा|తరగతి|வகுப்பு|ತರಗತಿ|ക്ലാസ്)\s*[:：-]\s*([0-9०-९IVX]+)", 1)
    subject = F.regexp_extract("text", r"(?imu)(?:\bsub(?:ject)?\.?|विषय|విషయం|பாடம்|ವಿಷಯ|വിഷയം)\s*[:：]\s*([^\n|\]]+?)\s*(?:$|\||\])", 1)
    return docs.select("doc_id", F.nullif(klass, F.lit("")).alias("class"), F.nullif(F.trim(subject), F.lit("")).alias("subject"))


def section_heading(line: Column) -> Column:
    """[M5] ordinal, instruction and literal marks of a heading; null for other lines."""
    body = r"^\s*(?:\[\[SECTION_ROW:\s*)?([IVX]{1,6})[.)]\s+(.*?)(?:\s*\|\|\s*([^\]]*))?(?:\]\])?\s*$"
    inline = r"\s((?:[0-9०-९]+\s*[x×*]\s*[0-9०-९]+\s*=\s*[0-9०-९]+|[0-9०-९]+(?:[./½¼¾][0-9०-९]*)?)\s*(?:M|Marks?|अंक))$"
    cell, text = F.trim(F.regexp_extract(line, body, 3)), F.regexp_extract(line, body, 2)
    marks = F.when(cell != "", cell).otherwise(F.regexp_extract(text, inline, 1))
    return F.when(line.rlike(body), F.struct(T.section_ordinal(F.regexp_extract(line, body, 1)).alias("ordinal"), F.trim(F.regexp_replace(text, inline, "")).alias("instruction"), F.nullif(marks, F.lit("")).alias("marks")))


def text_layer_reliable(text: Column) -> Column:
    """[M6] False for private-use glyphs, replacement characters and marks that follow no letter."""
    return ~(text.rlike(r"[\x{E000}-\x{F8FF}\x{FFFD}]") | text.rlike(r"(?:^|\s)\p{M}{2,}"))


def automatic_format(docs: DataFrame) -> DataFrame:
    """[M7] science, humanities, worksheet or compact, from what headings ask for."""
    heads = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x: x.rlike(HEAD)))
    kind = (F.when(heads.rlike(r"(?i)diagram|experiment|label"), "science").when(heads.rlike(r"(?i)passage|essay|letter|paragraph"), "humanities")
            .when(heads.rlike(r"(?i)match|tick|fill|circle|colou?r"), "worksheet").otherwise("compact"))
    return docs.select("doc_id", kind.alias("format"))


def repair_antonyms(rows: DataFrame) -> DataFrame:
    """[M8] In sections on opposites, match rows as plain pairs without stray ticks; elsewhere lines stay."""
    pair = r"(?i)^\s*\[\[MATCH_ROW:\s*(.*?)\s*\|\|\s*(.*?)\]\]\s*$"
    flat = F.trim(F.regexp_replace(F.concat(F.regexp_extract("line", pair, 1), F.lit(" - "), F.regexp_extract("line", pair, 2)), "[✓✔☑]", ""))
    inside = F.col("section").rlike(r"(?iu)antonym|opposite|विलोम|విరుద్ధ")
    return with_section(rows).select("doc_id", "line_no", F.when(F.coalesce(inside, F.lit(False)) & F.col("line").rlike(pair), flat).otherwise(F.col("line")).alias("line"))


def join_brackets(rows: DataFrame) -> DataFrame:
    """[M9] A line that only holds an empty bracket joins the statement above it."""
    bracket = F.trim("line").rlike(r"^(?:\(\s*\)|\[\s*\])$")
    nxt = F.lead("line").over(by_line())
    joined = F.when(F.coalesce(F.trim(nxt).rlike(r"^(?:\(\s*\)|\[\s*\])$"), F.lit(False)) & ~bracket & (F.trim("line") != ""), F.concat("line", F.lit(" "), F.trim(nxt))).otherwise(F.col("line"))
    before = F.lag(F.trim("line")).over(by_line())
    return rows.withColumn("joined", joined).withColumn("gone", bracket & F.coalesce((before != "") & ~before.rlike(r"^(?:\(\s*\)|\[\s*\])$"), F.lit(False))).where("NOT gone").select("doc_id", "line_no", F.col("joined").alias("line"))


def captions_as_text(text: Column) -> Column:
    """[M11] Figures whose caption is a numbered question become that text; short labels stay figures."""
    return F.regexp_replace(text, r"(?i)\[\[FIGURE:\s*[0-9, ]+\|\s*([0-9०-९]+[.)]\s*[^\]|]{12,}?)\s*\]\]", "$1")


def picture_notes(rows: DataFrame) -> DataFrame:
    """[M12] Notes such as "duck pic" of one section as one row of pictures, unless the section has a real figure."""
    note = r"(?i)^\s*([A-Za-z]+)\s+pic(?:ture)?\s*$"
    held = with_section(rows).where("section IS NOT NULL").groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.when(F.col("line").rlike(note), F.struct("line_no", F.lower(F.regexp_extract("line", note, 1)).alias("name"))))).alias("notes"), F.bool_or(F.col("line").rlike(r"(?i)\[\[(?:SOURCE_)?FIGURE")).alias("real"))
    return held.where("size(notes) > 0 AND NOT real").select("doc_id", "section", F.concat(F.lit("[[PICTURE_ROW: "), F.array_join(F.transform("notes", lambda x: x["name"]), " || "), F.lit("]]")).alias("line"))


def renamed_media(text: Column, old: Column, new: Column) -> Column:
    """[M25] A media id renamed inside figure markers only; other text keeps it."""
    parts = F.split(text, r"(?=\[\[SOURCE_FIGURE)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("[[SOURCE_FIGURE"), F.concat(F.replace(F.substring_index(p, "]]", 1), old, new), F.substr(p, F.length(F.substring_index(p, "]]", 1)) + 1))).otherwise(p)), "")


def image_measures(images: DataFrame) -> DataFrame:
    """[F44, M19] brightness, contrast, sharpness, noise and ink of (id, width, height, pixels), grey bytes in rows.

    Images whose byte number doesn't fit their size give nulls.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, w, h, data in zip(*(batch.column(c).to_pylist() for c in ("id", "width", "height", "pixels"))):
                if not data or not w or not h or len(data) != w * h:
                    rows.append((k, None, None, None, None, None))
                    continue
                x = np.frombuffer(data, np.uint8).reshape(h, w).astype(np.float64)
                inner = x[1:-1, 1:-1]
                edge = 4 * inner - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:] if min(w, h) > 2 else np.zeros(1)
                smooth = (x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]) / 4 if min(w, h) > 2 else inner
                noise = float(np.median(np.abs(inner - smooth))) if min(w, h) > 2 else 0.0
                rows.append((k, float(x.mean()), float(x.std()), float(edge.var()), noise, float((x < 128).mean())))
            kinds = (pa.int64(), *[pa.float64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["id", "brightness", "contrast", "sharpness", "noise", "ink"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, "id long, brightness double, contrast double, sharpness double, noise double, ink double")


def checkpoints_kept(saved: DataFrame, now: Column, hours: int, budget: int) -> DataFrame:
    """[T11, D19] Of checkpoint pages (key, page, size, ts) the unexpired ones, earlier pages first, up to a byte budget per key."""
    total = F.sum("size").over(Window.partitionBy("key").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return saved.where(F.col("ts") + F.make_interval(hours=F.lit(hours)) > now).withColumn("total", total).where(F.col("total") <= budget).select("key", "page", "total")
