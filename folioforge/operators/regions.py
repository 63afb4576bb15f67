
from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import markers as M
from folioforge.operators.lines import UP_TO_HERE, by_line


def region_kind(line: Column) -> Column:
    """What a line is on the page, without grid modes; the first rule that fits decides."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike(r"(?i)^\[\[(?:GRID|GRID_ROW|TABLE_ROW)"), "grid").when(t.rlike(r"(?i)^\[\[MATCH_ROW"), "matching")
        .when(t.rlike(r"(?i)\b(?:school|vidyalaya|examination|assessment)\b") & (F.length(t) <= 90), "header")
        .when(t.rlike(r"(?i)^(?:name|class|roll|date|subject|time|marks)\b[^:]{0,20}:"), "field")
        .when(t.rlike(r"(?i)^(?:\[\[SECTION_ROW:|[IVX]{1,6}[.)]\s+\S)"), "section").when(t.rlike(T.MARKS) & (F.length(t) <= 20), "marks")
        .when(t.rlike(r"_{3,}|\(\s*\)"), "fill_blank").when(t.rlike(r"^\s*(?:[0-9०-९]+|[a-z])[.)]\s*\S"), "question").when(t.contains("||"), "two_column").otherwise("paragraph"))


def regions(rows: DataFrame) -> DataFrame:
    """[F23, D6] Neighbouring lines of one kind as a region: doc_id, region, kind, first_line, n_lines."""
    kind = rows.withColumn("kind", region_kind(F.col("line"))).where("kind <> 'blank'")
    starts = F.when(F.coalesce(F.lag("kind").over(by_line()) == F.col("kind"), F.lit(False)), 0).otherwise(1)
    placed = kind.withColumn("starts", starts).withColumn("region", F.sum("starts").over(by_line().rowsBetween(*UP_TO_HERE)))
    return placed.groupBy("doc_id", "region").agg(F.min("kind").alias("kind"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def scaled_bounds(spec: Column, width: int, height: int) -> Column:
    """[M16] x, y, w, h of 0..1000 as pixels of an image; null if they are no four whole numbers in bounds."""
    p = F.transform(F.split(spec, ","), lambda v: F.trim(v).try_cast("int"))
    x, y, w, h = (F.get(p, F.lit(k)) for k in range(4))
    fine = (F.size(p) == 4) & ~F.exists(p, lambda v: v.isNull()) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1000) & (y + h <= 1000)
    px = lambda v, n: F.round(v * n / 1000).cast("int")
    return F.when(fine, F.struct(px(x, width).alias("x"), px(y, height).alias("y"), px(w, width).alias("w"), px(h, height).alias("h")))


def exam_content(text: str) -> str:
    """[M3] Without banners and repeated administrative rows; another class begins a new paper."""
    out, seen, klass = [], set(), None
    for line in text.split("\n"):
        if re.match(r"\s*\[\[(?:SOURCE_)?BANNER:", line, re.I):
            continue
        m = re.match(r"\s*(?:class|कक्षा)\s*[:：-]\s*(\S+)", line, re.I)
        if m and klass is not None and m[1] != klass and out and out[-1] != "[[PAPER_BREAK]]":
            out.append("[[PAPER_BREAK]]")
            seen = set()
        klass = m[1] if m else klass
        if line.strip() == "[[PAPER_BREAK]]":
            seen = set()
        own = frozenset(M.field_labels(line)) if not re.match(r"\s*[0-9०-९]+[.)]", line) and re.search(r"[:：]", line) else frozenset()
        if own and "_" not in line:
            key = (own, re.sub(r"\s+", " ", line.strip().lower()))
            if key in seen:
                continue
            seen.add(key)
        out.append(line)
    return "\n".join(out)


def laid_out(text: str) -> str:
    """[M13] One answer rule per written question that has none, and numbers for unnumbered items of a section."""
    out, n, inside = [], 0, False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if M.ordinal(line):
            n, inside = 0, bool(re.search(r"answer|write|explain", line, re.I))
        m = re.match(r"\s*([0-9०-९]+)[.)]\s", line)
        n = n + 1 if m else n
        out.append(line)
        following = lines[i + 1] if i + 1 < len(lines) and not re.match(r"\s*[0-9०-९]+[.)]\s", lines[i + 1]) else ""
        if inside and m and not re.search(r"_{2,}|\[\[ANSWER_LINES|\(\s*\)", line + following):
            out.append("[[ANSWER_LINES: 1]]")
    return "\n".join(out)


def apply_edits(marked: str, edited: str, most: float = 0.5) -> str | None:
    """[M18] The text of a marked row after a person edited its plain form; null if too much changed or markers were pasted.

    Words keep their cell: each changed stretch goes to the cell in which it begins.
    """
    if "[[" in edited:
        return None
    cells = re.split(r"(\[\[[A-Z_-]+:\s*|\s*\|\|\s*|\]\])", marked)
    words: list[tuple[int, str]] = [(k, w) for k, c in enumerate(cells) if k % 2 == 0 for w in c.split()]
    new = edited.replace("|", " ").split()
    match = difflib.SequenceMatcher(None, [w for _, w in words], new, autojunk=False)
    if match.ratio() < 1 - most:
        return None
    kept: dict[int, list[str]] = {k: [] for k in range(0, len(cells), 2)}
    first = next((k for k, _ in words), 0)
    for tag, a, b, c, d in match.get_opcodes():
        if tag == "equal":
            for k, w in words[a:b]:
                kept[k].append(w)
        elif c < d:
            kept[words[a][0] if a < b else words[a - 1][0] if a else first].extend(new[c:d])
    return "".join(c if k % 2 else " ".join(kept[k]) if c.strip() or kept[k] else c for k, c in enumerate(cells))
