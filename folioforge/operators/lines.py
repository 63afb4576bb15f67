"""Line and block operators: ordered computations within a document, as windows over (doc_id, line_no).

Every window is partitioned by document, so documents run in parallel; a line number orders each. Codes in
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def by_line(*more: str):
    return Window.partitionBy("doc_id", *more).orderBy("line_no")


def lines(docs: DataFrame) -> DataFrame:
    """[D3] doc_id, line_no from 0, line. Null text has no lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line"))


#: Patterns of section headings.
SECTION_ROW = r"(?i)^\s*\[\[SECTION_ROW:\s*([^|\]]+?)(?:\s*\|\|[^\]]*)?\]\]\s*$"
SECTION_PLAIN = r"(?i)^\s*([IVX]{1,6})[.)]?\s+([^\n]{3,140})$"


def with_section(rows: DataFrame) -> DataFrame:
    """[W1] Adds section: the title of the last heading at or above the line."""
    title = F.when(F.col("line").rlike(SECTION_ROW), F.trim(F.regexp_extract("line", SECTION_ROW, 1))).when(
        F.col("line").rlike(SECTION_PLAIN), F.trim("line"))
    return rows.withColumn("title", title).withColumn("section", F.last("title", ignorenulls=True).over(by_line().rowsBetween(*UP_TO_HERE)))


def section_evidence(rows: DataFrame) -> DataFrame:
    """[A19, D7] Per document and section: order, images (100 at most) and the widest explicit row of images."""
    images = r"(?i)\[\[SOURCE_FIGURE(?:_ROW)?:\s*([^\]\n]+)\]\]"
    explicit = r"(?i)\[\[SOURCE_FIGURE_ROW:\s*([^\]\n]+)\]\]"
    sizes = lambda p: F.transform(T.all_of(F.col("line"), p, 1), lambda b: F.size(F.filter(F.split(b, r"\s*\|\|\s*"), lambda x: x != "")))
    counted = with_section(rows).where("section IS NOT NULL").withColumns({
        "n": F.aggregate(sizes(images), F.lit(0), lambda s, x: s + x), "w": F.coalesce(F.array_max(sizes(explicit)), F.lit(0))})
    return counted.groupBy("doc_id", "section").agg(
        F.min("line_no").alias("first_line"), F.least(F.lit(100), F.sum("n")).cast("int").alias("images"), F.max("w").alias("widest"))


#: Kinds that a layout proposal may name.
LAYOUT_KINDS = ["pictures", "matching", "mcq", "true_false", "fill_blanks", "translation", "written", "table", "other"]


def safe_layout(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """[P18, J1] Proposals (doc_id, ord, title, kind, columns) whose section exists: kind and columns held to the evidence, first per title.

    Of proposals with one ord the one with the largest place counts, where there is such a column.
    """
    first = Window.partitionBy("doc_id", "title").orderBy("ord", *(F.desc(c) for c in proposals.columns if c == "place"))
    kept = (
        proposals.where(F.col("kind").isin(LAYOUT_KINDS))
        .join(evidence.select("doc_id", F.col("section").alias("title"), "images", "widest"), ["doc_id", "title"])
        .withColumn("rn", F.row_number().over(first)).where("rn = 1"))
    columns = (
        F.when(F.col("images") == 0, 5).when(F.col("images") == 1, 1).when(F.col("widest") >= 2, F.least(F.lit(5), "widest"))
        .when(F.col("columns").isNotNull(), F.greatest(F.lit(2), F.least(F.lit(5), "images", "columns"))).otherwise(F.least(F.lit(5), "images")))
    kind = F.when((F.col("kind") == "pictures") & (F.col("images") == 0), "other").otherwise(F.col("kind"))
    return kept.select("doc_id", "title", kind.alias("kind"), columns.cast("int").alias("columns"))


def heading_number(line: Column) -> Column:
    """The number of a section heading; null for other lines."""
    label = F.regexp_extract(line, r"^\s*(?:\[\[SECTION_ROW:\s*)?([IVX]+)[.)]?\s+", 1)
    n = T.section_ordinal(F.nullif(label, F.lit("")))
    return F.when(n <= 15, n)


def sequence_findings(rows: DataFrame) -> DataFrame:
    """[W2] Headings that don't follow the one before by one: doc_id, line_no, line, number, previous."""
    heads = rows.select("doc_id", "line_no", "line", heading_number(F.col("line")).alias("number")).where("number IS NOT NULL")
    return heads.withColumn("previous", F.lag("number").over(by_line())).where("previous IS NOT NULL AND number <> previous + 1")


def out_of_order_sections(rows: DataFrame) -> DataFrame:
    """[W3] Headings below the one before; a class line starts anew."""
    epoch = F.sum(F.when(F.col("line").rlike(r"(?i)^\s*Class\s*[:：-]"), 1).otherwise(0)).over(by_line().rowsBetween(*UP_TO_HERE))
    heads = rows.withColumn("epoch", epoch).withColumn("number", heading_number(F.col("line"))).where("number IS NOT NULL")
    return heads.withColumn("previous", F.lag("number").over(by_line("epoch"))).where("number < previous").select("doc_id", "line_no", "number", "previous")


#: What each check says.
DETAILS = {
    "opening": "Opening Bit I was not found. Check the source PDF before printing.",
    "unclear": "Uncertain OCR characters must be checked against the source.",
    "picture": "A picture placeholder still needs a real illustration.",
    "wide": "Image row exceeds the five-column print grid.",
    "unnumbered": "No clearly numbered question items were detected. Compare with every source page.",
    "sequence": "Section sequence has a gap or duplicate. Recover omitted bits from the PDF; do not invent a question.",
    "marks": "Marks arithmetic differs from the printed total. Verify the source before changing marks.",
}
#: Categories of issues.
CATEGORIES = ["sections", "questions", "marks", "alignment", "images", "pages", "language", "ocr"]
ISSUES = "array<struct<severity: string, category: string, evidence: string, detail: string>>"


def _issue(category: str, evidence: Column, detail: str) -> Column:
    return F.struct(F.lit("review").alias("severity"), F.lit(category).alias("category"), evidence.alias("evidence"), F.lit(DETAILS[detail]).alias("detail"))


def _line_issues(text: Column) -> Column:
    """Of each line in order: a heading that doesn't follow the one before by one, and marks whose product is another."""
    marks = r"(\d+)\s*[x×]\s*(\d+)\s*=\s*(\d+)"

    def step(s: Column, line: Column) -> Column:
        number = heading_number(line)
        factor = lambda k: F.regexp_extract(line, marks, k).try_cast("decimal(18,0)")
        found = F.array_compact(F.array(
            F.when(number.isNotNull() & (number != s["previous"] + 1), _issue("sections", F.substring(line, 1, 140), "sequence")),
            F.when(line.rlike(marks) & (factor(1) * factor(2) != factor(3)), _issue("marks", F.regexp_extract(line, marks, 0), "marks"))))
        return F.struct(F.coalesce(number, s["previous"]).alias("previous"), F.concat(s["found"], found).alias("found"))

    start = F.struct(F.lit(None).cast("int").alias("previous"), F.array().cast(ISSUES).alias("found"))
    return F.aggregate(F.split(text, "\r?\n"), start, step)["found"]


def issues_of(text: Column, continuation: Column | bool = False, most: int = 20) -> Column:
    """[P16] The read-only checks before printing as an array, the first few; a continuation needs no opening section. One scan, without a shuffle."""
    text = F.coalesce(text, F.lit(""))
    goes_on = continuation if isinstance(continuation, Column) else F.lit(continuation)
    opened = text.rlike(r"(?i)\[\[SECTION_ROW:\s*I(?:[.)\s]|\s*\|\|)") | text.rlike(r"(?m)^\s*I[.)\s]+\S")
    figures = r"(?i)\[\[SOURCE_FIGURE(?:_ROW)?:\s*([^\]]+)\]\]"
    wide = F.filter(
        F.zip_with(T.all_of(text, figures, 0), T.all_of(text, figures, 1), lambda m, body: F.struct(m.alias("m"), F.size(F.filter(F.split(body, r"\s*\|\|\s*"), lambda x: x != "")).alias("n"))),
        lambda x: x["n"] > 5)
    whole = lambda when, *issue: F.array_compact(F.array(F.when(when, _issue(*issue))))
    found = F.concat(
        whole(~F.coalesce(goes_on, F.lit(False)) & ~opened, "sections", F.lit("Bit I"), "opening"),
        whole(text.rlike(r"(?i)\[unclear(?::[^\]\n]*)?\]|\x{FFFD}"), "ocr", F.lit("[unclear]"), "unclear"),
        whole(text.rlike(r"(?i)\[\[PICTURE(?:_ROW|_OPTION)?:"), "images", F.lit("[[PICTURE: …]]"), "picture"),
        F.transform(wide, lambda x: _issue("images", F.substring(x["m"], 1, 100), "wide")),
        whole(~text.rlike(r"(?im)^\s*(?:[0-9०-९]+[.)]|\[\[(?:QUESTION_ROW|MATCH_ROW|CHOICE_ROW|QA_ROW):)"), "questions", F.lit("Question numbering"), "unnumbered"),
        _line_issues(text))
    return F.slice(found, 1, most)


def _listed(docs: DataFrame, issues: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(issues).alias("ord", "x")).select("doc_id", (F.col("ord") + 1).alias("ord"), "x.*")


def print_issues(docs: DataFrame, most: int = 20) -> DataFrame:
    """[P16] doc_id, ord, severity, category, evidence, detail; docs may say in continuation which of them go on from another page."""
    return _listed(docs, issues_of(F.col("text"), F.col("continuation") if "continuation" in docs.columns else False, most))


def supported_of(issues: Column, text: Column, most: int = 10) -> Column:
    """[P17] Of the first 3 * most issues those whose evidence stands in the text and that say something, in their allowed form."""
    said = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    formed = F.transform(F.slice(issues, 1, 3 * most), lambda i: F.struct(
        F.when(i["severity"] == "critical", "critical").otherwise("review").alias("severity"),
        F.when(i["category"].isin(CATEGORIES), i["category"]).otherwise("alignment").alias("category"),
        said(i["evidence"], 140).alias("evidence"), said(i["detail"], 250).alias("detail")))
    return F.slice(F.filter(formed, lambda i: (i["evidence"] != "") & (i["detail"] != "") & F.coalesce(text, F.lit("")).contains(i["evidence"])), 1, most)


def supported_issues(proposed: DataFrame, most: int = 10) -> DataFrame:
    """[P17] The usable ones of each document's proposed issues (doc_id, text, issues)."""
    return _listed(proposed, supported_of(F.col("issues"), F.col("text"), most))


def reviewed(proposed: DataFrame, most: int = 18, most_proposed: int = 8) -> DataFrame:
    """[O6] The checks' issues of each document, then the usable proposed ones, most in all."""
    return _listed(proposed, F.slice(F.concat(issues_of(F.col("text")), supported_of(F.col("issues"), F.col("text"), most_proposed)), 1, most))


#: Patterns of the line kinds.
BLOCKS = {
    "pagebreak": r"(?i)^\[\[PAGEBREAK\]\]$", "picture": r"(?i)^\[\[PICTURE(?:_OPTION)?:\s*(.*?)\]\]$", "checkboxes": r"(?i)^\[\[CHECKBOX\]\]$",
    "option_row": r"(?i)^\[\[OPTION_ROW:\s*(.*?)\]\]$", "match_table": r"(?i)^\[\[MATCH_ROW:\s*(.*?)\s*\|\|\s*(.*?)\]\]$",
    "branch": r"(?i)^\[\[BRANCH_ROOT:\s*(.*?)\]\]$", "branch_item": r"(?i)^\[\[BRANCH_ITEM:\s*(.*?)\s*\|\|\s*(.*?)\]\]$", "branch_end": r"(?i)^\[\[BRANCH_END\]\]$",
}
#: The marks at the end of a heading.
HEADING_MARKS = r"(?s)\(?\s*\d+\s*[xX×*]\s*\d+.*$"
CLASS = r"(?i)\b(?:CLASS|STD|STANDARD|GRADE)\s*[-:.]?\s*([IVXLCDM\d]+)"
TITLE = r"(?i)(?:ASSESSMENT|EXAMINATION|EXAM|ANNUAL|HALF[- ]?YEARLY|SUMMATIVE|FORMATIVE|FA|SA)\b"
PART = r"(?i)^\s*(?:PART\s*[-:]?\s*[A-Z]|SECTION\s*[-:]?\s*[A-Z]|UNIT\s*[-:]?\s*\w+)\b.*$"
HEADING = r"^\s*(?:[IVXLCDM]+|[A-Z])[.)]?\s+\S.*$"
QUESTION = r"^\s*(?:\(?\d+\)?[.)]|\(?[a-z]\)|\(?[ivx]+\))\s+\S"


def line_kind(line: Column) -> Column:
    """The block type of a trimmed line, before neighbours are joined; the first rule that fits decides."""
    rule = lambda name: line.rlike(BLOCKS[name])
    plain = ~line.contains("____")
    return (
        F.when(line == "", "blank").when(rule("pagebreak"), "pagebreak")
        .when(line.rlike(CLASS) & (F.length(line) <= 80) & plain, "title").when(line.rlike(TITLE) & (F.length(line) <= 90) & plain, "title")
        .when(rule("branch"), "branch")
        .when(rule("picture"), "picture_grid").when(rule("checkboxes"), "checkboxes").when(rule("option_row"), "option_row").when(rule("match_table"), "match_table")
        .when((line.rlike(PART) | line.rlike(HEADING)) & ~line.rlike(QUESTION), "section").otherwise("text"))


def typed_lines(rows: DataFrame) -> DataFrame:
    """Lines with kind and opens: the lines from a branch's root to its end are of the branch; blanks between pictures are of the pictures' kind.

    opens: a branch begins here. All windows have one partitioning and order.
    """
    above = by_line().rowsBetween(Window.unboundedPreceding, -1)
    below = by_line().rowsBetween(1, Window.unboundedFollowing)
    typed = rows.withColumn("line", F.trim("line")).withColumn("own", line_kind(F.col("line")))
    root, end = F.when(F.col("own") == "branch", F.col("line_no")), F.when(F.col("line").rlike(BLOCKS["branch_end"]), F.col("line_no"))
    solid = F.when(F.col("own") != "blank", F.col("own"))
    around = typed.withColumns({
        "root": F.max(root).over(above), "end": F.coalesce(F.max(end).over(above), F.lit(-1)),
        "before": F.last(solid, ignorenulls=True).over(above), "after": F.first(solid, ignorenulls=True).over(below)})
    inside = F.coalesce(F.col("root") > F.col("end"), F.lit(False))
    gap = (F.col("own") == "blank") & (F.col("before") == "picture_grid") & (F.col("after") == "picture_grid")
    kind = F.when(inside, "branch").when(F.coalesce(gap, F.lit(False)), "picture_grid").otherwise(F.col("own"))
    return around.withColumns({"kind": kind, "opens": (F.col("own") == "branch") & ~inside}).drop("root", "end", "before", "after")


def heading_text(line: Column) -> Column:
    """A heading without its marks."""
    bare = F.regexp_replace(F.regexp_replace(line, HEADING_MARKS, ""), r"^[ .\t]+|[ .\t]+$", "")
    return F.regexp_replace(F.when(bare != "", bare).otherwise(line), r"\.+$", "")


def blocks(rows: DataFrame) -> DataFrame:
    """[W4, F22] doc_id, block, line_no, kind, n_lines, text, raw: neighbouring picture or match lines, and a branch, are one block (gaps and islands).

    n_lines counts the pictures, rows or items of a block; text is its first line, a heading without its marks, a branch's root; raw is the line as it was.
    """
    joined = F.col("kind").isin("picture_grid", "match_table", "branch") & ~F.col("opens")
    starts = F.when(joined & F.coalesce(F.lag("kind").over(by_line()) == F.col("kind"), F.lit(False)), 0).otherwise(1)
    numbered = typed_lines(rows).withColumn("starts", starts).withColumn("block", F.sum("starts").over(by_line().rowsBetween(*UP_TO_HERE)))
    counted = F.when(F.col("kind") == "branch", F.col("line").rlike(BLOCKS["branch_item"])).otherwise((F.col("kind") == "blank") | (F.col("own") != "blank"))
    raw = F.min_by("line", "line_no")
    grouped = numbered.groupBy("doc_id", "block").agg(F.min("line_no").alias("line_no"), F.min("kind").alias("kind"), F.count_if(counted).alias("n_lines"), raw.alias("raw"))
    text = F.when(F.col("kind") == "section", heading_text(F.col("raw"))).when(F.col("kind") == "branch", F.trim(F.regexp_extract("raw", BLOCKS["branch"], 1))).otherwise(F.col("raw"))
    return grouped.withColumn("text", text)


def collapse_blanks(rows: DataFrame) -> DataFrame:
    """[W6, W7] Blocks without edge blanks, and with one blank of each run."""
    solid = F.when(F.col("kind") != "blank", F.col("line_no"))
    doc = Window.partitionBy("doc_id")
    inside = rows.withColumns({"lo": F.min(solid).over(doc), "hi": F.max(solid).over(doc)}).where("line_no BETWEEN lo AND hi")
    return inside.withColumn("before", F.lag("kind").over(by_line())).where("NOT (kind = 'blank' AND before = 'blank')").drop("lo", "hi", "before")


def split_by_class(rows: DataFrame) -> DataFrame:
    """[W5] Adds class_key and paper: a title with another class starts a new paper; before the first, UNKNOWN."""
    key = F.when((F.col("kind") == "title") & F.col("text").rlike(CLASS), F.upper(F.regexp_extract("text", CLASS, 1)))
    # A document that opens with something else starts as UNKNOWN, so a first class title there changes the key.
    carried = F.coalesce(F.last("key", ignorenulls=True).over(by_line().rowsBetween(*UP_TO_HERE)), F.lit("UNKNOWN"))
    keyed = rows.withColumn("key", key).withColumn("class_key", carried)
    change = F.when(F.coalesce(F.lag("class_key").over(by_line()) != F.col("class_key"), F.lit(False)), 1).otherwise(0)
    return keyed.withColumn("paper", F.sum(change).over(by_line().rowsBetween(*UP_TO_HERE))).drop("key")


def block_weight() -> Column:
    """[A7] Body lines that a block takes on paper."""
    return (
        F.when(F.col("kind") == "picture_grid", 4.5).when(F.col("kind") == "match_table", F.col("n_lines") + 0.5).when(F.col("kind") == "branch", F.col("n_lines") + 1.5)
        .when(F.col("kind") == "title", 1.6).when(F.col("kind") == "section", 1.5).when(F.col("kind").isin("checkboxes", "option_row"), 1.4).otherwise(1.0))


def pages(weight: Column, per_page: int = 40) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / per_page)).cast("int")


def page_estimate(rows: DataFrame, keys: list[str], per_page: int = 40) -> DataFrame:
    """[A7] n_blocks, weight and pages per group of blocks."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.round(F.sum(block_weight()), 1).alias("weight")).withColumn(
        "pages", pages(F.col("weight"), per_page))


def smart_fit(rows: DataFrame, budget: int) -> DataFrame:
    """Blocks of documents over the page budget: blank runs collapsed; if that isn't enough, without blanks.

    The rows are read once: what stays and what it weighs are windows over the document. Rows without a doc_id go.
    """
    doc = Window.partitionBy("doc_id")
    over = lambda w: pages(F.round(F.sum(w).over(doc), 1)) > budget
    solid = F.when(F.col("kind") != "blank", F.col("line_no"))
    marked = rows.where("doc_id IS NOT NULL").withColumns({
        "_before": F.lag("kind").over(by_line()), "_lo": F.min(solid).over(doc), "_hi": F.max(solid).over(doc), "_over": over(block_weight())})
    # Of collapse_blanks; a blank between two other blocks has its neighbour among them too.
    held = F.col("line_no").between(F.col("_lo"), F.col("_hi")) & ~((F.col("kind") == "blank") & (F.col("_before") == "blank"))
    kept = marked.withColumn("_held", F.coalesce(held, F.lit(False))).where("NOT _over OR _held")
    again = kept.withColumn("_again", F.col("_over") & over(block_weight()))
    return again.where("NOT _again OR kind <> 'blank'").select(*rows.columns)


def marks_totals(rows: DataFrame) -> DataFrame:
    """[A6] Per document the sum of the sections' marks, and the sections whose printed total is wrong."""
    marked = rows.where("kind = 'section'").withColumn("m", T.parse_marks(F.col("raw"))).where("m IS NOT NULL")
    wrong = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("m.mismatch"), F.struct("line_no", F.col("m.raw").alias("raw"))))), lambda x: x["raw"]), "; ")
    return marked.groupBy("doc_id").agg(F.sum("m.total").alias("grand_total"), F.count_if("m.mismatch").alias("n_wrong"), wrong.alias("wrong"))


def with_page_break(rows: DataFrame) -> DataFrame:
    """[W15] Drops page breaks and marks the block after each."""
    return rows.withColumn("break_before", F.coalesce(F.lag("kind").over(by_line()) == "pagebreak", F.lit(False))).where("kind <> 'pagebreak'")


def short_runs(rows: DataFrame, least: int = 8, most_chars: int = 4, least_cells: int = 6) -> DataFrame:
    """[W11] Runs of least or more short lines as grids, numbers at either end left out: doc_id, first_line, n, columns, rows, cells.

    Blank lines don't part a run; any other line does. A grid has least_cells cells at least, and as many columns as make it square.
    """
    solid = rows.withColumn("cell", F.trim("line")).where("cell <> ''")
    marked = solid.withColumn("short", (F.length("cell") <= most_chars) & ~F.col("cell").startswith("[["))
    island = marked.withColumn("g", F.row_number().over(by_line()) - F.row_number().over(by_line("short"))).where("short")
    held = F.array_sort(F.collect_list(F.struct("line_no", "cell")))
    runs = island.groupBy("doc_id", "g").agg(F.min("line_no").alias("first_line"), held.alias("all")).where(F.size("all") >= least)
    said = F.filter(F.transform("all", lambda x, k: F.when(~x["cell"].rlike("^[0-9]+$"), k + 1)), lambda k: k.isNotNull())
    kept = runs.withColumn("said", said).where("size(said) > 0").withColumn(
        "cells", F.transform(F.slice("all", F.array_min("said"), F.array_max("said") - F.array_min("said") + 1), lambda x: x["cell"])).where(F.size("cells") >= least_cells)
    n = F.size("cells")
    columns = F.ceil(F.sqrt(n)).cast("int")
    return kept.select("doc_id", "first_line", n.alias("n"), columns.alias("columns"), F.ceil(n / columns).cast("int").alias("rows"), F.array_join("cells", "|").alias("cells"))


#: Patterns of a section row and of what is no word of a heading.
SECTION_OPEN = r"(?i)^\s*\[\[SECTION_ROW:"
ORDINAL = r"(?i)^\s*(?:\[\[(?:SECTION_ROW|QUESTION_ROW):\s*)?([IVX]{1,6})(?:[.)\s]|$)"


def heading_words(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, SECTION_OPEN + r"\s*", ""), r"(?s)\s*\|\|.*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*[IVX]{1,6}[.)\s]+", ""), "[^A-Za-z0-9]+", " ")))


def dedupe_prelude(rows: DataFrame) -> DataFrame:
    """[W14] A plain line that says in at least twelve characters what the section row below it says goes blank; blank lines may stand between."""
    below = F.first(F.when(F.trim("line") != "", F.col("line")), ignorenulls=True).over(by_line().rowsBetween(1, Window.unboundedFollowing))
    numbered = lambda c: F.upper(F.regexp_extract(c, ORDINAL, 1)).isin(T.ROMAN)
    plain = (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*\[\[") & ~numbered(F.col("line"))
    heading = F.col("below").rlike(SECTION_OPEN) & numbered(F.col("below"))
    words = heading_words(F.col("line"))
    repeated = plain & heading & (F.length(words) >= 12) & (words == heading_words(F.col("below")))
    return rows.withColumn("below", below).withColumn("line", F.when(F.coalesce(repeated, F.lit(False)), "").otherwise(F.col("line"))).drop("below")


def compact_pages(rows: DataFrame) -> DataFrame:
    """[M4] Page-break lines go unless a class line follows."""
    nxt = F.lead("line").over(by_line())
    return rows.withColumn("nxt", nxt).where((F.trim("line") != "[[PAGE_BREAK]]") | F.coalesce(F.col("nxt").rlike(r"(?i)^\s*Class\s*[:：-]"), F.lit(False))).drop("nxt")


def pack_figures(rows: DataFrame, width: int = 5) -> DataFrame:
    """[M10] Neighbouring single figures as rows of up to width."""
    figure = r"(?i)^\s*\[\[FIGURE:\s*(.*?)\]\]\s*$"
    marked = rows.withColumn("fig", F.when(F.col("line").rlike(figure), 1).otherwise(0))
    island = marked.withColumn("g", F.row_number().over(by_line()) - F.row_number().over(by_line("fig"))).where("fig = 1")
    placed = island.withColumn("r", F.floor((F.row_number().over(by_line("g")) - 1) / width))
    return placed.groupBy("doc_id", "g", "r").agg(
        F.min("line_no").alias("line_no"), F.count("*").alias("n"),
        F.concat(F.lit("[[FIGURE_ROW: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.regexp_extract(x["line"], figure, 1)), " || "), F.lit("]]")).alias("line")).select("doc_id", "line_no", "n", "line")
