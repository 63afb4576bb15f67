"""

All are Column functions over the two texts, so a table of readings is judged in one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import text as T

#: Patterns of headings, rows, labels and scores.
HEADING = r"(?i)^\s*(?:\[\[SECTION_ROW:\s*)?([IVX]{1,6})[.)]\s+\S"
ROW_OPEN = r"(?i)^\s*\[\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW|CHOICE_ROW|OPTION_ROW):\s*"
LABEL = r"(?:^|\|\|)\s*([0-9०-९౦-౯௦-௯]+)[.)।]\s*\S"
SCORED = r"(?i)^\s*\[\[(SECTION_ROW|QUESTION_ROW):\s*(.*?)\s*\|\|\s*([^|]*?)\]\]\s*$"
TRAILING = r"(?iu)(?:^|\s)(\p{Nd}+\s*[x×X*]\s*\p{Nd}+\s*=\s*\p{Nd}+\s*(?:M|Marks?|अंक)?|\p{Nd}+\s*(?:M|Marks?|अंक))\s*[.।]?\s*$"
START = "continuation"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _sectioned(text: Column, found) -> Column:
    """Array of (section, item) in order; found(line, section) gives the items of a line."""
    start = F.struct(F.lit(START).alias("bit"), F.array().cast("array<struct<bit: string, item: string>>").alias("items"))

    def step(s: Column, line: Column) -> Column:
        head = F.regexp_extract(line, HEADING, 1)
        bit = F.when(head != "", F.upper(head)).otherwise(s["bit"])
        items = F.transform(found(line, bit), lambda x: F.struct(x["bit"].alias("bit"), x["item"].alias("item")))
        return F.struct(bit.alias("bit"), F.concat(s["items"], items).alias("items"))

    return F.aggregate(_lines(text), start, step)["items"]


def question_inventory(text: Column) -> Column:
    """[P11] The visible question labels in order, each with its section."""
    return _sectioned(text, lambda line, bit: F.transform(T.all_of(F.regexp_replace(line, ROW_OPEN, ""), LABEL, 1), lambda x: F.struct(bit.alias("bit"), x.alias("item"))))


def scores(text: Column) -> Column:
    """The literal scores in order, each with its section, or section and question."""
    def found(line: Column, bit: Column) -> Column:
        body = F.regexp_extract(line, SCORED, 2)
        label = F.regexp_extract(body, r"^\s*([0-9०-९౦-౯௦-௯]+)[.)।]", 1)
        key = F.when(F.upper(F.regexp_extract(line, SCORED, 1)) == "SECTION_ROW", bit).otherwise(F.concat(bit, F.lit(":"), F.when(label != "", label).otherwise(F.trim(body))))
        own = F.regexp_replace(F.regexp_extract(line, SCORED, 3), r"\s+", "")
        tail = F.when(line.rlike(HEADING), F.regexp_replace(F.regexp_extract(line, TRAILING, 1), r"\s+", "")).otherwise("")
        item = F.when(line.rlike(SCORED), F.struct(key.alias("bit"), own.alias("item"))).otherwise(F.struct(bit.alias("bit"), tail.alias("item")))
        return F.filter(F.array(item), lambda x: x["item"] != "")

    return _sectioned(text, found)


def is_subsequence(old: Column, new: Column) -> Column:
    """[P12] old stands in new, in order, with gaps allowed."""
    return F.aggregate(new, F.lit(0), lambda i, x: F.when(F.coalesce(x == F.get(old, i), F.lit(False)), i + 1).otherwise(i)) == F.size(old)


def _of(items: Column, bit: Column) -> Column:
    return F.transform(F.filter(items, lambda x: x["bit"] == bit), lambda x: x["item"])


def loses_questions(first: Column, second: Column) -> Column:
    """[P12] Some section's labels are no subsequence of the second reading's.

    What stands before the first heading may continue the section before it, or stand anywhere.
    """
    a, b = question_inventory(first), question_inventory(second)
    bits = F.array_distinct(F.transform(a, lambda x: x["bit"]))
    nxt = F.get(F.filter(bits, lambda x: x != START), F.lit(0))
    roman = F.array(*map(F.lit, T.ROMAN))
    place = F.coalesce(F.array_position(roman, nxt), F.lit(0)).cast("int")
    before = F.when(place > 1, _of(b, F.get(roman, place - 2)))

    def candidate(bit: Column) -> Column:
        own = _of(b, bit)
        prior = F.when((bit == START) & (F.size(F.coalesce(before, F.array().cast("array<string>"))) > 0), before).otherwise(own)
        return F.when((bit == START) & (F.size(prior) == 0), F.transform(b, lambda x: x["item"])).otherwise(prior)

    return F.exists(bits, lambda bit: ~is_subsequence(_of(a, bit), candidate(bit)))


def loses_marks(first: Column, second: Column) -> Column:
    """[P13] Some section's or question's literal scores are no subsequence of the second reading's."""
    a, b = scores(first), scores(second)
    return F.exists(F.array_distinct(F.transform(a, lambda x: x["bit"])), lambda bit: ~is_subsequence(_of(a, bit), _of(b, bit)))


#: Marker kinds that a layout may use.
KINDS = (
    "COUNT_OBJECTS ABACUS SECTION_ROW QUESTION_ROW ARITHMETIC_ROW MATCH_ROW TABLE_ROW GRID_ROW FIGURE_ROW FIGURE SHAPE_ROW GRID ANSWER_LINES CHOICE_ROW OPTION_ROW "
    "BANNER FOOTER SOURCE_PAGE TABLE_WIDTHS TABLE_HEADER TABLE_REGION BRANCH_ROOT BRANCH_ITEM DOUBLE-STRIKE DOUBLE-UNDERLINE STRIKE INSERT REPLACE CIRCLED UNDERLINE BOXED "
    "HIGHLIGHT MARGIN STAMP SIGNATURE PICTURE PICTURE_OPTION PICTURE_ROW").split()
#: The pattern of rows inside rows.
_NESTED = r"(?i)\[\[(?:TABLE_ROW|GRID_ROW|MATCH_ROW|ARITHMETIC_ROW):[^\n]*\[\[(?:TABLE_ROW|GRID_ROW|FIGURE_ROW|MATCH_ROW|ARITHMETIC_ROW|GRID):"


def _bounds_fail(spec: Column, edge: int, area: int | None) -> Column:
    parts = F.transform(F.split(spec, ","), lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d{1,6}(?:\.0+)?$"), F.trim(x).cast("double")))
    x, y, w, h = (F.get(parts, F.lit(k)) for k in range(4))
    bad = (x < 0) | (y < 0) | (w <= 0) | (h <= 0) | (x + w > edge) | (y + h > edge)
    return (F.size(parts) != 4) | F.exists(parts, lambda v: v.isNull()) | F.coalesce(bad | (w * h > area) if area else bad, F.lit(True))


def invalid_markers(text: Column) -> Column:
    """[P5] Nested rows, empty cells, unknown kinds, unbalanced brackets, figures out of bounds, wrong counts, pages or grids."""
    t = F.coalesce(text, F.lit(""))
    allowed = r"(?i)^(?:(?:" + "|".join(KINDS) + r"):.*|CHECKBOX|BRANCH_END)$"
    # Every opening up to the first closing after it, nested ones too: the text between an opening and the next two closing brackets.
    opened = F.transform(F.slice(F.split(t, r"\[\["), 2, 1 << 20), lambda x: F.when(x.contains("]]"), F.trim(F.substring_index(x, "]]", 1))).otherwise(x))
    unknown = F.exists(opened, lambda x: ~F.regexp_replace(x, r"\s", " ").rlike(allowed))
    figures = F.flatten(F.zip_with(
        T.all_of(t, r"(?is)\[\[(FIGURE(?:_ROW)?|BANNER|TABLE_REGION):\s*(.*?)\]\]", 1), T.all_of(t, r"(?is)\[\[(FIGURE(?:_ROW)?|BANNER|TABLE_REGION):\s*(.*?)\]\]", 2),
        lambda k, b: F.when(F.upper(k) == "FIGURE_ROW", F.split(b, r"\s*\|\|\s*")).otherwise(F.array(b))))
    boxed = F.exists(figures, lambda s: _bounds_fail(F.trim(F.get(F.split(s, r"\|"), F.lit(0))), 1001, 600_000))

    def count_fails(kind: Column, body: Column) -> Column:
        p = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
        data, label, answer, bounds = (F.get(p, F.lit(k)) for k in range(4))
        objects = data.rlike(r"^(?:grapes|apple|smiley|lollipop|star|kite|circle),(?:[1-9]|[12]\d|30)$")
        rods = F.transform(F.split(data, ","), lambda x: F.substring_index(x, "=", 1))
        beads = data.rlike(r"^(?:Th|H|T|O)=\d(?:,(?:Th|H|T|O)=\d){0,3}$") & (F.size(F.array_distinct(rods)) == F.size(rods))
        fine = label.rlike(r"^\d+[.)]?$") & answer.isin("box", "none") & F.when(F.upper(kind) == "ABACUS", beads).otherwise(objects)
        return (F.size(p) != 4) | ~F.coalesce(fine, F.lit(False)) | _bounds_fail(bounds, 1000, None)

    counted = r"(?i)\[\[(COUNT_OBJECTS|ABACUS):\s*([^\]\n]+)\]\]"
    counts = F.exists(F.zip_with(T.all_of(t, counted, 1), T.all_of(t, counted, 2), count_fails), lambda x: x)
    pages = F.exists(T.all_of(t, r"(?i)\[\[SOURCE_PAGE:\s*([^\]]*)\]\]", 1), lambda x: ~F.trim(x).rlike("^[1-9][0-9]{0,2}$"))

    def grid_fails(x: Column) -> Column:
        r, c = (F.regexp_extract(F.trim(x), r"(?i)^(\d{1,2})x(\d{1,2})$", k).try_cast("int") for k in (1, 2))
        return ~F.coalesce(r.between(1, 52) & c.between(1, 32) & (r * c <= 600), F.lit(False))

    grids = F.exists(T.all_of(t, r"(?i)\[\[GRID:\s*([^\]]*)\]\]", 1), grid_fails)
    unbalanced = T.hits(t, r"\[\[") != T.hits(t, r"\]\]")
    return t.rlike(_NESTED) | t.rlike(r"(?i)\[\[(?:QUESTION_ROW|SECTION_ROW):[^\]|]*\]\]") | unbalanced | unknown | boxed | counts | pages | grids


def verified_crops(first: Column, second: Column) -> Column:
    """[P6, J6] first with the bounds of second's figures, if both have as many figures with equal captions; else first."""
    specs = lambda t: F.flatten(F.transform(T.all_of(t, T.FIGURES, 2), lambda b: F.split(b, r"\s*\|\|\s*")))
    caption = lambda s: F.lower(F.trim(F.coalesce(F.get(F.split(s, r"\|"), F.lit(1)), F.lit(""))))
    a, b = specs(first), specs(second)
    same = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.transform(a, caption) == F.transform(b, caption)) & ~invalid_markers(second)
    fresh = F.zip_with(a, b, lambda o, n: F.concat(F.trim(F.get(F.split(n, r"\|"), F.lit(0))), F.when(F.instr(o, "|") > 0, F.substr(o, F.instr(o, "|"))).otherwise("")))
    # Figures are put back one at a time: the k-th old spec by the k-th new one, each behind what was done before.
    start = F.struct(F.lit("").alias("done"), first.alias("rest"))

    def step(s: Column, pair: Column) -> Column:
        at = F.instr(s["rest"], pair["o"])
        return F.struct(F.concat(s["done"], F.substr(s["rest"], F.lit(1), at - 1), pair["n"]).alias("done"), F.substr(s["rest"], at + F.length(pair["o"])).alias("rest"))

    folded = F.aggregate(F.zip_with(a, fresh, lambda o, n: F.struct(o.alias("o"), n.alias("n"))), start, step)
    return F.when(same, F.concat(folded["done"], folded["rest"])).otherwise(first)


#: Patterns of editing marks and of an empty reading.
EDITS = r"\[\[(?:DOUBLE-STRIKE|DOUBLE-UNDERLINE|STRIKE|INSERT|REPLACE|CIRCLED|UNDERLINE|BOXED|HIGHLIGHT|MARGIN|STAMP|SIGNATURE|PICTURE|PICTURE_OPTION|OPTION_ROW|MATCH_ROW):"
NOTHING = r"(?i)^no\s+(?:readable\s+)?text\s+detected[.!]?$"


def comparable(text: Column) -> Column:
    """A reading without layout: pictures as one token, cells as words, rules and doubts as space."""
    t = F.regexp_replace(text, r"(?is)\[\[(?:FIGURE(?:_ROW)?|BANNER|GRID|SHAPE_ROW|ANSWER_LINES|TABLE_REGION|TABLE_WIDTHS|TABLE_HEADER|SOURCE_PAGE):\s*.*?\]\]", " X ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)\[\[[A-Z_-]+:\s*(.*?)\]\]", "$1"), r"\|\|", " ")
    return F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\\_"), F.lit("_")), "[_─]{2,}", " "), r"(?i)\[unclear(?::[^\]\n]{0,80})?\]?", " ")


def agreement(first: Column, second: Column) -> Column:
    """[J9] Shared tokens, as often as both have them, over the larger number of tokens, for one pair."""
    tokens = lambda t: F.filter(F.split(F.regexp_replace(comparable(t), r"[|()\[\]{}.,;:!?/\\]+", " "), r"\s+"), lambda x: x != "")
    a, b = tokens(first), tokens(second)
    shared = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def structured(meta: Column) -> Column:
    at = lambda k: F.coalesce(meta[k], F.lit(0))
    return (F.coalesce(meta["structuredLayout"], F.lit(False)) | (at("multiColumnRows") >= 1) | (at("denseOptionRows") >= 1) | (at("longHorizontalRules") >= 2) | (at("longVerticalRules") >= 1) | (at("lineCount") >= 10))


def should_verify(text: Column, meta: Column) -> Column:
    """[P14] Whether a second reading is worth its price: emptiness, lost lines, doubts, edits, structure, difficulty, ink without text."""
    v = T.js_trim(F.coalesce(text, F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(v, r"(?s)\[\[.*?\]\]", ""), T.UNCLEAR, ""))
    n_lines = F.size(F.filter(F.split(v, "\n+"), lambda x: F.trim(x) != ""))
    at = lambda k: F.coalesce(meta[k], F.lit(0))
    missed = F.coalesce(meta["scanStrategy"] == "line-mosaic", F.lit(False)) & (at("lineCount") >= 4) & (n_lines < F.greatest(F.lit(2), F.floor(at("lineCount") * 0.5)))
    ink = (at("edgeRatio") >= 0.018) | (at("score") >= 1) | (at("contrast") >= 28)
    hard = F.coalesce(meta["difficulty"] == "hard", F.lit(False)) | (at("score") >= 2)
    return (T.degenerate(v) | invalid_markers(v) | (v == "") | v.rlike(NOTHING) | v.rlike(r"(?i)^no\s+text\s+found[.!]?$") | missed | v.rlike(r"(?i)\[\[FIGURE(?:_ROW)?:") | (T.hits(v, T.UNCLEAR) > 0)
            | v.rlike("(?i)" + EDITS) | v.rlike(r"(?i)\[\[CHECKBOX\]\]") | structured(meta) | hard | ((F.length(plain) < 12) & ink))


def accept_second(first: Column, second: Column, meta: Column) -> Column:
    """[P15] Whether the second reading replaces the first: an ordered cascade, the first rule that applies decides."""
    a, b = (T.js_trim(F.coalesce(t, F.lit(""))) for t in (first, second))
    size = lambda t: F.length(F.regexp_replace(comparable(t), r"\s+", ""))
    n_lines = lambda t: F.size(F.filter(F.split(t, "\n+"), lambda x: F.trim(x) != ""))
    doubts = lambda t: T.hits(t, T.UNCLEAR)
    edits = lambda t: T.hits(t, EDITS) + T.hits(t, r"\[\[CHECKBOX\]\]")
    expected, shaped, page = F.coalesce(meta["lineCount"], F.lit(0)), structured(meta), meta["pageNumber"]
    la, lb, na, nb, same = size(a), size(b), n_lines(a), n_lines(b), agreement(a, b)
    unsure = (doubts(a) > 0) | (edits(a) > 0)
    lost = T.loses_script(a, b) | T.loses_sections(a, b) | loses_questions(a, b) | loses_marks(a, b)
    opening = ~T.missing_opening(a, page) & T.missing_opening(b, page)
    enough = F.when(shaped, 0.28).otherwise(0.50)
    return (
        F.when((b == "") | T.degenerate(b) | invalid_markers(b) | b.rlike(NOTHING), False)
        .when(T.degenerate(a) | invalid_markers(a) | (a == "") | a.rlike(NOTHING), True)
        .when(lost | opening | (~T.lacks_responses(a) & T.lacks_responses(b)), False)
        .when(T.blank_stems(a) > T.blank_stems(b), False)
        .when(lb < F.greatest(F.lit(4.0), la * 0.68), False)
        .when(~shaped & (lb > la * 1.55) & (la > 20), False).when(shaped & (lb > la * 5.0) & (la > 20), False)
        .when((expected >= 4) & (nb < F.greatest(F.lit(2), F.floor(expected * 0.4))), False)
        .when(shaped & (nb >= na + 2) & (lb >= la * 1.1) & ((same >= 0.28) | (la < 80)), True)
        .when(~unsure & ~shaped & (la > 40) & (same < 0.5), False)
        .when(~unsure & shaped & (la > 80) & (same < 0.28) & (nb <= na + 1), False)
        .when(doubts(b) < doubts(a), True).when((edits(b) < edits(a)) & (lb >= la * 0.75), True)
        .otherwise((lb >= la * 0.88) & ((la <= 40) | (same >= enough) | unsure)))


def quantities(text: Column) -> Column:
    """The counted objects of a reading, without bounds."""
    p = r"(?i)\[\[(COUNT_OBJECTS|ABACUS):\s*([^\]\n]+)\]\]"
    return F.zip_with(T.all_of(text, p, 1), T.all_of(text, p, 2), lambda k, b: F.concat(F.upper(k), F.lit(":"), F.array_join(F.slice(F.transform(F.split(b, r"\|"), lambda x: F.trim(x)), 1, 3), "|")))


#: The kinds whose figures two readings must count alike, and the parts of such a marker: label, answer and bounds.
_COUNTED = r"(?i)\[\[(?:COUNT_OBJECTS|ABACUS):\s*"
_PART = r"[^\S\n]*\|[^\S\n]*([^\]\n|]*?)"


def reconciled(text: Column, first: Column, second: Column, completed: Column) -> Column:
    """(text, disagreement): where there is no second reading, or it counts otherwise, a counted figure becomes the
    picture at its bounds, or [unclear] if it has none. A null reading counts nothing; a null text stays null."""
    agreed = F.coalesce(completed, F.lit(False)) & (quantities(F.coalesce(first, F.lit(""))) == quantities(F.coalesce(second, F.lit(""))))
    bounded = F.regexp_replace(text, rf"{_COUNTED}[^\]\n|]*{_PART}{_PART}[^\S\n]*\|[^\S\n]*([^\]\n|]*[^\]\s|])[^\S\n]*(?:\|[^\]\n]*)?\]\]", r"[[FIGURE: $3|$1|$2]]")
    plain = F.regexp_replace(bounded, rf"{_COUNTED}[^\]\n]+\]\]", "[unclear]")
    return F.struct(F.when(agreed, text).otherwise(plain).alias("text"), (~agreed).alias("disagreement"))


def clean_hints(hints: Column) -> Column:
    """[P19] Of the first twenty hints (wrong, right, count) the usable ones, trimmed, counts held to 1..99, twelve at most."""
    trimmed = F.transform(F.slice(hints, 1, 20), lambda h: F.struct(T.js_trim(h["wrong"]).alias("wrong"), T.js_trim(h["right"]).alias("right"), F.greatest(F.lit(1), F.least(F.lit(99), F.coalesce(h["count"], F.lit(1)))).alias("count")))
    fine = lambda h: (h["wrong"] != "") & (h["right"] != "") & (h["wrong"] != h["right"]) & (F.length(h["wrong"]) <= 40) & (F.length(h["right"]) <= 40) & ~F.concat(h["wrong"], h["right"]).rlike("[\r\n<>]")
    return F.slice(F.filter(trimmed, fine), 1, 12)


def clean_views(views: Column, budget: int = 5 << 20) -> Column:
    """[P20, N3] Of the first six views (size, x, y, w, h) those in bounds whose running size, rejected ones included, is within the budget: their indices."""
    indexed = F.transform(F.slice(views, 1, 6), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    sound = F.filter(indexed, lambda s: (s["v"]["size"] <= 2 << 20) & (s["v"]["x"] >= 0) & (s["v"]["y"] >= 0) & (s["v"]["w"] > 0) & (s["v"]["h"] > 0) & (s["v"]["x"] + s["v"]["w"] <= 1000) & (s["v"]["y"] + s["v"]["h"] <= 1000))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, x: F.struct((s["total"] + x["v"]["size"]).alias("total"), F.when(s["total"] + x["v"]["size"] <= min(5 << 20, budget), F.concat(s["kept"], F.array(x["i"]))).otherwise(s["kept"]).alias("kept"))
    return F.aggregate(sound, start, step)["kept"]
