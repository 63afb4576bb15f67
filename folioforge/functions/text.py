"""Scalar text functions: Column in, Column out, all inside the JVM unless the docstring says otherwise.

"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: White space as the reference's language reads it: Java's \s plus the Unicode spaces and the byte-order mark.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Code-point ranges by language, in the order in which ties are settled.
LANGUAGE_RANGES = {
    "hi": (0x0900, 0x097F), "te": (0x0C00, 0x0C7F), "ta": (0x0B80, 0x0BFF), "kn": (0x0C80, 0x0CFF), "ml": (0x0D00, 0x0D7F),
    "bn": (0x0980, 0x09FF), "gu": (0x0A80, 0x0AFF), "pa": (0x0A00, 0x0A7F), "or": (0x0B00, 0x0B7F), "ur": (0x0600, 0x06FF),
}
#: Languages that write in the range of another.
SHARED_RANGES = {"mr": "hi", "ks": "ur"}
#: Scripts that a second reading must not lose.
NATIVE_SCRIPTS = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic"]
#: Roman numerals of sections.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]
#: Telugu words by their usual Latin spelling.
TELUGU_WORDS = {
    "enti": "ఏంటి", "emiti": "ఏమిటి", "enduku": "ఎందుకు", "ela": "ఎలా", "evaru": "ఎవరు", "ekkada": "ఎక్కడ", "avunu": "అవును",
    "kaadu": "కాదు", "nenu": "నేను", "nuvvu": "నువ్వు", "meeru": "మీరు", "idi": "ఇది", "adi": "అది",
}
#: Markup entities and what they stand for, in order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def in_range(code: str) -> str:
    lo, hi = LANGUAGE_RANGES[SHARED_RANGES.get(code, code)]
    return f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]"


def hits(text: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(text, F.lit(pattern))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def detect_language(text: Column) -> Column:
    """The script with strictly more letters than Latin and all before it, of three at least; else en."""
    text = F.coalesce(text, F.lit(""))
    ranked = [F.struct(hits(text, "[A-Za-z]").alias("n"), F.lit(0).alias("place"), F.lit("en").alias("code"))]
    for k, code in enumerate(LANGUAGE_RANGES, 1):
        n = hits(text, in_range(code))
        ranked.append(F.struct(F.when(n >= 3, n).otherwise(-1).alias("n"), F.lit(-k).alias("place"), F.lit(code).alias("code")))
    return F.array_max(F.array(*ranked))["code"]


@arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Canonical composition; Spark has no built-in for it, so this one runs in Arrow batches."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def clean_control(text: Column) -> Column:
    """Without NULs and a leading byte-order mark, composed."""
    return nfc(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "^\\x{FEFF}", ""))


def unfence(text: Column) -> Column:
    """Without a code fence around the whole, trimmed."""
    head = F.regexp_replace(text, r"(?i)^```(?:text|markdown)?\s*\n?", "")
    return js_trim(F.regexp_replace(head, r"\n?```\s*\z", ""))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), f"{WS}+\\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def count_regions(text: Column) -> Column:
    """Non-blank lines, one at least; 0 for empty or null text."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(js_trim(x)) > 0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), lines))


def strip_tags(text: Column) -> Column:
    """[S8] Tags as spaces, entities resolved, white space squeezed."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in [*ENTITIES, ("&nbsp;", " ")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def strip_office(text: Column) -> Column:
    """[S9] Tabs, breaks and paragraphs kept as characters; one blank line at most."""
    out = F.regexp_replace(text, r"(?i)<w:tab\s*/>", "\t")
    out = F.regexp_replace(out, r"(?i)<[wa]:br\s*/>|</(?:w|a|text):p>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return js_trim(F.regexp_replace(F.regexp_replace(out, "[ \\t]+\n", "\n"), "\n{3,}", "\n\n"))


def degenerate(text: Column) -> Column:
    """[P1] A reading that has run into a loop: too long, or one character far too often in a row."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) > 30000) | text.rlike("([_ .─-])\\1{199,}") | text.rlike("([^\\s])\\1{79,}")


def blank_safe(text: Column) -> Column:
    """[P2] Very long rules shortened to 28, at most 12,000 characters."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "_{81,}", "_" * 28), 1, 12000)


#: The pattern of a mark of doubt.
UNCLEAR = r"(?i)\[unclear(?::[^\]\n]*)?\]"


#: Section instructions that ask for a truth value, a choice or a blank, whatever the case.
ASKS_TRUTH = (
    r"\b(?:write|mark|choose)\s+[TFYN]\b|\b(?:write|mark|choose)\s+(?:t\s*(?:or|/)\s*f|y\s*(?:or|/)\s*n)\b|सही.*गलत|हाँ.*नहीं|हां.*नहीं|అవును.*కాదు|అవునా.*కాదా|ஆம்.*இல்லை|ಹೌದು.*ಇಲ್ಲ|അതെ.*അല്ല|হ্যাঁ.*না|ਹਾਂ.*ਨਹੀਂ|ہاں.*نہیں|"
    r"\b(?:true\s*(?:or|/|and)\s*false|true\s+false|yes\s*(?:or|/|and)\s*no|yes\s+no)\b")
ASKS_CHOICE = r"\b(?:choose|tick|select)\b[^\n]{0,90}\b(?:correct|right|answer|option)\b|సరైన.*ఎంచుకో|சரியான.*தேர்ந்தெடு|ಸರಿಯಾದ.*ಆಯ್ಕೆ"
ASKS_BLANK = r"खाली स्थान|रिक्त स्थान|ఖాళీ|கோடிட்ட|ಖಾಲಿ|ഒഴിഞ്ഞ|শূন্যস্থান|ਖਾਲੀ|خالی|\bfill\b[^\n]{0,90}\bblanks?\b|\bquestion\s+tags?\b"
#: Patterns of places for a response, numbered items, and the lines that begin a section.
PLACE = r"(?:_{2,}|\.{3,}|…|[─━—]{2,}|\(\s*\)|\[\s*\]|□|☐|\[\[(?:ANSWER_LINES|GRID|GRID_ROW|CHECKBOX|BOXED):?)"
ITEM = r"(?:^|\n|\|\||\[\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW):)\s*\p{Nd}+[.)।]\s*\S"
ITEM_START, PLACE_START = r"^\s*\p{Nd}+[.)।]\s+\S", r"^\s*(?:\(\s*\)|\[\s*\]|□|☐|_{2,}|\[\[ANSWER_LINES:)"
SECTION_HEAD = r"[^\S\n]*(?:\[\[SECTION_ROW:[^\S\n]*([^\n]*?)(?:\|\||\]\])|[IVXLCDM]+[.)][^\S\n]+([^\n]+))"
SECTION_BREAK = r"[^\S\n]*(?:Class\s*:|\[\[PAPER_BREAK\]\])"


def lacks_responses(text: Column) -> Column:
    """[P8] A section that asks for responses has two numbered items or more and no place for one, or, where truth values or choices are asked, a place for some and none for others.

    Of over 80,000 characters, no.
    """
    text = F.coalesce(text, F.lit(""))
    sections = F.split(text, rf"(?im)(?=^(?:{SECTION_HEAD}|{SECTION_BREAK}))")

    def suspect(section: Column) -> Column:
        head = "(?i)^" + SECTION_HEAD
        asked = F.concat(F.regexp_extract(section, head, 1), F.regexp_extract(section, head, 2))
        uneven = asked.rlike("(?i)" + ASKS_TRUTH) | asked.rlike("(?iu)" + ASKS_CHOICE)
        body = F.regexp_replace(section, r"^[^\n]*\n?", "")
        several = hits(body, ITEM) >= 2
        parts = F.flatten(F.transform(F.split(body, "\n"), lambda x: F.split(
            F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*\[\[(?:MATCH_ROW|TABLE_ROW|QUESTION_ROW):\s*", ""), r"\]\]\s*$", ""), r"\s*\|\|\s*")))

        # A question is a numbered part with the places for a response that follow it.
        def step(s: Column, part: Column) -> Column:
            more = (F.size(s) > 0) & part.rlike(PLACE_START)
            grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(s, F.size(s) - 1), F.lit("")), F.lit(" "), part)))
            return F.when(part.rlike(ITEM_START), F.concat(s, F.array(part))).when(more, grown).otherwise(s)

        questions = F.aggregate(parts, F.array().cast("array<string>"), step)
        open_ = F.size(F.filter(questions, lambda q: q.rlike(PLACE)))
        some = uneven & (F.size(questions) >= 2) & (open_ > 0) & (open_ < F.size(questions))
        return (uneven | asked.rlike("(?iu)" + ASKS_BLANK)) & several & (~body.rlike(PLACE) | some)

    # Most texts ask for nothing: they are told by one look.
    asks = text.rlike(f"(?iu){ASKS_TRUTH}|{ASKS_CHOICE}|{ASKS_BLANK}") & (F.length(text) <= 80_000)
    return F.when(asks, F.exists(sections, suspect)).otherwise(False)


def blank_stems(text: Column) -> Column:
    """[P15] How many numbered cells say something before their blank."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\_"), F.lit("_")), r"(?i)\[\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW|GRID_ROW):\s*", ""), r"\]\]", "")
    bodies = F.transform(F.split(bare, r"\n|\|\|"), lambda c: F.regexp_extract(c, r"(?s)^\s*[0-9०-९]+[.)]\s*(.*)$", 1))
    said = lambda b: F.regexp_replace(F.get(F.split(b, r"=|[-–]\s*_{2,}|_{2,}"), F.lit(0)), r"[^\p{L}\p{N}]", "") != ""
    return F.size(F.filter(bodies, lambda b: b.rlike("_{2,}") & said(b)))


def review_warnings(text: Column) -> Column:
    """[P3] Kinds of visible doubt: unclear marks, replacement characters, pictures without an image, sections without places for responses."""
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(
        F.when(hits(text, UNCLEAR) > 0, F.concat(F.lit("unclear_source:"), hits(text, UNCLEAR).cast("string"))),
        F.when(text.contains("\ufffd"), F.lit("invalid_character")),
        F.when(text.rlike(r"(?i)\[\[PICTURE(?:_OPTION|_ROW)?:"), F.lit("missing_source_picture")),
        F.when(lacks_responses(text), F.lit("missing_answer_spaces"))))


def loses_script(first: Column, second: Column) -> Column:
    """[P4] Some native script with twenty letters or more has less than half of them left."""
    def lost(script: str) -> Column:
        before, after = (hits(F.coalesce(t, F.lit("")), f"\\p{{Is{script}}}") for t in (first, second))
        return (before >= 20) & (after < before * 0.5)

    out = F.lit(False)
    for script in NATIVE_SCRIPTS:
        out = out | lost(script)
    return out


#: The pattern of a section heading with its label.
SECTION_LABEL = r"(?m)^\s*(?:\[\[SECTION_ROW:\s*)?([IVXLCDM]+)[.)]?\s+[^\n]+"


def section_labels(text: Column) -> Column:
    return all_of(F.coalesce(text, F.lit("")), SECTION_LABEL, 1)


def loses_sections(first: Column, second: Column) -> Column:
    """[P10, O8] Two labels or more, one of which the second reading lacks."""
    a, b = section_labels(first), section_labels(second)
    return (F.size(a) >= 2) & (F.size(F.array_except(a, b)) > 0)


def missing_opening(text: Column, page: Column) -> Column:
    """[P9] Page 1 whose first section isn't I, although numbered items exist."""
    labels = section_labels(text)
    numbered = text.rlike(r"(?m)^\s*(?:\[\[(?:QUESTION_ROW|MATCH_ROW|TABLE_ROW):\s*)?[0-9०-९]+[.)]\s*\S")
    return F.coalesce((page == 1) & (F.size(labels) > 0) & (F.get(labels, F.lit(0)) != "I") & numbered, F.lit(False))


#: The pattern of figures, alone or in a row.
FIGURES = r"(?i)\[\[(FIGURE(?:_ROW)?):\s*([^\]\n]*?)\]\]"


def figure_widths(text: Column) -> Column:
    """Figures per row, in order."""
    kinds, bodies = all_of(F.coalesce(text, F.lit("")), FIGURES, 1), all_of(F.coalesce(text, F.lit("")), FIGURES, 2)
    return F.zip_with(kinds, bodies, lambda k, b: F.when(
        F.upper(k) == "FIGURE_ROW", F.size(F.filter(F.split(b, r"\s*\|\|\s*"), lambda x: x != ""))).otherwise(1))


def figure_layout_changed(first: Column, second: Column) -> Column:
    """[P7] Both have figures, in other rows (the caller rejects invalid markers)."""
    a, b = figure_widths(first), figure_widths(second)
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def section_ordinal(label: Column) -> Column:
    """The number of a canonical Roman numeral up to XX."""
    pairs = [F.lit(x) for k, r in enumerate(ROMAN, 1) for x in (r, k)]
    return F.create_map(*pairs)[F.upper(label)]


#: The pattern of an equation of marks.
MARKS = r"\(?\s*(\d+)\s*[xX×*]\s*(\d+)\s*(?:/\s*(\d+)\s*)?(?:=\s*(\d+)\s*)?\)?"


def parse_marks(text: Column) -> Column:
    """The first equation of marks N x M [/ D] [= P]; null if there is none."""
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, MARKS, k), F.lit("")), F.lit("9" * 9)).cast("long")
    n, per, denom, printed = (number(k) for k in (1, 2, 3, 4))
    computed = n * per
    total = F.coalesce(printed, computed)
    return F.when(text.rlike(MARKS), F.struct(
        F.trim(F.regexp_extract(text, MARKS, 0)).alias("raw"), n.alias("n"), per.alias("per"), denom.alias("denom"), total.alias("total"),
        computed.alias("computed"), (total != computed).alias("mismatch")))


def years(text: Column) -> Column:
    """Years 1500 to 1999, in order of appearance."""
    return all_of(F.coalesce(text, F.lit("")), r"\b(1[5-9]\d{2})\b", 1)


def valid_ratio(text: Column) -> Column:
    """Share of Devanagari letters and ASCII letters and digits among what isn't white space."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(text, r"[^\x{0900}-\x{097F}A-Za-z0-9]", "")) / solid).otherwise(0.0)


#: Marks that recognition leaves behind, and words that it misreads, in the order in which they are replaced.
STRAY_MARKS, RULED_LINES = r"[|\\/\[\]{}<>~`^=_!@#$%&*]", "[-=_]{3,}"
MISREAD = (
    ("मगंल", "मंगल"),
    ("लक्मीबाई", "लक्ष्मीबाई"),
    ("बहादर", "बहादुर"),
    ("स्वतन्त्रता", "स्वतंत्रता"),
    ("क्रांती", "क्रांति"),
    ("रेम्युले?टिं?ग", "रेग्युलेटिंग"),
    ("रे[मँ]्युले?टिं?ग", "रेग्युलेटिंग"),
    ("बैटिक", "बैंटिक"),
    ("बेंटिक", "बैंटिक"),
    ("मैकले", "मैकाले"),
    ("चारपे?कर", "चापेकर"),
    ("बंदुओं", "बंधुओं"),
    ("रैड", "रैंड"),
    ("जार्ज", "जॉर्ज"),
)


def readable_tokens(text: Column) -> Column:
    """Stray marks out and misread words mended, then one token per line, those with thirty percent valid characters at least."""
    text = F.regexp_replace(F.regexp_replace(text, STRAY_MARKS, " "), RULED_LINES, " ")
    for seen, meant in MISREAD:
        text = F.regexp_replace(text, seen, meant)
    return F.array_join(F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda t: valid_ratio(t) >= 0.3), "\n")


def dictionary_check(word: Column) -> Column:
    """The dictionary is empty on purpose, for transcription is literal: a word is known if it isn't blank, always valid, and has no
    correction; a null word is not known."""
    return F.struct(F.coalesce(F.length(js_trim(word)) > 0, F.lit(False)).alias("known"), F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("suggested_correction"),
                    F.lit("literal_transcription_mode").alias("reason"))


def native_roman(text: Column) -> Column:
    """Telugu for words of the lexicon; empty if any Latin word isn't in it, or there is none."""
    table = F.create_map(*[F.lit(x) for pair in TELUGU_WORDS.items() for x in pair])
    words = F.transform(all_of(text, "[A-Za-z]+"), lambda w: F.lower(w))
    known = F.forall(words, lambda w: F.array_contains(F.map_keys(table), w))
    # The gaps between the words, then words and gaps in turn.
    gaps = F.split(text, "[A-Za-z]+")
    out = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(words, F.slice(gaps, 2, 1 << 20), lambda w, g: F.concat(table[w], F.coalesce(g, F.lit("")))), ""))
    return F.when((F.size(words) > 0) & known, out).otherwise("")


def matches_script(text: Column, language: Column) -> Column:
    """[P22] A letter of the language's range is there; languages without one always match."""
    out = F.lit(True)
    for code in [*LANGUAGE_RANGES, *SHARED_RANGES]:
        out = F.when(language == code, text.rlike(in_range(code))).otherwise(out)
    return F.when(language == "en", text.rlike("[A-Za-z]")).otherwise(out)


def matches_context(text: Column, source: Column, context: Column) -> Column:
    """[P23] Every letter is in a script that source or context shows, or is a letter of source."""
    evidence = F.concat_ws(" ", source, context)
    letters = F.array_distinct(all_of(text, r"\p{L}"))
    ranges = [r"[A-Za-z\x{00C0}-\x{024F}]", *(in_range(c) for c in LANGUAGE_RANGES)]

    def fits(letter: Column) -> Column:
        out = source.contains(letter)
        for r in ranges:
            out = out | (letter.rlike(r) & evidence.rlike(r))
        return out

    return (F.size(letters) > 0) & F.forall(letters, fits)


def keeps_numbers(source: Column, other: Column) -> Column:
    """[P24] Numbers, formulas, blanks and operators are the same, in the same order."""
    blank = lambda t: F.transform(all_of(t, r"_{2,}|\.{3,}|…+|\(\s*\)"), lambda x: F.when(x.startswith("("), F.lit("( )")).otherwise(x))
    same = lambda f: f(source) == f(other)
    return (same(lambda t: all_of(t, r"\p{N}+(?:[.,]\p{N}+)*")) & same(lambda t: all_of(t, r"\$[^$]+\$"))
            & same(blank) & same(lambda t: all_of(t, r"[+×÷=^_≤≥≠∑∫√−/]")))


def within_selection(source: Column, other: Column) -> Column:
    """[P25] Not many more words than source, and no answer label that source lacks."""
    words = lambda t: F.size(all_of(t, r"[\p{L}\p{M}\p{N}]+"))
    label = r"(?i)^(?:the answer is\b|answer\s*:|ans\s*:|solution\s*:|उत्तर\s*:|जवाब\s*:)"
    room = words(source) + F.greatest(F.lit(2), F.ceil(words(source) * 0.2))
    return (words(other) <= room) & (~other.rlike(label) | source.rlike(label))


def clean_suggestions(items: Column, most: int = 8) -> Column:
    """[P21] Trimmed, of one line and 900 characters at most, distinct, the first few. Compose with nfc() beforehand where needed."""
    trimmed = F.transform(items, js_trim)
    fine = F.filter(trimmed, lambda x: (F.length(x) > 0) & (F.length(x) <= 900) & ~x.rlike("[\\r\\n]"))
    return F.slice(F.array_distinct(fine), 1, most)


def parse_suggestions(text: Column, most: int = 8) -> Column:
    """The first of array, object, fenced part and whole text that parses, cleaned."""
    raw = F.trim(text)
    whole = [F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.trim(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)), raw]
    tries = []
    for x in whole:
        tries += [F.from_json(x, "array<string>"), F.from_json(x, "struct<suggestions: array<string>>")["suggestions"]]
    usable = [F.when(F.exists(t, lambda v: v.isNotNull()), F.filter(t, lambda v: v.isNotNull())) for t in tries]
    return clean_suggestions(F.coalesce(*usable, F.array().cast("array<string>")), most)


def expand_pdf_escapes(text: Column) -> Column:
    """[S4] Backslash escapes other than octal ones; a backslash pair is taken first, through a private character."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\ue000"))
    for mark, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.replace(out, F.lit("\ue000"), F.lit("\\"))


def error_kind(message: Column) -> Column:
    """[P26] daily_limit, paid, timeout, transient or other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: m.contains(w))
    return (
        F.when(m.rlike(r"\b3036\b") | has("daily free allocation", "used up your daily free"), "daily_limit")
        .when(has("5035", "requires a workers paid plan"), "paid")
        .when(has("3007", "3008", "timed out", "timeout", "aborted", "408"), "timeout")
        .when(m.rlike(r"\b(?:3040|429|502|503|504)\b") | has(
            "out of capacity", "capacity temporarily exceeded", "too many requests", "rate limit", "temporarily unavailable", "service unavailable", "bad gateway"), "transient")
        .otherwise("other"))


def first_text(payload: Column) -> Column:
    """The first non-empty text of the shapes that responses come in, from JSON."""
    paths = ["$.response", "$.result.response", "$.choices[0].message.content", "$.choices[0].text", "$.output_text", "$.text"]
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths))


def picture_query(text: Column) -> Column:
    """Compatibility-composed and trimmed; null unless it has 2 to 80 letters, digits and separators."""
    t = js_trim(nfkc(text))
    return F.when(t.rlike(r"^[\p{L}\p{M}\p{N} ._'-]{2,80}$") & t.rlike(r"[\p{L}\p{N}]"), t)
