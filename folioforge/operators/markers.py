"""Normalising and flattening of marker text: rules that look at nested markers or at neighbouring lines.

The markers of a text are parsed into a tree once; rules then work on nodes, or on typed lines. Documents are
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, groupby, pairwise, takewhile

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

DEPTH = 16
#: Kinds whose content is dropped, kept, or split into cells.
DROPPED = {"STRIKE", "DOUBLE-STRIKE", "ANSWER", "SOLUTION", "ANSWER_KEY", "MARGIN", "STAMP"}
UNWRAPPED = {"INSERT", "HIGHLIGHT"}
CELLED = {"SECTION_ROW", "QUESTION_ROW", "TABLE_ROW", "GRID_ROW", "MATCH_ROW", "CHOICE_ROW", "OPTION_ROW", "ARITHMETIC_ROW"}
LINE_KINDS = (
    "COUNT_OBJECTS ABACUS SECTION_ROW QUESTION_ROW ARITHMETIC_ROW MATCH_ROW TABLE_ROW GRID_ROW FIGURE_ROW FIGURE SHAPE_ROW GRID "
    "ANSWER_LINES CHOICE_ROW OPTION_ROW BANNER FOOTER TABLE_WIDTHS TABLE_HEADER TABLE_REGION SOURCE_PAGE").split()
_NUMBER = r"(?:[0-9०-९]+(?:[./][0-9०-९]+)?[¼½¾]?|[¼½¾])"
#: Patterns of scores, cells, items and headings.
SCORE = re.compile(rf"\(?{_NUMBER}(?:\s*[x×X*]\s*{_NUMBER}\s*=\s*{_NUMBER}\s*(?:M|[Mm]arks?)?|\s*(?:M|[Mm]arks?|अंक))?\)?\Z")
CELLS = re.compile(r"\s*\|\|\s*")
ITEM = re.compile(r"\s*(?:\[\[(?:SECTION_ROW|QUESTION_ROW):|[0-9०-९]+[.)]\s|[IVX]{1,6}(?:[.)]?\s|[.)]?$))", re.I)
HEADING = re.compile(r"SECTION_ROW:|^\s*[IVX]+[.)]?\s", re.I)


@dataclass
class Node:
    """A marker with its kind and content, or with kind None a bare [[...]]."""

    kind: str | None
    parts: list = field(default_factory=list)
    closed: bool = True


_MARK = re.compile(r"\[\[(?:([A-Za-z_-]+):\s*)?|\]\]")


def parse(text: str) -> list:
    """Strings and nodes; an opening that never closes becomes text again."""
    stack: list[tuple[list, Node | None, int]] = [([], None, 0)]
    at = 0
    for m in _MARK.finditer(text):
        stack[-1][0].append(text[at : m.start()])
        at = m.end()
        if m[0] != "]]":
            stack.append(([], Node(m[1].upper() if m[1] else None), m.start()))
        elif len(stack) > 1:
            parts, node, _ = stack.pop()
            node.parts = parts
            stack[-1][0].append(node)
        else:
            stack[-1][0].append("]]")
    stack[-1][0].append(text[at:])
    if len(stack) > 1:  # the outermost unclosed opening and all behind it stay as they were
        start = stack[1][2]
        return [*stack[0][0], text[start:]]
    return stack[0][0]


def render(parts: list) -> str:
    return "".join(p if isinstance(p, str) else f"[[{p.kind + ': ' if p.kind else ''}{render(p.parts)}]]" for p in parts)


def top_cells(body: str) -> list[str]:
    """Cells of a row, split where no marker is open."""
    cells, depth, at = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]|\|\|", body):
        if m[0] == "||":
            if not depth:
                cells.append(body[at : m.start()].strip())
                at = m.end()
        else:
            depth += 1 if m[0] == "[[" else -1
    return [*cells, body[at:].strip()]


#: Cells that say nothing, and cells with a place to write.
EMPTY = {"", "none", "null"}
PLACE = re.compile(r"_{2,}|\[\[(?:GRID|ANSWER_LINES):", re.I)


def row_of(kind: str, cells: list[str] | tuple[str, ...]) -> str:
    return f"[[{kind}: {' || '.join(cells)}]]"


def canonical_row(kind: str, body: str) -> str:
    """A row in its one form: without empty tail cells, the score last; a row without score is plain text."""
    if kind not in ("SECTION_ROW", "QUESTION_ROW", "MATCH_ROW"):
        return f"[[{kind}: {body}]]"
    *front, last = top_cells(body)
    if kind == "MATCH_ROW":
        spare = last.lower() == "none" and any(map(PLACE.search, front))
        return row_of(kind, [*front, "" if spare else last])
    said = [k for k, c in enumerate([*front, last]) if c.lower() not in EMPTY]
    *stem, score = [*front, last][: said[-1] + 1 if said else 1]
    return row_of(kind, (" ".join(stem), score)) if stem and SCORE.match(score) else " ".join([*stem, score])


def _cleaned(parts: list, depth: int) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(re.sub(r"(?:\\_){2,}", lambda m: m[0].replace("\\", ""), p))
        elif p.kind is None:
            digits = render(p.parts).strip()
            out.append(f"[[BOXED: {digits}]]" if re.fullmatch("[0-9०-९]+", digits) else render([p]))
        elif p.kind in DROPPED or depth >= DEPTH:
            continue
        elif p.kind == "REPLACE":
            pieces = re.split(r"\s*(?:->|→|=>|\|\|)\s*", _cleaned(p.parts, depth + 1))
            out.append(" ".join(pieces[1:]))
        elif p.kind in UNWRAPPED:
            out.append(_cleaned(p.parts, depth + 1))
        else:
            body = _cleaned(p.parts, depth + 1)
            if p.kind in CELLED:
                body = re.sub(r"(?<!\|)\s+\|\s+(?!\|)", " || ", body)
            out.append(canonical_row(p.kind, body))
    return "".join(out)


def clean(text: str) -> str:
    """What the paper shows: struck and answer parts gone, replacements applied, rows canonical, answer lines blank."""
    out = _cleaned(parse(recognised_markup(text)), 0)
    return re.sub(r"^\s*(?:Ans(?:wer)?|Solution|उत्तर|जवाब)\s*[:：]\s*[^\n]+$", "_" * 20, out, flags=re.I | re.M)


def recognised_markup(text: str) -> str:
    """Complete HTML tables and a few LaTeX forms as markers; anything doubtful stays as it is."""
    text = re.sub(r"&(?:nbsp|#160|#x0*a0);", "\u00a0", text, flags=re.I)
    text = re.sub(r"\\hspace\*?\{\s*(\d+(?:\.\d+)?)\s*cm\s*\}", lambda m: "_" * max(4, min(24, int(float(m[1]) * 4 + 0.5))), text, flags=re.I)
    for _ in range(2):
        text = re.sub(r"\\underline\{([^{}]*)\}", r"\1", text, flags=re.I)
    text = re.sub(r"\\hline\b", "", text, flags=re.I)

    def table(m: re.Match) -> str:
        rows = re.findall(r"<tr\s*>(.*?)</tr\s*>", m[2], re.I | re.S)
        if not rows or re.sub(r"<tr\s*>.*?</tr\s*>", "", m[2], flags=re.I | re.S).strip():
            return m[0]
        out = []
        for r in rows:
            cells = re.findall(r"<t[dh]\s*>(.*?)</t[dh]\s*>", r, re.I | re.S)
            rest = re.sub(r"<t[dh]\s*>.*?</t[dh]\s*>", "", r, flags=re.I | re.S).strip()
            if not cells or rest or any(re.search(r"</?(?:table|tr|td|th)\b", c, re.I) or "|" in c for c in cells):
                return m[0]
            out.append("[[TABLE_ROW: " + " || ".join(re.sub(r"\s*\n\s*", " ", c).strip() for c in cells) + "]]")
        return m[1] + "\n".join(out)

    return re.sub(r"(^|\n)[ \t]*<table\s*>(.*?)</table\s*>[ \t]*(?=\n|$)", table, text, flags=re.I | re.S)


def _piped(line: str) -> tuple[str, ...]:
    """The cells of a line between pipes; none for other lines."""
    m = re.fullmatch(r"\|(.*)\|", line.strip())
    if not m or "[[" in line:
        return ()
    double = "||" in m[1] and re.search(r"[^|\s]", m[1])
    cells = tuple(c.strip() for c in m[1].split("||" if double else "|"))
    return cells if 2 <= len(cells) <= 52 and "|" not in "".join(cells) else ()


def _letters(cell: str) -> bool:
    return 1 <= len(cell) <= 4 and all(unicodedata.category(c)[0] in "LM" for c in cell)


def _pipe_code(cells: tuple[str, ...]) -> str:
    """One letter for what a row of cells is: a rule, a blank row, letters, or another row."""
    if all(re.fullmatch(r":?-{3,}:?", c) for c in cells):
        return "-"
    return "." if not any(cells) else "l" if len(cells) >= 4 and all(map(_letters, cells)) else "x"


def pipe_tables(text: str) -> str:
    """Markdown tables as TABLE_ROW, runs of blank pipe rows as GRID, letters below an alphabet's name as GRID_ROW.

    Neighbouring rows of one width are read as a word of their codes: a table is a row, a rule, and rows up to the next rule.
    """
    out: list[str] = []
    for width, run in groupby([(x, _piped(x)) for x in text.split("\n")], key=lambda r: len(r[1])):
        rows = list(run)
        if not width:
            out += [x for x, _ in rows]
            continue
        most = min(32, max(1, 600 // width))
        for m in re.finditer(rf"(?P<table>.-[^-]*)|(?P<grid>\.{{1,{most}}})|(?P<strip>l)|.", "".join(_pipe_code(c) for _, c in rows)):
            lines, cells = zip(*rows[m.start() : m.end()])
            if m["table"]:
                out += [row_of("TABLE_ROW", c) for c in (cells[0], *cells[2:])]
            elif m["grid"]:
                out.append(f"[[GRID: {width}x{len(lines)}]]")
            elif m["strip"] and "वर्णमाला" in next(filter(str.strip, reversed(out)), ""):
                out.append(row_of("GRID_ROW", cells[0]))
            else:
                out += lines
    return "\n".join(out)


#: Patterns of administrative strips and of blanks to fill.
ADMIN = re.compile(r"\s*(?:class\s*:|subject\s*:|time\s*:|name\b[^|]{0,50}:|roll\b[^|]{0,15}:|invigilator\b|(?:total\s+)?marks\b)", re.I)
BLANKED = re.compile(r"[0-9०-९]+(?:[.)।]\s*|\s+)\S.*(?:_{2,}|\(\s*\))\s*\Z", re.S)
_TABLE_ROW = re.compile(r"\s*\[\[TABLE_ROW:\s*(.*)\]\]\s*", re.I | re.S)


def _strip_cells(line: str) -> list[str]:
    """The two to four numbered blanks of a line."""
    cells = [c.strip() for c in CELLS.split(line)]
    return cells if "[[" not in line and 2 <= len(cells) <= 4 and all(len(c) <= 300 and BLANKED.match(c) for c in cells) else []


def _admin_cells(line: str) -> list[str]:
    """The cells of an administrative strip, as text or as a row already."""
    row = _TABLE_ROW.fullmatch(line)
    body = row[1] if row else line
    cells = [c.strip() for c in CELLS.split(body)]
    fits = ADMIN.match(body) and "[[" not in body and (1 if row else 2) <= len(cells) <= 8 and max(map(len, cells)) <= 300
    return cells if fits else []


def native_rows(text: str) -> str:
    """Strips of numbered blanks as MATCH_ROW; administrative strips before a paper's first question as TABLE_ROW, a blank line between such of different widths."""
    lines = text.split("\n")
    strips = [_strip_cells(x) for x in lines]
    events = [False if x.strip().upper() == "[[PAPER_BREAK]]" else True if ITEM.match(x) or strip else None for x, strip in zip(lines, strips)]
    asked = list(accumulate(events, lambda before, now: before if now is None else now, initial=False))[1:]
    heads = [[] if started else _admin_cells(x) for x, started in zip(lines, asked)]
    out = []
    for line, strip, head, above in zip(lines, strips, heads, [[], *heads]):
        if head and above and len(head) != len(above):
            out.append("")
        out.append(row_of("MATCH_ROW", strip) if strip else row_of("TABLE_ROW", head) if head else line)
    return "\n".join(out)


#: Letter sequences that writing exercises name by their ends.
SEQUENCES = [
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "अ आ इ ई उ ऊ ऋ ए ऐ ओ औ".split(),
    "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह".split(),
]
#: Where each letter stands: its sequence and its number there.
_LETTER = {c: (k, n) for k, seq in enumerate(SEQUENCES) for n, c in enumerate(seq)}
#: Patterns of an instruction to write a range of letters, and of what makes boxes needless.
_SPAN = re.compile(r"([A-Za-z\u0904-\u0939])\s*[”\"'’]?\s*(?:से|to|through|[-–])\s*[“\"'‘]?\s*([A-Za-z\u0904-\u0939])(?:\s|[”\"'’]|तक|[.,।]|$)", re.I)
_ASKS_LETTERS = [re.compile(x, re.I) for x in ("write|लिख|वर्णमाला", "alphabet|letters?|वर्णमाला|अक्षर", _SPAN.pattern)]
_ASKS_OTHER = re.compile("missing|complete|fill|रिक्त|खाली|पूर", re.I)
_HAS_BOXES = re.compile(r"\[\[(?:GRID|TABLE|ANSWER_LINES)|_{3,}|[□▢]", re.I)


def _letter_count(line: str) -> int:
    """How many letters the range that the line names has; 0 without one."""
    (seq, a), (other, b) = (_LETTER.get(c, (None, 0)) for c in _SPAN.search(line).groups())
    return max(0, b - a + 1) if seq is not None and seq == other else 0


def writing_boxes(text: str) -> str:
    """Empty boxes, ten a row, below an instruction to write an explicit range of letters, unless boxes are there."""
    lines = text.split("\n")
    out = []
    for line, near in zip(lines, ("\n".join(lines[i : i + 4]) for i in range(len(lines)))):
        asked = all(p.search(line) for p in _ASKS_LETTERS) and not _ASKS_OTHER.search(line) and not _HAS_BOXES.search(near)
        tens, rest = divmod(_letter_count(line) if asked else 0, 10)
        out += [line, *["[[GRID: 10x1]]"] * tens, *[f"[[GRID: {rest}x1]]"] * bool(rest)]
    return "\n".join(out)


#: Names of counted objects that readers use for the ones there are.
OBJECTS = {"grape": "grapes", "apples": "apple", "stars": "star", "faces": "smiley", "face": "smiley", "smileys": "smiley", "lollipops": "lollipop", "kites": "kite", "circles": "circle"}
_BLOCK = "|".join([*LINE_KINDS, "SOURCE_FIGURE_ROW", "SOURCE_FIGURE", "SOURCE_BANNER"])
_BEGINS = re.compile(rf"\s*(?:\[\[(?:{_BLOCK}):|(?:Class|Subject)\s*:)", re.I)
_LEAF = re.compile(r"\[\[([^\[\]\n]*)\]\](\s*=\s*\[\[\s*\]\])?")
_FIGURES_IN_ROW = re.compile(r"\[\[SOURCE_FIGURE_ROW:\s*((?:\[\[SOURCE_FIGURE:[^\]]*\]\]\s*(?:\|\|\s*)?)+)\]\]", re.I)


def _number(x: str) -> float:
    try:
        return float(x.strip() or 0)
    except ValueError:
        return math.nan


def _repaired_count(kind: str, body: str) -> str:
    """A counted figure with its object's usual name, its label with a point, and whole bounds around the given ones; what can't be read stays."""
    parts = [x.strip() for x in body.split("|")]
    if len(parts) != 4:
        return body
    data, label, answer, place = re.sub(r"\s*([,=])\s*", r"\1", parts[0]), *parts[1:]
    named = re.fullmatch(r"([a-z]+),(\d{1,2})", data, re.I)
    box = [_number(x) for x in place.split(",")]
    if len(box) != 4 or not all(map(math.isfinite, box)) or kind == "COUNT_OBJECTS" and not named:
        return body
    if kind == "COUNT_OBJECTS":
        data = f"{OBJECTS.get(named[1].lower(), named[1].lower())},{named[2]}"
    low = [math.floor(v) for v in box[:2]]
    size = [math.ceil(v + n) - at for v, n, at in zip(box, box[2:], low)]
    return "|".join([data, re.sub(r"\A(\d+)[.)]?\Z", r"\1.", label), answer.lower(), ",".join(map(str, low + size))])


def _repaired_leaf(m: re.Match) -> str:
    kind, colon, body = m[1].partition(":")
    if not m[1].strip():
        return "[[CHECKBOX]]" + (m[2] or "")
    if colon and kind.upper() in ("COUNT_OBJECTS", "ABACUS"):  # such a figure has its own answer box
        return f"[[{kind.upper()}: {_repaired_count(kind.upper(), body.strip())}]]"
    return m[0]


def open_after(depth: int, line: str) -> int:
    """How many markers are open behind the line."""
    return max(0, depth + line.count("[[") - line.count("]]"))


def closed_lines(text: str) -> str:
    """[F16] Openings with one bracket, counted figures and rows of wrapped figures repaired; a marker left open ends before the next block line."""
    text = re.sub(rf"(?<!\[)\[({_BLOCK}):", r"[[\1:", text, flags=re.I)
    text = re.sub(r"\[\[\s*\]\]", "[[CHECKBOX]]", _LEAF.sub(_repaired_leaf, text))
    text = _FIGURES_IN_ROW.sub(lambda m: row_of("SOURCE_FIGURE_ROW", [x.strip() for x in re.findall(r"\[\[SOURCE_FIGURE:\s*([^\]]*)\]\]", m[1], re.I)]), text)
    lines = text.split("\n")
    # Blocks begin at block lines, and nothing is open where one does.
    heads = [0, *(k for k, x in enumerate(lines) if k and _BEGINS.match(x)), len(lines)]
    for a, b in pairwise(heads):
        if (left := reduce(open_after, lines[a:b], 0)) and b < len(lines):
            lines[b - 1] = re.sub(r"\s*\|\|\s*\Z", "", lines[b - 1]) + "]]" * left
    return "\n".join(lines)


#: Patterns of place-value sections and of number ranges to write.
_PLACE_VALUE = re.compile(r"tens\s+and\s+ones", re.I)
_NUMBERS = re.compile(r"\bwrite\s+(?:the\s+)?numbers?\s+from\s+(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\b", re.I)
_IN_WORDS = re.compile(r"\b(?:words?|names?)\b", re.I)
_DRAWN = re.compile(r"\[\[(?:GRID|TABLE_ROW|FIGURE)", re.I)


def _number_boxes(line: str, below: str) -> list[str]:
    """Boxes for the range of numbers that a line says to write, unless its section has some."""
    m = None if _IN_WORDS.search(line) or _DRAWN.search(below) else _NUMBERS.search(line)
    n = int(m[2]) - int(m[1]) + 1 if m else 0
    if not 1 <= n <= 100:
        return []
    return [f"[[GRID: 10x{n // 10}]]"] if n % 10 == 0 else [f"[[GRID: {n}x1]]"] if n < 10 else []


def maths_rows(text: str) -> str:
    """Strips of numbers as GRID_ROW, place-value rows as TABLE_ROW, and boxes for an explicit range of numbers to write. Sections are read one by one."""
    lines, out = text.split("\n"), []
    heads = [0, *(k for k, x in enumerate(lines) if k and HEADING.search(x)), len(lines)]
    for section in (lines[a:b] for a, b in pairwise(heads)):
        place = HEADING.search(section[0]) and _PLACE_VALUE.search(section[0])
        for k, line in enumerate(section):
            cells, strip = CELLS.split(line), re.split(r"\s*\|{1,2}\s*", line.strip())
            if "[[" not in line and place and len(cells) == 3:
                out.append(row_of("TABLE_ROW", cells))
            elif "[[" not in line and 5 <= len(strip) <= 52 and all(re.fullmatch(r"[0-9]{1,3}", c) for c in strip):
                out.append(row_of("GRID_ROW", strip))
            else:
                out += [line, *_number_boxes(line, "\n".join(section[k + 1 :]))]
    return "\n".join(out)


def maths_figure(kind: str, body: str) -> dict | None:
    """A counted figure or an abacus as values, or None where any part of it is out of its form."""
    data, label, answer, place = ([x.strip() for x in body.split("|")] + ["", "", "none", ""][len(body.split("|")) :])[:4]
    box = [int(x) if re.fullmatch(r"\s*\d+(?:\.0*)?\s*", x) else -1 for x in re.sub(r"\.0*(?=,|$)", "", place).split(",")] if place else []
    inside = len(box) == 4 and min(box) >= 0 and min(box[2:]) > 0 and max(box[0] + box[2], box[1] + box[3]) <= 1000
    if not re.fullmatch(r"(?:\d+[.)]?)?", label) or answer not in ("box", "none") or place and not inside:
        return None
    out = {"kind": kind, "label": label, "answer": answer == "box", "region": box or None}
    if kind == "COUNT_OBJECTS":
        m = re.fullmatch(rf"({'|'.join(sorted(set(OBJECTS.values())))}),(\d{{1,2}})", data, re.I)
        return out | {"object": m[1].lower(), "count": int(m[2])} if m and 1 <= int(m[2]) <= 30 else None
    rods = dict(re.findall(r"(?:\A|,)(Th|H|T|O)=(\d)(?=,|\Z)", data))
    return out | {"rods": {k: int(v) for k, v in rods.items()}} if 1 <= len(rods) == len(data.split(",")) <= 4 else None


#: Administrative fields and the words that name them.
FIELDS = {
    "exam": r"\bname\s+of\s+(?:the\s+)?examination\b", "roll": r"\broll\s*(?:no\.?|number)?\b|अनुक्रमांक|క్రమ సంఖ్య|வரிசை எண்|ಕ್ರಮ ಸಂಖ್ಯೆ|റോൾ നമ്പർ",
    "class": r"\bclass\b|कक्षा|తరగతి|வகுப்பு|ತರಗತಿ|ക്ലാസ്|শ্রেণি|درجہ", "subject": r"\bsub(?:ject)?\.?\s*:|(?:विषय|విషయం|పాఠ్యాంశం|பாடம்|ವಿಷಯ|വിഷയം|বিষয়|مضمون)\s*[:：]",
    "marks": r"\b(?:total\s+)?marks?\b|कुल\s*अंक|మొత్తం\s*మార్కులు|மொத்த மதிப்பெண்கள்|ಒಟ್ಟು ಅಂಕಗಳು|ആകെ മാർക്ക്", "name": r"(?:\bname|नाम|పేరు|பெயர்|ಹೆಸರು|പേര്)\s*[:：]",
    "date": r"(?:\bdate|दिनांक|తేదీ|தேதி|ದಿನಾಂಕ)\s*[:：]", "time": r"(?:\btime|समय|సమయం|நேரம்|ಸಮಯ)\s*[:：]",
}
_FIELDS = {k: re.compile(v, re.I) for k, v in FIELDS.items()}


def field_labels(text: str) -> set[str]:
    """The administrative fields that a text names."""
    text = re.sub("<br>", " ", text, flags=re.I)
    return {k for k, p in _FIELDS.items() if p.search(text)}


_CONTROL, _ROW = re.compile(r"\s*\[\[TABLE_(?:REGION|WIDTHS|HEADER):", re.I), re.compile(r"\s*\[\[TABLE_ROW:\s*(.*?)\]\]\s*\Z", re.I | re.S)
_ORDINAL = re.compile(r"\s*(?:\[\[(?:SECTION_ROW|QUESTION_ROW):\s*)?([IVX]{1,6})(?:[.)\s]|$)", re.I)


def ordinal(line: str) -> int:
    from folioforge.functions.text import ROMAN

    m = _ORDINAL.match(line)
    return ROMAN.index(m[1].upper()) + 1 if m and m[1].upper() in ROMAN else 0


@dataclass
class Block:
    """Neighbouring table lines; a control line after a row begins another block. Any other line is a block of its own, without rows."""

    start: int
    end: int
    rows: list[str]
    labels: set[str]

    @property
    def width(self) -> int:
        return max((len(CELLS.split(r)) for r in self.rows), default=0)

    @property
    def is_header(self) -> bool:
        return len(self.labels) >= 3 or len(self.labels) == 2 and "name" in self.labels and bool(self.labels & {"marks", "roll", "class", "subject"})


def blocks_of(lines: list[str]) -> list[Block]:
    # A line is a control line, a row, or something else; blocks are words c*r* of these.
    codes = "".join("c" if _CONTROL.match(x) else "r" if _ROW.match(x) else "." for x in lines)
    out = []
    for m in re.finditer(r"c+r*|r+|\.", codes):
        own = lines[m.start() : m.end()]
        rows = [_ROW.match(x)[1] for x in own if _ROW.match(x)]
        out.append(Block(m.start(), m.end(), rows, set() if m[0] == "." else field_labels(" ".join(own))))
    return out


_ASKED = re.compile(r"\s*(?:\[\[QUESTION_ROW:\s*)?[0-9०-९]+[.)।]\s")
_NEW_PAPER = re.compile(r"\s*\[\[(?:PAPER_BREAK\]\]\s*\Z|SOURCE_BANNER:)", re.I)
_NEW_PAGE = re.compile(r"\s*\[\[(?:PAGE_BREAK|PAPER_BREAK|SOURCE_BANNER):", re.I)
#: How many lines behind a header a cleaner reading of it is looked for.
AHEAD = 18


def is_question(line: str) -> bool:
    return bool(ordinal(line) or _ASKED.match(line))


def _read_again(block: Block, later: list[Block], lines: list[str]) -> bool:
    """Whether a cleaner reading of a crowded header follows before the first question: as many fields in fewer columns or more rows."""
    if not (block.width > 5 or len(block.rows) == 1 and len(block.labels) >= 5):
        return False
    near = takewhile(lambda b: b.start < block.end + AHEAD and not is_question(lines[b.start]) and not _NEW_PAGE.match(lines[b.start]), later)
    return any(len(b.labels & block.labels) >= 3 and (b.width < block.width or len(b.rows) > len(block.rows)) for b in near)


def without_repeated_headers(text: str) -> str:
    """[W13] Administrative tables on continuation pages go, and crowded ones that are read again; the first of a paper stays."""
    lines, out, started = text.split("\n"), [], False
    found = blocks_of(lines)
    for k, block in enumerate(found):
        if _NEW_PAPER.match(lines[block.start]):
            started = False
        elif block.is_header:
            n = ordinal(next((x for x in lines[block.end :] if x.strip() and not _CONTROL.match(x)), ""))
            if started and n > 1 or not started and _read_again(block, found[k + 1 :], lines):
                continue
            started = started and n != 1
        else:
            started = started or any(map(is_question, lines[block.start : block.end]))
        out += lines[block.start : block.end]
    return without_repeated_prelude(re.sub(r"\n{3,}", "\n\n", "\n".join(out)))


def heading_words(line: str) -> str:
    """The words of a heading, without number, score and marks."""
    plain = re.split(r"\s*\|\|", re.sub(r"^\s*\[\[SECTION_ROW:\s*", "", line, flags=re.I))[0]
    return re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"^\s*[IVX]{1,6}[.)\s]+", "", plain, flags=re.I)).strip().lower()


def without_repeated_prelude(text: str) -> str:
    """[W14] A plain line that says in at least twelve characters what the section row below it says goes blank."""
    lines = text.split("\n")
    solid = [k for k, x in enumerate(lines) if x.strip()]
    for above, below in pairwise(solid):
        plain = not lines[above].lstrip().startswith("[[") and not ordinal(lines[above])
        if plain and ordinal(lines[below]) and re.match(r"\s*\[\[SECTION_ROW:", lines[below], re.I):
            words = heading_words(lines[above])
            if len(words) >= 12 and words == heading_words(lines[below]):
                lines[above] = ""
    return "\n".join(lines)


def grid_cells(text: str) -> str:
    """[W12] Runs of single-character lines as one GRID_ROW; other lines pass."""
    out: list[str] = []
    held: list[str] = []
    for line in [*text.split("\n"), None]:
        if line is not None and len(line.strip()) == 1:
            held.append(line)
            continue
        out += [f"[[GRID_ROW: {' || '.join(x.strip() for x in held)}]]"] if len(held) >= 8 else held
        held = []
        out += [] if line is None else [line]
    return "\n".join(out)


_GRID = re.compile(r"\[\[GRID:\s*(\d{1,2})\s*[x×]\s*(\d{1,2})\s*(?:\|\s*(?:\|\s*)?(?:none|box))?\s*\]\](?:[ \t]+(?:none|box)(?=[ \t]*(?:\n|$)))?", re.I)
_UNMARKED = re.compile(rf"\s*({'|'.join(LINE_KINDS)}):\s*(.*?)(?:\]\])?\s*\Z", re.I)


def one_line_each(text: str) -> str:
    """Markers that go over several lines on one."""
    lines = text.split("\n")
    depths = accumulate(lines, open_after, initial=0)
    starts = [k for k, d in zip(range(len(lines)), depths) if not d]
    return "\n".join(" ".join([lines[a], *map(str.strip, lines[a + 1 : b])]) for a, b in pairwise([*starts, len(lines)]))


def normalise(text: str) -> str:
    """All rules in their order: the one form of a reading."""
    for rule in (closed_lines, clean, maths_rows, pipe_tables, native_rows, writing_boxes):
        text = rule(text)
    lines = one_line_each(_GRID.sub(r"[[GRID: \1x\2]]", text)).split("\n")
    named = [row_of(m[1].upper(), [m[2]]) if (m := _UNMARKED.match(x)) else x for x in lines]
    return without_repeated_headers("\n".join(named))


def branches(text: str) -> str:
    """Branch diagrams as lines with arrows, the root beside the middle one."""
    def drawn(m: re.Match) -> str:
        root = m[1].strip()
        items = re.findall(r"^\s*\[\[BRANCH_ITEM:\s*(.*?)\s*\|\|\s*(.*?)\]\]\s*$", m[2], re.I | re.M)
        mid = len(items) // 2
        rows = [(f"○ {root} " if k == mid else " " * 5) + ("↗" if k < mid else "↘" if k > mid else "→") + f" {a.strip()}" + (f" ───────── {b.strip()}" if b.strip() else "") for k, (a, b) in enumerate(items)]
        return "\n".join(rows or [root])

    return re.sub(r"^\s*\[\[BRANCH_ROOT:\s*([^\n]*?)\]\]\s*$(.*?)(?:^\s*\[\[BRANCH_END\]\]\s*$|\Z)", drawn, text, flags=re.I | re.M | re.S)


def _plain(node: Node) -> str:
    body = "".join(p if isinstance(p, str) else _plain(p) for p in node.parts)
    cells = [c.strip() for c in CELLS.split(body)]
    k = node.kind or ""
    if k in ("FIGURE", "FIGURE_ROW"):
        return "    ".join((c.split("|")[1].strip() if "|" in c else "") or "[illustration]" for c in cells)
    if k in ("BANNER", "TABLE_WIDTHS", "TABLE_HEADER", "TABLE_REGION", "FOOTER", "SOURCE_PAGE"):
        return ""
    if k in ("PICTURE_ROW", "SHAPE_ROW"):
        return "    ".join(f"[{c} {k[:-4].lower()}] ______" for c in cells)
    if k == "GRID" and (m := re.fullmatch(r"(\d{1,2})[x×](\d{1,2})", body.strip(), re.I)):
        return "\n".join([" ".join("□" * min(52, int(m[1])))] * min(32, int(m[2])))
    if k == "ANSWER_LINES" and body.strip().isdigit():
        return "\n".join(["_" * 28] * min(10, int(body)))
    if k in ("SECTION_ROW", "QUESTION_ROW", "CHOICE_ROW"):
        return "    ".join(cells)
    if k == "GRID_ROW":
        return " | ".join("□" if c == "_" else c for c in cells)
    if k in ("TABLE_ROW", "MATCH_ROW"):
        return " | ".join(cells)
    if k == "ARITHMETIC_ROW":
        return "\n\n".join(re.sub("<br>", "\n", c, flags=re.I) for c in cells)
    if k == "OPTION_ROW":
        return "   ".join(f"{c} [ ]" for c in cells)
    if k in ("PICTURE", "PICTURE_OPTION"):
        return body.strip() + (" pic [ ]" if k == "PICTURE_OPTION" else " pic")
    if k == "REPLACE":
        return " ".join(x for x in (p.strip() for p in re.split(r"->|→|=>", body, maxsplit=1)) if x)
    if not k:
        return {"CHECKBOX": "[ ]", "PAGE_BREAK": "\n\n"}.get(body.strip().upper(), f"[[{body}]]")
    return body.strip()


def plain(text: str) -> str:
    """A reading without markers, as a person would type it."""
    out = "".join(p if isinstance(p, str) else _plain(p) for p in parse(branches(text)))
    return unicodedata.normalize("NFC", re.sub(r"\[unclear:\s*[^\]]+\]", "[unclear]", out, flags=re.I)).strip()


_GUARDED = re.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\b\d{4}\b|[0-9०-९౦-౯]+(?:[.,/][0-9०-९౦-౯]+)*|[।॥!?;:]+|\n")


def protect(text: str) -> tuple[str, list[str]]:
    """[F8] Dates, years, numerals, marks and breaks behind placeholders, and what they stand for."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"\ue010{len(kept) - 1}\ue011"

    return _GUARDED.sub(hide, text), kept


def restore(text: str, kept: list[str]) -> str:
    """[F8] The inverse of protect()."""
    return re.sub("\ue010(\\d+)\ue011", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)


def styled_runs(text: str) -> list[tuple[str, str]]:
    """(style, text) runs of a line with inline annotations."""
    out = []
    for p in parse(text):
        if isinstance(p, str):
            if p:
                out.append(("", p))
        else:
            out.append(((p.kind or "bare").lower(), render(p.parts)))
    return out


def over_texts(rule: Callable[[str], str]):
    """The rule as a function on a string column; null stays null."""
    @arrow_udf(StringType())
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rule(t) for t in texts.to_pylist()], pa.string())

    return apply
