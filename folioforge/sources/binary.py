"""Readers of document files: one row per file, page or block, from (path, content) as binaryFile gives them.

Formats are opened inside Arrow-fed Python functions, one file at a time; a file that can't be read gives a row
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.corpus import natural_format

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """[S13] path, length, content, format and digest of every file below path; formats decide the reader (S1)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "content", natural_format(F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"))


def text_files(table: DataFrame) -> DataFrame:
    """[S2] path, text of text files; bytes that are no UTF-8 become U+FFFD."""
    return table.where("format = 'text'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def members(content: bytes, wanted: str = "") -> dict[str, bytes]:
    """[S7, N18] The members of a zip archive by name, stored or deflated, whole; only names that match wanted from their start are unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and re.match(wanted, i.filename)}


def _decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _words(xml: str) -> str:
    xml = re.sub(r"(?i)<w:tab\s*/>", "\t", xml)
    xml = re.sub(r"(?i)<[wa]:br\s*/>|</(?:w|a|text):p>", "\n", xml)
    xml = re.sub("<[^>]+>", "", xml)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        xml = xml.replace(a, b)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+\n", "\n", xml)).strip()


def _number(name: str) -> int:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m[1]) if m else 0


def office_text(content: bytes) -> str:
    """[S5, O3] Text of docx (body, then headers, footers and notes), pptx (slides by number) and open documents."""
    try:
        parts = members(content, r"word/[^/]+\.xml|ppt/slides/[^/]+\.xml|content\.xml")
    except zipfile.BadZipFile:
        found = "\n".join(m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{4,}", content))
        if len(found) < 3:
            raise ValueError("no text found") from None
        return found
    word = [n for n in ("word/document.xml",) if n in parts] + sorted(n for n in parts if re.match(r"word/(?:header|footer|footnotes|endnotes)\d*\.xml$", n))
    slides = sorted((n for n in parts if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=_number)
    return "\n".join(t for n in word or slides or [n for n in ("content.xml",) if n in parts] if (t := _words(_decode(parts[n]))))


def sheet_text(content: bytes) -> str:
    """[S6] Shared strings of a workbook, or the text of its first sheet."""
    parts = members(content, r"xl/(?:sharedStrings|worksheets/sheet1)\.xml|content\.xml")
    name = next((n for n in ("xl/sharedStrings.xml", "xl/worksheets/sheet1.xml", "content.xml") if n in parts), None)
    return re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", _decode(parts[name]))).strip() if name else ""


_ESCAPE = re.compile(r"\\(?:([nrtbf()\\])|([0-7]{1,3})|\r?\n)")
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def pdf_string(raw: str) -> str:
    """[S4] The text of a literal string: escapes and octal codes resolved."""
    return _ESCAPE.sub(lambda m: _SIMPLE.get(m[1], m[1]) if m[1] else chr(int(m[2], 8) & 255) if m[2] else "", raw)


_SHOWN = re.compile(r"\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^()\\])*\)|[^\]])*)\]\s*TJ", re.S)


def pdf_text(content: bytes) -> str:
    """[S3] Strings that content streams show, each once, in order; printable runs if there are too few."""
    out: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", content, re.S):
        try:
            data = zlib.decompressobj().decompress(m[1])
        except zlib.error:
            data = m[1]
        for block in re.findall(r"BT(.*?)ET", data.decode("latin1"), re.S):
            for s in _SHOWN.finditer(block):
                text = pdf_string(s[1]) if s[1] is not None else "".join(pdf_string(x) for x in re.findall(r"\(((?:\\.|[^()\\])*)\)", s[2], re.S))
                if len(re.findall("[A-Za-z0-9]", text)) >= 2:
                    out.append(text.strip())
    if len(out) < 10:
        out += [m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{6,}", re.sub(rb"stream\r?\n.*?endstream", b"", content, flags=re.S)) if re.search(rb"[A-Za-z]{3}", m) and b"obj" not in m]
    return "\n".join(dict.fromkeys(out))


READERS = {"pdf": pdf_text, "office": office_text, "sheet": sheet_text}


def read_texts(table: DataFrame) -> DataFrame:
    """[S3, S5, S6, S13] path, format, text, chars, is_scan (a page file with at most 200 characters) and error, of every PDF, office or sheet file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "format", "content"))):
                try:
                    text, error = READERS[kind](content or b""), None
                except Exception as e:  # a broken file is a finding, not the end of the job
                    text, error = None, f"{type(e).__name__}: {e}"[:200]
                rows.append((path, kind, text, len(text or ""), kind == "pdf" and len(text or "") <= 200, error))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["path", "format", "text", "chars", "is_scan", "error"])

    return table.where(F.col("format").isin(*READERS)).select("path", "format", "content").mapInArrow(run, "path string, format string, text string, chars int, is_scan boolean, error string")


def docx_rows(content: bytes) -> list[tuple[int, str, str, bool]]:
    """[S11, S12, S14] Blocks of a Word file in body order: ordinal, kind (title, section, text, table), text, bordered.

    A kept-with-next centred paragraph is a title, another kept-with-next one a section; a two-cell table row is a MATCH_ROW.
    """
    body = ElementTree.fromstring(members(content, "word/document.xml")["word/document.xml"]).find(f"{W}body")
    out: list[tuple[int, str, str, bool]] = []
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            props = e.find(f"{W}pPr")
            keep = props is not None and props.find(f"{W}keepNext") is not None
            jc = props.find(f"{W}jc") if props is not None else None
            centred = jc is not None and jc.get(f"{W}val") == "center"
            out.append((len(out), "title" if keep and centred else "section" if keep else "text", said(e), False))
        elif e.tag == f"{W}tbl":
            bordered = e.find(f"{W}tblPr/{W}tblBorders") is not None
            for tr in e.iter(f"{W}tr"):
                cells = [said(c).strip() for c in tr.findall(f"{W}tc")]
                kind = "MATCH_ROW" if len(cells) == 2 else "TABLE_ROW"
                out.append((len(out), "table", f"[[{kind}: {' || '.join(cells)}]]", bordered))
    return out


def word_blocks(table: DataFrame) -> DataFrame:
    """[S12] path, ord, kind, text, bordered of every block of the Word files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, *r) for r in docx_rows(content or b"")]
                except Exception:
                    rows.append((path, -1, "error", None, None))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["path", "ord", "kind", "text", "bordered"])

    return table.where(F.col("path").endswith(".docx")).select("path", "content").mapInArrow(run, "path string, ord int, kind string, text string, bordered boolean")


def check_package(content: bytes) -> list[str]:
    """[P28] What a Word package lacks: parts, an A4 page, margins, relationships."""
    try:
        parts = members(content, r"\[Content_Types\]\.xml|word/document\.xml|_rels/")
    except zipfile.BadZipFile:
        return ["not an archive"]
    found = [f"missing {n}" for n in ("[Content_Types].xml", "word/document.xml", "_rels/.rels") if n not in parts]
    if "word/document.xml" in parts:
        root = ElementTree.fromstring(parts["word/document.xml"])
        size, margin = root.find(f".//{W}pgSz"), root.find(f".//{W}pgMar")
        if size is None or (size.get(f"{W}w"), size.get(f"{W}h")) != ("11906", "16838"):
            found.append("page is not A4")
        if margin is None:
            found.append("no margins")
    return found


def checked_packages(table: DataFrame) -> DataFrame:
    """[P28] path and, joined by semicolons, what each Word file lacks; empty if nothing. A null content is no archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lacks = ["; ".join(check_package(c or b"")) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(lacks, pa.string())], ["path", "lacks"])

    return table.where(F.col("path").endswith(".docx")).select("path", "content").mapInArrow(run, "path string, lacks string")
