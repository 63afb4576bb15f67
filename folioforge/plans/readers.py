"""The file readers, over one file per part: text, page, Word, slide, open document and sheet files, broken ones among them."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.corpus import natural_format
from folioforge.session import table
from folioforge.sources import binary as B

ENDINGS = ("txt", "pdf", "docx", "pptx", "odt", "xlsx")
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(members: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text)
    return data.getvalue()


def word_file(name: str, brand: str, kind: str, size: int) -> bytes:
    """A centred title, a section, a paragraph and a bordered row of two cells, with a header; parts and page setup by size."""
    p = lambda text, props="": f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"
    page = ('<w:pgSz w:w="11906" w:h="16838"/>' if size % 3 == 0 else '<w:pgSz w:w="9000" w:h="9000"/>') + ("<w:pgMar/>" if size % 5 else "")
    body = (p(name, '<w:pPr><w:keepNext/><w:jc w:val="center"/></w:pPr>') + p(f"I. {kind}", "<w:pPr><w:keepNext/></w:pPr>") + p(f"{name} &amp; {kind}")
            + f"<w:tbl><w:tblPr><w:tblBorders/></w:tblPr><w:tr><w:tc>{p(name)}</w:tc><w:tc>{p(brand)}</w:tc></w:tr></w:tbl><w:sectPr>{page}</w:sectPr>")
    parts = {"_rels/.rels": "<r/>"} | ({"[Content_Types].xml": "<t/>"} if size % 2 else {})
    return archive(parts | {"word/header1.xml": f"<w:hdr {NS}>{p(brand)}</w:hdr>", "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"})


def page_file(name: str, brand: str, size: int) -> bytes:
    """Strings shown one by one and in an array, in a deflated stream; ten of them but where size is even."""
    shown = "".join(f"({name} {k}) Tj\n" for k in range(1 if size % 2 == 0 else 10)) + "[(" + brand[:3] + ") -20 (" + brand[3:] + " \\(\\101\\))] TJ"
    return b"%PDF-1.4\n1 0 obj <</Length 9>>\nstream\n" + zlib.compress(f"BT {shown} ET".encode()) + b"\nendstream\nendobj\n"


def content(key: int, name: str, brand: str, kind: str, size: int) -> bytes:
    ending = ENDINGS[key % 6]
    if ending == "txt":
        return f"{name}\n{brand} ".encode() + (b"\xff" if size % 2 else "é".encode())
    if ending == "pdf":
        return page_file(name, brand, size)
    if ending == "docx":
        return word_file(name, brand, kind, size)
    if ending == "pptx":
        return b"\x00\x01" if size % 10 == 0 else archive({f"ppt/slides/slide{k}.xml": f"<a:p><a:t>{t}</a:t></a:p>" for k, t in ((10, brand), (2, name))})
    if ending == "odt":
        return archive({"content.xml": f"<text:p>{name}</text:p><text:p>{kind} &lt;{size}&gt;</text:p>"})
    return b"none" if size % 10 == 1 else archive({"xl/sharedStrings.xml": f"<si><t>{name}</t></si>\n<si><t>{brand}</t></si>"})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, format of one file for every part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            paths = [f"f{r['p_partkey']}.{ENDINGS[r['p_partkey'] % 6]}" for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([content(*r.values()) for r in rows], pa.binary())], ["path", "content"])

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return parts.mapInArrow(run, "path string, content binary").withColumn("format", natural_format(F.col("path")))


QUERIES = {
    "s2_text_files": lambda s, d: B.text_files(files(s, d)),
    "s3_s5_s6_read_texts": lambda s, d: B.read_texts(files(s, d)),
    "s12_word_blocks": lambda s, d: B.word_blocks(files(s, d)),
    "p28_checked_packages": lambda s, d: B.checked_packages(files(s, d)),
}
_PATH = "'f' || p_partkey || '.' || ['" + "', '".join(ENDINGS) + "'][p_partkey % 6 + 1] AS path"
ORACLE = {
    "s2_text_files": f"SELECT {_PATH}, p_name || chr(10) || p_brand || ' ' || CASE WHEN p_size % 2 = 1 THEN chr(65533) ELSE 'é' END AS text FROM part WHERE p_partkey % 6 = 0",
    "s3_s5_s6_read_texts": f"""
        WITH t AS (SELECT {_PATH}, p_partkey % 6 AS e, CASE p_partkey % 6
            WHEN 1 THEN array_to_string(list_transform(range(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 10 END), lambda k: p_name || ' ' || k), chr(10)) || chr(10) || p_brand || ' (A)' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '%PDF-1.4' ELSE '' END
            WHEN 2 THEN array_to_string([p_name, 'I. ' || p_type, p_name || ' & ' || p_type, p_name, p_brand, p_brand], chr(10))
            WHEN 3 THEN CASE WHEN p_size % 10 <> 0 THEN p_name || chr(10) || p_brand END
            WHEN 4 THEN p_name || chr(10) || p_type || ' <' || p_size || '>'
            ELSE CASE WHEN p_size % 10 <> 1 THEN p_name || ' ' || p_brand END END AS text FROM part WHERE p_partkey % 6 > 0)
        SELECT path, CASE e WHEN 1 THEN 'pdf' WHEN 5 THEN 'sheet' ELSE 'office' END AS format, text, CAST(len(coalesce(text, '')) AS INT) AS chars, e = 1 AND len(text) <= 200 AS is_scan,
            CASE WHEN text IS NULL AND e = 3 THEN 'ValueError: no text found' WHEN text IS NULL THEN 'BadZipFile: File is not a zip file' END AS error FROM t""",
    "s12_word_blocks": f"""
        WITH t AS (SELECT *, {_PATH} FROM part WHERE p_partkey % 6 = 2)
        SELECT path, 0 AS ord, 'title' AS kind, p_name AS text, false AS bordered FROM t UNION ALL SELECT path, 1, 'section', 'I. ' || p_type, false FROM t
        UNION ALL SELECT path, 2, 'text', p_name || ' & ' || p_type, false FROM t UNION ALL SELECT path, 3, 'table', '[[MATCH_ROW: ' || p_name || ' || ' || p_brand || ']]', true FROM t""",
    "p28_checked_packages": f"""SELECT {_PATH}, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'missing [Content_Types].xml' END, CASE WHEN p_size % 3 > 0 THEN 'page is not A4' END,
        CASE WHEN p_size % 5 = 0 THEN 'no margins' END], lambda x: x IS NOT NULL), '; ') AS lacks FROM part WHERE p_partkey % 6 = 2""",
}
