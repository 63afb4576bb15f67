
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(samples: DataFrame, path: str) -> None:
    """[K1, K6] One JSON object per row; Spark's commit makes the folder whole or absent (K5)."""
    samples.write.mode("errorifexists").json(path)


def preview(blocks: DataFrame) -> DataFrame:
    """[K3] Per document the JSON list of its blocks in order, page breaks left out."""
    item = F.struct("line_no", F.struct(F.col("kind").alias("type"), "text").alias("b"))
    return blocks.where("kind <> 'pagebreak'").groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"])).alias("preview"))


def put_with_expiry(rows: DataFrame, path: str, now: Column, days: int) -> None:
    """[K4] Appends rows that count until now + days; unexpired() reads them back."""
    rows.withColumn("expires_at", now + F.make_interval(days=F.lit(days))).write.mode("append").parquet(path)


def unexpired(table: DataFrame, now: Column) -> DataFrame:
    """[K4, S15] What has not expired; the filter reaches the Parquet scan."""
    return table.where(F.col("expires_at") > now)


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def word_package(blocks: list[tuple[str, str]]) -> bytes:
    """[K2] An A4 Word file of (kind, text) blocks; a page break takes effect on the block after it."""
    out, broken = [], False
    for kind, text in blocks:
        if kind == "pagebreak":
            broken = True
            continue
        props = ("<w:keepNext/>" if kind in ("title", "section") else "") + ("<w:pageBreakBefore/>" if broken else "") + ('<w:jc w:val="center"/>' if kind == "title" else "")
        broken = False
        out.append(f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t xml:space="preserve">{escape(text or "")}</w:t></w:r></w:p>')
    page = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="720" w:right="720" w:bottom="720" w:left="720"/></w:sectPr>'
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(out)}{page}</w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", body)):
            z.writestr(zipfile.ZipInfo(name), content)
    return data.getvalue()


def render_packages(blocks: DataFrame) -> DataFrame:
    """[K2] (doc_id, content): a Word file per document from blocks (doc_id, line_no, kind, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_package([(b["kind"], b["text"]) for b in doc]) for doc in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    item = F.struct("line_no", "kind", "text")
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("blocks")).mapInArrow(run, "doc_id long, content binary")
