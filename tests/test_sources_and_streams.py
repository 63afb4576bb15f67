import io
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.sources import binary as B
from folioforge.sources import sinks as K
from folioforge.streaming import usage as U


def archive(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    return data.getvalue()


PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj [(Wor) -20 (ld 1)] TJ (Hello \\(x\\)) Tj ET") + b"\nendstream\nendobj"


@pytest.fixture
def folder(spark, tmp_path):
    for name, content in {
        "a.docx": K.word_package([("title", "T & U"), ("section", "I. Do"), ("pagebreak", ""), ("text", "x")]), "b.pptx": archive({f"ppt/slides/slide{k}.xml": f"<a:p>s{k}</a:p>" for k in (10, 2, 1)}),
        "c.pdf": PDF, "d.xlsx": archive({"xl/sharedStrings.xml": "<si><t>one</t></si><si><t>two</t></si>"}), "e.txt": b"caf\xc3\xa9 \xff", "f.docx": b"\x00\x01", "g.bin": b"?",
    }.items():
        (tmp_path / name).write_bytes(content)
    return B.files(spark, f"file://{tmp_path}")


def test_readers(folder):
    got = {r.path.rpartition("/")[2]: r for r in B.read_texts(folder).collect()}
    assert got["a.docx"].text == "T & U\nI. Do\nx" and got["b.pptx"].text == "s1\ns2\ns10"
    assert got["c.pdf"].text.split("\n")[:2] == ["Hello (x)", "World 1"] and got["c.pdf"].is_scan
    assert got["d.xlsx"].text == "one two" and got["f.docx"].error and got["f.docx"].text is None
    assert B.text_files(folder).first().text.startswith("café ")


def test_word_round_trip(folder):
    rows = [(r.ord, r.kind, r.text) for r in B.word_blocks(folder).where("path LIKE '%a.docx'").orderBy("ord").collect()]
    assert rows == [(0, "title", "T & U"), (1, "section", "I. Do"), (2, "text", "x")]
    assert B.check_package(K.word_package([])) == [] and "page is not A4" in B.check_package(archive({"[Content_Types].xml": "", "_rels/.rels": "", "word/document.xml": "<a/>"}))
    assert B.check_package(b"no") == ["not an archive"]


def test_sinks(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "title", "a"), (1, 1, "pagebreak", ""), (1, 2, "text", "b")], "doc_id long, line_no int, kind string, text string")
    assert K.preview(blocks).first().preview == '[{"type":"title","text":"a"},{"type":"text","text":"b"}]'
    assert B.office_text(K.render_packages(blocks).first().content) == "a\nb"
    path = f"file://{tmp_path}/kv"
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    K.put_with_expiry(spark.range(3), path, now, 2)
    K.put_with_expiry(spark.range(3, 5), path, now, 30)
    later = F.timestamp_seconds(F.lit(1_700_000_000 + 3 * 86400))
    assert sorted(r.id for r in K.unexpired(spark.read.parquet(path), later).collect()) == [3, 4]
    K.write_jsonl(spark.range(2), f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def events():
    at = pd.Timestamp("2024-01-01 10:00")
    rows = [(k, at + pd.Timedelta(minutes=k), "reserve", None, 1000.0) for k in range(10)]
    rows += [(20, at + pd.Timedelta(minutes=20), "settle", 200.0, 1000.0), (21, at + pd.Timedelta(minutes=21), "reserve", None, 10.0), (22, at + pd.Timedelta(minutes=22), "add", 9990.0, None), (23, at + pd.Timedelta(minutes=23), "add", 50.0, None)]
    rows += [(30, at + pd.Timedelta(days=1), "exhausted", None, None), (31, at + pd.Timedelta(days=1, minutes=1), "reserve", None, 1.0)]
    return pd.DataFrame(rows, columns=["event_id", "ts", "op", "amount", "reserve"])


def test_ledger_stream(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    e = events()
    for part in (e[:6], e[6:]):
        spark.createDataFrame(part).select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in U.EVENTS.split(", "))).coalesce(1).write.mode("append").parquet(src)
        U.run_available(U.ledger(U.event_stream(spark, src)), out, f"file://{tmp_path}/cp")
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert len(got) == len(e)
    assert [got[k].allowed for k in range(10)] == [True] * 9 + [False]
    assert got[20].booked == 8200 and got[21].allowed and got[22].used == 9990 and got[23].used == 10000 and got[23].requests == 2
    table = {r.event_id: r for r in U.ledger_of(spark.read.schema(U.EVENTS).parquet(src)).collect()}
    assert table == got
    assert got[31].allowed is False and got[31].exhausted and got[30].day == "2024-01-02"


def test_requests_once(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "request_id string, s long").select("request_id", F.timestamp_seconds("s").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("request_id string, ts timestamp").parquet(src)
    U.run_available(U.once_per_request(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert sorted(r.request_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]


def test_history_is_thinned():
    history, state = [], (0.0, 0.0, 0, False)
    for k in range(400):
        state, _ = U.ledger_step(state, "add", 1.0, 0.0, history, str(k))
        assert len(history) <= 144 and history[-1][0] == str(k)
    assert history[0][0] == "0"
