"""Literal rows that the driver's Latin-only tables lack, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(sql_value, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def values_sql(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


BASE = 1_000_000_000
TEXTS = [
    "यह एक परीक्षा पत्र है और इसमें दस प्रश्न हैं।",
    "ఇది ఒక ప్రశ్న పత్రం abc",
    "இது ஒரு கேள்வித்தாள்",
    "ab कखग",
    "abc कख",
    "",
    "_" * 250,
    "a" * 79 + " " + "b" * 80,
    "I. Fill in the blanks 5x2=10\n1. The cat ____ \n2. Dog [unclear: x]\n[[PICTURE: tree]]",
    "II) Match 10 x 3 = 31\nIII. Tick 4×5/40=20\nIV. Name (2*3)",
    "[[SECTION_ROW: V. Write || 3M]]\n\u00a0\n  \n1. x\ufffd",
    "```text\nhello\nworld\n```",
    "Founded in 1871 and again 1877, not 2001 or 15999",
    "<w:p>one<w:tab/>two</w:p><w:p>a &amp; b &lt;c&gt;</w:p>\n\n\n\n<b>x</b>&nbsp;y",
    "Class: 5\nName: Asha\nName: Asna\nPlace - Delhi",
    "enti idi", "ela are you", "meeru",
    "I. Fill in the blanks\n1. The cat\n2. The dog\nII. Read\n1. a ____", "I. Write true or false\n1. a ( )\n2. b\n3. c", "I. Write true or false\n1. a\n( )\n2. b ( )",
    "[[SECTION_ROW: III. Choose the correct option || 5M]]\n[[MATCH_ROW: 1. a ( ) || 2. b]]", "Class: 4\nI. खाली स्थान भरो\n१. क\n२. ख", "I. Choose the right answer\n1. a",
]
ROWS = [(BASE + k, t) for k, t in enumerate(TEXTS)]

NATIVE = "यह एक लंबा हिन्दी वाक्य है जो मूल पृष्ठ से पढ़ा गया था"
#: id, first reading, second reading, page number
READINGS = [
    (1, NATIVE, "This is a long sentence in another language", 1),
    (2, NATIVE, NATIVE + " [unclear]", 1),
    (3, "I. Read\n1. a\n2. b\nII. Write\n1. c", "I. Read\n1. a\n2. b\nII. Write\n1. c\n2. d", 1),
    (4, "I. Read\n1. a\n2. b\nII. Write\n1. c", "I. Read\n1. a\nII. Write\n1. c", 1),
    (5, "I. Read\n1. a\nII. Write\n1. c", "I. Read\n1. a\n1. c", 1),
    (6, "II. Write\n1. c\nIII. Name\n1. d", "I. Read\n1. b\nII. Write\n1. c\nIII. Name\n1. d", 1),
    (7, "[[FIGURE_ROW: 1,1,5,5|a || 9,9,5,5|b]]", "[[FIGURE: 1,1,5,5|a]]\n[[FIGURE: 9,9,5,5|b]]", 2),
    (8, "[[FIGURE: 1,1,5,5|a]]", "[[FIGURE: 2,2,5,5|a]]", 2),
    (9, "I. Read\n१. क\n२. ख", "I. Read\n१. क\n2. ख", 3),
    (10, "", "", 1),
    (11, "I. Fill in the blanks\n1. The cat sat on the ____\n2. The dog ran to ____", "I. Fill in the blanks\n1. The cat sat on the\n2. The dog ran to it", 2),
    (12, "I. Do these sums now\n1. seven = ____\n2. eight = ____\n3. nine - ____", "I. Do these sums now\n1. ____ seven\n2. eight = ____\n3. nine - ____", 2),
    (13, "I. Do these sums now\n1. seven = ____\n2. eight = ____", "I. Do these sums now\n1. seven == ____\n2. eight == ____", 2),
]
