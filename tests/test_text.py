import re

import pytest
from pyspark.sql import functions as F

from driftlens.functions.regex import spell
from driftlens.functions.text import (
    CLOSE,
    OPEN,
    balanced_braces,
    find_all,
    line_col,
    normalise_body,
    offset_to_line,
    starts_like_operation,
    strip_quotes,
)

TEXTS = [
    "",
    "test",
    "a test, Testée\n\tunknown_x invalid\r\nextra",
    "née übertest test\u00a0dummy\u2003x\n\n\ntest",
    "x" * 50 + "\n" + "test " * 700,
    "emoji 😀 test 😀😀 unknown\n😀 test",
    f"held {OPEN} test {CLOSE} test",
    'f(first: "ten", last:\n\'x\')\n{ a(  ) b{ } }',
]
PATTERNS = [
    (r"\b(?:invalid|unknown|test|dummy|extra)\w*\b", "i"),
    (r"\w+", ""),
    (r"\s+", ""),
    (r"^\s*\w+", "m"),
    (r"(['\"]{1,3})([\s\S]*?)(\1)", ""),
    (r"(\w+)\s*\(\s*\)", "i"),
    (r"[^)]*\)", ""),
    (r"(\w+)\s*:\s*(\w+)(?!\s*\[)", ""),
]


@pytest.mark.parametrize("pattern,flags", PATTERNS)
def test_find_all_equals_finditer(spark, pattern, flags):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = df.select("id", F.inline(find_all(F.col("text"), pattern, flags))).collect()
    mode = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)
    expected = []
    for key, text in enumerate(TEXTS):
        for hit in re.finditer(pattern, text, mode):
            before = text[: hit.start()]
            shown = hit.group().replace(OPEN, "\ufffd").replace(CLOSE, "\ufffd")
            expected.append((key, shown, hit.start(), before.count("\n"), len(before.rsplit("\n", 1)[-1])))
    assert sorted(map(tuple, got)) == sorted(expected)


def test_spell_keeps_classes_and_backreferences():
    assert spell(r"[^\w]\1") == r"(?d)[^\p{L}\p{N}_]\1"
    assert spell(r"[\s\S]*", "im").startswith("(?dium)(?s:.)")


def test_positions(spark):
    text = "ab\ncd\n"
    df = spark.createDataFrame([(i,) for i in range(8)], "at int").withColumn("text", F.lit(text))
    line, col = line_col(F.col("text"), F.lit(10), F.col("at"))
    shifted, _ = line_col(F.col("text"), F.lit(10), F.col("at"), 1)
    rows = df.select("at", line, col, shifted, offset_to_line(F.col("text"), F.col("at"))).orderBy("at").collect()
    assert [tuple(r)[1:3] for r in rows] == [(10, 1), (10, 2), (10, 3), (11, 1), (11, 2), (11, 3), (10, 1), (10, 1)]
    assert [r[3] for r in rows] == [11, 11, 11, 12, 12, 12, 11, 11]
    assert [r[4] for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3]


def test_bodies(spark):
    rows = [
        ("class A: # x\n\tb = 1\u00a0", "classA:b=1"),
        (None, ""),
        ("# only", ""),
    ]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select(normalise_body(F.col("raw")), "want").collect())


def test_quotes_and_predicates(spark):
    rows = [('"""a"""', "a"), ("'a'", "a"), ('"a', '"a'), ("'''a\"\"\"", "'''a\"\"\""), ('""', ""), ("a", "a"), ('"', "")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select(strip_quotes(F.col("raw")), "want").collect())
    df = spark.createDataFrame([(" \n QUERY x {}", True, True), ("a query", False, False), ("fragment {", True, False)], "t string, s boolean, b boolean")
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(starts_like_operation(F.col("t")), "s", balanced_braces(F.col("t")), "b").collect())


def test_strip_takes_every_blank(spark):
    from driftlens.functions.regex import BLANK, BLANKS
    from driftlens.functions.text import strip

    every = spark.range(0xFFFE).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    blank = every.filter(F.regexp_like("c", F.lit(spell(f"^[{BLANK}]\\z"))))
    assert {r.c for r in blank.collect()} == set(BLANKS)
    pad = F.concat("c", F.lit(" a"), "c", F.lit("b　"), "c")
    was = F.regexp_replace(pad, spell(r"^\s+|\s+\z"), "")
    assert every.filter(~was.eqNullSafe(strip(pad))).count() == 0
