"""Column functions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from driftgauge.functions import intervals, items, numerals, stats

NUMBERS = [
    ("42", 42.0), ("答案 42", 42.0), ("jibu ni 42", 42.0), ("४२", 42.0), ("৪২ টাকা", 42.0), ("๔๒", 42.0), ("١٢٣", 123.0),
    ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("1 234,5", 1234.5), ("12,345", 12345.0), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("1.234.567,89", 1234567.89), ("3,14", 3.14), ("-17", -17.0), ("+8", 8.0),
    ("3 apples and 5 pears. The answer is 8", 8.0), ("Antwort: 12 of 30", 30.0), ("Réponse : 7", 7.0), ("Ответ: 9", 9.0), ("2 then 4.", 4.0), ("ends 4,", 4.0),
    ("none", None), ("", None), ("...", None), ("0", 0.0), ("5 3", 53.0), ("5\n3", None), ("answer without; 7 before answer", 7.0), ("1 234", 1234.0), ("1 234,5", 1234.5), ("1 234", None), (None, None), ("²", 2.0),
]


def test_numerals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", numerals.final_number(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [v for _, v in NUMBERS]


def test_tolerance(spark):
    df = spark.createDataFrame([(1.0, 1.00009, True), (1.0, 1.0002, False), (1e6, 1e6 + 99, True), (1e6, 1e6 + 101, False)], "g double, x double, ok boolean")
    assert all(r.ok == r.m for r in df.withColumn("m", numerals.matches(F.col("g"), F.col("x"))).collect())


@pytest.mark.parametrize(("raw", "base", "n", "want"), [("1", 1, 4, 0), ("4", 1, 4, 3), ("0", 0, 3, 0), ("2", 0, 3, 2), ("A", None, 4, 0), ("d", None, 4, 3), ("1", None, 3, None), ("5", 1, 4, None), ("E", None, 4, None), ("x", 0, 4, None), (None, 0, 4, None)])
def test_answers(spark, raw, base, n, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(items.answer_index(F.col("a"), base, F.lit(n))).first()[0] == want


def test_answers_refuse(spark):
    with pytest.raises(ValueError):
        items.answer_index(F.lit("1"), 2, F.lit(4))
    with pytest.raises(Exception, match="no valid answer"):
        spark.range(1).select(items.answer_index(F.lit("9"), 0, F.lit(4), strict=True)).collect()


def test_options(spark):
    rows = [(["a", "b", "c", None, None], ["a", "b", "c"], False), (["a", "b", "", "  "], ["a", "b"], False), (["a", "b"], ["a", "b"], False), (["a", None, "c", None], ["a", None, "c"], True), ([], [], False)]
    df = spark.createDataFrame(rows, "o array<string>, want array<string>, hole boolean")
    for r in df.withColumn("got", items.stripped_options(F.col("o"))).withColumn("h", items.has_hole(F.col("o"))).collect():
        assert (r.got, r.h) == (r.want, r.hole)


def test_ids_and_prompts(spark):
    df = spark.createDataFrame([("p1", 1, "It rained.", " Effect ", "wet", "dry"), ("p1", 2, "x", "why?", "a", "b")], "link string, n int, premise string, q string, a string, b string")
    assert [r[0] for r in df.select(items.item_id(["link", "n"])).collect()] == ["p1␟1", "p1␟2"]
    with pytest.raises(ValueError):
        items.item_id("__row_index__")
    q, c = items.question_of({"premise": "premise", "question": "q"})
    prompts = [r[0] for r in df.select(items.choice_prompt(q, items.options_of({"options": ["a", "b"]}), c)).collect()]
    assert prompts[0] == "It rained.\n\nWhat happened as a result?\nA. wet\nB. dry\nAnswer with a single letter from A to B.\nAnswer:"
    assert "why?" in prompts[1]
    nli, none = items.question_of({"premise": "premise", "hypothesis": "a"})
    row = df.select(nli, none).first()
    assert row[0] == "It rained.\nQuestion: wet True, False, or Neither?" and row[1] is None
    assert df.select(items.without_last_line(F.lit("a\nb\nc"))).first()[0] == "a\nb"


def test_interval_sets(spark):
    df = spark.sql("SELECT array(named_struct('lo', 0D, 'hi', 1D), named_struct('lo', 2D, 'hi', 4D)) AS s")
    s = F.col("s")
    r = df.select(intervals.contains(s, 1.0), intervals.contains(s, 1.5), intervals.width(s), intervals.measure(s), intervals.negate(s), intervals.shift(s, 1.0), intervals.hull(s), intervals.union(s, F.expr("array(named_struct('lo', 0.5D, 'hi', 2D))"))).first()
    assert (r[0], r[1], r[2], r[3]) == (True, False, 4.0, 3.0)
    assert [tuple(x) for x in r[4]] == [(-4.0, -2.0), (-1.0, 0.0)] and [tuple(x) for x in r[5]] == [(1.0, 2.0), (3.0, 5.0)]
    assert tuple(r[6]) == (0.0, 4.0) and [tuple(x) for x in r[7]] == [(0.0, 4.0)]


def test_statistics(spark):
    z = [0.0, 0.5, 1.96, -3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.two_sided_p(F.col("z"))).collect()]
    assert all(abs(a - math.erfc(abs(x) / math.sqrt(2))) < 2e-7 for a, x in zip(got, z, strict=True))
    r = spark.sql("SELECT 1000D AS big, 1D AS y").select(stats.softplus(F.col("big")), stats.log_loss(F.col("big"), F.col("y")), stats.two_sided_p(F.lit(float("nan"))), stats.wald_z(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(r) == (1000.0, 0.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        stats.minimax_floor(-1)
