"""Null, NaN, rounding, division and tie rules on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from townhall.functions import semantics as s
from townhall.functions.tails import beta_lower, chi2_tail, chi2_tail_of, gamma_upper, t_two_sided
from townhall.operators import bins, reshape, selection, series


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_missing_differs_from_every_value(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert df.filter(s.differs(F.col("k"), "a")).count() == 2
    assert df.filter(F.col("k") != "a").count() == 1


def test_flags_are_never_unknown(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    assert [r.f for r in df.select(s.flag(F.col("v") > 0).alias("f")).collect()] == [True, False]


def test_sums_and_divisions(spark):
    df = spark.createDataFrame([(None, 0), (None, 2)], "v int, w int")
    assert df.agg(s.total(F.col("v")).alias("t")).first().t == 0
    assert [r.q for r in df.select(s.safe_div(F.lit(1), F.col("w")).alias("q")).collect()] == [None, 0.5]


@pytest.mark.parametrize("value,even,js", [(2.5, 2, 3), (3.5, 4, 4), (-2.5, -2, -2), (0.5, 0, 1)])
def test_rounding(spark, value, even, js):
    assert one(spark, s.round_even(F.lit(value))) == even
    assert one(spark, s.round_up(F.lit(value))) == js


def test_exact_rounding_is_pythons(spark):
    xs = [5.215, 15.645, 2.675, -2.675, 0.125, 1.005, -1.005, *(i / 1000 for i in range(-500, 500, 7))]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r.y == round(r.x, 2) for r in df.select("x", s.round_exact(F.col("x")).alias("y")).collect())


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("12.5",), (" 7 ",), ("*",), ("#",), (None,)], "v string")
    assert [r.n for r in df.select(s.number(F.col("v")).alias("n")).collect()] == [12.5, 7.0, None, None, None]


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r.v for r in s.nan_to_null(df).collect()] == [None, 1.0]


def test_row_reductions(spark):
    df = spark.createDataFrame([(1, None, 3), (None, None, None)], "a int, b int, c int")
    got = df.select(s.row_sum(["a", "b", "c"]).alias("s"), s.row_count(["a", "b", "c"]).alias("n"), s.row_mean(["a", "b", "c"]).alias("m")).collect()
    assert [tuple(r) for r in got] == [(4, 2, 2.0), (0, 0, None)]


def test_truncation_tripwire():
    assert s.truncation_suspect(1000) and s.truncation_suspect(1024) and not s.truncation_suspect(800)


def test_expectations_count_unknown_as_failing(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    assert [tuple(r) for r in s.expect(df, {"positive": F.col("v") > 0}).collect()] == [("positive", 2)]


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(17,), (18,), (24,), (25,), (109,), (110,), (None,)], "age int")
    got = [r.b for r in df.select(bins.cut(F.col("age"), bins.VOTER_AGES).alias("b")).collect()]
    assert got == [None, "18-24", "18-24", "25-34", "65-109", None, None]


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "v double")
    assert sorted((r.bin, r.n) for r in bins.histogram(df, "v", 2).collect()) == [(0, 1), (1, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r.bin, r.n) for r in bins.histogram(same, "v").collect()] == [(0, 2)]


def test_ranks_break_ties_by_order_and_skip_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 3.0)], "k string, v double").withColumn("g", F.lit(1))
    got = {r.k: r["rank"] for r in selection.rank_first(df, ["g"], "v", ["k"]).collect()}
    assert got == {"d": 1, "a": 2, "b": 3, "c": None}


def test_cascade_takes_the_first_predicate_that_matches(spark):
    df = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "y"), ("h", "z"), (None, "y")], "file string, v string")
    tried = [F.col("v") == "x", F.col("v") == "y"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(selection.fallback_cascade(df, ["file"], tried).collect()) == key([("f", "x"), ("g", "y"), (None, "y")])
    assert key(selection.fallback_cascade(df, ["file"], tried, "all").collect()) == key([("f", "x"), ("g", "y"), ("h", "z"), (None, "y")])


def test_series_alignment_and_gaps(spark):
    a = spark.createDataFrame([(2000, 2.0), (2001, 4.0)], "year int, value double")
    b = spark.createDataFrame([(2001, 2.0), (2002, 0.0)], "year int, value double")
    assert {r.year: r.ratio for r in series.ratio(a, b, "year").collect()} == {2000: None, 2001: 2.0, 2002: None}
    gap = spark.createDataFrame([("s", 1, 10), ("s", 2, None), ("s", 3, 13)], "k string, year int, v int")
    assert [r.v for r in series.fill_gap(gap, ["k"], "year", "v").orderBy("year").collect()] == [10, 11, 13]
    full = series.complete(spark.createDataFrame([("s", 2000, 1)], "k string, year int, v int"), ["k"], series.years(spark, 1999, 2001), {"v": 0})
    assert sorted((r.year, r.v) for r in full.collect()) == [(1999, 0), (2000, 1), (2001, 0)]


def test_base_that_is_missing_gives_missing(spark):
    df = spark.createDataFrame([("s", 2001, 5.0)], "k string, year int, v double")
    assert series.index_to_base(df, ["k"], "year", "v", 2000).first().indexed is None


def test_reshaping(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, x int, y int")
    assert [tuple(r) for r in reshape.wide_to_long(df, ["k"], ["x", "y"]).collect()] == [("a", "x", 1)]
    assert reshape.wide_to_long(df, ["k"], ["x", "y"], keep_missing=True).count() == 2
    renamed = reshape.rename_first_wins(spark.createDataFrame([(1, 2, 3)], "AREA int, area_title int, Other int"), {"area": "area_code", "area_title": "area_code"})
    assert renamed.columns == ["area_code", "other"] and renamed.first().area_code == 1
    sep = reshape.with_separator(spark.createDataFrame([(1.0, "a")], "ord double, label string"), "ord", "label", "x", 0.5).orderBy("ord")
    assert [r.label for r in sep.collect()] == ["x", "a"]
    pairs = reshape.by_position(spark.createDataFrame([("b",), ("a",)], "p string"), spark.createDataFrame([(2,), (1,)], "q int"), "p", "q")
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", 1), ("b", 2)]
    picks = spark.createDataFrame([(["a"],), (["none"],)], "c array<string>")
    assert [r.t for r in picks.select(reshape.toggled(F.col("c"), "b", "none").alias("t")).collect()] == [["a", "b"], ["b"]]
    assert [r.t for r in picks.select(reshape.toggled(F.col("c"), "none", "none").alias("t")).collect()] == [["none"], []]


def test_deepest_item(spark):
    items = F.array(*[F.struct(F.lit(v).alias("amount"), F.lit(n).alias("name")) for v, n in ((1.0, "a"), (3.0, "b"), (3.0, "c"))])
    assert one(spark, selection.deepest(items, "amount", "name")) == "b"
    assert one(spark, selection.deepest(F.array(F.struct(F.lit(0.0).alias("amount"), F.lit("a").alias("name"))), "amount", "name")) is None


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi2_tail(5.0, 0) == 1
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert gamma_upper(1, 2) == pytest.approx(math.exp(-2))
    assert beta_lower(2, 3, 0.4) == pytest.approx(0.5248)


def test_tail_columns(spark):
    rows = [(x, m) for m in (0, 1, 2, 3, 4, 7, 10, 31) for x in (0.0, 1e-6, 0.3, 2.0, 7.9, 8.1, 40.0, 300.0)]
    df = spark.createDataFrame(rows, "x double, m long").withColumn("p", chi2_tail_of(F.col("x"), F.col("m")))
    for x, m, p in df.collect():
        assert p == pytest.approx(chi2_tail(x, m), rel=1e-11, abs=1e-300), (x, m)
