import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import columns as ops
from millrace.operators import dedup, missing, ordering, types


def column(df, name, order=None):
    rows = df.orderBy(order) if order else df
    return [r[0] for r in rows.select(F.col(f"`{name}`")).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, "b"), (3, 4.0, None), (4, 4.0, "b"), (5, None, "a"), (6, 11.0, None)], "i int, v double, t string"
    )


@pytest.mark.parametrize(
    "method, expected", [("mean", 5.0), ("median", 4.0), ("mode", 4.0), ("min", 1.0), ("max", 11.0), ("p10", 1.9), ("p90", 8.9)]
)
def test_fill_numbers(gaps, method, expected):
    assert column(missing.fill(gaps, "v", method), "v", "i")[1] == pytest.approx(expected)


def test_fill_text_and_constants(spark, gaps):
    assert column(missing.fill(gaps, "t", "mode"), "t", "i")[2] == "a"
    assert column(missing.fill(gaps, "t", "unknown"), "t", "i")[5] == "Unknown"
    assert column(missing.fill(gaps, "v", "constant", "7"), "v", "i")[1] == 7.0
    with pytest.raises(TypeError):
        missing.fill(gaps, "v", "constant", "none")
    assert column(missing.fill(gaps, "v", "constant", "none", widen=True), "v", "i")[1] == "none"
    empty = spark.createDataFrame([(None,), (None,)], "t string")
    assert column(missing.fill(empty, "t", "mode"), "t") == ["Unknown", "Unknown"]
    assert column(missing.fill(spark.createDataFrame([(None,)], "v double"), "v", "median"), "v") == [None]


def test_fill_of_whole_numbers_by_mean_is_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(column(missing.fill(df, "v", "mean"), "v")) == [1.0, 1.5, 2.0]


@pytest.mark.parametrize("slices", [None, 5])
def test_ordered_fills_match_pandas(spark, slices):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"i": rng.permutation(400), "g": rng.integers(0, 3, 400)})
    pdf["v"] = np.where(rng.random(400) < 0.7, np.nan, rng.normal(size=400).round(3))
    # A third of all rows share one order key; the second key breaks the tie.
    pdf["k"] = np.where(pdf.i < 133, 50, pdf.i)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6)
    ordered = pdf.sort_values(["k", "i"])
    forward = missing.ffill(df, "v", ["k", "i"]).toPandas().set_index("i").v
    backward = missing.bfill(df, "v", ["k", "i"], ["g"]).toPandas().set_index("i").v
    pd.testing.assert_series_equal(forward.sort_index(), ordered.assign(v=ordered.v.ffill()).set_index("i").v.sort_index(), check_names=False)
    by_group = ordered.assign(v=ordered.groupby("g").v.bfill()).set_index("i").v
    pd.testing.assert_series_equal(backward.sort_index(), by_group.sort_index(), check_names=False)
    placed = ordering.running_before(df, ["k", "i"], "pos", slices=slices).toPandas().set_index("i").pos
    assert placed.sort_index().tolist() == pd.Series(range(400), index=ordered.i).sort_index().tolist()


def test_ffill_with_full_ties_keeps_rows(spark):
    df = spark.createDataFrame([(1, 5.0)] * 50 + [(1, None)] * 50, "k int, v double")
    out = missing.ffill(df, "v", ["k"])
    assert out.count() == 100


def test_fill_by_group(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None), (None, 9.0)], "g string, v double"
    )
    out = missing.fill_by_group(df, "g", "v", "mean").collect()
    assert sorted([(r.g, r.v) for r in out], key=str) == sorted(
        [("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", None), (None, None), (None, 9.0)], key=str
    )
    assert [r.v for r in missing.fill_by_group(df, "g", "v", "sum").collect() if r.g == "b"] == [0.0]
    best = missing.fill_by_group(df, "g", "v", ["max", "median"], mode="best").collect()
    assert sorted(r.v for r in best if r.g == "a") == [1.0, 2.0, 3.0]


def test_suggest_and_apply(spark):
    rng = np.random.default_rng(0)
    rows = [
        (
            None if i % 10 == 0 else float(rng.normal()), None if i % 10 == 0 else float(rng.lognormal(0, 2)),
            None if i % 4 == 0 else "x", None if i % 4 == 0 else str(i % 5), None if i % 100 else "rare",
            None if i % 3 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i,
        )
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "n double, s double, m string, u string, d string, w timestamp_ntz, i int")
    advice = missing.suggest_cleaning(df)
    actions = {r.column: r.action for r in advice.collect()}
    assert actions == {
        "n": "Fill with Mean", "s": "Fill with 10th Percentile", "m": "Fill with Mode", "u": 'Fill with "Unknown"', "d": "Drop Column", "w": "Forward Fill"
    }
    with pytest.raises(ValueError):
        missing.apply_cleaning(df, advice)
    out = missing.apply_cleaning(df, advice, order_by=["i"])
    assert "d" not in out.columns
    assert missing.missing_summary(out).count() == 0
    report = missing.fill_report(df, out, ["n"]).first()
    assert report.filled_in_targets == 30 and report.remaining == 0 and set(report.columns_changed) == {"n", "s", "m", "u", "w"}
    assert missing.recommend_fill(spark.createDataFrame([(1.0,)], "v double"), "v").first().method == "mean"


def test_fill_where(gaps):
    out = missing.fill_where(gaps, "v", ops.predicate(gaps, "t", "=", "b"), "25")
    assert column(out, "v", "i") == [1.0, 25.0, 4.0, 4.0, None, 11.0]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None), (2, "y")], "a int, b string")
    assert dedup.duplicate_stats(df).first().asDict() == {"duplicate_rows": 2, "duplicate_pct": 40.0}
    assert [tuple(r) for r in dedup.duplicate_rows(df).collect()] == [(1, None)] * 3
    assert dedup.drop_duplicates(df).count() == 3
    assert dedup.duplicate_stats(df.limit(0)).first().asDict() == {"duplicate_rows": 0, "duplicate_pct": 0.0}


def test_duplicate_chunks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 7)
    df = spark.range(100).selectExpr("id % 3 AS k").unionAll(spark.createDataFrame([(9,)], "k bigint"))
    got = dedup.duplicate_rows(df).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {0: 34, 1: 33, 2: 33}


def test_long_texts_compare_whole(spark):
    a, b = "x" * 1000 + "a", "x" * 1000 + "b"
    assert dedup.duplicate_stats(spark.createDataFrame([(a,), (b,), (a,)], "t string")).first().duplicate_rows == 1


@pytest.mark.parametrize(
    "to, source, expected",
    [
        ("long", ["2.5", "3.5", "x", None, " 7 "], [2, 4, None, None, 7]),
        ("double", ["5d", " 5 ", "1e3", "0x1A", "1,000"], [None, 5.0, 1000.0, None, None]),
        ("timestamp", ["2024-01-05", "5/1/2024", "2024.1.5", "1/5/2024 3:04 PM", "soon"],
         [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 15, 4), None]),
        ("int", ["1", "x", None], [1, None, None]),
    ],
)
def test_convert(spark, to, source, expected):
    df = spark.createDataFrame([(s,) for s in source], "t string")
    assert column(types.convert(df, "t", to), "t") == expected


def test_convert_boolean_is_all_or_nothing(spark):
    df = spark.createDataFrame([("yes",), ("0",), (None,)], "t string")
    assert column(types.convert(df, "t", "boolean"), "t") == [True, False, None]
    with pytest.raises(ValueError):
        types.convert(df, "t", "bool")
    assert column(types.convert(df, "t", "bool", on_unmapped="null"), "t") == [None, False, None]


def test_suggest_and_apply_types(spark):
    rows = [(str(i), "n/a" if i % 15 == 0 else f"{i}.5", f"{1 + i % 28}/{1 + i % 12}/2024", "ab"[i % 2], f"id{i}" if i % 2 else str(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "w string, f string, d string, c string, m string, i int")
    found = {r.column: r for r in types.suggest_types(df).collect()}
    assert {c: r.suggested_type for c, r in found.items()} == {"w": "integer", "f": "float", "d": "datetime", "c": "category", "m": "string"}
    assert found["f"].confidence == "Medium" and found["d"].format == "d/M/yyyy"
    typed = types.apply_types(df, types.suggest_types(df), ["w", "d"])
    assert dict(typed.dtypes)["w"] == "bigint" and dict(typed.dtypes)["d"] == "timestamp_ntz" and dict(typed.dtypes)["f"] == "string"


def test_narrowing_limits_are_strict(spark):
    df = spark.createDataFrame([(0, -127, -128, 255, 256, 0.5, 0.1), (1, 127, 0, 0, 0, 1.0, 0.2)], "a long, b long, c long, d long, e long, f double, g double")
    narrow, changes = types.narrow_types(df)
    assert {r.column: r.narrow for r in changes.collect()} == {"a": "uint8", "b": "int8", "c": "int16", "d": "uint8", "e": "uint16", "f": "float32"}
    assert dict(narrow.dtypes) == {"a": "smallint", "b": "tinyint", "c": "smallint", "d": "smallint", "e": "int", "f": "float", "g": "double"}
    assert narrow.first().asDict()["c"] == -128


def test_whole_floats(spark):
    df = spark.createDataFrame([(1.0, 1.5), (None, 2.0)], "a double, b double")
    assert dict(types.whole_floats_to_long(df).dtypes) == {"a": "bigint", "b": "double"}


def test_long_texts_are_judged_like_short_ones(spark, monkeypatch):
    rows = [(str(i), f"{i}/3/2020" if i > 12 else "31/3/2020", "7" * 30 if i % 2 else "b 12") for i in range(60)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    short = types.suggest_types(df).collect()
    monkeypatch.setattr(types, "LONG_TEXT", 0)
    assert sorted(map(str, types.suggest_types(df).collect())) == sorted(map(str, short)) and len(short) >= 2
    assert types.suggest_types(df.limit(0)).collect() == []
