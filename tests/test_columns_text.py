import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.kernels import lcs_length
from millrace.functions.kinds import normalize_nulls
from millrace.operators import columns as ops
from millrace.operators import fuzzy, text


def values(df, name):
    return [r[0] for r in df.select(F.col(f"`{name}`")).collect()]


def test_add_column_types_and_errors(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = ops.add_column(ops.add_column(df, "n", "number", "2.5"), "t", "empty")
    assert out.first().asDict() == {"a": 1, "n": 2.5, "t": None}
    assert dict(out.dtypes)["t"] == "string"
    with pytest.raises(ValueError):
        ops.add_column(df, "a")
    with pytest.raises(ValueError):
        ops.add_column(df, "b", "integer", "2.5")
    assert ops.split_new_names(df, [" x ", "a", "", "y", "x"]) == (["x", "y"], ["a", "x"])


def test_formula_division_and_modulo(spark):
    df = spark.createDataFrame([(7, -3), (-7, 3), (5, 0), (None, 2)], "a int, b int")
    assert values(ops.formula(df, "r", "a", "%", "b"), "r") == [-2, 2, None, None]
    assert values(ops.formula(df, "r", "a", "/", "b"), "r")[2:] == [None, None]
    floats = spark.createDataFrame([(5.5, -2.0), (-5.5, 2.0)], "a double, b double")
    assert values(ops.formula(floats, "r", "a", "%", "b"), "r") == [5.5 % -2.0, -5.5 % 2.0]


def test_predicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("B", 10000000.0)], "t string, v double")
    assert values(df.select(ops.predicate(df, "t", "=", "a").alias("p")), "p") == [True, False, False]
    assert values(df.select(ops.predicate(df, "t", "!=", "a").alias("p")), "p") == [False, True, True]
    assert values(df.select(ops.predicate(df, "t", "contains", "b").alias("p")), "p") == [False, False, True]
    assert values(df.select(ops.predicate(df, "v", "=", "10000000.0").alias("p")), "p") == [False, False, True]
    assert values(df.select(ops.predicate(df, "v", "=", "1").alias("p")), "p") == [False, False, False]
    numbers = spark.createDataFrame([("5d",), (" 5 ",), ("1e3",), ("inf",), ("0x1A",), ("1,000",)], "t string")
    assert values(numbers.select(ops.predicate(numbers, "t", ">", "0").alias("p")), "p") == [False, True, True, True, False, False]


def test_conditional_column_types(spark):
    df = spark.createDataFrame([(20, "x"), (10, "y"), (None, "z")], "age int, s string")
    adult = ops.predicate(df, "age", ">", 18)
    assert values(ops.conditional_column(df, "s", adult, "Adult"), "s") == ["Adult", "y", "z"]
    assert values(ops.conditional_column(df, "s", adult, "Adult", "Minor"), "s") == ["Adult", "Minor", "Minor"]
    with pytest.raises(TypeError):
        ops.conditional_column(df, "age", adult, "old")
    assert values(ops.conditional_column(df, "age", adult, "old", widen=True), "age") == ["old", "10", None]


def test_expr_column_mentions_column_twice(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    assert values(ops.expr_column(df, "r", "a + a + m", {"m": "max(a)"}), "r") == [6.0, 12.0]


def test_normalize_nulls(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert values(normalize_nulls(df), "v") == [None, 1.0]


@pytest.mark.parametrize(
    "source, expected",
    [("o'neil a1b x-y", "O'Neil A1B X-Y"), ("ÉCOLE no.1", "École No.1"), ("", ""), (None, None)],
)
def test_title_case(spark, source, expected):
    df = spark.createDataFrame([(source,)], "t string")
    assert values(text.clean_text(df, "t", case="title"), "t") == [expected]


def test_spaces_cover_unicode_and_order_is_fixed(spark):
    df = spark.createDataFrame([("  a   b\t",), (" x - y ",), (None,)], "t string")
    assert values(text.clean_text(df, "t", spaces=True), "t") == ["a b", "x - y", None]
    assert values(text.clean_text(df, "t", spaces=True, specials=True), "t")[1] == "x  y"


def test_replace_and_merge(spark):
    df = spark.createDataFrame([("a.b",), ("aXb",), (None,)], "t string")
    assert values(text.replace_text(df, "t", ".", "-"), "t") == ["a-b", "aXb", None]
    mapping = spark.createDataFrame([("a.b", "k")], "drop string, keep string")
    assert sorted(values(text.merge_values(df, "t", mapping), "t"), key=str) == sorted(["k", "aXb", None], key=str)
    with pytest.raises(ValueError):
        text.replace_text(df, "t", "", "x")


def reference_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs_matches_table(a, b):
    assert lcs_length(a, b) == reference_lcs(a, b)


@pytest.mark.parametrize("threshold", [70, 80, 95, 100])
def test_fuzzy_pairs_equal_brute_force(spark, threshold):
    import random

    rng = random.Random(threshold)
    words = {"".join(rng.choice("abcde é1") for _ in range(rng.randint(1, 14))) for _ in range(120)}
    words |= {w[:i] + w[i + 1 :] for w in list(words)[:60] for i in (0, len(w) // 2)} - {""}
    rows = [(w,) for w in sorted(words) for _ in range(1 + len(w) % 3)] + [(None,), ("",)]
    found = fuzzy.fuzzy_pairs(spark.createDataFrame(rows, "t string"), "t", threshold).collect()
    wanted = {
        (a, b): 200 * reference_lcs(a, b) / (len(a) + len(b))
        for a in words for b in words if a.encode() < b.encode() and 200 * reference_lcs(a, b) / (len(a) + len(b)) >= threshold
    }
    assert {(r.value_1, r.value_2): r.similarity for r in found} == pytest.approx(wanted)
    assert len(found) == len(wanted)
    assert all(r.count_1 == 1 + len(r.value_1) % 3 for r in found)
    assert [r.similarity for r in found] == sorted((r.similarity for r in found), reverse=True)


def test_length_histogram_and_profile(spark):
    df = spark.createDataFrame([("a",), ("bbb",), ("bbb",), (None,)], "t string")
    assert text.text_profile(df, "t").first().asDict() == pytest.approx(
        {"avg_length": 7 / 3, "max_length": 3, "min_length": 1, "unique_pct": 50.0}
    )
    assert {r.bin: r["count"] for r in text.length_histogram(df, "t", 2).collect()} == {0: 1, 1: 2}


def test_fuzzy_candidates_of_random_names_are_few(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 14))) for _ in range(4000)})
    values = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(names)], "_id long, _value string, _len int")
    assert fuzzy.candidate_pairs(values, 80).count() < 0.03 * len(names) ** 2 / 2


@pytest.mark.parametrize("threshold", [30, 70, 80, 95, 100])
def test_fuzzy_pairs_of_short_and_long_values(spark, threshold):
    r, values = random.Random(3), set()
    for base in ["".join(r.choice("abcxyz") for _ in range(k)) for k in (1, 2, 3, 5, 8, 13, 21, 34, 90, 200) for _ in range(3)]:
        for _ in range(5):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randrange(2)] = r.choice(["", "é", "z"])
            values.add("".join(w))
    values = sorted(values - {""})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if 200 * lcs_length(a, b) >= threshold * (len(a) + len(b)) - 1e-6}
    found = fuzzy.fuzzy_pairs(spark.createDataFrame([(x,) for x in values], "t string"), "t", threshold).collect()
    assert {(f.value_1, f.value_2) for f in found} == want and len(found) == len(want)


def test_fuzzy_lines_of_prose_meet_at_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "PASS", 2_000, raising=False)  # lines of one length in several passes
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    lines = [" ".join(r.choice(words) for _ in range(r.randrange(8, 60))) for _ in range(150)]
    # Edits at even distances, the hardest to meet at anything; as many as 95 % allow, or one more.
    lines += ["".join("#" if i % 20 == 10 else c for i, c in enumerate(line)) for line in lines[:40]]
    lines += [line[: len(line) // 2] + line[len(line) // 2 + len(line) // 11 :] for line in lines[40:80]]
    values = sorted(set(lines))
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if 200 * lcs_length(a, b) >= 95 * (len(a) + len(b)) - 1e-6}
    found = fuzzy.fuzzy_pairs(spark.createDataFrame([(x,) for x in lines], "t string"), "t", 95).collect()
    assert {(f.value_1, f.value_2) for f in found} == want and len(want) > 50
    numbered = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(values)], "_id long, _value string, _len int")
    assert fuzzy.candidate_pairs(numbered, 95).count() < 2 * len(want)
