import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import columns as ops
from millrace.operators import dedup, profile, text
from millrace.plans import ORACLES, QUERIES
from millrace.sources import csv, sinks
from millrace.streaming import rowwise


def test_csv_types_and_missing_text(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('i,f,b,t,n\n1,2.5,True,"say ""x"", y",NA\n,NaN,false,null,\n3,-1e3,TRUE,007x,N/A\n')
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "n": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, True, 'say "x", y', None), (None, None, False, None, None), (3, -1000.0, True, "007x", None)]
    assert csv.read_csv(spark, path, limit=1, order_by=["t"]).count() == 1


def test_csv_keeps_long_numbers_and_refuses_surplus_fields(spark, tmp_path):
    path = str(tmp_path / "long.csv")
    with open(path, "w") as f:
        f.write("id,wide,over\n9007199254740993001,12345678901234567890123," + "9" * 40 + "\n9007199254740993002,5,1\n9007199254740993003,,2\n7\n")
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "wide": "decimal(38,0)", "over": "string"}
    assert {r.id for r in df.collect()} == {9007199254740993001, 9007199254740993002, 9007199254740993003, 7}
    with open(path, "w") as f:
        f.write("x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        csv.read_csv(spark, path).collect()
    with pytest.raises(Exception, match="more than 2 fields"):
        csv.read_csv(spark, path, infer=False).select("y").collect()


def test_csv_limit_orders_by_typed_values(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    with open(path, "w") as f:
        f.write("n\n10\n9\n100\n")
    assert [r.n for r in csv.read_csv(spark, path, limit=2, order_by=["n"]).collect()] == [9, 10]


def test_a_text_that_spells_a_digest_is_a_value_of_its_own(spark):
    long = "x" * 100
    spelled = spark.range(1).select(F.sha2(F.lit(long), 256).alias("s")).first().s
    df = spark.createDataFrame([(long,), (spelled,), ("#" + spelled,)], "t string")
    assert profile.column_info(df).first().asDict()["unique"] == 3
    assert QUERIES and dedup.duplicate_stats(df).first()["duplicate_rows"] == 0


def test_csv_encodings_and_line_breaks(spark, tmp_path):
    latin, lines = str(tmp_path / "l.csv"), str(tmp_path / "m.csv")
    with open(latin, "wb") as f:
        f.write("t\ncafé\n".encode("latin-1"))
    with open(lines, "w") as f:
        f.write('t,u\n"a\nb",1\n')
    assert csv.detect_encoding(spark, latin) == "latin-1"
    assert csv.read_csv(spark, latin).first().t == "café"
    assert csv.read_csv(spark, lines, multiline=True).first().t == "a\nb"
    with pytest.raises(ValueError):
        csv.read_csv(spark, latin, encoding="utf-7")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "i long, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, csv.read_csv(spark, str(tmp_path / "c")).collect())) == [(1, 'a "q", b'), (2, None)]
    sinks.write_report(profile.cleaning_report(df, df.dropna(), ["x"]), str(tmp_path / "r"))
    row = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert row["rows_removed"] == 1 and row["recent_actions"] == ["x"] and "timestamp" in row


def test_row_wise_steps_on_a_stream(spark, tmp_path):
    source = spark.createDataFrame([(1, " a  b "), (2, None), (3, "C")], "i int, t string")
    source.write.parquet(str(tmp_path / "in"))
    fill = rowwise.fit_fill(source, "t", "mode")
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    cleaned = rowwise.apply_steps(
        stream,
        lambda d: text.clean_text(d, "t", spaces=True, case="upper"),
        fill,
        lambda d: ops.conditional_column(d, "size", ops.predicate(d, "i", ">", 1), "big", "small"),
    )
    started = cleaned.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    started.processAllAvailable()
    started.stop()
    rows = sorted(tuple(r) for r in spark.table("cleaned").collect())
    assert rows == [(1, "A B", "small"), (2, fill.values["t"], "big"), (3, "C", "big")]


SLOW = {"train_classifiers", "train_regressors", "stack", "tune", "cross_validated"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_matches_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_queries import normal

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    want = normal([d[0] for d in found.description], found.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == want


def test_isolation_and_fuzzy_queries_run(spark, sf_dir):
    assert QUERIES["fuzzy_pairs"](spark, sf_dir).count() > 0
    flagged = QUERIES["isolation_forest"](spark, sf_dir)
    assert flagged.filter("is_outlier").count() <= 0.1 * flagged.filter(F.col("value").isNotNull()).count() + 1
