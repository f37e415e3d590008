"""Literal cases of detectors, repairs, bins, sessions and sources."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import detectors as D
from gleaner.operators import histogram as H
from gleaner.operators import scatter as S
from gleaner.operators import summary as A
from gleaner.operators import wranglers as W
from gleaner.plans import payload
from gleaner.plans.session import Session
from gleaner.sources import ID, id_range, ingest, load, table_name, with_id
from gleaner.streaming import fit_limits, stream_errors


def cells(df):
    return sorted((r["column_id"], r["row_id"]) for r in df.collect())


@pytest.mark.parametrize("name, want", [("sales_data.csv", "sales_data"), ("5table.csv", "table5table"), ("$name.csv", "table_name")])
def test_table_name(name, want):
    assert table_name(name) == want


def test_missing(spark):
    df = spark.createDataFrame([(1, None, "cat"), (2, "null", "undefined"), (3, "Null", " ")], "ID long, a string, b string")
    assert cells(D.missing_value(df)) == [("a", 1), ("a", 2), ("b", 2)]
    assert cells(D.missing_value(df, client=True)) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "ID long, x double")
    assert cells(D.missing_value(nan)) == [("x", 1)]


def test_anomaly(spark):
    rows = [(i, 10.0 + i % 3, str(i % 2)) for i in range(1, 12)] + [(12, 500.0, "x")]
    df = spark.createDataFrame(rows, "ID long, x double, t string")
    assert cells(D.anomaly(df)) == [("x", 12)]
    assert cells(D.anomaly(df.limit(9))) == []  # fewer than ten numbers
    assert cells(D.anomaly(df.withColumn("x", F.lit(3.0)), ["x"])) == []  # no deviation


def test_incomplete(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a"] * 3 + ["b"] * 2 + ["c", None], 1)], "ID long, v string")
    assert cells(D.incomplete(df)) == [("v", 4), ("v", 5), ("v", 6)]
    many = spark.createDataFrame([(i, str(i)) for i in range(1, 13)], "ID long, v string")
    assert cells(D.incomplete(many)) == []  # more than ten numbers


def test_mismatch_and_its_tie(spark):
    values = ["100", "100", "250", "250", "100", "many", "few", "some", "lots", "none"]
    df = spark.createDataFrame(list(enumerate(values, 1)), "ID long, cap string")
    assert cells(D.datatype_mismatch(df)) == [("cap", i) for i in range(6, 11)]
    assert cells(D.datatype_mismatch(df.where("ID > 5 or ID = 1"))) == [("cap", 1)]


def test_own_detector(spark):
    D.register_detector("long_text", lambda df: D.flagged(df, {"v": F.length("v") > 3}, "long"))
    try:
        assert cells(D.run_detectors(spark.createDataFrame([(1, "abcd"), (2, "a")], "ID long, v string"), ["long_text"])) == [("v", 1)]
    finally:
        del D.DETECTORS["long_text"]


def test_average_and_impute(spark):
    df = spark.createDataFrame([(1, 10.0, "A"), (2, -5.0, "B"), (3, 0.0, "A"), (4, None, None), (5, 2.25, "B")], "ID long, x double, t string")
    assert W.average(df, "x").first()["value"] == 6.1  # mean of positives, half to even
    assert W.average(df, "t").first()["value"] == "A"  # a tie goes to the first
    got = {r["ID"]: (r["x"], r["t"]) for r in W.impute(W.impute(df, "x", [4, 99]), "t", [4]).collect()}
    assert got[4] == (6.1, "A") and got[2] == (-5.0, "B") and len(got) == 5
    empty = spark.createDataFrame([(1, None, None)], "ID long, x double, t string")
    assert W.average(empty, "x").first()["value"] == 0 and W.impute(empty, "t", [1]).first()["t"] is None


def test_remove(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "ID long")
    assert [r["ID"] for r in W.remove_rows(df, ["2", 99]).orderBy(ID).collect()] == [1, 3]


def test_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 20, 30, 40, 50], 1)], "ID long, v long")
    rows, _ = H.binned(df, "v", n=3)
    assert [r["x_bin"] for r in rows.orderBy(ID).collect()] == [0, 0, 1, 2, 2]
    same, _ = H.binned(df.withColumn("v", F.lit(5)), "v", n=3)
    assert {r["x_bin"] for r in same.collect()} == {1}


def test_histogram_with_errors_and_empty_bins(spark):
    df = spark.createDataFrame([(1, "US", 1), (2, "US", 9), (3, None, 5), (4, "DK", None)], "ID long, c string, v long")
    errors = spark.createDataFrame([(1, "c", "mismatch"), (1, "v", "anomaly"), (3, "c", "missing")], D.ERRORS)
    got = {r["x"]: (r["items"], r["errors"]) for r in H.histogram(df, errors, "c").collect()}
    assert got == {"US": (2, {"mismatch": 1}), "DK": (1, {})}
    grid = H.histogram(df, errors, "c", "v", m=2).collect()
    assert len(grid) == 4 and sum(r["items"] for r in grid) == 2
    assert payload.histogram(df, errors, "v", n=2)["histograms"][0]["count"] == {"items": 2, "anomaly": 1}
    none = H.histogram(df.withColumn("z", F.lit(None).cast("string")), errors, "z").collect()
    assert [(r["x"], r["items"]) for r in none] == [("null", 4)]


def test_scatter_limits(spark):
    df = spark.createDataFrame([(i, i, "k") for i in range(1, 21)], "ID long, x long, y string")
    errors = spark.createDataFrame([(i, "x", "anomaly") for i in range(1, 6)], D.ERRORS)
    got = S.sample(df, errors, "x", "y", bad=2, total=5).collect()
    assert len(got) == 5 and sum(r["has_error"] for r in got) == 2
    assert len(S.entries(df, errors, "x", "y", bad=30, total=100).collect()) == 20


def test_summary(spark):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, 2.7, None), (3, 3.2, "a")], "ID long, x double, t string")
    assert A.numeric_stats(df, ["x"]).first()["mean"] == pytest.approx(2.4667, abs=1e-4)
    assert A.categorical_stats(df, ["t"]).first().asDict() == {"column_id": "t", "distinct_values": 2, "mode": "a"}
    assert A.error_distribution(D.missing_value(df), df).first()["fraction"] == pytest.approx(1 / 3)
    assert [r["ID"] for r in A.failing(df, "x", ">", "2").collect()] == [1]
    assert {r["ID"] for r in A.failing(df, "t", "=", "a").collect()} == {2}


def test_session(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(1, 5)], "ID long, v string")
    s = Session(df)
    s.apply("remove", [1])
    assert s.preview("remove", [2]).table.count() == 2 and s.current.table.count() == 3
    s.apply("remove", [2])
    assert s.undo().table.count() == 3 and s.undo().table.count() == 4 and s.undo().table.count() == 4
    assert s.redo().table.count() == 3
    s.apply("remove", [3])
    assert s.redo().table.count() == 2 and "WRANGLERS['remove'](df, [3])" in s.script()


def test_ids_and_ingest(spark, tmp_path):
    good = spark.createDataFrame([("x", 7), ("y", 3)], "a string, ID long")
    assert with_id(good).columns == ["ID", "a"]
    bad = spark.createDataFrame([("x", 7), ("y", 7)], "a string, ID long")
    got = with_id(bad, ["a"])
    assert got.columns == ["ID", "a", "Original_ID"] and sorted(r["ID"] for r in got.collect()) == [1, 2]
    path = tmp_path / "My data.csv"
    path.write_text("name,n\nab,1\n,2\n")
    name = ingest(spark, str(path), str(tmp_path), ["n"])
    table, errors = load(spark, name, str(tmp_path))
    assert name == "my_data" and id_range(table, 1, 1).count() == 1
    assert ("name", 2) in cells(errors)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0 + i % 2) for i in range(1, 20)] + [(20, 99.0), (21, None)], "ID long, x double")
    df.write.parquet(str(tmp_path / "in"))
    limits = fit_limits(df, ["x"])
    found = stream_errors(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limits, ["x"])
    q = found.writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert cells(spark.table("found")) == [("x", 20), ("x", 21)]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
