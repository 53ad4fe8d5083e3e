import pytest
from pyspark.sql import types as T

from tideline.sources import ingest, sinks


def test_publish_and_latest(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root)
    sinks.publish(spark.range(5), root, None)
    (tmp_path / "t" / "v99999999999999999-broken").mkdir()  # a version that was not finished
    assert sinks.latest(spark, root).count() == 5
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        sinks.latest(spark, str(tmp_path / "none"))


def test_csv_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id, name \n1, x \nbad,line,here\n2,y\n")
    (tmp_path / "b_skip.csv").write_text("id,name\n9,z\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    good, bad = ingest.read_csv_lenient(spark, str(tmp_path / "a.csv"), schema)
    assert sorted(r["id"] for r in good.select("id", "name").collect()) == [1, 2] and bad.count() == 1
    trimmed = ingest.trimmed(good)
    assert [r["name"] for r in trimmed.orderBy("id").collect()] == ["x", "y"]
    assert ingest.read_csvs(spark, str(tmp_path / "*.csv"), "skip").count() == 3
    sinks.write_csv(good, str(tmp_path / "out"), gzip=True)
    assert list((tmp_path / "out").glob("*.csv.gz"))
    assert ingest.read_csv(spark, str(tmp_path / "out"), schema, ["id"]).columns == ["id"]


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, own double")
    with pytest.raises(KeyError):
        ingest.require(df, ["a", "b"])
    with pytest.raises(KeyError):
        ingest.gated(df, ["own"], ["a", "own"])
    assert ingest.gated(df, ["own"]).columns == ["a"]
    assert ingest.gated(df, ["own"], include=True).columns == ["a", "own"]


def test_results(spark, tmp_path):
    df = sinks.tidy(spark.createDataFrame([("x", 1, 2.0)], "k string, n int, v double"), ["k"])
    assert sorted(map(tuple, df.collect())) == [("x", "n", 1.0), ("x", "v", 2.0)]
    sinks.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
