from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from memberlens.session import shared_dir
from memberlens.sources import tables as src
from tests.helpers import rows


def test_cache_freshness(spark, fresh_dir):
    path, built = fresh_dir + "/c", []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert src.cached(spark, path, build).count() == 1
    assert src.cached(spark, path, build).count() == 1 and len(built) == 1
    assert src.cached(spark, path, build, now=datetime.now() + timedelta(hours=25)).count() == 2
    assert src.cached(spark, path, build, force=True).count() == 3


def test_csv_numbers(spark, fresh_dir):
    with open(fresh_dir + "/a.csv", "w") as f:
        f.write("name,v\nx,1.5\ny,(X)\nz,\n")
    assert rows(src.read_csv_numeric(spark, fresh_dir + "/a.csv", ["v"])) == [("x", 1.5), ("y", None), ("z", None)]


def test_metadata_keywords(spark):
    meta = spark.createDataFrame([("A1", "Income, median"), ("A2", "Other"), ("A3", "Percent unemployed")], "column_code string, label string")
    assert rows(src.columns_by_keyword(meta, {"income": "low", "unemploy": "high"}), "code", "direction") == [("A1", "low"), ("A3", "high")]


def test_declared_schema(spark, fresh_dir):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    src.insert_into(spark.createDataFrame([("x", 1)], "a string, b int"), schema, fresh_dir + "/t")
    src.insert_into(spark.createDataFrame([("y", 2)], "a string, b int"), schema, fresh_dir + "/t")
    assert rows(spark.read.parquet(fresh_dir + "/t"), "b", "a") == [(1, "x"), (2, "y")]
    with pytest.raises(Exception):
        src.insert_into(spark.createDataFrame([("x", "q")], "a string, b date"), schema, fresh_dir + "/t")


def test_reports(spark, fresh_dir):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>")
    src.write_report(df, fresh_dir + "/csv")
    src.write_report(df, fresh_dir + "/json", "json")
    assert spark.read.option("header", True).option("escape", '"').csv(fresh_dir + "/csv").first()["l"] == '["a","b"]'
    assert spark.read.json(fresh_dir + "/json").first()["l"] == ["a", "b"]


def test_stored_keeps_columns_and_prunes(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "a int, kind string, b int")
    back = src.stored(df, "stage", ["kind"])
    assert back.columns == df.columns and rows(back) == rows(df)
    plan = back.where("kind = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_names_and_catalogue(spark):
    src.session_table(spark.range(3), "three_rows")
    assert src.scan(spark, "three_rows").count() == 3
    assert "three_rows" in {r[0] for r in src.listed_tables(spark).collect()}
    assert rows(src.schema_catalogue({"t": spark.range(1)}), "table_name", "column_name", "data_type") == [("t", "id", "bigint")]
    assert rows(src.inline(spark, [(1, "a")], "k int, v string")) == [(1, "a")]
    assert src.map_chunks(spark.range(10), lambda f: f.assign(id=f["id"] * 2), "id long").agg({"id": "sum"}).first()[0] == 90


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
