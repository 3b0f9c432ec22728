"""Reads in balanced parts from a database in memory, the one whose driver comes with Spark."""

import datetime

import pytest
from pyspark.sql import functions as F

from govlake.sources import databases

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def url(spark):
    url = "jdbc:derby:memory:govlake_tests;create=true"
    # nine tenths of the rows have keys in a hundredth of the range
    skewed = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1000).alias("k"), F.concat(F.lit("n'"), F.col("id").cast("string")).alias("name"))
    skewed.write.option("createTableColumnTypes", "name VARCHAR(40)").jdbc(url, "SKEWED", properties=DRIVER)
    days = spark.createDataFrame([(None if i % 10 == 0 else datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 7), i) for i in range(100)], "d date, i int")
    days.write.jdbc(url, "DAYS", properties=DRIVER)
    return url


def sizes(df):
    return [n for n in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").toPandas().n]


def test_parts_are_balanced_on_a_skewed_key(spark, url):
    got = databases.read(spark, url, "SKEWED", "k", 5, **DRIVER)
    assert sizes(got.rows) == [200] * 5 and tuple(got.facts.first())[1:] == ("SKEWED", 1000, 1000, False)
    assert got.rows.select("k").distinct().count() == 1000
    assert max(sizes(databases.read(spark, url, "SKEWED", "name", 4, **DRIVER).rows)) <= 300


def test_null_keys_and_ties_are_read_once(spark, url):
    got = databases.read(spark, url, "DAYS", "d", 4, **DRIVER)
    assert got.rows.count() == 100 and got.rows.where("d IS NULL").count() == 10 and got.rows.select("i").distinct().count() == 100


def test_caps_are_told_and_the_first_table_is_the_default(spark, url):
    assert databases.tables(spark, url, **DRIVER) == ["DAYS", "SKEWED"]
    got = databases.read(spark, url, limit=30, **DRIVER)
    assert got.rows.count() == 30 and tuple(got.facts.first())[1:] == ("DAYS", 100, 30, True)
    spark.createDataFrame([], "k int").write.jdbc(url, "NOTHING", properties=DRIVER)
    assert databases.read(spark, url, "NOTHING", "k", 3, **DRIVER).rows.count() == 0
    with pytest.raises(ValueError):
        databases.tables(spark, "jdbc:odd:x")
