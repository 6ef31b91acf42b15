"""The round trip of a manifest against its SQL."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def _manifest_against_sql(spark, rows, folder):
    folder.mkdir()
    rows.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["manifest_round_trip"])
    got = __spark_entry__.queries()["manifest_round_trip"](spark, str(folder)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_manifest_round_trip_over_splits(spark, tmp_path):
    """Lines keep their places when the text is read in many splits and written in many parts."""
    rows = spark.range(0, 3000, 1, 5).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    few = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for names in (list(few)[:2], list(few)):
        kept = {k: spark.conf.get(k) for k in names}
        try:
            for k in names:
                spark.conf.set(k, few[k])
            _manifest_against_sql(spark, rows, tmp_path / str(len(names)))
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v)


def test_manifest_round_trip_of_odd_ids(spark, tmp_path):
    """Repeated, negative, long and missing ids; texts that differ in case, by null or only beyond the BMP."""
    ids = [3, 3, 3, 3, 3, 3, -1, -20, 10, 12345678901, 12345678902, 2345678901, None, None, None]
    texts = ["b", None, "", "B", "\U0001f600", "�", "n", "m", "x", "q", "p", "r", "z", None, "y" * 70]
    long = "w" * 80
    more = [(7, long + "b"), (7, long + "a"), (7, long), (7, long)]
    rows = spark.createDataFrame([*zip(ids, texts), *more], "doc_id long, text string").repartition(6)
    _manifest_against_sql(spark, rows, tmp_path / "t")
