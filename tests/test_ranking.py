import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailstat.operators.ranking import hash_rank, latest_before, running_count


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(60), rng.random() < 0.3, rng.randrange(5)) for i in range(400)]
    return spark.createDataFrame(data, "id long, k string, t long, flag boolean, v int").cache()


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_hash_rank_is_row_number(rows, digits):
    hashed = rows.withColumn("h", F.sha2(F.col("v").cast("string"), 256))
    want = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("h", "id")).cast("long"))
    got = hash_rank(hashed, ["k"], "h", "id", digits=digits)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_latest_before_is_the_last_flagged_row(rows, stretch):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("p", F.last(F.when(F.col("flag"), F.struct("t", "id", "v")), ignorenulls=True).over(w)).select("id", "p.t", F.col("p.id").alias("pid"), "p.v")
    got = latest_before(rows, ["k"], ["t", "id"], F.col("flag"), ["v"], "p", stretch).select("id", "p.t", F.col("p.id").alias("pid"), "p.v")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


@pytest.mark.parametrize("stretch", [1, 50, 1000])
def test_running_count_is_row_number(rows, stretch):
    want = rows.select("id", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long").alias("n"))
    got = running_count(rows, ["k"], "id", "n", stretch).select("id", F.col("n").cast("long").alias("n"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
