from pyspark.sql import Window
from pyspark.sql import functions as F

from potable.operators.numbering import dense_ordinal, running_total


def test_dense_ordinal_matches_row_number_with_a_hot_group(spark):
    # one group holds a third of the rows, cut into many slices
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("o"),
        F.col("id"),
    )
    got = dense_ordinal(df, ["g"], ["o", "id"], "n", num_slices=7)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    j = got.join(ref, ["g", "o", "id"])
    assert j.count() == 3000
    assert j.where("n <> r").count() == 0


def test_running_total_matches_a_window_with_a_hot_group(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("o"),
        (F.col("id") % 13).alias("v"),
    )
    got = running_total(df, ["g"], ["o"], "v", "before", num_slices=7)
    earlier = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("r", F.coalesce(F.sum("v").over(earlier), F.lit(0)))
    j = got.join(ref, ["g", "o"])
    assert j.count() == 3000
    assert j.where("before <> r").count() == 0
