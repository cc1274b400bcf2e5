from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmask.operators.rank import global_rank


def test_global_rank_equals_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    r = global_rank(df, [F.col("k").desc(), "id"], "rank", num_partitions=7)
    w = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("k").desc(), "id")) - 1)
    j = r.join(w, ["k", "id"])
    assert j.count() == 5000
    assert j.filter("rank != rn").count() == 0
