from datetime import date

from pyspark.sql import functions as F

from lodestar.operators import reviews


def test_reviews_that_cannot_fit_are_not_ranked(spark):
    rows = spark.range(400).select(F.when(F.col("id") >= 0, "a").alias("spot_id"), F.col("id").alias("review_id"), F.concat(F.lit("a quiet place number "), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"),
                                   F.when(F.col("id") >= 0, F.lit(date(2023, 12, 1))).alias("at"), F.lit(1.0).alias("rating"))
    out = reviews.selected(rows, F.lit("2024-01-01").cast("date"), 600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    # the longest first, of 400 characters that are 100 tokens and a header of 20
    assert [(r.review_id, r.place, len(r.text)) for r in out.orderBy("place").collect()] == [(399 - i, i + 1, 400) for i in range(5)]
    (alone,) = reviews.selected(rows, F.lit("2024-01-01").cast("date"), 10).collect()
    assert (alone.review_id, alone.place, len(alone.text)) == (399, 1, 200)
