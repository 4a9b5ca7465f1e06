from lodestar.operators import work


def test_reviews_are_counted_by_the_keys_that_are_given(spark):
    records = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "source_id long, expected int")
    reviews = spark.createDataFrame([(1, 7), (1, 7), (2, 1), (9, 1)], "source_id long, review_id long")
    got = work.missing_downloads(records, reviews, ["source_id"])
    assert {(r.source_id, r.loaded) for r in got.collect()} == {(1, 1), (3, 0)}
