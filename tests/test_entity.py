from datetime import datetime

from pyspark.sql import functions as F

from lodestar.operators import entity, reviews

NORTH_M = 1 / 111194.9  # degrees of latitude to a metre


def test_matches(spark):
    spots = spark.createDataFrame([
        (1, None, "Lake View Camp", "camping", 40.0, 3.0, True), (2, "osm1", "Old Mill", "parking", 41.0, 3.0, True), (3, None, "Beach", "parking", 42.0, 3.0, True), (4, None, "Ghost", "parking", 43.0, 3.0, False)],
        "spot_id long, anchor_id string, spot_name string, spot_type string, r_lat double, r_lon double, active boolean")
    records = spark.createDataFrame([
        (10, "a", "x1", None, "whatever", "parking", 0.0, 0.5), (11, "a", "x2", "osm1", "zzz", "wild", 0.0, 0.5),
        (12, "a", "x3", None, "Lake View Camping", "camping", 40.0 + 60 * NORTH_M, 3.0), (13, "a", "x4", None, "Lake View Camp", "wild", 40.0 + 10 * NORTH_M, 3.0),
        (14, "a", "x5", None, "Other name", "parking", 42.0 + 10 * NORTH_M, 3.0), (15, "a", "x6", None, "Other name", "parking", 42.0 + 60 * NORTH_M, 3.0),
        (16, "a", "x7", None, None, "parking", 42.0 + 60 * NORTH_M, 3.0), (17, "a", "x8", None, "Ghost", "parking", 43.0, 3.0)],
        "record_id long, source string, source_id string, anchor_id string, name string, type string, lat double, lon double")
    known = spark.createDataFrame([("a", "x1", 3)], "source string, source_id string, spot_id long")
    got = {r.record_id: (r.rule, r.spot_id) for r in entity.find_matches(records, spots, known).collect()}
    assert got == {10: (0, 3), 11: (1, 2), 12: (2, 1), 13: (None, None), 14: (2, 3), 15: (None, None), 16: (2, 3), 17: (None, None)}


def test_merges_and_references(spark):
    shells = spark.createDataFrame([(1, "A", "parking", 40.0, 3.0), (2, "Lake View", "parking", 41.0, 3.0), (3, "A", "camping", 42.0, 3.0)], "shell_id long, name string, type string, lat double, lon double")
    spots = spark.createDataFrame([(11, "B", "parking", 40.0 + 20 * NORTH_M, 3.0), (12, "Lake View Park", "parking", 41.0 + 50 * NORTH_M, 3.0), (13, "B", "wild", 42.0, 3.0)],
                                  "spot_id long, spot_name string, spot_type string, r_lat double, r_lon double")
    assert {(r.shell_id, r.spot_id) for r in entity.safe_merges(shells, spots).collect()} == {(1, 11), (2, 12)}
    mentions = spark.createDataFrame([(1, "lake view", "same_complex", 41.0, 3.0), (1, "nowhere", "other", 41.0, 3.0)], "spot_id long, mentioned_name string, relation string, lat double, lon double")
    others = spots.select(F.col("spot_id").alias("other_id"), F.col("spot_name").alias("other_name"), "r_lat", "r_lon")
    assert {tuple(r) for r in entity.cross_references(mentions, others).collect()} == {(1, 12, "same_complex"), (12, 1, "same_complex")}


def test_reviews(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, i, f"unique words number{i} alpha{i} beta{i} gamma{i}", day(1)) for i in range(14)]
    rows += [(1, 20, "very quiet place near the lake", day(2)), (1, 21, "very quiet place near the lake!", day(3)), (1, 22, "", day(3)), (2, 30, "same", day(1)), (2, 31, "same", day(1))]
    got = {r.review_id for r in reviews.drop_near_duplicates(spark.createDataFrame(rows, "spot_id long, review_id long, text string, at timestamp")).collect()}
    assert got == {*range(14), 21, 30, 31}
    df = spark.createDataFrame([("Lake View", "lake vew"), (None, "x")], "a string, b string")
    ratios = [r.x for r in df.select(reviews.sequence_ratio("a", "b").alias("x")).collect()]
    assert ratios[0] > 0.9 and ratios[1] == 0.0
    tags = [r.x for r in df.select(reviews.close_matches(F.col("b"), ["lake-view", "sea"], 0.7).alias("x")).collect()]
    assert tags == ["lake-view", None]
