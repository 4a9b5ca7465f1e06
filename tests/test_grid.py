from lodestar.operators import places


def test_cells_of_boxes(spark):
    boxes = spark.createDataFrame([(1, 35.0, -10.0, 45.0, 5.0), (2, 0.0, 0.0, 0.1, 2.6), (3, 5.0, 5.0, 5.0, 9.0), (4, 5.0, 5.0, 4.0, 9.0), (5, None, 0.0, 1.0, 1.0)], "box_id int, south double, west double, north double, east double")
    got = sorted(tuple(r) for r in places.box_grid(boxes, 2.5).collect())
    assert got == [(1, 35 + i * 2.5, -10 + j * 2.5) for i in range(4) for j in range(6)] + [(2, 0.0, 0.0), (2, 0.0, 2.5)]
    assert places.box_grid(boxes.limit(0), 2.5).count() == 0
