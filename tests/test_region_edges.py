from lodestar.operators import places


def test_a_point_on_the_edge_of_a_region_is_inside(spark):
    corners = [(18.0, 20.0), (24.0, 20.0), (24.0, 26.0), (18.0, 26.0), (18.0, 20.0)]
    regions = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in corners])], "region_id int, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(i, 20 + i * 0.07, 24.0) for i in range(80)] + [(100 + i, 26.0, 18 + i * 0.07) for i in range(80)], "point_id long, lat double, lon double")
    assert {(r.region_id, r.inside) for r in places.regions_of(points, regions).collect()} == {(1, True)}
