import math
import random

import pytest

from lodestar.operators import dense_places


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize(("radius", "k", "leaf", "deepest"), [(800.0, 3, 8, 17), (60.0, 1, 4, 17), (3000.0, 5, 2, 9)])
def test_one_city_with_half_of_all_places(spark, radius, k, leaf, deepest):
    rng = random.Random(int(radius))
    city = [(48.85 + rng.random() / 50, 2.35 + rng.random() / 50) for _ in range(150)]
    world = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(110)] + [(90.0, 10.0), (-90.0, 0.0), (89.9, -170.0), (0.0, 180.0), (0.1, -180.0), (0.0, 179.99)] + [(10.0, 10.0)] * 20
    right = [(i, *p) for i, p in enumerate(city + world)] + [(900, None, 1.0)]
    left = [(i, *p) for i, p in enumerate([(48.86, 2.36), (48.0, 3.0), (50.0, 1.0), (89.95, 100.0), (-89.0, 5.0), (0.0, -179.995), (10.0, 10.0), (10.001, 9.999), *[(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(25)]])] + [(99, 1.0, None)]
    want = {}
    for i, lat, lon in left[:-1]:
        found = sorted((km((lat, lon), (a, o)), j) for j, a, o in right[:-1])
        want[i] = [j for d, j in found if d <= radius][:k]
    rows = dense_places.nearest_dense(spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "other long, r_lat double, r_lon double"), radius, "id", "other", k, leaf, deepest).collect()
    got = {i: [] for i in want}
    for r in sorted(rows, key=lambda r: (r.id, r["rank"])):
        got[r.id].append(r.other)
    assert got == want
