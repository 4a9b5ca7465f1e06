import random

import pytest

from lodestar.operators import reconcile


def plain(steps):
    to = {}
    for a, b in steps:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))
    out = {}
    for a in to:
        seen, at = [], a
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        end = min(seen[seen.index(at):]) if at in to else at
        if end != a:
            out[a] = end
    return out


@pytest.mark.parametrize("steps", [
    [(1, 2), (2, 3), (3, 4), (5, 4), (6, 6), (None, 1), (7, None)],
    [*[(k, k + 1) for k in range(1, 30)], (30, 31), (31, 30)],
    [(1, 2), (2, 1), (3, 1), (9, 8), (8, 7), (7, 9), (10, 9), (11, 10), (20, 5), (20, 4)],
    [(k, (k * 7 + 3) % 41) for k in range(41)],
    [],
])
def test_ends_of_chains_and_circles(spark, steps):
    rows = spark.createDataFrame(steps, "old_id long, new_id long")
    assert {r.old_id: r.new_id for r in reconcile.merge_ends(rows).collect()} == plain(steps)


def test_any_steps(spark):
    rng = random.Random(4)
    steps = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(50)]
    assert {r.old_id: r.new_id for r in reconcile.merge_ends(spark.createDataFrame(steps, "old_id long, new_id long")).collect()} == plain(steps)
