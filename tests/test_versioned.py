import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.operators import views
from lodestar.sources.versioned import Kept, VersionedTables

BASE = StructType([StructField("k", LongType()), StructField("g", StringType()), StructField("x", LongType())])
VIEW = StructType([StructField("g", StringType()), StructField("n", LongType()), StructField("x", LongType())])
CHANGES = "k long, g string, x long, seq long, deleted boolean"


def build(rows):
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/t", {"base": Kept(BASE, ("k",), 8), "view": Kept(VIEW, ("g",), 8)}).create()


def put(tables, version, changes):
    return views.maintained(tables, "base", "view", tables.spark.createDataFrame(changes, CHANGES), ["k"], ["g"], build, version)


def held(tables, name):
    return sorted((tuple(r) for r in tables.snapshot().read(name).collect()), key=str)


def full(state):
    groups = {}
    for g, x in state.values():
        n, total = groups.get(g, (0, 0))
        groups[g] = (n + 1, total + x)
    return sorted(((g, *v) for g, v in groups.items()), key=str)


def test_view_equals_a_full_refresh_after_any_changes(tables):
    rng, state = random.Random(3), {}
    for version in range(4):
        changes = []
        for seq in range(40):
            k = rng.choice([None, *range(25)])
            g, x, gone = rng.choice([None, "a", "a", "b", "c", f"g{rng.randrange(20)}"]), rng.randrange(100), rng.random() < 0.3
            changes.append((k, g, x, seq, gone))
            state.pop(k, None) if gone else state.__setitem__(k, (g, x))
        assert put(tables, version, changes)
        assert held(tables, "base") == sorted(((k, *v) for k, v in state.items()), key=str)
        assert held(tables, "view") == full(state)


def test_only_touched_buckets_are_written(tables):
    put(tables, 0, [(k, f"g{k}", 1, 0, False) for k in range(200)])
    put(tables, 1, [(5, "g5", 7, 0, None)])
    places = tables.snapshot().places
    for name in ("base", "view"):
        assert sorted(v for (n, _), v in places.items() if n == name) == [0] * 7 + [1]


def test_a_version_applies_once_and_no_changes_are_a_version(tables):
    assert put(tables, 0, [(1, "a", 2, 0, False)]) and not put(tables, 0, [(1, "b", 9, 0, False)])
    assert put(tables, 1, []) and tables.snapshot().version == 1 and held(tables, "view") == [("a", 1, 2)]
    tables.create()
    assert put(tables, 5, [(1, None, None, 0, True)]) and held(tables, "base") == held(tables, "view") == []


def test_a_killed_commit_leaves_nothing(tables, monkeypatch):
    put(tables, 0, [(1, "a", 2, 0, False)])
    before = tables.snapshot()
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_note", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            put(tables, 1, [(1, "b", 9, 0, False), (2, "a", 1, 0, False)])
    assert tables.snapshot().version == 0 and held(tables, "base") == [(1, "a", 2)] and held(tables, "view") == [("a", 1, 2)]
    assert put(tables, 1, [(1, "b", 9, 0, False)]) and held(tables, "view") == [("b", 1, 9)]
    assert before.read("view").collect() == [("a", 1, 2)]  # a reader keeps what it began with


def test_rows_outside_their_buckets_are_refused(tables, spark):
    rows = spark.createDataFrame([(k, "a", 1) for k in range(50)], BASE)
    with pytest.raises(ValueError):
        tables.commit(0, {"base": (rows, [0])})
    assert tables.snapshot().version == -1
    narrow = spark.createDataFrame([(k, "a", 1) for k in range(50)], "k int, g string, x int")  # dealt as the table's own types are
    assert tables.commit(0, {"base": (narrow, range(8))}) and tables.touched("base", narrow) == tables.touched("base", rows)
    assert sorted(r["k"] for r in tables.snapshot().read("base").collect()) == list(range(50))
    with pytest.raises(ValueError):
        VersionedTables(spark, "x", {"a": Kept(BASE, ("k",), 0)})
