import struct

import pytest
from pyspark.sql import functions as F

from lodestar.operators import places
from lodestar.sources import osm_pbf
from lodestar.sources.osm_pbf import _block, _bytes, _deltas, _number, _put, _zigzag


def _entities(n):
    """Nodes and ways as the source's rows; negative ids and places, many tags, none, letters beyond ASCII."""
    tags = lambda i: {f"k{j}": f"wért {i * j}" for j in range(i % 4)} | ({"amenity": "fuel", "shop": "supermarket"} if i % 5 == 0 else {})
    nodes = [("node", i * 3 - 1000, (i * 104729 % 36000 - 18000) * 99991, (i * 7919 % 18000 - 9000) * 99991, tags(i), None) for i in range(n)]
    ways = [("way", i - 7, None, None, tags(i), [((i + j) % n) * 3 - 1000 for j in range(i % 6)]) for i in range(n // 2)]
    return nodes + ways


def _as_set(rows):
    return sorted((r.kind, r.id, r.lon_e7, r.lat_e7, tuple(sorted(r.tags.items())), None if r.refs is None else tuple(r.refs)) for r in rows)


def _plain_places(rows):
    keys, out = ("amenity", "shop", "tourism", "natural"), []
    at = {r[1]: (r[2], r[3]) for r in rows if r[0] == "node" and abs(r[2]) <= 1_800_000_000 and abs(r[3]) <= 900_000_000}
    for kind, i, _, _, tags, refs in rows:
        found = [name for k in keys for name, key, value in places.CATEGORIES if key == k and tags.get(k) == value]
        ends = [at[r] for r in ([i] if kind == "node" else refs) if r in at]
        if found and ends:
            out.append((found[0], kind, i, sum(e[0] for e in ends) / len(ends) / 1e7, sum(e[1] for e in ends) / len(ends) / 1e7))
    return sorted(out)


def test_round_trip_and_places(spark, tmp_path):
    osm_pbf.register(spark)
    rows = _entities(20_000)
    spark.createDataFrame(rows, osm_pbf.SCHEMA).repartition(2).write.format("osm_pbf").mode("append").save(str(tmp_path / "e"))
    whole = spark.read.format("osm_pbf").load(str(tmp_path / "e"))
    cut = spark.read.format("osm_pbf").option("partition_bytes", 1).load(str(tmp_path / "e"))
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    want = sorted((k, i, x, y, tuple(sorted(t.items())), None if r is None else tuple(r)) for k, i, x, y, t, r in rows)
    assert _as_set(whole.collect()) == want == _as_set(cut.collect())
    only = spark.read.format("osm_pbf").option("kinds", "way").load(str(tmp_path / "e"))
    assert only.count() == 10_000 and only.where("kind = 'node'").count() == 0
    got = sorted(map(tuple, places.extract_places(whole).collect()))
    assert got == [pytest.approx(x) if isinstance(x, float) else x for x in _plain_places(rows)]


def test_overwrite_append_and_empty(spark, tmp_path):
    osm_pbf.register(spark)
    path = str(tmp_path / "e")
    put = lambda rows, mode: spark.createDataFrame(rows, osm_pbf.SCHEMA).coalesce(1).write.format("osm_pbf").mode(mode).save(path)
    read = lambda: spark.read.format("osm_pbf").load(path)
    put(_entities(10), "append")
    put(_entities(10), "append")
    assert read().count() == 30
    put(_entities(4), "overwrite")
    assert read().count() == 6
    (tmp_path / "e" / "_left").write_bytes(b"of a lost task")
    assert read().count() == 6
    put([], "overwrite")
    assert read().count() == 0 and places.extract_places(read()).count() == 0


def test_single_nodes_offsets_granularity_and_raw_blobs(spark, tmp_path):
    """Parts of the format that the sink doesn't write: single nodes, offsets, a granularity, unpacked blocks."""
    osm_pbf.register(spark)
    strings = _bytes(1, b"".join(_bytes(1, s) for s in (b"", b"amenity", b"fuel")))
    node = _number(1, _zigzag(-5)) + _bytes(2, b"\x01") + _bytes(3, b"\x02") + _number(8, _zigzag(-123)) + _number(9, _zigzag(456))
    block = strings + _bytes(2, _bytes(1, node)) + _number(17, 1000) + _number(19, -2050) + _number(20, 77)
    blob = _bytes(1, block)
    header = _bytes(1, b"OSMData") + _number(3, len(blob))
    (tmp_path / "one.osm.pbf").write_bytes(struct.pack(">I", len(header)) + header + blob)
    (row,) = spark.read.format("osm_pbf").load(str(tmp_path / "one.osm.pbf")).collect()
    assert (row.id, row.lat_e7, row.lon_e7, row.tags) == (-5, -1250, 4560, {"amenity": "fuel"})


def test_broken_files_are_errors_that_name_the_place(spark, tmp_path):
    osm_pbf.register(spark)
    import io

    good = io.BytesIO()
    _put(good, "OSMHeader", _bytes(4, b"LocationsOnWays"))
    (tmp_path / "feature.pbf").write_bytes(good.getvalue())
    cut = io.BytesIO()
    _put(cut, "OSMData", _bytes(2, _bytes(2, _deltas(1, [1, 2]))))
    (tmp_path / "cut.pbf").write_bytes(cut.getvalue()[:-3])
    (tmp_path / "noise.pbf").write_bytes(b"\xff" * 50)
    (tmp_path / "fields.pbf").write_bytes(cut.getvalue())
    for name in ("feature", "cut", "noise", "fields"):
        with pytest.raises(Exception, match=f"{name}.pbf"):
            spark.read.format("osm_pbf").load(str(tmp_path / f"{name}.pbf")).collect()


def test_key_order_of_categories(spark):
    rows = [(1, {"shop": "supermarket", "amenity": "fuel"}), (2, {"amenity": "bench", "shop": "bakery"}), (3, {"natural": "beach", "tourism": "viewpoint"}), (4, {}), (5, None)]
    got = spark.createDataFrame(rows, "i int, tags map<string,string>").select("i", places.key_category(F.col("tags")).alias("c"), places.category(F.col("tags")).alias("first")).collect()
    assert [(r.c, r.first) for r in got] == [("fuel", "supermarket"), ("bakery", "bakery"), ("viewpoint", "viewpoint"), (None, None), (None, None)]


def test_blocks_of_many_entities_and_reads_of_one_kind(spark, tmp_path):
    """Empty keys and values, ways without nodes at a block's ends, greatest numbers; a filter on kind leaves out the other read."""
    osm_pbf.register(spark)
    far = (1 << 62) - 1
    rows = [("node", far, -1_800_000_000, 900_000_000, {"name": "", "": "x"}, None), ("node", -far, 5, -7, None, None),
            *[("way", i, None, None, {"v": str(i)} if i % 3 else {}, [far, -far, i][: i % 4]) for i in range(8_100)], ("way", 9_000, None, None, {"k": ""}, None)]
    spark.createDataFrame(rows, osm_pbf.SCHEMA).coalesce(1).write.format("osm_pbf").mode("append").save(str(tmp_path / "e"))
    got = osm_pbf.extract(spark, str(tmp_path / "e"))
    want = [(k, i, x, y, tuple(sorted((t or {}).items())), None if k == "node" else tuple(r or ())) for k, i, x, y, t, r in rows]
    assert _as_set(got.collect()) == sorted(want)
    assert got.where("kind = 'way'")._jdf.queryExecution().optimizedPlan().toString().count("osm_pbf") == 1
