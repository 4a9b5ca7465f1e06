import os

import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or type(value).__name__ in ("NAType", "NaTType") or value != value:
        return None
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return float(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [f"{x:.4f}" if isinstance(x, float) else str(x) for x in r])


ORACLE = __spark_entry__.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = __spark_entry__.queries()[name](spark, SF)
    a, cursor = _rows(found.columns, found.collect()), con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    b = _rows(names, cursor.fetchall())
    assert sorted(found.columns) == sorted(names) and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6)
