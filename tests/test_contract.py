"""The driver contract: entry() smoke, every oracle key equal to DuckDB at sf0.01."""

import pytest

import __spark_entry__ as E
from market_fixtures import SF001
from oracle import compare, duck

ORACLE_KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "Ticker" in df.columns


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF001)
    assert r["status"] == "ok", r


def _family(t: str) -> str:
    t = t.lower()
    for fam, keys in (("map", ("map",)), ("array", ("array", "[]")), ("float", ("double", "float")),
                      ("decimal", ("decimal",)), ("int", ("bigint", "int", "long", "smallint", "tinyint")),
                      ("string", ("varchar", "string")), ("timestamp", ("timestamp",)), ("date", ("date",)),
                      ("bool", ("bool",))):
        if any(k in t for k in keys):
            return fam
    return t


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_types_match_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    got = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(E.oracle_sql()[key])
    exp = {c: _family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert got == exp
