"""Every registered query against its DuckDB oracle on the smallest tables
(the same check the driver runs at sf0.01)."""
import math
import os

import duckdb
import pytest

from samples import SF_SMALL

import __spark_entry__ as entry
from tessera.plans.catalog import all_oracles, all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    mine = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_has_an_entry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # the library's own queries; those of the removable part have their own tests
    assert set(all_queries()) - set(all_oracles()) == {"site_awareness"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["page_id", "title", "text_chars", "cuts", "kept", "unclosed"]
