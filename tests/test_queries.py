"""Every query with SQL gives the rows that DuckDB gives; those without run."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from terrane.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert got == want


def test_equal_scores_of_a_stratum_go_to_the_least_id(spark, tmp_path):
    """Orders that differ in their key alone, by a multiple of 1000: all of a fold have equal scores, in any order of rows."""
    con = duckdb.connect()
    for t in ("customer", "nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{FOLDER}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    one = f"(SELECT * FROM '{FOLDER}/orders.parquet' ORDER BY o_orderkey LIMIT 1)"
    for order in ("k", "k DESC"):
        con.execute(f"COPY (SELECT o.* REPLACE (k * 1000 + 7 AS o_orderkey) FROM {one} o, range(200) r(k) ORDER BY {order}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        got = catalog.QUERIES["first_per_stratum"](spark, str(tmp_path)).collect()
        assert len(got) == 5 and all(r.top_id == r.first_id for r in got)
