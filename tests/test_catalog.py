"""Every query with SQL gives what DuckDB gives on the same tables."""

import os
import random
from pathlib import Path

import duckdb
import pytest

from tidemark import catalog
from tidemark.operators import scores

#: Smaller tables have no whole chains; a query whose result is empty proves nothing.
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name not in catalog.SQL:
        return
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_bootstrap_takes_all_days(spark):
    """Against the plain bootstrap: whole blocks, then the tail block, 2,000 draws over all days from seed 42."""
    daily = scores.daily_losses(catalog.returns(spark, DATA), ["series"]).collect()
    first, n = min(r.day for r in daily), max(r.day for r in daily) - min(r.day for r in daily) + 1
    losses = {s: [0.0] * n for s in {r.series for r in daily}}
    for r in daily:
        losses[r.series][r.day - first] = r.abs_loss
    rng, want, tail = random.Random(42), {}, n % 7
    for draw in range(2000):
        starts = [rng.randrange(n - 7 + 1) for _ in range(n // 7)]
        last = rng.randrange(n - tail + 1) if tail else 0
        for s, x in losses.items():
            want[s, draw] = sum(sum(x[i : i + 7]) for i in starts) + sum(x[last : last + tail])
    got = {(r.series, r.draw): r.loss for r in catalog.QUERIES["j15_bootstrap"](spark, DATA).collect()}
    assert tail and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_compared_streams_differ(spark):
    """The comparison has rows, and one stream scored truths that the other did not."""
    got = {r.horizon: r.n for r in catalog.QUERIES["k10_compare_risen"](spark, DATA).collect()}
    assert len(got) > 1 and 0 < got[None] < catalog.returns(spark, DATA).count()
    assert got[None] == sum(n for h, n in got.items() if h is not None)
