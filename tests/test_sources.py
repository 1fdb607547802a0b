"""Zipped archives from real files, and ridge models against numpy."""

import zipfile
from pathlib import Path

import numpy as np
import pytest

from tidemark.operators import archive
from tidemark.plans import replay as plans

DATA = "/root/testdata/sf0.01"
HOUR = 3_600_000


def row(hour, close="1.5", start=0):
    at = start + hour * HOUR
    return f"{at},1.0,2.0,0.5,{close},7,{at + HOUR - 1},0,3,0,0,0"


def test_zipped_months(spark, tmp_path):
    """Plain and zipped folders give the same rows; damaged files, other members and broken rows are told."""
    lines = [",".join(archive.KLINE_COLUMNS), row(0), row(1, "x"), row(2) + ",more", row(3), "1,2,3", row(24 * 40)]
    for kind in ("plain", "zipped"):
        folder = tmp_path / kind / "symbol=A" / "month=1970-01"
        folder.mkdir(parents=True)
        text = "\n".join(lines) + "\n"
        if kind == "plain":
            (folder / "A-1h-1970-01.csv").write_text(text)
        else:
            with zipfile.ZipFile(folder / "A-1h-1970-01.zip", "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("A-1h-1970-01.csv", text)
    read = lambda: archive.zipped_hourly(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "zipped")))
    plain = archive.monthly_hourly(spark, str(tmp_path / "plain")).drop("row_sha256")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(read().drop("row_sha256")) == key(plain)
    assert {r.reason for r in plain.collect()} == {None, "row-value", "row-width", "outside-month"}
    bad = tmp_path / "zipped" / "symbol=B" / "month=1970-01"
    bad.mkdir(parents=True)
    (bad / "B-1h-1970-01.zip").write_bytes(b"no zip at all")
    with zipfile.ZipFile(bad / "C.zip", "w") as z:
        z.writestr("D.csv", row(0))
    found = [r for r in read().collect() if r.symbol == "B"]
    assert sorted(r.reason for r in found) == ["archive-damaged", "archive-member"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize(("query", "lags"), [(plans.j12_ridge_lags, 6), (plans.j12_ridge_24, 24)])
def test_ridge_against_numpy(spark, query, lags):
    data = {}
    for r in plans.featured(spark, DATA, lags).collect():
        data.setdefault(r.series, []).append((r.features, r.target))
    got = {r.series: r for r in query(spark, DATA).collect()}
    assert got.keys() == data.keys() and data
    for series, rows in data.items():
        x, y = np.array([f for f, _ in rows]), np.array([t for _, t in rows])
        scale = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(scale == 0, 1.0, scale)
        want = np.linalg.solve(z.T @ z + np.eye(lags), z.T @ (y - y.mean()))
        assert got[series].n == len(rows) and abs(got[series].intercept - y.mean()) < 1e-7
        assert np.abs(np.array(got[series].coefficients) - want).max() < 2e-6
