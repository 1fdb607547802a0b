"""Grids of horizons, chains of several steps, policies that require and the log of access, on small tables."""

import pytest

from tidemark.functions.expressions import HOUR_NS as H
from tidemark.operators import archive, contracts, grids

BAR = "series string, start_ns bigint, close double, finalized boolean"


def hours(spark, missing=(), open_=(), n=60, series="a"):
    return spark.createDataFrame([(series, h * H, 100.0 + h, h not in open_) for h in range(n) if h not in missing], BAR)


def test_horizon_grid_against_loop(spark):
    """Each origin by hand: cadences off the split's start, a missing and an open hour, labels beyond the end, blocks a horizon."""
    missing, open_, n, look = {20}, {33}, 60, 3
    splits, grid = [("one", 5 * H + 1, 40 * H, 2 * H), ("two", 40 * H, 70 * H, 0)], [(1, 1, 2), (4, 3, 7)]
    fine = [h for h in range(n) if h not in missing and h not in open_]
    want = {}
    for name, lo, hi, embargo in splits:
        for horizon, cadence, block in grid:
            step, count, after = cadence * H, [0] * 5, None
            origin = -(-lo // step) * step
            while origin < hi:
                count[0] += 1
                o = origin // H
                if origin >= lo + embargo and o - look >= 0 and origin + horizon * H < hi:
                    count[1] += 1
                    if all(h in fine for h in range(o - look, o)):
                        count[2] += 1
                        if all(h in fine for h in range(o, o + horizon)):
                            count[3] += 1
                            if after is None or origin >= after:
                                count[4], after = count[4] + 1, origin + block * H
                origin += step
            want["a", name, horizon] = tuple(count)
    found = grids.horizon_counts(grids.horizon_states(hours(spark, missing, open_, n), splits, grid, look)).collect()
    assert {(r.series, r.split, r.horizon): (r.candidates, r.structurally_eligible, r.origin_eligible, r.matured, r.blocks) for r in found} == want
    assert all(v[3] for k, v in want.items() if k[1] == "one")


def test_common_eligibility_against_loop(spark):
    """A gap of either series spoils the origins whose features or label it lies in, and no others."""
    b = hours(spark, {30}).union(hours(spark, {41}, series="b"))
    folds, grid, lags = [("training", 3 * H, 45 * H, 45 * H, True), ("evaluation", 20 * H, 55 * H, 55 * H, False)], [(1, 1), (6, 5)], 4
    want = {}
    for mode, lo, hi, cut, training in folds:
        for horizon, cadence in grid:
            for o in range(lo // H, hi // H, cadence):
                if (o + horizon) * H + 7 >= cut:
                    state = "immature-or-boundary-label"
                elif o - 1 < lags:
                    state = "missing-feature-history"
                elif not training and o - lags <= 20 + 2:
                    state = "purge-or-embargo"
                else:
                    state = "incomplete-common-pair" if {30, 41} & set(range(o - lags - 1, o + horizon)) else "selected"
                want[mode, horizon, o * H] = state
    found = grids.common_eligibility(b, 0, folds, grid, lags, 2 * H, 7, 20 * H).collect()
    assert {(r["mode"], r.horizon, r.origin_ns): r.state for r in found} == want and len(set(want.values())) == 5


def test_chained_cases(spark):
    """Each reason once, two lags and two label steps; coverage comes from the claims, one of them pending."""
    late, unknown, n = 21, 30, 60
    rows = hours(spark, {10}, {16}, n).selectExpr("series", "start_ns", "finalized", f"CASE WHEN start_ns = {unknown * H} THEN NULL WHEN start_ns = {late * H} THEN start_ns + {9 * H} ELSE start_ns + {H} END AS available_ns")
    claims = spark.createDataFrame([("a", 0, 40 * H, "complete"), ("a", 40 * H, 41 * H, "pending"), ("a", 41 * H, 70 * H, "complete")], "series string, claim_start bigint, claim_end bigint, status string")
    found = {r.start_ns // H: r.reason for r in grids.chained_cases(rows, claims, [("one", 2 * H, 55 * H)], 1000, 10, 2, 2).collect()}
    want = {0: "outside-or-crossing-split", 1: "lag-gap-or-missing", 5: "case", 8: "label-gap-or-missing", 11: "lag-gap-or-missing", 12: "lag-gap-or-missing", 13: "case", 14: "label-not-finalized", 16: "not-finalized", 17: "lag-not-finalized", 18: "lag-not-finalized", 20: "case"}
    want |= {21: "feature-unavailable", 23: "feature-unavailable", 24: "case", 28: "label-availability-purged", 29: "label-availability-purged", 30: "feature-unavailable,time-quality", 32: "feature-unavailable,time-quality", 33: "case"}
    want |= {38: "label-coverage", 40: "coverage", 42: "coverage", 43: "case", 51: "case", 52: "label-purged", 54: "outside-or-crossing-split"}
    assert {h: found[h] for h in want} == want


def test_access_log_keeps_denials(spark, tmp_path):
    """A denied request is an error, but the log has it, and requests that are fine pass."""
    path = str(tmp_path / "log")
    ask = lambda *rows: spark.createDataFrame(rows, "id string, operation string, first_ns bigint, last_ns bigint, label_ns bigint")
    assert [r.id for r in grids.admitted(ask(("a", "read", 0, 9, 0)), 10, path).collect()] == ["a"]
    with pytest.raises(PermissionError):
        grids.admitted(ask(("b", "read", 0, 9, 0), ("c", "read", 0, 10, 0), ("d", "build", 0, 9, 0), ("e", "read", None, 9, 0)), 10, path)
    assert {r.id: r.access for r in spark.read.parquet(path).collect()} == dict(zip("abcde", ["access_allowed"] * 2 + ["access_denied"] * 3, strict=True))


def test_required_policies_stop(spark):
    """What a require mode finds stops the job; rows that are refused before do not."""
    rows = spark.createDataFrame([(True, True, "complete"), (False, False, "pending")], "finalized boolean, healthy boolean, status string")
    assert [r.reason for r in contracts.policy(rows, True, "require", "require").collect()] == [None, "not-finalized"]
    for time_quality, cover, name in (("require", "include", "time-quality"), ("include", "require", "coverage")):
        with pytest.raises(Exception, match=f"the policy requires {name}"):
            contracts.policy(rows, False, time_quality, cover).collect()
        told = contracts.policies(rows, [(False, time_quality, cover)]).select("reason").collect()
        assert [r.reason for r in told] == [None, f"stops:{name}"]


def test_order_of_written_rows(spark, tmp_path):
    """Equal, falling and null offsets are told, each file by itself, in blocks of four places too."""
    for name, offsets in (("one", [1, 2, 2, 5, 4, None, 3, 7, 9, 8, 10]), ("two", [3, 4, 5])):
        spark.createDataFrame([(name, o) for o in offsets], "segment string, offset bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for span in (4, 1 << 20):
        found = {r.segment: tuple(r)[1:] for r in archive.written_order(rows, ["segment"], span).collect()}
        assert found == {"one": (11, 1, 4), "two": (3, 1, 0)}
