"""Doubling on the way of the query: halves of a window, the window, longer repeats."""

import numpy as np

from tidemark.llm import substrings
from tidemark.llm.shared import MULTIPLIERS, mixed


def test_windows_come_from_surviving_halves(spark, monkeypatch):
    """The query's windows are those whose two halves survive; repeated halves alone remove nothing."""
    seen, real = [], substrings.doubled

    def doubled(docs, length, step, window, table):
        out = real(docs, length, step, window, table)
        seen.append((length, step, sorted((r.doc_id, r.start) for r in out.collect())))
        return out

    monkeypatch.setattr(substrings, "doubled", doubled)
    a, b = [f"a{i}" for i in range(14)], [f"b{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, "x " + " ".join(a)), (3, " ".join(b[:7]) + " y"), (4, "z " + " ".join(b[6:])), (5, " ".join(b))]
    got = dict(substrings.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert seen == [(7, 6, [(1, 0), (1, 1), (2, 1), (2, 2)])]
    assert got == dict(rows) | {2: "x"}


def test_hash_is_that_of_the_halves():
    rng = np.random.default_rng(3)
    for window in (1, 2, 3, 5, 8, 13, 50):
        words = rng.integers(0, 2**63, 4 * window + 9, np.uint64)
        half = -(-window // 2)
        for length, longer in ((half, window), (window, 2 * window)):
            step = longer - length
            one, two = substrings.doubled_hashes(words, length, window), substrings.doubled_hashes(words, longer, window)
            if step:
                with np.errstate(over="ignore"):
                    assert (two == mixed(one[: len(one) - step] * MULTIPLIERS[0] + one[step:])).all()
            assert len(two) == len(words) - longer + 1
        assert len(substrings.doubled_hashes(words[: window - 1], window, window)) == 0
        assert (substrings.least_of(words, window) == np.lib.stride_tricks.sliding_window_view(words, window).min(axis=1)).all()


def test_windows_of_other_lengths(spark):
    """Windows of one, two and five words against plain loops."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 30)))) for i in range(20)]
    for window in (1, 2, 5):
        least, want = {}, []
        for d, text in rows:
            w = text.split()
            runs = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
            gone = {i + k for i, run in enumerate(runs) if least.setdefault(run, d) < d for k in range(window)}
            want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert sorted(map(tuple, substrings.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), window).collect())) == want
