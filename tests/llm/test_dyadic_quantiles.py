import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import dyadic_quantiles as dq


def test_codes_keep_order_and_bracket_the_value(spark):
    rng = np.random.default_rng(1)
    x = np.r_[0.0, -0.0, 1e-300, -1e-300, 1e-9, 1e308, -1e308, 1.7e308, 1e150, rng.normal(size=300) * 10.0 ** rng.integers(-8, 9, 300)]
    x.sort()
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    codes = np.array([r[0] for r in df.select(dq.code(F.col("v"))).collect()])
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 2**32
    low, high = dq.value_at(codes), dq.value_at(codes + 1)
    slack = 1e-9 * np.abs(x) + 1e-15
    assert (low <= x + slack).all() and (x <= high + slack).all()
    assert ((high - low) <= 2e-6 * np.abs(x) + 1e-11).all()


def test_rank_error_stays_within_the_bound_after_merges():
    rng = np.random.default_rng(2)
    k = 640  # eps = 0.05
    parts = []
    values = []
    for i in range(7):
        v = np.sort(rng.lognormal(i / 3, 1 + i / 5, 5000))
        codes = (np.floor(np.log(v / 1e-6 + np.sqrt((v / 1e-6) ** 2 + 1)) * 2**20) + 2**31).astype(np.int64)
        one = np.ones(len(v), np.int64)
        parts.append(dq.compress(0 * one, 0 * one, codes, one, k))
        values.append(codes)
    g, level, node, n = dq.compress(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
    every = np.sort(np.concatenate(values))
    total = len(every)
    assert n.sum() == total
    inner = level > 0
    assert (n[inner] <= total // k + 7).all()  # at most n / k a part, floors added up
    assert len(n) <= 3 * k * 1.2
    low, high = node << level, ((node + 1) << level) - 1
    for p in (0.01, 0.25, 0.5, 0.9, 0.999):
        r = int(p * (total - 1))
        lo_order, hi_order = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
        lo = low[lo_order][np.searchsorted(np.cumsum(n[lo_order]), r + 1)]
        hi = high[hi_order][np.searchsorted(np.cumsum(n[hi_order]), r + 1)]
        assert lo <= every[r] <= hi
        for v in (lo, hi):
            first, last = np.searchsorted(every, v), np.searchsorted(every, v, side="right")
            error = 0 if first <= r < last else min(abs(first - r), abs(last - 1 - r))
            assert error <= 0.05 * total + 7


def test_percentiles_hold_the_exact_value(spark):
    rng = np.random.default_rng(4)
    rows = [("a", None if i % 50 == 0 else "r1", float(v)) for i, v in enumerate(rng.normal(size=3000))]
    rows += [("b", "r1", 5.0)] * 40 + [("c", "r1", float("nan")), ("c", "r1", None), ("c", "r1", float("inf")), (None, None, 1.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "s string, r string, v double").repartition(5).withColumn("level", F.lit(1)).withColumn("n", F.lit("x"))
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    for eps in (0.005, 0.2):
        digest = dq.digest(df, ["s", "r"], "v", eps)
        out = {(x["s"], x["r"], x["p"]): x for x in dq.percentiles(digest, ["s", "r"], probs).collect()}
        assert {k[0] for k in out} == {"a", "b", None}
        for s, r in {(s, r) for s, r, _ in out}:
            exact = np.percentile([v for a, b, v in rows if (a, b) == (s, r) and v is not None], [100 * p for p in probs])
            for p, e in zip(probs, exact, strict=True):
                x = out[s, r, p]
                assert x["low"] <= e <= x["high"], (s, r, p, e, x)
                if eps == 0.005:
                    assert x["value"] == pytest.approx(e, rel=2e-6, abs=1e-9)


def test_parts_merge_into_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), int(i % 11), float(v)) for i, v in enumerate(rng.exponential(size=20_000))]
    df = spark.createDataFrame(rows, "k int, day int, v double").repartition(4)
    merged = dq.merge(dq.digest(df, ["k", "day"], "v", 0.05), ["k"], 0.05)
    for r in dq.percentiles(merged, ["k"], (0.1, 0.5, 0.99)).collect():
        mine = np.sort([v for k, _, v in rows if k == r["k"]])
        e = np.percentile(mine, 100 * r["p"])
        assert r["rows"] == len(mine) and r["low"] <= e <= r["high"]
        ranks = np.searchsorted(mine, [r["low"], r["high"]]) / len(mine)
        assert np.abs(ranks - r["p"]).max() <= 0.05 + 1e-3


def test_exact_percentiles_of_open_groups(spark):
    rng = np.random.default_rng(6)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=4000), 1)] + [("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "s string, v double").repartition(3)
    brackets = dq.percentiles(dq.digest(df, ["s"], "v", 0.2), ["s"], (0.05, 0.5, 0.95))
    out = {(r["s"], r["p"]): r["exact"] for r in dq.exact_percentiles(df, brackets, ["s"], "v").collect()}
    for s in "ab":
        for p in (0.05, 0.5, 0.95):
            assert out[s, p] == pytest.approx(np.percentile([v for a, v in rows if a == s], 100 * p), abs=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "s string, v double")
    assert dq.percentiles(dq.digest(df, ["s"], "v"), ["s"], (0.5,)).count() == 0
