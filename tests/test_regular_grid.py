import math
import random

import numpy as np

from plumbline.operators.regular_grid import regular_grid

SCHEMA = "row_id bigint, dataset_id bigint, row_ord bigint, timestamp double, measurement double"


def grid(spark, rows, periods, **kw):
    df = spark.createDataFrame([(i, d, i, t, v) for i, (d, t, v) in enumerate(rows)], SCHEMA)
    rec = spark.createDataFrame(periods, "dataset_id bigint, nominal_period_s double")
    return {(r["dataset_id"], r["slot_no"]): r for r in regular_grid(df, rec, **kw).collect()}


def hermite(t, v, x):
    """Independent monotone cubic: slopes by the harmonic mean rule, evaluated with the Hermite basis."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m = np.zeros(len(t))
    if len(t) == 2:
        m[:] = d[0]
    else:
        for i in range(1, len(t) - 1):
            if d[i - 1] * d[i] > 0:
                w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])
        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = min(np.searchsorted(t, x, side="right") - 1, len(h) - 1)
    s = (x - t[i]) / h[i]
    return (1 + 2 * s) * (1 - s) ** 2 * v[i] + s * (1 - s) ** 2 * h[i] * m[i] + s * s * (3 - 2 * s) * v[i + 1] + s * s * (s - 1) * h[i] * m[i + 1]


def test_against_brute_force_and_shard_size(spark):
    rng = random.Random(3)
    slots = sorted(rng.sample(range(-40, 200), 110))
    rows = [(1, k * 0.5 + rng.uniform(-0.2, 0.2), rng.gauss(0, 1)) for k in slots]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    a = grid(spark, shuffled, [(1, 0.5)], max_gap=4)
    assert sorted(k for _, k in a) == list(range(slots[0], slots[-1] + 1))
    assert {k for (_, k), r in a.items() if r["status"] == "observed"} == set(slots)
    # Segments between long gaps, each with a cubic of its own.
    segments, current = [], [0]
    for i in range(1, len(slots)):
        if slots[i] - slots[i - 1] - 1 > 4:
            segments.append(current)
            current = []
        current.append(i)
    segments.append(current)
    for seg in segments:
        t, v = np.array([rows[i][1] for i in seg]), np.array([rows[i][2] for i in seg])
        for k in range(slots[seg[0]], slots[seg[-1]] + 1):
            r = a[1, k]
            if r["status"] != "observed":
                assert r["status"] == "filled"
                assert math.isclose(r["value"], hermite(t, v, k * 0.5), rel_tol=1e-9, abs_tol=1e-9)
    assert all(r["value"] is None for r in a.values() if r["status"] == "gap")
    for shard in (1, 3, 7):
        b = grid(spark, shuffled, [(1, 0.5)], max_gap=4, shard_slots=shard)
        assert a.keys() == b.keys()
        assert all(a[k]["status"] == b[k]["status"] and (a[k]["value"] is None or math.isclose(a[k]["value"], b[k]["value"], abs_tol=1e-12)) for k in a)


def test_monotone_data_stay_monotone(spark):
    rows = [(1, float(k), float(k**3)) for k in range(0, 40, 3)]
    out = grid(spark, rows, [(1, 1.0)], max_gap=5)
    values = [out[1, k]["value"] for k in range(0, 40)]
    assert values == sorted(values)


def test_what_is_no_reading(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 1.0), (1, 1.0, None), (1, 2.0, nan), (1, 3.0, inf), (1, None, 5.0), (1, nan, 5.0), (1, inf, 5.0), (1, 4.0, 2.0), (None, 1.0, 1.0), (2, 0.0, 1.0), (2, 5.0, 1.0), (3, 1.0, None), (4, 0.0, 1.0)]
    out = grid(spark, rows, [(1, 1.0), (1, 1.0), (2, None), (3, 1.0), (4, 1.0), (None, 1.0)])
    assert sorted(out) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (4, 0)]
    assert [out[1, k]["status"] for k in range(5)] == ["observed", "filled", "filled", "filled", "observed"]


def test_ties_repeats_and_huge_gaps(spark):
    rows = [(1, 0.4, 7.0), (1, -0.4, 8.0), (1, 0.4, 7.0), (1, 200_000.0, 1.0)]
    out = grid(spark, rows, [(1, 1.0)])
    assert len(out) == 200_001 and out[1, 0]["readings"] == 3 and out[1, 0]["value"] == 7.0
    assert out[1, 100_000]["status"] == "gap"


def test_empty(spark):
    assert grid(spark, [], [(1, 1.0)]) == {}
    assert grid(spark, [(1, 1.0, 1.0)], []) == {}
