import math

import numpy as np
import pytest

from plumbline.operators import generic_tools as gt
from plumbline.operators import imu_tools as it
from plumbline.operators import spectral

GENERIC = "k string, row_ord bigint, timestamp double, measurement double, reference double, sweep_direction string, revision string, temperature double, humidity double, supply_voltage double"


def generic(spark, m, r, k="a", t=None, sweep=None, revision=None, temperature=None):
    n = len(m)
    num = lambda x: None if x is None else float(x)
    rows = [(k, i, float(i) if t is None else num(t[i]), num(m[i]), num(r[i]), sweep[i] if sweep else None, revision[i] if revision else None, num(temperature[i]) if temperature is not None else None, None, 5.0) for i in range(n)]
    return spark.createDataFrame(rows, GENERIC).repartition(3)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_constant_bias(spark):
    r = np.linspace(0, 10, 20)
    df = generic(spark, r + 0.5, r)
    a = one(gt.accuracy(df, ["k"]))
    assert a["bias"] == pytest.approx(0.5) and a["mean_absolute_error"] == pytest.approx(0.5) and a["root_mean_squared_error"] == pytest.approx(0.5)
    assert a["sample_count"] == 20
    # The zero reference takes no part in percentages.
    assert a["maximum_absolute_percentage_error"] == pytest.approx(0.5 / r[1] * 100)


def test_numbers_against_numpy(spark):
    rng = np.random.default_rng(1)
    r = np.repeat(np.arange(10.0), 12)
    m = 2 * r + 1 + rng.normal(0, 0.3, len(r))
    m[5], m[6] = np.nan, np.inf
    t = rng.permutation(len(r)) * 0.1
    df = generic(spark, m, r, t=t, temperature=rng.normal(20, 1, len(r)))
    ok = np.isfinite(m)
    mm, rr, tt = m[ok], r[ok], t[ok]
    e = mm - rr
    slope, icept = np.polyfit(rr, mm, 1)
    res = mm - slope * rr - icept
    lin = one(gt.linearity(df, ["k"]))
    assert lin["slope"] == pytest.approx(slope) and lin["intercept"] == pytest.approx(icept)
    assert lin["r_squared"] == pytest.approx(1 - (res**2).sum() / ((mm - mm.mean()) ** 2).sum())
    assert lin["residual_standard_deviation"] == pytest.approx(res.std(ddof=1)) and lin["maximum_deviation_percent_full_scale"] == pytest.approx(100 * np.abs(res).max() / (abs(slope) * 9))
    p = one(gt.precision(df, ["k"]))
    assert p["robust_sigma"] == pytest.approx(1.4826 * np.median(np.abs(e - np.median(e)))) and p["p95_absolute_demeaned_error"] == pytest.approx(np.percentile(np.abs(e - e.mean()), 95))
    assert p["interquartile_range"] == pytest.approx(np.subtract(*np.percentile(e, [75, 25])))
    levels = [mm[rr == x] for x in range(10)]
    rep = one(gt.repeatability(df, ["k"]))
    assert rep["pooled_standard_deviation"] == pytest.approx(math.sqrt(sum((len(x) - 1) * x.var(ddof=1) for x in levels) / sum(len(x) - 1 for x in levels)))
    s = one(gt.sensitivity(df, ["k"]))
    local = np.diff([x.mean() for x in levels])
    assert s["mean_local_sensitivity"] == pytest.approx(local.mean()) and s["local_sensitivity_standard_deviation"] == pytest.approx(local.std(ddof=1)) and s["interval_count"] == 9
    d = one(gt.drift(df, ["k"]))
    assert d["drift_rate"] == pytest.approx(np.polyfit(tt, e, 1)[0]) and d["endpoint_error_change"] == pytest.approx(e[tt.argmax()] - e[tt.argmin()])
    n = one(gt.signal_to_noise(df, ["k"]))
    assert n["snr_db"] == pytest.approx(10 * math.log10(rr.var() / e.var()))
    fields = {x["field"]: x for x in gt.environmental_stability(df, ["k"]).collect()}
    assert set(fields) == {"temperature"}  # no humidity, constant voltage


def test_outliers(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(0, 1, 200)
    e[[3, 50, 70]] = 50
    o = one(gt.outliers(generic(spark, e, np.zeros(200)), ["k"]))
    z = 0.6744897501960817 * (e - np.median(e)) / np.median(np.abs(e - np.median(e)))
    assert o["outlier_count"] == (np.abs(z) > 3.5).sum() >= 3
    flat = one(gt.outliers(generic(spark, [1.0] * 10 + [2.0], [0.0] * 11), ["k"]))
    assert flat["outlier_count"] == 1 and flat["maximum_absolute_z"] == math.inf


def test_hysteresis_and_tolerance(spark):
    up = np.arange(6.0)
    down = up[::-1] + 0.004
    m, r = np.r_[up, down + 0.2], np.r_[up, down]
    sweep = ["up"] * 6 + [" down "] * 6
    assert gt.hysteresis(generic(spark, m, r, sweep=sweep), ["k"]).count() == 0
    h = one(gt.hysteresis(generic(spark, m, r, sweep=sweep), ["k"], tolerance=0.01))
    assert h["matched_level_count"] == 6 and h["maximum_absolute_hysteresis"] == pytest.approx(0.204)
    exact = one(gt.hysteresis(generic(spark, np.r_[up, up + 0.2], np.r_[up, up], sweep=sweep), ["k"]))
    assert exact["hysteresis_rms"] == pytest.approx(0.2) and exact["matched_reference_span"] == 5


def test_level_clusters(spark):
    r = [1.0, 1.01, 1.02, 2.0, 2.01, 5.0]
    out = {round(x["r"], 4): x["n"] for x in gt.level_table(generic(spark, r, r), ["k"], tolerance=0.03).collect()}
    assert out == {1.01: 3, 2.005: 2, 5.0: 1}


def test_revisions(spark):
    df = generic(spark, np.r_[np.full(6, 1.0), np.full(6, 2.0), np.full(2, 9.0)], np.zeros(14), revision=["A"] * 6 + ["B"] * 6 + ["C"] * 2)
    assert {r["revision"]: r["bias"] for r in gt.revision_comparison(df, ["k"]).collect()} == {"A": 1.0, "B": 2.0}


IMU = "k string, row_ord bigint, timestamp double, ax double, ay double, az double, gx double, gy double, gz double, temperature double, orientation_label string"


def imu(spark, x, t=None, label=None, temperature=None, k="a"):
    n = len(x)
    t = np.arange(n) / 100 if t is None else t
    rows = [(k, i, float(t[i]), *map(float, x[i]), 20.0 if temperature is None else float(temperature[i]), label[i] if label else None) for i in range(n)]
    return spark.createDataFrame(rows, IMU).repartition(3)


def test_inertial_numbers_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [0.02, 0.03, 0.025, 0.001, 0.002, 0.0015], (600, 6)) + [0, 0, 9.83, 0.001, -0.002, 0.003]
    x[:, 1] += 0.8 * x[:, 0]
    temp = np.linspace(20, 30, 600)
    x[:, 3] += 1e-3 * (temp - 25)
    df = imu(spark, x, temperature=temp, label=["+Z"] * 600)
    g = one(it.gyro_bias(df, ["k"]))
    assert g["bias_vector_magnitude"] == pytest.approx(np.linalg.norm(x[:, 3:].mean(0))) and g["gx_std"] == pytest.approx(x[:, 3].std(ddof=1))
    a = one(it.accelerometer_bias(df, ["k"]))
    assert a["orientation"] == "+Z" and a["az_bias"] == pytest.approx(x[:, 2].mean() - 9.80665) and a["noise_spread_ratio"] > 1
    n = {r["axis"]: r for r in it.stationary_noise(df, ["k"]).collect()}
    assert n["ay"]["difference_noise"] == pytest.approx(np.diff(x[:, 1]).std(ddof=1) / math.sqrt(2)) and n["gz"]["span_5_95"] == pytest.approx(np.subtract(*np.percentile(x[:, 5], [95, 5])))
    e = one(it.gravity_error(df, ["k"]))
    size = np.linalg.norm(x[:, :3], axis=1)
    assert e["mean_absolute_error"] == pytest.approx(np.abs(size - 9.80665).mean())
    c = one(it.axis_correlation(df, ["k"]))
    cov = np.cov(x[:, :3].T)
    assert c["correlation_ax_ay"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) and c["strongest"] == "ax_ay"
    assert c["difference_correlation_ax_ay"] == pytest.approx(np.corrcoef(np.diff(x[:, 0]), np.diff(x[:, 1]))[0, 1])
    assert c["dominant_variance_percent"] == pytest.approx(100 * np.linalg.eigvalsh(cov).max() / np.trace(cov))
    t = {r["axis"]: r for r in it.temperature_stability(df, ["k"]).collect()}
    assert t["gx"]["coefficient"] == pytest.approx(np.polyfit(temp, x[:, 3], 1)[0]) and t["gx"]["r_squared"] > 0.5
    bins = [r for r in it.temperature_bins(df, ["k"]).collect() if r["axis"] == "gx"]
    assert len(bins) == 10 and sum(r["sample_count"] for r in bins) == 600


def test_six_positions_recover_bias_and_sensitivity(spark):
    rng = np.random.default_rng(4)
    bias, sens = np.array([0.08, -0.05, 0.04]), np.array([1.01, 0.992, 1.006])
    rows, labels = [], []
    for label, axis, sign in (("+X", 0, 1), ("x-", 0, -1), ("plus Y", 1, 1), ("Negative_Y", 1, -1), ("+z", 2, 1), ("minusZ", 2, -1)):
        g = np.zeros(3)
        g[axis] = sign * 9.80665
        rows.append(np.c_[g * sens + bias + rng.normal(0, 0.01, (80, 3)), np.zeros((80, 3))])
        labels += [label] * 80
    s = one(it.six_position(imu(spark, np.concatenate(rows), label=labels), ["k"]))
    for i, a in enumerate(("ax", "ay", "az")):
        assert s[f"{a}_bias"] == pytest.approx(bias[i], abs=0.005) and s[f"{a}_sensitivity"] == pytest.approx(sens[i], abs=0.001)
    assert s["corrected_component_rmse"] < 0.01 < s["raw_component_rmse"]


def test_saturation_runs(spark):
    x = np.zeros((30, 6))
    x[:, 0] = np.linspace(-0.5, 0.5, 30)
    x[5:9, 0] = 2.0
    x[12:14, 0], x[15, 0], x[14, 0], x[20, 0] = 2.0, 2.0, np.nan, 2.5
    limits = spark.createDataFrame([("a", "ax", -2.0, 2.0), ("a", "ay", 1.0, 1.0)], "k string, axis string, low double, high double")
    s = one(it.saturation(imu(spark, x), ["k"], limits))
    assert (s["exact_upper_count"], s["longest_exact_run"], s["outside_count"], s["near_count"], s["longest_near_run"]) == (7, 4, 1, 8, 4)


def test_sampling(spark):
    t = np.arange(50) * 0.01
    t[20:] += 0.03
    t[30:] += 0.08
    t[40] = t[39]
    t[45] = t[44] - 0.001
    s = one(it.sampling_integrity(imu(spark, np.zeros((50, 6)), t=t), ["k"]))
    assert (s["duplicate_count"], s["backward_count"], s["large_gap_count"]) == (1, 1, 1)
    assert s["median_interval"] == pytest.approx(0.01) and s["largest_gap"] == pytest.approx(0.09) and s["estimated_missing"] == 3 + 8 + 1 + 1


def test_spectrum_of_a_sine(spark):
    n = 4096
    t = np.arange(n) / 100
    x = np.zeros((n, 6))
    x[:, 0] = 0.7 * np.sin(2 * np.pi * 12.5 * t)
    x[:, 1:] = np.random.default_rng(5).normal(0, 0.1, (n, 5))
    series = spectral.longest_segment(imu(spark, x), ["k"], ["ax", "ay", "az"])
    out = {r["axis"]: r for r in spectral.spectrum_metrics(spectral.welch(series, ["k"], ["ax", "ay", "az"], segment_length=512), ["k"]).collect()}
    assert out["ax"]["dominant_frequency"] == pytest.approx(12.5) and out["ax"]["integrated_rms"] == pytest.approx(0.7 / math.sqrt(2), rel=0.01)
    assert out["ax"]["segment_count"] == 1 + (n - 512) // 256 and out["ay"]["integrated_rms"] == pytest.approx(0.1, rel=0.05)


def test_longest_segment_and_allan(spark):
    rng = np.random.default_rng(6)
    n = 3000
    x = rng.normal(0, 0.02, (n, 6)) + 5
    t = np.arange(n) / 100
    t[700:] += 1.0
    x[2500, 3] = np.nan
    series = spectral.longest_segment(imu(spark, x, t=t), ["k"], ["gx", "gy", "gz"])
    rows = series.orderBy("pos").collect()
    assert len(rows) == 1800 and rows[0]["gx"] == pytest.approx(x[700, 3]) and rows[-1]["pos"] == 1799
    curve = spectral.allan_curve(series, ["k"], ["gx", "gy", "gz"], points=12, min_samples=500, min_duration=5.0)
    got = {(r["axis"], r["m"]): r["adev"] for r in curve.collect()}
    y = x[700:2500, 3]
    for m in spectral.averaging_factors(1800, 12):
        c = np.r_[0, np.cumsum(y - y[0])]
        mean = (c[m:] - c[:-m]) / m
        assert got["gx", m] == pytest.approx(math.sqrt(0.5 * np.mean((mean[m:] - mean[:-m]) ** 2)))
    a = {r["axis"]: r for r in spectral.allan_metrics(curve, ["k"]).collect()}
    assert a["gx"]["random_walk_coefficient"] == pytest.approx(0.02 * math.sqrt(0.01), rel=0.15)
