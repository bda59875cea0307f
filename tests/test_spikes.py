import numpy as np
import pytest

from plumbline.operators import kalman
from plumbline.operators.spikes import flag_generic, flag_inertial

SAMPLES = "row_id bigint, dataset_id bigint, row_ord bigint, timestamp double, measurement double, reference double"
RANGES = "dataset_id bigint, range_min double, range_max double"


def source(seed, n=300, ref=False, coarse=None):
    rng = np.random.default_rng(seed)
    r = 50 + 10 * np.sin(np.arange(n) / 15) if ref else np.full(n, 50.0)
    y = r * (1.01 if ref else 1.0) + 0.3 + rng.normal(0, 0.2, n)
    return (np.round(y / coarse) * coarse if coarse else y), (r if ref else [None] * n)


def rows(d, y, r, base=0):
    return [(base + i, d, i, float(i), None if v is None else float(v), None if x is None else float(x)) for i, (v, x) in enumerate(zip(y, r, strict=True))]


def flagged(spark, data, ranges=((1, 0.0, 100.0), (2, 0.0, 100.0)), **kw):
    df = spark.createDataFrame(data, SAMPLES).selectExpr("*", "'x' AS kind", "1 AS block").repartition(3)
    return {r["row_id"]: r["kind"] for r in flag_generic(df, spark.createDataFrame(list(ranges), RANGES), **kw).collect()}


@pytest.mark.parametrize("ref", [False, True])
def test_spikes_stuck_runs_and_impossible_readings(spark, ref):
    y, r = source(1, ref=ref)
    y[40] += 4
    y[90:93] -= 3
    y[150:165] = y[149]
    y[200], y[201] = 1e9, float("inf")
    y[0] += 5
    got = flagged(spark, rows(1, y, r))
    assert {i for i, k in got.items() if k == "spike"} == {0, 40, 90, 91, 92}
    assert {i for i, k in got.items() if k == "stuck"} == set(range(149, 165))
    assert {i for i, k in got.items() if k == "impossible"} == {200, 201}


def test_what_is_no_case(spark):
    y, r = source(2, ref=True)
    r[100:105] = r[100:105] + 30  # the measurement follows the reference
    y[100:105] += 30.3
    coarse, none = source(3, coarse=0.5)
    data = rows(1, y, r) + rows(2, coarse, none, 1000)
    assert flagged(spark, data) == {}
    shifted, none = source(4)
    shifted[150:] += 8  # a lasting change of the source
    assert flagged(spark, rows(1, shifted, none)) == {}


@pytest.mark.parametrize("n", [6, 7, 8, 12, 20])
def test_excursions_of_any_length(spark, n):
    y, r = source(11, n=400)
    y[150 : 150 + n] += 100  # 500 sigma
    assert flagged(spark, rows(1, y, r), ranges=[]) == {i: "spike" for i in range(150, 150 + n)}


@pytest.mark.parametrize("n", [7, 8, 12])
def test_long_excursions_of_a_resting_axis(n):
    rng = np.random.default_rng(12)
    y = rng.normal(0, 0.02, (400, 3)) + 9.8
    y[200 : 200 + n, 1] += 10
    z, _ = kalman.standardised_innovations(y, np.arange(400.0)[:, None] * np.ones((1, 3)), np.full((400, 3), np.nan), True, 6.2)
    assert np.argwhere(np.abs(z) > 6.2).tolist() == [[i, 1] for i in range(200, 200 + n)]


@pytest.mark.parametrize("n", [6, 9, 30])
def test_stuck_runs_of_any_length(spark, n):
    y, r = source(13, n=400)
    y[150 : 150 + n] = y[150]
    coarse, none = source(14, n=400, coarse=0.1)
    coarse[40:43] = coarse[40]  # an ordinary repeat of a coarse sensor
    assert flagged(spark, rows(1, y, r) + rows(2, coarse, none, 1000)) == {i: "stuck" for i in range(150, 150 + n)}


def test_a_long_recording_is_judged_in_segments():
    from plumbline.operators import spikes

    rng = np.random.default_rng(15)
    n = 16_896
    y = 50 + np.cumsum(rng.normal(0, 0.05, n)) + rng.normal(0, 0.2, n)
    at = [0, 511, 512, 5000, n - 1]
    y[at] += 6
    z, _ = spikes._filtered(y, np.arange(n, dtype=float), np.full(n, np.nan), np.array([0]), np.array([n]), False, 6.2)
    assert np.flatnonzero(np.abs(z) > 6.2).tolist() == at and np.isfinite(z).all()


def test_blocks_do_not_change_the_verdict(spark):
    y, r = source(5, n=900)
    for i in (10, 255, 256, 300, 511, 512, 700):
        y[i] += 5
    y[505:520] = y[505]
    whole = flagged(spark, rows(1, y, r))
    cut = flagged(spark, rows(1, y, r), block_rows=256, halo_rows=64)
    assert whole == cut
    assert {10, 255, 256, 300, 700} <= set(whole)


def test_nulls_repeats_and_empty(spark):
    y, r = source(6)
    y[50] += 6
    data = rows(1, y, r)
    data[60] = (60, 1, 60, 60.0, None, None)
    data[61] = (61, 1, 61, 61.0, float("nan"), None)
    data[62] = (62, 1, 62, None, float(y[62]), None)
    data.append((900, 1, 51, 50.0, float(y[50]), None))  # delivered twice
    data += [(901, None, None, None, 5.0, None), (902, 2, 0, 0.0, 500.0, None), (903, 2, 1, 1.0, 50.0, None)]
    got = flagged(spark, data)
    assert got == {50: "spike", 900: "spike", 902: "impossible"}
    assert flagged(spark, []) == {}
    assert flagged(spark, rows(1, y, r), ranges=[(9, 0.0, 1.0)]) == {50: "spike"}


def test_readings_without_reference_are_judged(spark):
    y, r = source(9, ref=True)
    r[70:75] += 30  # a step of the reference, one of its rows without one
    y[70:75] += 30.3
    y[40] += 4
    y[120] -= 4
    y[200:202] += 4
    y[299] += 4
    data = rows(1, y, r)
    for i in (20, 40, 70, 74, 120, 121, 150, *range(198, 206), 299):
        data[i] = (*data[i][:5], float("nan") if i == 120 else None)
    assert flagged(spark, data) == {i: "spike" for i in (40, 120, 200, 201, 299)}
    lonely, none = source(10)
    lonely[90] += 4
    data = rows(1, lonely, none)
    data[10] = (*data[10][:5], 50.0)  # one reference in the whole recording
    assert flagged(spark, data) == {90: "spike"}


def test_one_sided_noise_is_normal():
    rng = np.random.default_rng(7)
    y = rng.beta(0.4, 2.5, (400, 5)) * 3
    y[100, 2] += 12
    z, _ = kalman.standardised_innovations(y, np.arange(400.0)[:, None] * np.ones((1, 5)), np.full((400, 5), np.nan), False, 6.2)
    assert np.argwhere(np.abs(z) > 6.2).tolist() == [[100, 2]]


def test_filter_against_dense_algebra():
    """The forward prediction equals the conditional mean of the Gaussian model."""
    rng = np.random.default_rng(8)
    n, r, ratio, sd = 12, 0.5, 0.2, 3.0
    y = rng.normal(0, 1, n)
    mean, var = kalman.run_filter(y[:, None], np.ones((n, 1), bool), np.r_[0.0, np.ones(n - 1)][:, None], np.zeros((n, 1)), np.array([r]), np.array([ratio]), False, np.zeros(1), np.array([sd]), np.zeros(1))
    k = np.minimum.outer(np.arange(n), np.arange(n)) * r * ratio + sd**2
    for i in range(1, n):
        g = np.linalg.solve(k[:i, :i] + r * np.eye(i), k[:i, i])
        assert mean[i, 0] == pytest.approx(g @ y[:i])
        assert var[i, 0] == pytest.approx(k[i, i] - g @ k[:i, i])


def imu_rows(seed, n=300, moving=False):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 100
    a = rng.normal(0, 0.02, (n, 3)) + [0, 0, 9.8] + (np.stack([3 * np.sin(t * 8), 2 * np.cos(t * 7), np.sin(t * 5)], 1) if moving else 0)
    g = rng.normal(0, 0.001, (n, 3)) + (np.stack([np.sin(t * 6)] * 3, 1) if moving else 0.001)
    return t, a, g


IMU = "row_id bigint, dataset_id bigint, row_ord bigint, timestamp double, ax double, ay double, az double, gx double, gy double, gz double, temperature double, motion_state string"
RECORDING = "dataset_id bigint, nominal_period_s double, test_mode string, expected_stationary boolean, notes string, accelerometer_range_max double, accelerometer_range_unit string, gyroscope_range_max double, gyroscope_range_unit string"


def test_inertial_sensors_in_their_own_units(spark):
    data = []
    for d, moving, in_g in ((1, False, False), (2, True, False), (3, False, True)):
        t, a, g = imu_rows(d, moving=moving)
        a[50, 0] += 2.0
        a[80:82, 0] -= 1.5
        g[120, 0] += 0.5
        a[200, 0] = 45.0
        if in_g:
            a /= 9.80665
        data += [(d * 1000 + i, d, i, float(t[i]), *map(float, a[i]), *map(float, g[i]), 25.0, "moving" if moving else "rest") for i in range(len(t))]
    rec = [(d, 0.01, "imu_dynamic" if d == 2 else "imu_stationary", d != 2, None, 4.0, "g", 2000.0, "deg/s") for d in (1, 2, 3)]
    units = spark.createDataFrame([(1, "ax", "ax", "m/s^2", None)], "dataset_id bigint, field_name string, source_column string, units string, original_units string")
    out = flag_inertial(spark.createDataFrame(data, IMU), spark.createDataFrame(rec, RECORDING), units).collect()
    got = {(r["row_id"], r["field_name"], r["kind"]) for r in out}
    want = {(d * 1000 + i, f, k) for d in (1, 2, 3) for i, f, k in ((50, "ax", "spike"), (80, "ax", "spike"), (81, "ax", "spike"), (120, "gx", "spike"), (200, "ax", "impossible"))}
    assert got == want
