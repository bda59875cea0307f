"""Queries that measure inertial recordings in common units, over tables written here."""

import numpy as np
import pytest

import __spark_entry__ as entry

G = 9.80665
IMU = "row_id bigint, dataset_id bigint, row_ord bigint, sensor_id string, timestamp double, ax double, ay double, az double, gx double, gy double, gz double, temperature double, orientation_label string, motion_state string"
RECORDING = "dataset_id bigint, sensor_type string, nominal_period_s double, nominal_sampling_rate_hz double, test_mode string, expected_stationary boolean, notes string, accelerometer_range_max double, accelerometer_range_unit string, gyroscope_range_max double, gyroscope_range_unit string"
UNITS = "dataset_id bigint, field_name string, source_column string, units string, original_units string"


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """Six poses of one sensor, every other recording in g, limits of 2 g stated in the unit the values are not in."""
    d, rows, rec = str(tmp_path_factory.mktemp("units")), [], []
    rng = np.random.default_rng(3)
    n = 200
    for i, (axis, sign) in enumerate([(a, s) for a in range(3) for s in (1, -1)]):
        a = rng.normal(0, 0.02, (n, 3)) + [0.1, -0.05, 0.02]
        a[:, axis] += sign * G
        in_g = i % 2 == 0
        a[100:104, axis] = sign * 2 * G
        a = a / G if in_g else a
        g = rng.normal(0, 0.001, (n, 3))
        label = ("plus" if sign > 0 else "minus") + " " + "xyz"[axis]
        rows += [(i * 1000 + k, i, k, "s", k * 0.01, *map(float, a[k]), *map(float, g[k]), 25.0, label, "rest") for k in range(n)]
        rec.append((i, "imu", 0.01, 100.0, "imu_stationary", True, None, 2 * G if in_g else 2.0, "m/s^2" if in_g else "g", 2000.0, "deg/s"))
    for name, data, schema in (("imu_samples", rows, IMU), ("recordings", rec, RECORDING), ("channel_units", [], UNITS)):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def run(spark, name, d):
    return entry.queries()[name](spark, d).collect()


def test_six_positions_in_mixed_units(spark, recorded):
    (r,) = run(spark, "imu_six_position", recorded)
    assert (r["ax_bias"], r["ay_bias"], r["az_bias"]) == pytest.approx((0.1, -0.05, 0.02), abs=0.01)
    assert r["ax_sensitivity"] == pytest.approx(1.02, abs=0.01)
    assert r["raw_mean_angular_deviation"] < 1


def test_limits_and_values_meet_in_one_unit(spark, recorded):
    rows = run(spark, "imu_saturation", recorded)
    assert sum(r["exact_count"] for r in rows) == 6 * 4 and sum(r["outside_count"] for r in rows) == 0
    assert len(rows) == 6 * 6 and max(r["longest_exact_run"] for r in rows) == 4


@pytest.mark.parametrize(("name", "column"), [("imu_accelerometer_bias", "mean_vector_magnitude"), ("imu_gravity_error", "mean_magnitude"), ("imu_gravity_by_orientation", "mean_vector_magnitude")])
def test_gravity_is_gravity_in_every_recording(spark, recorded, name, column):
    rows = run(spark, f"{name}", recorded)
    assert len(rows) == 6
    assert all(r[column] == pytest.approx(G * 1.02, rel=0.02) for r in rows)


def test_clipping_is_a_hypothesis(spark, recorded):
    rows = [r for r in run(spark, "imu_hypotheses", recorded) if r["hypothesis"] == "range_boundary_clipping"]
    assert sorted((r["dataset_id"], r["axes"], r["strength"], r["evidence"]) for r in rows) == [(i, f"a{'xyz'[i // 2]}", "strong", 4.0) for i in range(6)]
