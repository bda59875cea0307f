"""Spectra over whole recordings: late, repeated and lost rows, slow peaks, both groups of axes."""

import numpy as np
import pytest

import __spark_entry__ as entry
from plumbline.operators import spectral


def test_pairs_in_order_of_time(spark, tmp_path):
    n = 600
    rng = np.random.default_rng(1)
    t = np.arange(n) * 0.1
    e = np.sin(2 * np.pi * 0.05 * t) + rng.normal(0, 0.01, n)  # 20 s a period: three of 64 rows never show
    rows = [(1, i, float(t[i]), float(50 + e[i]), 50.0) for i in range(n) if i % 97]
    for i in range(10, 560, 50):
        rows[i], rows[i + 3] = (1, rows[i][1], *rows[i + 3][2:]), (1, rows[i + 3][1], *rows[i][2:])
    df = spark.createDataFrame(rows, "dataset_id bigint, row_ord bigint, timestamp double, measurement double, reference double")
    df.write.parquet(f"{tmp_path}/generic_samples.parquet")
    (r,) = entry.queries()["generic_psd"](spark, str(tmp_path)).collect()
    assert r["segment_length"] == len(rows)
    assert r["dominant_frequency"] == pytest.approx(0.05, abs=0.01) and not r["regular"]
    got = spectral.ordered_by_time(df.withColumn("e", df.measurement - df.reference), ["dataset_id"], ["e"], block_rows=50).orderBy("pos").collect()
    want = sorted((x[2], x[1], x[3] - x[4]) for x in rows)
    assert [x["pos"] for x in got] == list(range(len(rows)))
    assert [x["e"] for x in got] == [w[2] for w in want] and got[0]["dt"] == pytest.approx(0.1)


def test_inertial_series_are_taken_whole(spark, tmp_path):
    n = 400
    rng = np.random.default_rng(2)
    cols = ("ax", "ay", "az", "gx", "gy", "gz")
    df = spark.createDataFrame([(1, i, i * 0.01, *map(float, rng.normal(0, 1, 6))) for i in range(n)], "dataset_id bigint, row_ord bigint, timestamp double, " + ", ".join(f"{c} double" for c in cols))
    df = df.selectExpr("*", "row_ord AS row_id", "25.0D AS temperature", "'moving' AS motion_state")
    df.write.parquet(f"{tmp_path}/imu_samples.parquet")
    recordings = [(1, 0.01, "unknown", None, None)]
    spark.createDataFrame(recordings, "dataset_id bigint, nominal_period_s double, test_mode string, expected_stationary boolean, notes string").write.parquet(f"{tmp_path}/recordings.parquet")
    spark.createDataFrame([], "dataset_id bigint, field_name string, source_column string, units string, original_units string").write.parquet(f"{tmp_path}/channel_units.parquet")
    assert {(r["axis"], r["segment_length"]) for r in entry.queries()["imu_psd"](spark, str(tmp_path)).collect()} == {(c, n) for c in cols}
    allan = entry.queries()["imu_allan_deviation"](spark, str(tmp_path)).collect()
    assert {r["axis"] for r in allan} == set(cols)
    assert {r["points"] for r in allan} == {len(spectral.averaging_factors(n))} and all(r["bias_instability"] is None for r in allan)


def test_blocks_change_no_segment_and_no_deviation(spark):
    rng = np.random.default_rng(4)
    n = 500
    t = np.arange(n) * 0.01
    t[120:] += 0.05  # a lost stretch
    t[400] = t[399]
    x = rng.normal(0, 1, (n, 3))
    x[300, 1] = np.nan
    rows = [(1, i, float(t[i]), *map(float, x[i])) for i in range(n)] + [(2, i, i * 0.01, 1.0, 2.0, 3.0) for i in range(7)] + [(None, 1, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k bigint, row_ord bigint, timestamp double, a double, b double, c double").repartition(4)
    axes = ["a", "b", "c"]
    want = [(1, i - 120, *x[i]) for i in range(120, 300)] + [(2, i, 1.0, 2.0, 3.0) for i in range(7)]
    for block in (3, 64, 60_000):
        series = spectral.longest_segment(df, ["k"], axes, block_rows=block)
        assert sorted((r["k"], r["pos"], r["a"], r["b"], r["c"]) for r in series.collect()) == want
    curves = []
    for block, halo in ((60_000, 30_000), (64, 20), (16, 8)):
        curve = spectral.allan_curve(series, ["k"], axes, points=12, min_samples=100, min_duration=0.5, block_rows=block, halo_rows=halo)
        curves.append({(r["axis"], r["m"]): r["adev"] for r in curve.collect()})
    assert len(curves[0]) == 3 * len(spectral.averaging_factors(180, 12))
    for other in curves[1:]:
        assert other == pytest.approx(curves[0])
