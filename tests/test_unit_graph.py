import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import unit_graph as ug

IMU = "row_id bigint, dataset_id bigint, row_ord bigint, timestamp double, ax double, ay double, az double, gx double, gy double, gz double, temperature double, motion_state string"
RECORDING = "dataset_id bigint, nominal_period_s double, test_mode string, expected_stationary boolean, notes string"
UNITS = "dataset_id bigint, field_name string, source_column string, units string, original_units string"


def test_shortest_compositions():
    table = ug.conversions()
    assert table["h"] == ("s", pytest.approx(3600), 0)
    assert table["mg"][1] == pytest.approx(9.80665e-3)
    assert table["rpm"][1] == pytest.approx(2 * math.pi / 60)
    target, scale, offset = table["degR"]
    assert target == "degC" and 491.67 * scale + offset == pytest.approx(0)
    assert 212 * table["degF"][1] + table["degF"][2] == pytest.approx(100)
    assert table["m/s^2"] == ("m/s^2", 1.0, 0.0)


def test_cycles_must_agree(monkeypatch):
    monkeypatch.setattr(ug, "EDGES", (*ug.EDGES, ("h", "ms", 1000.0, 0.0)))
    with pytest.raises(ValueError, match="disagree"):
        ug.conversions()


def test_spellings(spark):
    said = [("acc_x [g]", "g"), ("Temp(°C)", "degC"), ("Time / ms", "ms"), ("gx_in_dps", "deg/s"), ("ax", None), ("x [furlong]", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in said], "c string").select(ug.header_unit("c"))
    assert [r[0] for r in df.collect()] == [b for _, b in said]
    df = spark.createDataFrame([(" G ",), ("Milli-G",), ("µs",), ("KELVIN",), ("",), (None,)], "c string").select(ug.unit_name("c"))
    assert [r[0] for r in df.collect()] == ["g", "mg", "us", "K", None, None]


def recording(d, seed, n=240, moving=False):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 0.01
    a = rng.normal(0, 0.03, (n, 3)) + [0.05, -0.04, 9.81]
    g = rng.normal(0, 0.001, (n, 3)) + 0.001
    if moving:
        a += np.stack([2 * np.sin(t * 9), 2 * np.cos(t * 7), np.sin(t * 5)], 1)
        g += np.stack([0.3 * np.sin(t * 9), 0.3 * np.cos(t * 9), 0.2 * np.sin(t * 4)], 1)
    return d, t, a, g, np.full(n, 24.0), "moving" if moving else "rest"


def table(spark, recs):
    rows = []
    for d, t, a, g, temp, state in recs:
        rows += [(d * 1000 + i, d, i, float(t[i]), *map(float, a[i]), *map(float, g[i]), float(temp[i]), state) for i in range(len(t))]
    return spark.createDataFrame(rows, IMU).repartition(4)


def detected(spark, recs, units=(), notes=None):
    rec = [(r[0], 0.01, None, None, (notes or {}).get(r[0])) for r in recs]
    rec = rec + rec[:1]
    args = table(spark, recs), spark.createDataFrame(rec, RECORDING), spark.createDataFrame(list(units), UNITS)
    channels = ug.channel_units_from_values(*args)
    return args, channels, {(r["dataset_id"], r["field_name"]): (r["unit"], r["partial"]) for r in channels.collect()}


def test_units_come_from_the_values(spark):
    recs = [list(recording(d, d, moving=d in (3, 6))) for d in range(1, 9)]
    recs[1][2] = recs[1][2] / 9.80665  # 2: g
    recs[1][1] = recs[1][1] * 1e6  # us
    recs[2][3] = recs[2][3] * 180 / math.pi  # 3: moving, deg/s
    recs[3][4] = recs[3][4] * 1.8 + 32  # 4: degF
    recs[4][2] = recs[4][2] * 100  # 5: cm/s^2
    recs[5][2] = recs[5][2] / 9.80665 * 1000  # 6: moving, mg as stated
    recs[6][2][120:] *= 1000 / 9.80665  # 7: changes to mg half way
    recs[7][2][:, 1] /= 9.80665  # 8: one axis in g
    units = [(1, "ax", "acc [g]", "g", "g"), (4, "temperature", "t", "degC", None), (4, "temperature", "t", "degC", None), (6, "ax", "x", "milli-g", None), (8, "ay", "y", " G ", None), (8, "ax", "x", "m/s2", None), (None, None, None, None, None)]
    args, channels, got = detected(spark, recs, units)
    assert got[1, "ax"] == ("m/s^2", False) and got[1, "gx"] == ("rad/s", False) and got[1, "timestamp"] == ("s", False)
    assert got[2, "ax"] == ("g", False) and got[2, "timestamp"] == ("us", False)
    assert got[3, "gy"] == ("deg/s", False) and got[3, "ax"] == ("m/s^2", False)
    assert got[4, "temperature"] == ("degF", False)
    assert got[5, "az"] == ("cm/s^2", False)
    assert got[6, "ax"] == ("mg", False)
    assert got[7, "ax"] == ("mg", True)
    assert [got[8, a][0] for a in ("ax", "ay", "az")] == ["m/s^2", "g", "m/s^2"]
    found = {(r[0], r[1]) for r in ug.not_canonical(channels).collect()}
    assert found == {(2, "ax"), (2, "ay"), (2, "az"), (2, "timestamp"), (3, "gx"), (3, "gy"), (3, "gz"), (4, "temperature"), (5, "ax"), (5, "ay"), (5, "az"), (6, "ax"), (6, "ay"), (6, "az"), (7, "ax"), (7, "ay"), (7, "az"), (8, "ay")}
    back = ug.to_common_units(args[0], channels)
    size = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    for r in back.groupBy("dataset_id").agg(F.median(size).alias("a"), F.max("timestamp").alias("t"), F.avg("temperature").alias("c"), F.min(size).alias("low"), F.max(size).alias("high")).collect():
        assert r["t"] == pytest.approx(2.39) and r["c"] == pytest.approx(24.0)
        if r["dataset_id"] not in (3, 6):
            assert r["a"] == pytest.approx(9.81, rel=0.01) and r["low"] > 9.4 and r["high"] < 10.2, r


def test_short_second_units_and_strays(spark):
    recs = [list(recording(d, d)) for d in (1, 2, 3)]
    recs[0][2][233:] /= 9.80665  # 1: the last 3 % in g
    recs[0][2][235, 1] = np.nan  # a row whose vector has no length
    recs[1][2][100] *= 20  # 2: a stray reading
    recs[1][4][50] = 90.0
    recs[2][4][236:] = recs[2][4][236:] * 1.8 + 32  # 3: the last four rows in degF
    recs[2][4][236:] += 20  # well above what degC would be
    args, channels, got = detected(spark, recs)
    assert got[1, "ax"] == ("g", True) and got[2, "ax"] == ("m/s^2", False) and got[2, "temperature"] == ("degC", False)
    assert got[3, "temperature"] == ("degF", True)
    back = {r["row_ord"]: r for r in ug.to_common_units(args[0], channels).where("dataset_id = 1").collect()}
    plain = {r["row_ord"]: r for r in args[0].where("dataset_id = 1").collect()}
    assert all(back[i]["az"] == pytest.approx(plain[i]["az"] * (9.80665 if i >= 233 else 1)) for i in range(240))


def test_notes_and_the_join_on_unit_and_target(spark):
    recs = [recording(1, 1)]
    rec = [(1, 0.01, None, None, "long lead; gyro in dps; data sheet quotes range in g")]
    units = spark.createDataFrame([(1, f, f, None, None) for f in ("gx", "ax")], UNITS)
    got = {r["field_name"]: r["stated"] for r in ug.statements(units, spark.createDataFrame(rec, "dataset_id bigint, nominal_period_s double, test_mode string, expected_stationary boolean, notes string")).collect()}
    assert got == {"gx": "deg/s", "ax": None}
    odd = spark.createDataFrame([(1, "ax", "g", False, None), (1, "gx", "g", False, None)], "dataset_id bigint, field_name string, unit string, partial boolean, stated string")
    assert {r["field_name"]: r["scale"] for r in ug.with_functions(odd).collect()} == {"ax": 9.80665, "gx": None}
    assert len(recs) == 1


def test_missing_values_and_empty_tables(spark):
    rec = recording(1, 1)
    rec[2][5, 0] = np.nan
    rec[4][:] = np.nan
    args, channels, got = detected(spark, [rec])
    assert (1, "temperature") not in got and got[1, "ax"] == ("m/s^2", False)
    lone = table(spark, [recording(7, 7)])
    none = spark.createDataFrame([], RECORDING), spark.createDataFrame([], UNITS)
    assert {r["unit"] for r in ug.channel_units_from_values(lone, *none).collect()} == {"s", "m/s^2", "rad/s", "degC"}
    empty = spark.createDataFrame([], IMU)
    assert ug.channel_units_from_values(empty, *none).count() == 0
    assert ug.to_common_units(empty, ug.channel_units_from_values(empty, *none)).count() == 0
