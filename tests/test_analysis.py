import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vocabulary
from plumbline.functions.rounding import significant
from plumbline.joins import attach
from plumbline.operators import calibration, diagnostics, validation
from plumbline.plans import metrics
from plumbline.sources import csv_files

PAIR = "k string, row_ord bigint, timestamp double, measurement double, reference double, g string"


def pairs(spark, m, r, k="a", g=None):
    return spark.createDataFrame([(k, i, float(i), float(a), float(b), g[i] if g else None) for i, (a, b) in enumerate(zip(m, r, strict=True))], PAIR).repartition(3)


def test_calibration_recovers_a_line_from_training_rows_only(spark):
    sensor = np.linspace(-5, 15, 50)
    reference = 1.08 * sensor - 0.35
    reference[40:] += 100  # held-out rows must not reach the fit
    split = calibration.split_sequential(pairs(spark, sensor, reference), ["k"])
    model = calibration.fit(split, ["k"]).collect()[0]
    assert model["gain"] == pytest.approx(1.08, abs=1e-12) and model["offset"] == pytest.approx(-0.35, abs=1e-12) and model["training_rows"] == 40
    out = calibration.evaluate(split, ["k"], calibration.fit(split, ["k"])).collect()[0]
    assert out["validation_rows"] == 10 and out["rmse_after"] == pytest.approx(100) and out["error_std_after"] == pytest.approx(0, abs=1e-9)
    offset = calibration.fit(calibration.split_sequential(pairs(spark, sensor, sensor + 1.75), ["k"]), ["k"], "offset").collect()[0]
    assert (offset["gain"], offset["offset"]) == (1.0, pytest.approx(1.75))


def test_calibration_edges(spark):
    assert calibration.fit(calibration.split_sequential(pairs(spark, np.ones(10), np.arange(10.0)), ["k"]), ["k"]).count() == 0
    df = pairs(spark, [0, 1, float("nan"), 3, 4, 5], [1, 3, 5, float("inf"), 9, 11])
    model = calibration.fit(calibration.split_sequential(df, ["k"]), ["k"]).collect()[0]
    assert model["gain"] == pytest.approx(2) and model["offset"] == pytest.approx(1) and model["training_rows"] == 3
    groups = [f"run{i // 6}" for i in range(24)]
    split = calibration.split_grouped(pairs(spark, np.arange(24.0), np.arange(24.0), g=groups), ["k"], "g", share=0.25, seed=11)
    sides = {r["g"]: r["n"] for r in split.groupBy("g").agg(F.countDistinct("validation").alias("n")).collect()}
    assert set(sides.values()) == {1} and split.where("validation").count() == 6
    hashed = calibration.split_random(pairs(spark, np.arange(1000.0), np.arange(1000.0)), ["k"], seed=1)
    first = {r["row_ord"] for r in hashed.where("validation").collect()}
    again = {r["row_ord"] for r in calibration.split_random(pairs(spark, np.arange(1000.0), np.arange(1000.0)).repartition(9), ["k"], seed=1).where("validation").collect()}
    assert first == again and len(first) == 200
    four = calibration.split_random(pairs(spark, np.arange(4.0), np.arange(4.0)), ["k"], seed=3)
    assert four.where("validation").count() == 1 and calibration.split_random(pairs(spark, np.arange(3.0), np.arange(3.0)), ["k"]).count() == 0


LIMITS = [("<", 4.9, "pass"), ("<", 5, "fail"), ("<=", 5, "pass"), (">", 5.1, "pass"), (">=", 5, "pass"), ("==", 5, "pass"), ("==", 5.0001, "fail"), ("abs<", -4.9, "pass"), ("abs<=", -5.0, "pass"), ("abs<=", -5.1, "fail")]


def test_requirements(spark):
    wanted = [{"id": f"r{i}", "tool_id": "generic_accuracy", "metric": f"M{i}", "operator": op, "limit": 5} for i, (op, _, _) in enumerate(LIMITS)]
    wanted += [
        {"id": "between", "tool_id": "generic_accuracy", "metric": "M0", "operator": "between", "lower_limit": 4.9, "upper_limit": 6},
        {"id": "unit", "tool_id": "generic_accuracy", "metric": "M0", "operator": "<", "limit": 5, "unit": "M / S²"},
        {"id": "wrong_unit", "tool_id": "generic_accuracy", "metric": "M0", "operator": "<", "limit": 5, "unit": "g"},
        {"id": "missing", "tool_id": "generic_accuracy", "metric": "other", "operator": "<", "limit": 5},
        {"id": "no_tool", "tool_id": "generic_snr", "metric": "M0", "operator": "<", "limit": 5},
        {"id": "off", "tool_id": "generic_snr", "metric": "M0", "operator": "<", "limit": 5, "enabled": False},
    ]
    rows = [("a", "generic_accuracy", i, f"M{i}", float(v), "m/s^2") for i, (_, v, _) in enumerate(LIMITS)]
    rows += [("a", "generic_accuracy", 50, "M1", 5.0, "m/s^2"), ("a", "generic_accuracy", -1, "M1", 0.0, "m/s^2"), ("b", "generic_accuracy", 0, "M0", math.inf, "m/s^2")]
    table = spark.createDataFrame(rows, "k string, tool_id string, seq int, name string, value double, unit string")
    checks = metrics.qualify(table, spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string"), ["k"], metrics.requirements(wanted))
    got = {(r["k"], r["requirement_id"]): (r["status"], r["reason"]) for r in checks.collect()}
    assert len(got) == 3 * 15
    assert [got["a", f"r{i}"][0] for i in range(len(LIMITS))] == [s for _, _, s in LIMITS]
    assert got["a", "between"][0] == got["a", "unit"][0] == "pass"
    assert got["a", "wrong_unit"][1] == "unit differs" and got["a", "missing"][1] == "metric missing" and got["a", "no_tool"][1] == "tool gave no result"
    assert got["b", "r0"][1] == "value not finite" and got["c", "r0"][1] == "tool gave no result"
    total = {r["k"]: r["status"] for r in metrics.overall(checks, ["k"]).collect()}
    assert total == {"a": "fail", "b": "not_evaluated", "c": "not_evaluated"}
    by_tool = {(r["k"], r["tool_id"]): r["status"] for r in metrics.overall_by_tool(checks.where("requirement_id IN ('r0', 'missing')"), ["k"]).collect()}
    assert by_tool["a", "generic_accuracy"] == "pass"


def test_bad_requirements(tmp_path):
    base = {"id": "x", "tool_id": "t", "metric": "m", "operator": "<", "limit": 1}
    for change in ({"operator": "!="}, {"limit": True}, {"limit": math.nan}, {"metric": ""}, {"operator": "between"}, {"operator": "between", "lower_limit": 2, "upper_limit": 1}):
        with pytest.raises(ValueError):
            metrics.requirements([base | change])
    with pytest.raises(ValueError, match="two requirements"):
        metrics.requirements([base, base])
    path = tmp_path / "p.toml"
    path.write_text('[[requirements]]\nid = "a"\ntool_id = "t"\nmetric = "m"\noperator = "abs<="\nlimit = 2\nunit = "%"\n')
    assert metrics.load_requirements(path)[0]["limit"] == 2.0


def test_validator(spark):
    nan = float("nan")
    rows = [("a", i, float(i) if i != 5 else 4.0, None if i == 3 else (nan if i == 4 else float("inf") if i == 6 else 1.0), 7.0) for i in range(20)]
    rows[10] = ("a", 10, 3.0, 1.0, 7.0)
    rows += [("b", 0, 1.0, 1.0, 2.0), ("b", 1, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, row_ord bigint, timestamp double, x double, y double").repartition(3)
    got = {(r["k"], r["issue_id"], r["column"]): (r["severity"], r["affected_rows"]) for r in validation.validate(df, ["k"], ["timestamp", "x", "y"]).collect()}
    assert got["a", "missing_values", "x"] == ("warning", 2)
    assert got["a", "infinite_values", "x"] == ("error", 1)
    assert got["a", "constant_channel", "y"][0] == "info" and ("a", "constant_channel", "timestamp") not in got
    assert got["a", "duplicate_timestamps", "timestamp"] == ("warning", 1) and got["a", "backward_timestamps", "timestamp"] == ("error", 1)
    assert got["a", "large_time_gaps", "timestamp"] == ("warning", 1)
    assert got["b", "short_dataset", None] == ("warning", 2) and got["b", "duplicate_rows", None] == ("warning", 2) and got["b", "no_positive_time_intervals", "timestamp"][0] == "error"
    text = spark.createDataFrame([("a", i, v) for i, v in enumerate(["1", " 2 ", "abc", "1.0d", None, "inf", "NaN", "3f", ".5", "1e3"] * 2)], "k string, row_ord bigint, x string")
    raw, reading = csv_files.non_numeric("x")
    assert [r[0] for r in text.limit(10).select(reading).collect()] == [1.0, 2.0, None, None, None, math.inf, None, None, 0.5, 1000.0]
    issue = [r for r in validation.validate(text, ["k"], [], timestamp=None, text={"x": reading}).collect() if r["issue_id"] == "non_numeric_values"]
    assert issue[0]["severity"] == "error"


def test_vocabulary(spark):
    m = vocabulary.infer(["Time (s)", "Accel X", "GYRO_Y", "temp", "Temperature °C", "note", "reference", "measured value", "az"])
    assert m.fields["ax"] == "Accel X" and m.fields["gy"] == "GYRO_Y" and m.fields["timestamp"] == "Time (s)" and m.fields["az"] == "az" and m.fields["measurement"] == "measured value"
    assert "note" in m.unmapped
    clash = vocabulary.infer(["temp", "temp_c", "ax"])
    assert "temperature" not in clash.fields and clash.warnings
    with pytest.raises(ValueError):
        vocabulary.infer(["a", "a"])
    with pytest.raises(ValueError):
        vocabulary.infer(["a"], {"ax": "b"})
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "acc_x double, note double, gx double")
    assert vocabulary.apply(df, vocabulary.infer(df.columns)).columns == ["gx", "ax", "note"] or set(vocabulary.apply(df, vocabulary.infer(df.columns)).columns) == {"gx", "ax", "note"}
    with pytest.raises(ValueError, match="canonical"):
        vocabulary.apply(df, vocabulary.FieldMapping({"gx": "acc_x"}))


def test_csv_files(spark, tmp_path):
    n = 5000
    body = "\n".join(f"{i};{i / 2};x{i}" if i != 7 else "7;NA;" for i in range(n))
    (tmp_path / "a.csv").write_bytes(("﻿ time ;acc_x;note\n" + body).encode())
    df = csv_files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["time", "acc_x", "note", "source_file", "row_ord"]
    out = csv_files.numbers(df, ["time", "acc_x"]).orderBy("row_ord").collect()
    assert [r["row_ord"] for r in out] == list(range(n)) and [r["time"] for r in out] == [float(i) for i in range(n)]
    assert out[7]["acc_x"] is None and out[7]["note"] is None
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        again = csv_files.read_csv(spark, str(tmp_path / "a.csv"))
        assert again.rdd.getNumPartitions() > 3
        assert [r["time"] for r in again.orderBy("row_ord").collect()] == [str(i) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    shape = {r["column"]: (r["present"], r["missing"], r["distinct"]) for r in csv_files.profile(df, ["time", "acc_x", "note"]).collect()}
    assert shape["acc_x"] == (n - 1, 1, n - 1)
    assert csv_files.sniff(b"a|b\n1|2\n")[1] == "|" and csv_files.sniff("ä,b\n".encode("latin-1"))[0] == "iso-8859-1"
    with pytest.raises(ValueError):
        (tmp_path / "empty.csv").write_text("")
        csv_files.read_csv(spark, str(tmp_path / "empty.csv"))


def test_hypotheses(spark):
    spectra = spark.createDataFrame([("a", "gx", 10.0), ("a", "gy", 10.4), ("a", "gz", 30.0)], "k string, axis string, dominant_frequency double")
    corr = spark.createDataFrame([("a", 0.8, 0.1, -0.9, 0.75, 0.0, 0.2)], "k string, correlation_gx_gy double, correlation_gx_gz double, correlation_gy_gz double, difference_correlation_gx_gy double, difference_correlation_gx_gz double, difference_correlation_gy_gz double")
    axes = ("gx", "gy", "gz")
    assert [(r["axes"], r["strength"]) for r in diagnostics.shared_periodic(spectra, corr, ["k"], axes).collect()] == [("gx,gy", "moderate")]
    cov = {r["axes"]: r["hypothesis"] for r in diagnostics.unexplained_covariance(corr, ["k"], axes).collect()}
    assert cov == {"gx,gy": "short_timescale_cross_axis_covariance", "gy,gz": "slow_cross_axis_covariance"}
    sat = spark.createDataFrame([("a", "ax", 4, 3, 0), ("a", "ay", 4, 3, 1), ("a", "az", 1, 1, 0), ("a", "gx", 0, 0, 5)], "k string, axis string, exact_count bigint, longest_exact_run bigint, outside_count bigint")
    assert {r["axes"]: r["strength"] for r in diagnostics.boundary_clipping(sat, ["k"]).collect()} == {"ax": "strong", "ay": "conflicting", "az": "moderate"}


def test_attach_beyond_the_broadcast_bound(spark):
    big = spark.range(2000).withColumn("k", F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 50))
    small = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    near, far = attach(big, small, ["k"]), attach(big, small, ["k"], limit=10, salts=4)
    assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, far.select(near.columns).collect()), key=str)


def test_significant_digits(spark):
    x = [1.2345649, 123456.5, 0.00012345678, -9.9999999, 0.0, 1e-13, 1e30, None, float("inf")]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(significant(F.col("v"))).collect()]
    assert out == [1.23456, 123457.0, 0.000123457, -10.0, 0.0, 0.0, 1e30, None, None]


def test_stream_equals_table(spark, tmp_path):
    from plumbline.streaming.windows import windowed_accuracy

    rows = [(f"s{i % 2}", f"2024-01-01 0{i % 3}:10:00", float(i), float(i) - 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "sensor_id string, at string, measurement double, reference double").withColumn("ingested_at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_accuracy(stream, ["sensor_id"]).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("acc").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, windowed_accuracy(df, ["sensor_id"]).collect())) and len(got) == 6


def test_csv_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,value,note\n1,10,x\n2,20,y\n")
    (tmp_path / "b.csv").write_text("value,time,note\n30,3,z\n")
    (tmp_path / "c.csv").write_bytes("time;value;Größe\n5;50;e\n".encode("latin-1"))
    (tmp_path / "d.csv").write_text("\n")
    df = csv_files.read_csv(spark, str(tmp_path))
    got = {(r["time"], r["value"], r["note"], r["Größe"], r["row_ord"]) for r in df.collect()}
    assert got == {("1", "10", "x", None, 0), ("2", "20", "y", None, 1), ("3", "30", "z", None, 0), ("5", "50", None, "e", 0)}
    told = {r["path"][-5:]: r for r in csv_files.layouts(spark, str(tmp_path)).collect()}
    assert told["d.csv"]["problem"] == "empty" and told["c.csv"]["encoding"] == "ISO-8859-1" and told["c.csv"]["delimiter"] == ";"
    kinds = {r["column"]: r["kind"] for r in csv_files.profile(df, ["time", "note", "Größe"]).collect()}
    assert kinds == {"time": "integer", "note": "text", "Größe": "text"}


def test_mapping_problems():
    from plumbline.functions import vocabulary

    mapping = vocabulary.FieldMapping({"ax": "a", "ay": "a", "zz": "b", "az": "gone"})
    problems = vocabulary.validate(mapping, ["a", "b"], vocabulary.REQUIRED["generic"])
    assert problems == ["unknown field zz", "az: no column gone", "column a is used for ['ax', 'ay']", "required field measurement is not mapped"]


def test_exact_percentiles_at_any_size(spark):
    from plumbline.operators.order_statistics import percentiles

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=40_000), "b": np.repeat([1.0, 2.0], 5_000), "c": rng.integers(0, 9, 777).astype(float), "d": np.array([3.0]), None: np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r["k"]: r["q"] for r in percentiles(df, ["k"], {"q": F.col("v")}, ps).collect()}
    for k, x in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(x, ps)))
