"""Tool results as one long table of named metrics, and requirements checked against it.

Metric names and units are what requirements refer to.  ``{X}`` in a name is the axis (AX .. GZ), ``{G}`` the group
(Accelerometer or Gyroscope); ``{u}`` in a unit is the unit of the values.
"""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names and units by tool and result column.
NAMES: dict[str, dict[str, tuple[str, str | None]]] = {
    "generic_accuracy": {
        "sample_count": ("Valid Sample Count", None),
        "bias": ("Bias", "{u}"),
        "mean_absolute_error": ("Mean Absolute Error", "{u}"),
        "root_mean_squared_error": ("Root Mean Squared Error", "{u}"),
        "median_absolute_error": ("Median Absolute Error", "{u}"),
        "maximum_absolute_error": ("Maximum Absolute Error", "{u}"),
        "mean_percentage_error": ("Mean Percentage Error", "%"),
        "mean_absolute_percentage_error": ("Mean Absolute Percentage Error", "%"),
        "maximum_absolute_percentage_error": ("Maximum Absolute Percentage Error", "%"),
    },
    "generic_snr": {"signal_rms": ("Signal RMS", "{u}"), "noise_rms": ("Noise RMS", "{u}"), "snr_db": ("SNR", "dB"), "sample_count": ("SNR Sample Count", None)},
    "generic_drift": {
        "drift_rate": ("Drift Rate", "{u}/s"),
        "predicted_drift": ("Predicted Drift Over Test", "{u}"),
        "endpoint_error_change": ("Observed Endpoint Error Change", "{u}"),
        "fit_r_squared": ("Drift Fit R Squared", None),
        "duration": ("Drift Test Duration", "s"),
    },
    "imu_sampling_integrity": {
        "timestamp_count": ("Valid Timestamp Count", None),
        "duration": ("Recording Duration", "s"),
        "sampling_rate": ("Estimated Sampling Rate", "Hz"),
        "median_interval": ("Median Sample Interval", "s"),
        "coefficient_of_variation": ("Sample Interval Coefficient of Variation", None),
        "duplicate_count": ("Duplicate Timestamp Count", None),
        "backward_count": ("Backward Timestamp Count", None),
        "large_gap_count": ("Large Gap Count", None),
        "largest_gap": ("Largest Time Gap", "s"),
        "estimated_missing": ("Estimated Missing Samples", None),
        "capture_percent": ("Estimated Capture Fraction", "%"),
        "rate_error_percent": ("Sampling Rate Error", "%"),
    },
    "imu_gyro_bias": {**{f"{a}_mean": (f"{a.upper()} Bias", "{u}") for a in ("gx", "gy", "gz")}, "bias_vector_magnitude": ("Gyroscope Bias Vector Magnitude", "{u}"), "noise_spread_ratio": ("Gyroscope Axis Noise Spread Ratio", None)},
    "imu_stationary_noise": {
        "standard_deviation": ("{X} Noise Standard Deviation", "{u}"),
        "variance": ("{X} Noise Variance", "({u})^2"),
        "rms": ("{X} Noise RMS", "{u}"),
        "mad": ("{X} Noise MAD", "{u}"),
        "robust_sigma": ("{X} Robust Noise Sigma Estimate", "{u}"),
        "span_5_95": ("{X} 5-95 Percentile Noise Span", "{u}"),
        "difference_noise": ("{X} Successive-Difference Noise Estimate", "{u}"),
        "standard_to_robust_ratio": ("{X} Standard-to-Robust Noise Ratio", None),
    },
    "imu_gravity_error": {
        "sample_count": ("Gravity Sample Count", None),
        "mean_absolute_error": ("Gravity Magnitude MAE", "{u}"),
        "root_mean_squared_error": ("Gravity Magnitude RMSE", "{u}"),
        "maximum_absolute_error": ("Maximum Absolute Gravity Magnitude Error", "{u}"),
    },
    "imu_saturation": {
        "exact_count": ("{X} Exact Limit Count", None),
        "near_count": ("{X} Near Limit Count", None),
        "outside_count": ("{X} Out-of-Range Count", None),
        "longest_exact_run": ("{X} Longest Exact-Limit Run", None),
        "range_utilization_percent": ("{X} Configured Range Utilization", "%"),
    },
    "imu_temperature_stability": {"coefficient": ("{X} Temperature Coefficient", "{u}/degC"), "r_squared": ("{X} Temperature Regression R2", None)},
    "imu_six_position_calibration": {
        **{
            f"{a}_{c}": (f"{a.upper()} {n}", u)
            for a in ("ax", "ay", "az")
            for c, n, u in (("bias", "Bias", "{u}"), ("sensitivity", "Raw Sensitivity Ratio", None), ("sensitivity_error_percent", "Sensitivity Error Percent", "%"), ("correction_scale", "Correction Scale Factor", None), ("plus_minus_span", "Measured Plus-Minus Span", "{u}"))
        },
        "bias_vector_magnitude": ("Accelerometer Bias Vector Magnitude", "{u}"),
        "raw_component_rmse": ("Raw Calibration-Set Component RMSE", "{u}"),
        "corrected_component_rmse": ("Corrected Calibration-Set Component RMSE", "{u}"),
        "raw_gravity_magnitude_mae": ("Raw Calibration-Set Gravity Magnitude MAE", "{u}"),
        "corrected_gravity_magnitude_mae": ("Corrected Calibration-Set Gravity Magnitude MAE", "{u}"),
        "raw_mean_angular_deviation": ("Raw Calibration-Set Mean Angular Deviation", "deg"),
        "corrected_mean_angular_deviation": ("Corrected Calibration-Set Mean Angular Deviation", "deg"),
    },
    "imu_accelerometer_bias": {
        **{f"{a}_{c}": (f"{a.upper()} {n}", "{u}") for a in ("ax", "ay", "az") for c, n in (("mean", "Mean Output"), ("std", "Stationary Noise Standard Deviation"), ("rms", "RMS Output"), ("peak_to_peak", "Peak-to-Peak Output"), ("median", "Median Output"), ("bias", "Bias"))},
        "mean_vector_magnitude": ("Mean Acceleration Vector Magnitude", "{u}"),
        "gravity_magnitude_error": ("Gravity Magnitude Error", "{u}"),
        "gravity_magnitude_error_percent": ("Gravity Magnitude Error Percent", "%"),
        "bias_vector_magnitude": ("Accelerometer Bias Vector Magnitude", "{u}"),
        "mean_axis_std": ("Mean Axis Noise Standard Deviation", "{u}"),
        "maximum_axis_std": ("Maximum Axis Noise Standard Deviation", "{u}"),
        "noise_spread_ratio": ("Accelerometer Axis Noise Spread Ratio", None),
    },
    "imu_axis_correlation": {
        "maximum_absolute_correlation": ("{G} Maximum Absolute Axis Correlation", None),
        "maximum_absolute_difference_correlation": ("{G} Maximum Absolute First-Difference Axis Correlation", None),
        "dominant_variance_percent": ("{G} Dominant Covariance Variance Fraction", "%"),
        **{
            f"{c}_{a}_{b}": (f"{a.upper()}-{b.upper()} {n}", u)
            for g in ("a", "g")
            for a, b in ((f"{g}x", f"{g}y"), (f"{g}x", f"{g}z"), (f"{g}y", f"{g}z"))
            for c, n, u in (("covariance", "Covariance", "({u})^2"), ("correlation", "Correlation", None), ("difference_correlation", "First-Difference Correlation", None))
        },
    },
    "imu_psd": {
        "segment_length": ("{G} Welch Segment Length", None),
        "segment_count": ("{G} Welch Segment Count", None),
        "frequency_resolution": ("{G} Frequency Resolution", "Hz"),
        "integrated_rms": ("{X} PSD Integrated RMS", "{u}"),
        "median_psd": ("{X} Median Spectral Density", "({u})^2/Hz"),
        "median_amplitude_density": ("{X} Median Amplitude Spectral Density", "{u}/sqrt(Hz)"),
        "dominant_frequency": ("{X} Dominant Spectral Frequency", "Hz"),
        "dominant_psd": ("{X} Dominant Spectral PSD", "({u})^2/Hz"),
        "dominant_to_median_ratio": ("{X} Dominant Peak-to-Median PSD Ratio", None),
        "peak_count": ("{X} Prominent Spectral Peak Count", None),
        "first_peak_frequency": ("{X} Spectral Peak 1 Frequency", "Hz"),
    },
    "imu_allan_deviation": {
        "duration": ("{G} Allan Segment Duration", "s"),
        "minimum_deviation": ("{X} Minimum Allan Deviation", "{u}"),
        "tau_at_minimum": ("{X} Tau at Minimum Allan Deviation", "s"),
        "maximum_averaging_time": ("{X} Maximum Allan Averaging Time", "s"),
        "random_walk_coefficient": ("{X} {W} Random Walk Coefficient", "{w}"),
        "white_slope": ("{X} White-Noise Region Median Slope", None),
        "bias_instability": ("{X} Bias Instability Estimate", "{u}"),
    },
}
OPERATORS = ("<", "<=", ">", ">=", "==", "abs<", "abs<=", "between")
REQUIREMENT = "requirement_id string, tool_id string, metric string, operator string, limit double, lower_limit double, upper_limit double, unit string"


def to_metrics(result: DataFrame, keys: Sequence[str], tool_id: str, unit: str | Column | None = None) -> DataFrame:
    """keys, tool_id, seq, name, value, unit: one row per metric that is present."""
    u = F.lit(unit).cast("string") if unit is None or isinstance(unit, str) else unit

    def named(of: str | None) -> Column:
        if of is None:
            return F.lit(None).cast("string")
        if of == "{w}":
            return F.when(F.upper("axis").startswith("A"), "m/s/sqrt(s)").otherwise("rad/sqrt(s)")
        return F.replace(F.lit(of), F.lit("{u}"), u) if "{u}" in of else F.lit(of)

    axis = F.upper("axis") if "axis" in result.columns else F.lit("")
    group = F.col("group") if "group" in result.columns else F.when(axis.startswith("A"), "Accelerometer").otherwise("Gyroscope")
    walk = F.when(axis.startswith("A"), "Velocity").otherwise("Angle")
    rows = []
    for i, (c, (name, of)) in enumerate(NAMES[tool_id].items()):
        if c in result.columns:
            text = F.lit(name)
            for mark, value in (("{X}", axis), ("{G}", group), ("{W}", walk)):
                text = F.replace(text, F.lit(mark), value) if mark in name else text
            rows.append(F.struct(F.lit(i).alias("seq"), text.alias("name"), F.col(c).cast("double").alias("value"), named(of).alias("unit")))
    out = result.select(*keys, F.lit(tool_id).alias("tool_id"), F.explode(F.array(*rows)).alias("m"))
    return out.select(*keys, "tool_id", "m.*").where(F.col("value").isNotNull())


def load_requirements(path: str | Path) -> list[dict]:
    """Requirements of a TOML profile ([[requirements]] tables), checked; disabled ones are left out."""
    with open(path, "rb") as f:
        return requirements(tomllib.load(f).get("requirements", []))


def requirements(entries: Sequence[dict]) -> list[dict]:
    out, ids = [], set()
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")
    for e in entries:
        name = e.get("id") or e.get("requirement_id")
        if not name or not e.get("tool_id") or not e.get("metric"):
            raise ValueError(f"a requirement needs id, tool_id and metric: {e}")
        if name in ids:
            raise ValueError(f"two requirements are named {name}")
        ids.add(name)
        op = e.get("operator")
        if op not in OPERATORS:
            raise ValueError(f"{name}: unknown operator {op}")
        need = ("lower_limit", "upper_limit") if op == "between" else ("limit",)
        if not all(number(e.get(k)) for k in need) or (op == "between" and e["lower_limit"] > e["upper_limit"]):
            raise ValueError(f"{name}: {op} needs finite {' and '.join(need)}")
        if e.get("enabled", True):
            out.append({"requirement_id": name, "tool_id": e["tool_id"], "metric": e["metric"], "operator": op, "unit": e.get("unit"), **{k: float(e[k]) if k in e else None for k in ("limit", "lower_limit", "upper_limit")}})
    return out


def _unit_text(c: str) -> Column:
    return F.lower(F.replace(F.replace(F.trim(c), F.lit("²"), F.lit("^2")), F.lit(" "), F.lit("")))


def _holds() -> Column:
    v, lim, op = F.col("value"), F.col("limit"), F.col("operator")
    return (
        F.when(op == "<", v < lim)
        .when(op == "<=", v <= lim)
        .when(op == ">", v > lim)
        .when(op == ">=", v >= lim)
        .when(op == "==", v == lim)
        .when(op == "abs<", F.abs(v) < lim)
        .when(op == "abs<=", F.abs(v) <= lim)
        .when(op == "between", (v >= F.col("lower_limit")) & (v <= F.col("upper_limit")))
    )


def qualify(metrics: DataFrame, groups: DataFrame, keys: Sequence[str], wanted: Sequence[dict]) -> DataFrame:
    """One row per group and requirement: value, status (pass, fail, not_evaluated) and the reason for the latter.

    ``groups`` has one row per group; the requirements, a short list, are spread over it, then metrics are joined on
    equality.  Of metrics with the same name the last one (highest ``seq``) counts.
    """
    spark = metrics.sparkSession
    names = [c.split()[0] for c in REQUIREMENT.split(", ")]
    table = spark.createDataFrame([tuple(w.get(n) for n in names) for w in wanted], REQUIREMENT)
    rows = [F.struct(*[F.lit(w.get(n)).cast(table.schema[n].dataType).alias(n) for n in names]) for w in wanted]
    checks = groups.select(*keys).distinct().withColumn("q", F.explode(F.array(*rows))).select(*keys, "q.*")
    last = metrics.groupBy(*keys, "tool_id", F.col("name").alias("metric")).agg(F.max_by(F.struct("value", F.col("unit").alias("metric_unit")), "seq").alias("x"))
    last = last.select(*keys, "tool_id", "metric", "x.value", "x.metric_unit")
    ran = metrics.select(*keys, "tool_id", F.lit(True).alias("ran")).distinct()
    df = checks.join(last, [*keys, "tool_id", "metric"], "left").join(ran, [*keys, "tool_id"], "left")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    fits = F.col("unit").isNull() | (_unit_text("unit") == F.coalesce(_unit_text("metric_unit"), F.lit("")))
    reason = F.when(F.col("ran").isNull(), "tool gave no result").when(F.col("value").isNull(), "metric missing").when(~finite, "value not finite").when(~fits, "unit differs")
    status = F.when(reason.isNotNull(), "not_evaluated").when(_holds(), "pass").otherwise("fail")
    return df.select(*keys, "requirement_id", "tool_id", "metric", "operator", "value", "metric_unit", status.alias("status"), reason.alias("reason"))


def overall(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, passed, failed, not_evaluated, status: fail if any fails, else not_evaluated if any is, else pass."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = checks.groupBy(*keys).agg(count("pass"), count("fail"), count("not_evaluated"))
    return out.withColumn("status", F.when(F.col("fail") > 0, "fail").when(F.col("not_evaluated") > 0, "not_evaluated").otherwise("pass"))


def overall_by_tool(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same per tool, where requirements that could not be evaluated do not count against those that pass."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = checks.groupBy(*keys, "tool_id").agg(count("pass"), count("fail"), count("not_evaluated"))
    return out.withColumn("status", F.when(F.col("fail") > 0, "fail").when(F.col("pass") > 0, "pass").otherwise("not_evaluated"))


#: Findings a tool states about a recording: what metric shows it, from which value on, and how severe it is.
EVIDENCE: list[dict] = [
    {"tool_id": "imu_sampling_integrity", "metric": "Sample Interval Coefficient of Variation", "operator": ">", "limit": 0.05, "severity": "warning", "statement": "irregular sampling"},
    {"tool_id": "imu_sampling_integrity", "metric": "Sampling Rate Error", "operator": "abs>", "limit": 2.0, "severity": "warning", "statement": "sampling rate off its nominal value"},
    {"tool_id": "imu_sampling_integrity", "metric": "Backward Timestamp Count", "operator": ">", "limit": 0.0, "severity": "critical", "statement": "timestamps run backwards"},
    {"tool_id": "imu_sampling_integrity", "metric": "Duplicate Timestamp Count", "operator": ">", "limit": 0.0, "severity": "warning", "statement": "timestamps repeat"},
    {"tool_id": "imu_sampling_integrity", "metric": "Large Gap Count", "operator": ">", "limit": 0.0, "severity": "warning", "statement": "large time gaps"},
    {"tool_id": "imu_gyro_bias", "metric": "Gyroscope Axis Noise Spread Ratio", "operator": ">", "limit": 5.0, "severity": "warning", "statement": "gyroscope axes differ in noise"},
    {"tool_id": "imu_accelerometer_bias", "metric": "Accelerometer Axis Noise Spread Ratio", "operator": ">", "limit": 5.0, "severity": "warning", "statement": "accelerometer axes differ in noise"},
    {"tool_id": "imu_accelerometer_bias", "metric": "Gravity Magnitude Error Percent", "operator": "abs>", "limit": 2.0, "severity": "warning", "statement": "mean acceleration is not gravity"},
    *[{"tool_id": "imu_stationary_noise", "metric": f"{a} Standard-to-Robust Noise Ratio", "operator": ">", "limit": 2.0, "severity": "warning", "statement": "noise has heavy tails"} for a in ("AX", "AY", "AZ", "GX", "GY", "GZ")],
    *[{"tool_id": "imu_saturation", "metric": f"{a} Exact Limit Count", "operator": ">", "limit": 0.0, "severity": "warning", "statement": "readings at the configured limit"} for a in ("AX", "AY", "AZ", "GX", "GY", "GZ")],
    *[{"tool_id": "imu_saturation", "metric": f"{a} Out-of-Range Count", "operator": ">", "limit": 0.0, "severity": "critical", "statement": "readings beyond the configured range"} for a in ("AX", "AY", "AZ", "GX", "GY", "GZ")],
    *[{"tool_id": "imu_temperature_stability", "metric": f"{a} Temperature Regression R2", "operator": ">", "limit": 0.5, "severity": "info", "statement": "output follows temperature"} for a in ("AX", "AY", "AZ", "GX", "GY", "GZ")],
    *[{"tool_id": "imu_axis_correlation", "metric": f"{g} Maximum Absolute Axis Correlation", "operator": ">", "limit": 0.7, "severity": "info", "statement": "axes are correlated"} for g in ("Accelerometer", "Gyroscope")],
]


def evidence(metrics: DataFrame, keys: Sequence[str], rules: Sequence[dict] = EVIDENCE) -> DataFrame:
    """keys, tool_id, statement, severity, and the supporting metric with its value: findings that metrics show.

    The rules, a short fixed list, are joined with the metrics on tool and name.
    """
    spark = metrics.sparkSession
    names = ("tool_id", "metric", "operator", "limit", "severity", "statement")
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rules], "tool_id string, metric string, operator string, limit double, severity string, statement string")
    df = metrics.withColumnRenamed("name", "metric").join(F.broadcast(table), ["tool_id", "metric"])  # as large as the list above
    size = F.when(F.col("operator").startswith("abs"), F.abs("value")).otherwise(F.col("value"))
    return df.where(size > F.col("limit")).select(*keys, "tool_id", "statement", "severity", F.col("metric").alias("supporting_metric"), "value")


def outcomes(metrics: DataFrame, states: DataFrame, keys: Sequence[str], tools: Sequence[tuple[str, bool]]) -> DataFrame:
    """keys, tool_id, outcome (success or skipped), reason: one row per recording and tool.

    ``states`` has one row per recording with ``stationary``; ``tools`` names each tool and whether it needs rest.
    """
    ran = metrics.select(*keys, "tool_id", F.lit(True).alias("ran")).distinct()
    every = states.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t).alias("tool_id"), F.lit(rest).alias("rest")) for t, rest in tools]))).select(*keys, "stationary", "t.*")
    df = every.join(ran, [*keys, "tool_id"], "left")
    reason = F.when(F.col("ran"), None).when(F.col("rest") & ~F.col("stationary"), "recording is known to move").otherwise("fewer usable samples than the tool needs")
    return df.select(*keys, "tool_id", F.when(F.col("ran"), "success").otherwise("skipped").alias("outcome"), reason.alias("reason"))


def messages(checks: DataFrame) -> DataFrame:
    """``checks`` with a sentence on each requirement."""
    wanted = F.when(F.col("operator") == "between", F.lit("between its limits")).otherwise(F.concat(F.col("operator"), F.lit(" its limit")))
    value = F.format_string("%.6g", F.col("value"))
    said = F.when(F.col("status") == "not_evaluated", F.concat(F.col("metric"), F.lit(" was not evaluated: "), F.col("reason"))).otherwise(
        F.concat(F.col("metric"), F.lit(" is "), value, F.coalesce(F.concat(F.lit(" "), F.col("metric_unit")), F.lit("")), F.when(F.col("status") == "pass", F.lit(", as required ")).otherwise(F.lit(", not as required ")), wanted)
    )
    return checks.withColumn("message", said)
