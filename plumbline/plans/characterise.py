"""Whole analyses: recordings in common units, all tools, one long metric table, requirement checks and hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rounding import rounded
from plumbline.joins import written
from plumbline.operators import diagnostics, generic_tools, imu_tools
from plumbline.plans import metrics
from plumbline.plans.catalogue import Catalogue
from plumbline.plans.common_units import common_limits, common_units, resting, states
from plumbline.plans.sensor_queries import _ACCURACY, IMU_SAMPLES, KEY, PAIRS, generic, imu_spectra
from plumbline.session import read, shared_folder
from plumbline.streaming.windows import windowed_accuracy

catalogue = Catalogue()

#: Limits for demonstration, in common units.
EXAMPLE_REQUIREMENTS = metrics.requirements(
    [
        {"id": "rate", "tool_id": "imu_sampling_integrity", "metric": "Sampling Rate Error", "operator": "abs<=", "limit": 2, "unit": "%"},
        {"id": "capture", "tool_id": "imu_sampling_integrity", "metric": "Estimated Capture Fraction", "operator": ">=", "limit": 95, "unit": "%"},
        {"id": "backward", "tool_id": "imu_sampling_integrity", "metric": "Backward Timestamp Count", "operator": "<=", "limit": 0},
        {"id": "gyro_bias", "tool_id": "imu_gyro_bias", "metric": "Gyroscope Bias Vector Magnitude", "operator": "<=", "limit": 0.01, "unit": "rad/s"},
        *[{"id": f"{a}_noise", "tool_id": "imu_stationary_noise", "metric": f"{a.upper()} Robust Noise Sigma Estimate", "operator": "<=", "limit": 0.1 if a[0] == "a" else 0.01, "unit": "m/s^2" if a[0] == "a" else "rad/s"} for a in imu_tools.AXES],
        {"id": "gravity", "tool_id": "imu_gravity_error", "metric": "Gravity Magnitude MAE", "operator": "between", "lower_limit": 0, "upper_limit": 0.2, "unit": "m/s^2"},
    ]
)
GENERIC_REQUIREMENTS = metrics.requirements(
    [
        {"id": "bias", "tool_id": "generic_accuracy", "metric": "Bias", "operator": "abs<=", "limit": 0.5},
        {"id": "rmse", "tool_id": "generic_accuracy", "metric": "Root Mean Squared Error", "operator": "<", "limit": 1.0},
        {"id": "samples", "tool_id": "generic_accuracy", "metric": "Valid Sample Count", "operator": "between", "lower_limit": 150, "upper_limit": 300},
        {"id": "mape", "tool_id": "generic_accuracy", "metric": "Mean Absolute Percentage Error", "operator": "<=", "limit": 1.0, "unit": "%"},
        {"id": "other_unit", "tool_id": "generic_accuracy", "metric": "Maximum Absolute Percentage Error", "operator": "<=", "limit": 5.0, "unit": "ppm"},
        {"id": "unknown", "tool_id": "generic_accuracy", "metric": "No Such Metric", "operator": "<=", "limit": 1.0},
    ]
)


def written_units(spark: SparkSession, d: str) -> DataFrame:
    """Inertial samples in common units, written once for all tools."""
    return written(common_units(spark, d)).df


def imu_metrics(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """The long metric table of the inertial tools; ``samples`` in common units."""
    nominal = recordings.groupBy("dataset_id").agg(F.max("nominal_sampling_rate_hz").alias("nominal_rate"))
    axis_unit = F.when(F.substring("axis", 1, 1) == "a", "m/s^2").otherwise("rad/s")
    still = resting(samples, recordings)
    parts = [
        metrics.to_metrics(imu_tools.sampling_integrity(samples, KEY, nominal=nominal), KEY, "imu_sampling_integrity", "s"),
        metrics.to_metrics(imu_tools.gyro_bias(still, KEY, IMU_SAMPLES), KEY, "imu_gyro_bias", "rad/s"),
        metrics.to_metrics(imu_tools.accelerometer_bias(still, KEY, IMU_SAMPLES), KEY, "imu_accelerometer_bias", "m/s^2"),
        metrics.to_metrics(imu_tools.stationary_noise(still, KEY, min_samples=IMU_SAMPLES), KEY, "imu_stationary_noise", axis_unit),
        metrics.to_metrics(imu_tools.gravity_error(still, KEY, IMU_SAMPLES), KEY, "imu_gravity_error", "m/s^2"),
        metrics.to_metrics(imu_tools.temperature_stability(still, KEY, min_samples=IMU_SAMPLES), KEY, "imu_temperature_stability", axis_unit),
        metrics.to_metrics(imu_tools.saturation(samples, KEY, common_limits(recordings)), KEY, "imu_saturation", axis_unit),
        metrics.to_metrics(imu_tools.six_position(still, KEY), KEY, "imu_six_position_calibration", "m/s^2"),
    ]
    for axes, unit, group in ((imu_tools.ACCEL, "m/s^2", "Accelerometer"), (imu_tools.GYRO, "rad/s", "Gyroscope")):
        linked = imu_tools.axis_correlation(samples, KEY, axes, min_samples=IMU_SAMPLES).withColumn("group", F.lit(group))
        parts.append(metrics.to_metrics(linked, KEY, "imu_axis_correlation", unit))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@catalogue.query("imu_metrics_common_units")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(imu_metrics(written_units(spark, d), read(spark, d, "recordings")))


@catalogue.query("imu_qualification")
def imu_qualification(spark: SparkSession, d: str) -> DataFrame:
    """Requirement checks of every inertial recording: conversion to common units, tools, metrics, comparison."""
    samples = written_units(spark, d)
    found = imu_metrics(samples, read(spark, d, "recordings"))
    return rounded(metrics.qualify(found, samples.select(*KEY), KEY, EXAMPLE_REQUIREMENTS))


#: Inertial tools of the metric table, and whether they need a sensor at rest.
IMU_TOOLS = (
    ("imu_sampling_integrity", False),
    ("imu_gyro_bias", True),
    ("imu_accelerometer_bias", True),
    ("imu_stationary_noise", True),
    ("imu_gravity_error", True),
    ("imu_temperature_stability", True),
    ("imu_saturation", False),
    ("imu_six_position_calibration", True),
    ("imu_axis_correlation", False),
)


@catalogue.query("imu_evidence")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the metrics of each recording show, with severity and the metric that shows it."""
    return rounded(metrics.evidence(imu_metrics(written_units(spark, d), read(spark, d, "recordings")), KEY))


@catalogue.query("imu_tool_outcomes")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Success or the reason for none, per inertial recording and tool."""
    samples, recordings = written_units(spark, d), read(spark, d, "recordings")
    here = samples.select(*KEY).distinct().join(states(recordings), KEY, "left")
    return metrics.outcomes(imu_metrics(samples, recordings), here, KEY, IMU_TOOLS)


@catalogue.query("generic_tool_outcomes", f"""WITH a AS (SELECT dataset_id FROM ({PAIRS}) GROUP BY 1)
SELECT e.dataset_id, 'generic_accuracy' AS tool_id, CASE WHEN a.dataset_id IS NULL THEN 'skipped' ELSE 'success' END AS outcome, CASE WHEN a.dataset_id IS NULL THEN 'fewer usable samples than the tool needs' END AS reason
FROM (SELECT DISTINCT dataset_id FROM generic_samples) e LEFT JOIN a USING (dataset_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same of the accuracy tool."""
    samples = generic(spark, d)
    here = samples.select(*KEY).distinct().withColumn("stationary", F.lit(None).cast("boolean"))
    return metrics.outcomes(metrics.to_metrics(generic_tools.accuracy(samples, KEY), KEY, "generic_accuracy"), here, KEY, [("generic_accuracy", False)])


@catalogue.query("imu_qualification_summary")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overall(imu_qualification(spark, d), KEY)


_CHECKS = f"""WITH a AS (SELECT dataset_id, {_ACCURACY} FROM ({PAIRS}) GROUP BY 1), every AS (SELECT DISTINCT dataset_id FROM generic_samples),
m AS (SELECT e.dataset_id, a.dataset_id IS NOT NULL AS ran, a.* EXCLUDE (dataset_id) FROM every e LEFT JOIN a USING (dataset_id)),
c AS (
  SELECT dataset_id, 'bias' AS requirement_id, CASE WHEN NOT ran THEN 'not_evaluated' WHEN abs(bias) <= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM m
  UNION ALL SELECT dataset_id, 'rmse', CASE WHEN NOT ran THEN 'not_evaluated' WHEN root_mean_squared_error < 1 THEN 'pass' ELSE 'fail' END FROM m
  UNION ALL SELECT dataset_id, 'samples', CASE WHEN NOT ran THEN 'not_evaluated' WHEN sample_count BETWEEN 150 AND 300 THEN 'pass' ELSE 'fail' END FROM m
  UNION ALL SELECT dataset_id, 'mape', CASE WHEN NOT ran OR mean_absolute_percentage_error IS NULL THEN 'not_evaluated' WHEN mean_absolute_percentage_error <= 1 THEN 'pass' ELSE 'fail' END FROM m
  UNION ALL SELECT dataset_id, 'other_unit', 'not_evaluated' FROM m
  UNION ALL SELECT dataset_id, 'unknown', 'not_evaluated' FROM m)"""


def _generic_checks(spark: SparkSession, d: str) -> DataFrame:
    samples = generic(spark, d)
    found = metrics.to_metrics(generic_tools.accuracy(samples, KEY), KEY, "generic_accuracy")
    return metrics.qualify(found, samples.select(*KEY), KEY, GENERIC_REQUIREMENTS)


@catalogue.query("generic_qualification", f"{_CHECKS} SELECT * FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _generic_checks(spark, d).select("dataset_id", "requirement_id", "status")


@catalogue.query(
    "generic_qualification_summary",
    f"""{_CHECKS} SELECT dataset_id, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'not_evaluated') AS not_evaluated,
    CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' ELSE 'not_evaluated' END AS status FROM c GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overall(_generic_checks(spark, d), KEY)


@catalogue.query("imu_hypotheses")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the spectra, correlations, temperature fits and saturation counts of each recording support."""
    samples = written_units(spark, d)
    still = resting(samples, read(spark, d, "recordings"))
    out = diagnostics.temperature_association(imu_tools.temperature_stability(still, KEY, min_samples=IMU_SAMPLES), KEY)
    clipped = imu_tools.saturation(samples, KEY, common_limits(read(spark, d, "recordings")))
    out = out.unionByName(diagnostics.boundary_clipping(clipped, KEY))
    spectra = imu_spectra(samples).checkpoint()
    for axes in (imu_tools.ACCEL, imu_tools.GYRO):
        linked = imu_tools.axis_correlation(samples, KEY, axes, min_samples=IMU_SAMPLES).checkpoint()
        out = out.unionByName(diagnostics.shared_periodic(spectra, linked, KEY, axes)).unionByName(diagnostics.unexplained_covariance(linked, KEY, axes))
    return rounded(out)


@catalogue.query("accuracy_by_hour")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregation, run over the table."""
    return rounded(windowed_accuracy(generic(spark, d), ["sensor_id"]))
