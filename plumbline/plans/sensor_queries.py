"""Queries of the characterisation tools over the sample tables, keyed by recording, with their SQL.

Inertial samples are converted to common units first, here and in the SQL, and tools of resting sensors skip recordings
known to move.  Values are rounded to six significant digits on both sides: sums depend on the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import finite
from plumbline.functions import vocabulary
from plumbline.functions.rounding import rounded, rounded_sql
from plumbline.operators import calibration, generic_tools, imu_tools, spectral, validation
from plumbline.plans.catalogue import Catalogue
from plumbline.plans.common_units import RANGE_SQL, common_limits, common_sql, common_units, resting, states
from plumbline.session import read, shared_folder
from plumbline.sources import csv_files

catalogue = Catalogue()
KEY = ["dataset_id"]
#: Samples a recording needs in the registered inertial queries; the test recordings are short.
IMU_SAMPLES = 100


def tool(name: str, select: str | None = None, doubles: str = "", others: str = "dataset_id") -> Callable:
    """Registers a query whose result is rounded; ``select`` is the unrounded SQL, with its double and other columns."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        text = None if select is None else common_sql(select) if "imu_common" in select or "imu_resting" in select else select
        sql = None if text is None else rounded_sql(text, doubles.split(), others.split())
        catalogue.query(name, sql)(lambda spark, d: rounded(fn(spark, d)))
        return fn

    return add


def generic(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "generic_samples")


def imu(spark: SparkSession, d: str) -> DataFrame:
    return common_units(spark, d)


def imu_resting(spark: SparkSession, d: str) -> DataFrame:
    return resting(common_units(spark, d), read(spark, d, "recordings"))


PAIRS = "SELECT *, measurement AS m, reference AS r, measurement - reference AS e FROM generic_samples WHERE isfinite(measurement) AND isfinite(reference)"

_ACCURACY = """count(*) AS sample_count, avg(e) AS bias, avg(abs(e)) AS mean_absolute_error, sqrt(avg(e * e)) AS root_mean_squared_error,
       median(abs(e)) AS median_absolute_error, max(abs(e)) AS maximum_absolute_error, avg(e / abs(r) * 100) FILTER (r <> 0) AS mean_percentage_error,
       avg(abs(e / r) * 100) FILTER (r <> 0) AS mean_absolute_percentage_error, max(abs(e / r) * 100) FILTER (r <> 0) AS maximum_absolute_percentage_error"""
_ACCURACY_COLUMNS = "bias mean_absolute_error root_mean_squared_error median_absolute_error maximum_absolute_error mean_percentage_error mean_absolute_percentage_error maximum_absolute_percentage_error"


@tool("generic_accuracy", f"SELECT dataset_id, {_ACCURACY} FROM ({PAIRS}) GROUP BY 1", _ACCURACY_COLUMNS, "dataset_id sample_count")
def _(spark, d):
    return generic_tools.accuracy(generic(spark, d), KEY)


@tool("generic_accuracy_by_sensor", f"SELECT sensor_id, {_ACCURACY} FROM ({PAIRS}) GROUP BY 1", _ACCURACY_COLUMNS, "sensor_id sample_count")
def _(spark, d):
    return generic_tools.accuracy(generic(spark, d), ["sensor_id"])


@tool(
    "generic_linearity",
    f"""WITH p AS ({PAIRS}),
f AS (SELECT dataset_id, count(*) AS sample_count, count(DISTINCT r) AS unique_reference_count, max(r) - min(r) AS reference_span, regr_slope(m, r) AS slope,
             regr_intercept(m, r) AS intercept, avg(m) AS m_mean FROM p GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT r) >= 3),
q AS (SELECT p.dataset_id, m - (slope * r + intercept) AS res, m - m_mean AS dm FROM p JOIN f USING (dataset_id)),
v AS (SELECT dataset_id, sqrt(avg(res * res)) AS residual_rmse, coalesce(stddev_samp(res), 0) AS residual_standard_deviation, median(abs(res)) AS median_absolute_deviation,
             max(abs(res)) AS maximum_absolute_deviation, CASE WHEN sum(dm * dm) > 1e-15 THEN 1 - sum(res * res) / sum(dm * dm) END AS r_squared FROM q GROUP BY 1)
SELECT f.*, v.*, abs(slope) * reference_span AS fitted_output_span,
       CASE WHEN abs(slope) * reference_span > 1e-15 THEN 100 * maximum_absolute_deviation / (abs(slope) * reference_span) END AS maximum_deviation_percent_full_scale
FROM f JOIN v USING (dataset_id)""",
    "reference_span slope intercept residual_rmse residual_standard_deviation median_absolute_deviation maximum_absolute_deviation r_squared fitted_output_span maximum_deviation_percent_full_scale",
    "dataset_id sample_count unique_reference_count",
)
def _(spark, d):
    return generic_tools.linearity(generic(spark, d), KEY)


@tool(
    "generic_precision",
    f"""WITH p AS ({PAIRS}),
c AS (SELECT dataset_id, count(*) AS sample_count, avg(e) AS e_mean, quantile_cont(e, [0.25, 0.5, 0.75]) AS q, coalesce(stddev_samp(e), 0) AS standard_deviation FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT dataset_id, any_value(sample_count) AS sample_count, any_value(standard_deviation) AS standard_deviation, 1.4826 * median(abs(e - q[2])) AS robust_sigma,
       any_value(q[3] - q[1]) AS interquartile_range, quantile_cont(abs(e - e_mean), 0.95) AS p95_absolute_demeaned_error FROM p JOIN c USING (dataset_id) GROUP BY 1""",
    "standard_deviation robust_sigma interquartile_range p95_absolute_demeaned_error",
    "dataset_id sample_count",
)
def _(spark, d):
    return generic_tools.precision(generic(spark, d), KEY)


_LEVELS = f"SELECT dataset_id, r, count(*) AS n, avg(m) AS level_mean, var_samp(m) AS level_variance, max(m) - min(m) AS level_range FROM ({PAIRS}) GROUP BY ALL"


@tool(
    "generic_repeatability",
    f"""WITH l AS ({_LEVELS}), t AS (SELECT dataset_id, sum(n) AS every FROM l GROUP BY 1)
SELECT dataset_id, count(*) AS level_count, CAST(sum(n) AS BIGINT) AS sample_count, avg(n) AS average_repeats_per_level, sqrt(sum((n - 1) * level_variance) / sum(n - 1)) AS pooled_standard_deviation,
       avg(sqrt(level_variance)) AS mean_within_level_standard_deviation, max(sqrt(level_variance)) AS maximum_within_level_standard_deviation,
       avg(level_range) AS mean_within_level_range, max(level_range) AS maximum_within_level_range
FROM l JOIN t USING (dataset_id) WHERE n >= 3 GROUP BY dataset_id HAVING any_value(every) >= 6 AND count(*) >= 2""",
    "average_repeats_per_level pooled_standard_deviation mean_within_level_standard_deviation maximum_within_level_standard_deviation mean_within_level_range maximum_within_level_range",
    "dataset_id level_count sample_count",
)
def _(spark, d):
    return generic_tools.repeatability(generic(spark, d), KEY)


@tool(
    "generic_sensitivity",
    f"""WITH l AS ({_LEVELS}),
s AS (SELECT *, (level_mean - lag(level_mean) OVER w) / (r - lag(r) OVER w) AS local FROM l WINDOW w AS (PARTITION BY dataset_id ORDER BY r)),
g AS (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS sample_count, count(*) AS level_count, count(local) AS interval_count, (arg_max(level_mean, r) - arg_min(level_mean, r)) / nullif(max(r) - min(r), 0) AS global_sensitivity,
        avg(local) AS mean_local_sensitivity, coalesce(stddev_samp(local), 0) AS local_sensitivity_standard_deviation, min(local) AS minimum_local_sensitivity, max(local) AS maximum_local_sensitivity
      FROM s GROUP BY 1)
SELECT *, CASE WHEN abs(mean_local_sensitivity) > 1e-15 THEN 100 * local_sensitivity_standard_deviation / abs(mean_local_sensitivity) END AS local_sensitivity_cv FROM g WHERE sample_count >= 5 AND level_count >= 3""",
    "global_sensitivity mean_local_sensitivity local_sensitivity_standard_deviation minimum_local_sensitivity maximum_local_sensitivity local_sensitivity_cv",
    "dataset_id sample_count level_count interval_count",
)
def _(spark, d):
    return generic_tools.sensitivity(generic(spark, d), KEY)


@tool(
    "generic_drift",
    f"""WITH p AS (SELECT *, timestamp - min(timestamp) OVER (PARTITION BY dataset_id) AS x FROM ({PAIRS}) WHERE isfinite(timestamp)),
g AS (SELECT dataset_id, count(*) AS sample_count, max(x) AS duration, regr_slope(e, x) AS drift_rate, regr_intercept(e, x) AS fit_intercept,
             CASE WHEN regr_syy(e, x) > 1e-15 THEN regr_r2(e, x) END AS fit_r_squared,
             arg_max(e, (timestamp, row_ord)) - arg_min(e, (timestamp, row_ord)) AS endpoint_error_change FROM p GROUP BY 1)
SELECT *, drift_rate * duration AS predicted_drift FROM g WHERE sample_count >= 10 AND duration >= 1""",
    "duration drift_rate fit_intercept fit_r_squared endpoint_error_change predicted_drift",
    "dataset_id sample_count",
)
def _(spark, d):
    return generic_tools.drift(generic(spark, d), KEY)


@tool(
    "generic_snr",
    f"""WITH g AS (SELECT dataset_id, count(*) AS sample_count, var_pop(r) AS signal_power, var_pop(e) AS noise_power FROM ({PAIRS}) GROUP BY 1)
SELECT *, sqrt(signal_power) AS signal_rms, sqrt(noise_power) AS noise_rms, CASE WHEN noise_power > 1e-30 THEN 10 * log10(signal_power / noise_power) END AS snr_db FROM g WHERE sample_count >= 10 AND signal_power > 1e-15""",
    "signal_power noise_power signal_rms noise_rms snr_db",
    "dataset_id sample_count",
)
def _(spark, d):
    return generic_tools.signal_to_noise(generic(spark, d), KEY)


@tool(
    "generic_environmental_stability",
    f"""WITH p AS ({PAIRS}), l AS (SELECT dataset_id, e, 'temperature' AS field, temperature AS x FROM p UNION ALL SELECT dataset_id, e, 'humidity', humidity FROM p UNION ALL SELECT dataset_id, e, 'supply_voltage', supply_voltage FROM p),
g AS (SELECT dataset_id, field, count(*) AS sample_count, regr_slope(e, x) AS error_coefficient, CASE WHEN regr_syy(e, x) > 1e-15 AND regr_sxx(e, x) > 1e-15 THEN regr_r2(e, x) END AS r_squared, max(x) - min(x) AS span
      FROM l WHERE isfinite(x) GROUP BY ALL)
SELECT *, error_coefficient * span AS predicted_error_change FROM g WHERE sample_count >= 10 AND span > 0""",
    "error_coefficient r_squared span predicted_error_change",
    "dataset_id field sample_count",
)
def _(spark, d):
    return generic_tools.environmental_stability(generic(spark, d), KEY)


@tool(
    "generic_outlier_detection",
    f"""WITH p AS ({PAIRS}), a AS (SELECT *, median(e) OVER (PARTITION BY dataset_id) AS med FROM p), b AS (SELECT *, median(abs(e - med)) OVER (PARTITION BY dataset_id) AS mad FROM a),
z AS (SELECT *, CASE WHEN mad > 1e-15 THEN abs(0.6744897501960817 * (e - med) / mad) WHEN abs(e - med) <= 1e-15 THEN 0 ELSE 'infinity'::DOUBLE END AS z FROM b)
SELECT dataset_id, count(*) AS sample_count, count(*) FILTER (z > 3.5) AS outlier_count, any_value(med) AS median_error, any_value(mad) AS error_mad, max(z) AS maximum_absolute_z,
       100 * count(*) FILTER (z > 3.5) / count(*) AS outlier_percent FROM z GROUP BY 1 HAVING count(*) >= 10""",
    "median_error error_mad maximum_absolute_z outlier_percent",
    "dataset_id sample_count outlier_count",
)
def _(spark, d):
    return generic_tools.outliers(generic(spark, d), KEY)


@tool(
    "generic_hysteresis",
    f"""WITH p AS (SELECT * REPLACE (trim(sweep_direction) AS sweep_direction) FROM ({PAIRS}) WHERE trim(sweep_direction) <> ''),
f AS (SELECT dataset_id, arg_min(sweep_direction, row_ord) AS first_label FROM p GROUP BY 1 HAVING count(DISTINCT sweep_direction) = 2),
l AS (SELECT dataset_id, sweep_direction = first_label AS one, r, avg(m) AS lm FROM p JOIN f USING (dataset_id) GROUP BY ALL),
j AS (SELECT a.dataset_id, a.r, a.lm - b.lm AS d FROM l a JOIN l b ON a.dataset_id = b.dataset_id AND a.r = b.r AND a.one AND NOT b.one)
SELECT dataset_id, count(*) AS matched_level_count, max(abs(d)) AS maximum_absolute_hysteresis, avg(abs(d)) AS mean_absolute_hysteresis, sqrt(avg(d * d)) AS hysteresis_rms, max(r) - min(r) AS matched_reference_span
FROM j GROUP BY 1 HAVING count(*) >= 3""",
    "maximum_absolute_hysteresis mean_absolute_hysteresis hysteresis_rms matched_reference_span",
    "dataset_id matched_level_count",
)
def _(spark, d):
    return generic_tools.hysteresis(generic(spark, d), KEY)


@tool("generic_hysteresis_tolerance")
def _(spark, d):
    return generic_tools.hysteresis(generic(spark, d), KEY, tolerance=0.01)


@tool(
    "generic_revision_comparison",
    f"""WITH g AS (SELECT sensor_id, revision, count(*) AS sample_count, avg(e) AS bias, avg(abs(e)) AS mean_absolute_error, sqrt(avg(e * e)) AS root_mean_squared_error, max(abs(e)) AS maximum_absolute_error
      FROM ({PAIRS}) WHERE revision IS NOT NULL AND sensor_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)
SELECT * FROM g WHERE sensor_id IN (SELECT sensor_id FROM g GROUP BY 1 HAVING count(*) >= 2)""",
    "bias mean_absolute_error root_mean_squared_error maximum_absolute_error",
    "sensor_id revision sample_count",
)
def _(spark, d):
    return generic_tools.revision_comparison(generic(spark, d).where("sensor_id IS NOT NULL"), ["sensor_id"])


_STEPS = """SELECT *, t - lag(t) OVER (PARTITION BY dataset_id ORDER BY row_ord) AS dt FROM (SELECT dataset_id, row_ord, timestamp AS t FROM {table} WHERE isfinite(timestamp))"""
_SAMPLING = """count(*) AS {n}, arg_max(t, row_ord) - arg_min(t, row_ord) AS {duration}, median(dt) FILTER (dt > 0) AS {median}, avg(dt) FILTER (dt > 0) AS {mean}, stddev_pop(dt) FILTER (dt > 0) AS {std},
  count(*) FILTER (dt = 0) AS {dup}, count(*) FILTER (dt < 0) AS {back}"""


@tool(
    "imu_sampling_integrity",
    f"""WITH s AS ({_STEPS.format(table="imu_common")}),
b AS (SELECT dataset_id, {_SAMPLING.format(n="timestamp_count", duration="duration", median="median_interval", mean="mean_interval", std="interval_standard_deviation", dup="duplicate_count", back="backward_count")},
             min(dt) FILTER (dt > 0) AS minimum_interval, max(dt) FILTER (dt > 0) AS maximum_interval FROM s GROUP BY 1 HAVING count(*) FILTER (dt > 0) > 0),
g AS (SELECT dataset_id, sqrt(avg((dt - median_interval) ** 2)) AS rms_jitter, avg(abs(dt - median_interval)) AS mean_absolute_jitter, max(abs(dt - median_interval)) AS maximum_absolute_jitter,
             count(*) FILTER (dt > 5 * median_interval) AS large_gap_count, max(dt) FILTER (dt > 5 * median_interval) AS largest_gap,
             CAST(sum(greatest(round_even(dt / median_interval, 0), 1) - 1) AS BIGINT) AS estimated_missing FROM s JOIN b USING (dataset_id) WHERE dt > 0 GROUP BY 1),
n AS (SELECT dataset_id, max(nominal_sampling_rate_hz) AS nominal_rate FROM recordings GROUP BY 1)
SELECT *, 1 / median_interval AS sampling_rate, interval_standard_deviation / mean_interval AS coefficient_of_variation, 100 * timestamp_count / (timestamp_count + estimated_missing) AS capture_percent,
       CASE WHEN nominal_rate > 0 THEN 100 * (1 / median_interval - nominal_rate) / nominal_rate END AS rate_error_percent
FROM b JOIN g USING (dataset_id) LEFT JOIN n USING (dataset_id)""",
    "duration median_interval mean_interval interval_standard_deviation minimum_interval maximum_interval rms_jitter mean_absolute_jitter maximum_absolute_jitter largest_gap sampling_rate coefficient_of_variation capture_percent nominal_rate rate_error_percent",
    "dataset_id timestamp_count duplicate_count backward_count large_gap_count estimated_missing",
)
def _(spark, d):
    nominal = read(spark, d, "recordings").groupBy("dataset_id").agg(F.max("nominal_sampling_rate_hz").alias("nominal_rate"))
    return imu_tools.sampling_integrity(imu(spark, d), KEY, nominal=nominal)


def _axis_sql(axes: tuple[str, ...]) -> str:
    parts = []
    for a in axes:
        x = f"(CASE WHEN isfinite({a}) THEN {a} END)"
        parts.append(f"count({x}) AS {a}_count, avg({x}) AS {a}_mean, stddev_samp({x}) AS {a}_std, sqrt(avg({x} * {x})) AS {a}_rms, max({x}) - min({x}) AS {a}_peak_to_peak, median({x}) AS {a}_median")
    return ", ".join(parts)


def _axis_columns(axes: tuple[str, ...]) -> str:
    return " ".join(f"{a}_{c}" for a in axes for c in ("mean", "std", "rms", "peak_to_peak", "median"))


def _spread_sql(axes: tuple[str, ...]) -> str:
    s = ", ".join(f"{a}_std" for a in axes)
    return f"({' + '.join(f'{a}_std' for a in axes)}) / 3 AS mean_axis_std, greatest({s}) AS maximum_axis_std, CASE WHEN least({s}) > 0 THEN greatest({s}) / least({s}) WHEN greatest({s}) = 0 THEN 1 END AS noise_spread_ratio"


_SPREAD = "mean_axis_std maximum_axis_std noise_spread_ratio"
_G, _A = imu_tools.GYRO, imu_tools.ACCEL


def _at_least(axes: tuple[str, ...]) -> str:
    return f"least({', '.join(f'{a}_count' for a in axes)}) >= {IMU_SAMPLES}"


@tool(
    "imu_gyro_bias",
    f"""WITH g AS (SELECT dataset_id, {_axis_sql(_G)} FROM imu_resting GROUP BY 1)
SELECT *, sqrt(gx_mean ** 2 + gy_mean ** 2 + gz_mean ** 2) AS bias_vector_magnitude, {_spread_sql(_G)} FROM g WHERE {_at_least(_G)}""",
    f"{_axis_columns(_G)} bias_vector_magnitude {_SPREAD}",
    "dataset_id " + " ".join(f"{a}_count" for a in _G),
)
def _(spark, d):
    return imu_tools.gyro_bias(imu_resting(spark, d), KEY, IMU_SAMPLES)


_POSE = r"""CASE WHEN regexp_full_match(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[ _]', '', 'g'), '^(plus|positive)', '+'), '^(minus|negative)', '-'), '^([xyz])([+-])$', '\2\1'), '[+-][xyz]')
 THEN upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[ _]', '', 'g'), '^(plus|positive)', '+'), '^(minus|negative)', '-'), '^([xyz])([+-])$', '\2\1')) END"""


def _expected(a: str, pose: str = "orientation") -> str:
    return f"(CASE WHEN {pose} = '+{a[1].upper()}' THEN 9.80665 WHEN {pose} = '-{a[1].upper()}' THEN -9.80665 WHEN {pose} IS NOT NULL THEN 0 END)"


@tool(
    "imu_accelerometer_bias",
    f"""WITH g AS (SELECT dataset_id, {_axis_sql(_A)}, CASE WHEN count(DISTINCT trim(orientation_label)) = 1 THEN {_POSE.format("max(trim(orientation_label))")} END AS orientation FROM imu_resting GROUP BY 1),
h AS (SELECT *, sqrt(ax_mean ** 2 + ay_mean ** 2 + az_mean ** 2) AS mean_vector_magnitude, {_spread_sql(_A)}, {", ".join(f"{a}_mean - {_expected(a)} AS {a}_bias" for a in _A)} FROM g WHERE {_at_least(_A)})
SELECT *, mean_vector_magnitude - 9.80665 AS gravity_magnitude_error, 100 * (mean_vector_magnitude - 9.80665) / 9.80665 AS gravity_magnitude_error_percent, sqrt(ax_bias ** 2 + ay_bias ** 2 + az_bias ** 2) AS bias_vector_magnitude FROM h""",
    f"{_axis_columns(_A)} mean_vector_magnitude {_SPREAD} ax_bias ay_bias az_bias gravity_magnitude_error gravity_magnitude_error_percent bias_vector_magnitude",
    "dataset_id orientation " + " ".join(f"{a}_count" for a in _A),
)
def _(spark, d):
    return imu_tools.accelerometer_bias(imu_resting(spark, d), KEY, IMU_SAMPLES)


def _long_sql(extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT dataset_id, row_ord, '{a}' AS axis, {a} AS x{extra} FROM imu_resting WHERE isfinite({a})" for a in imu_tools.AXES)


@tool(
    "imu_stationary_noise",
    f"""WITH l AS ({_long_sql()}), p AS (SELECT *, x - lag(x) OVER (PARTITION BY dataset_id, axis ORDER BY row_ord) AS dx, median(x) OVER (PARTITION BY dataset_id, axis) AS med FROM l),
g AS (SELECT dataset_id, axis, count(*) AS sample_count, stddev_samp(x) AS standard_deviation, var_samp(x) AS variance, stddev_pop(x) AS rms, median(abs(x - med)) AS mad, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS span_5_95,
             CASE WHEN count(dx) >= 2 THEN stddev_samp(dx) / sqrt(2) END AS difference_noise FROM p GROUP BY ALL HAVING count(*) >= {IMU_SAMPLES})
SELECT *, 1.4826 * mad AS robust_sigma, CASE WHEN mad > 0 THEN standard_deviation / (1.4826 * mad) END AS standard_to_robust_ratio FROM g""",
    "standard_deviation variance rms mad robust_sigma span_5_95 difference_noise standard_to_robust_ratio",
    "dataset_id axis sample_count",
)
def _(spark, d):
    return imu_tools.stationary_noise(imu_resting(spark, d), KEY, min_samples=IMU_SAMPLES)


_VECTORS = "SELECT *, sqrt(ax * ax + ay * ay + az * az) AS a FROM imu_resting WHERE isfinite(ax) AND isfinite(ay) AND isfinite(az)"


@tool(
    "imu_gravity_error",
    f"""WITH v AS (SELECT *, a - 9.80665 AS d FROM ({_VECTORS})),
g AS (SELECT dataset_id, count(*) AS sample_count, avg(a) AS mean_magnitude, stddev_samp(a) AS magnitude_standard_deviation, avg(d) AS mean_error, avg(abs(d)) AS mean_absolute_error, sqrt(avg(d * d)) AS root_mean_squared_error,
             max(abs(d)) AS maximum_absolute_error FROM v GROUP BY 1 HAVING count(*) >= {IMU_SAMPLES})
SELECT *, {", ".join(f"100 * {c} / 9.80665 AS {c}_percent" for c in ("mean_error", "mean_absolute_error", "root_mean_squared_error", "maximum_absolute_error"))} FROM g""",
    "mean_magnitude magnitude_standard_deviation mean_error mean_absolute_error root_mean_squared_error maximum_absolute_error mean_error_percent mean_absolute_error_percent root_mean_squared_error_percent maximum_absolute_error_percent",
    "dataset_id sample_count",
)
def _(spark, d):
    return imu_tools.gravity_error(imu_resting(spark, d), KEY, IMU_SAMPLES)


@tool(
    "imu_gravity_by_orientation",
    f"""WITH g AS (SELECT dataset_id, trim(orientation_label) AS label, count(*) AS sample_count, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az FROM ({_VECTORS}) WHERE trim(orientation_label) <> '' GROUP BY ALL HAVING count(*) >= 50),
h AS (SELECT *, {_POSE.format("label")} AS orientation, sqrt(ax * ax + ay * ay + az * az) AS size FROM g),
i AS (SELECT *, {", ".join(f"{_expected(a)} AS e_{a}" for a in _A)} FROM h)
SELECT dataset_id, label, orientation, sample_count, size AS mean_vector_magnitude, 100 * (size - 9.80665) / 9.80665 AS magnitude_error_percent,
       sqrt((ax - e_ax) ** 2 + (ay - e_ay) ** 2 + (az - e_az) ** 2) AS vector_error,
       degrees(acos(greatest(-1, least(1, (ax * e_ax + ay * e_ay + az * e_az) / (size * sqrt(e_ax ** 2 + e_ay ** 2 + e_az ** 2)))))) AS angular_deviation FROM i""",
    "mean_vector_magnitude magnitude_error_percent vector_error angular_deviation",
    "dataset_id label orientation sample_count",
)
def _(spark, d):
    return imu_tools.gravity_by_orientation(imu_resting(spark, d), KEY)


def _correlation_sql(axes: tuple[str, ...]) -> str:
    a, b, c = axes
    ok = " AND ".join(f"isfinite({x})" for x in axes)
    pairs = ((a, b), (a, c), (b, c))
    aggs = ", ".join(
        f"covar_samp({x}, {y}) AS covariance_{x}_{y}, CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END AS correlation_{x}_{y}, "
        f"covar_samp(d{x}, d{y}) / nullif(stddev_samp(d{x}) * stddev_samp(d{y}), 0) AS difference_correlation_{x}_{y}"
        for x, y in pairs
    )
    size = [f"abs(correlation_{x}_{y})" for x, y in pairs]
    diff = ", ".join(f"abs(difference_correlation_{x}_{y})" for x, y in pairs)
    strongest = " ".join(f"WHEN {size[k]} = greatest({', '.join(size)}) THEN '{x}_{y}'" for k, (x, y) in enumerate(pairs))
    return f"""WITH p AS (SELECT *, {", ".join(f"{x} - lag({x}) OVER w AS d{x}" for x in axes)} FROM imu_common WHERE {ok} WINDOW w AS (PARTITION BY dataset_id ORDER BY row_ord)),
g AS (SELECT dataset_id, count(*) AS sample_count, {aggs} FROM p GROUP BY 1 HAVING count(*) >= {IMU_SAMPLES} AND least({", ".join(f"var_samp({x})" for x in axes)}) > 0)
SELECT *, greatest({", ".join(size)}) AS maximum_absolute_correlation, CASE {strongest} END AS strongest, greatest({diff}) AS maximum_absolute_difference_correlation FROM g"""


def _correlation_columns(axes: tuple[str, ...]) -> str:
    a, b, c = axes
    return " ".join(f"{k}_{p}" for p in (f"{a}_{b}", f"{a}_{c}", f"{b}_{c}") for k in ("covariance", "correlation", "difference_correlation")) + " maximum_absolute_correlation maximum_absolute_difference_correlation"


# The dominant share needs eigenvalues, which SQL has not; it is tested against NumPy.
@tool("imu_axis_correlation_accelerometer", _correlation_sql(_A), _correlation_columns(_A), "dataset_id sample_count strongest")
def _(spark, d):
    return imu_tools.axis_correlation(imu(spark, d), KEY, _A, min_samples=IMU_SAMPLES).drop("dominant_variance_percent")


@tool("imu_axis_correlation_gyroscope", _correlation_sql(_G), _correlation_columns(_G), "dataset_id sample_count strongest")
def _(spark, d):
    return imu_tools.axis_correlation(imu(spark, d), KEY, _G, min_samples=IMU_SAMPLES).drop("dominant_variance_percent")


@tool("imu_dominant_variance")
def _(spark, d):
    return imu_tools.axis_correlation(imu(spark, d), KEY, _A, min_samples=IMU_SAMPLES).select("dataset_id", "dominant_variance_percent")


_BY_TEMPERATURE = "SELECT * FROM (" + _long_sql(", temperature AS t") + ") WHERE isfinite(t)"


@tool(
    "imu_temperature_stability",
    f"""WITH g AS (SELECT dataset_id, axis, count(*) AS sample_count, min(t) AS temperature_minimum, max(t) AS temperature_maximum, regr_slope(x, t) AS coefficient,
        covar_samp(x, t) / nullif(stddev_samp(x) * stddev_samp(t), 0) AS correlation, regr_syy(x, t) AS syy, regr_sxy(x, t) AS sxy FROM ({_BY_TEMPERATURE}) GROUP BY ALL
      HAVING count(*) >= {IMU_SAMPLES} AND max(t) - min(t) >= 2)
SELECT *, temperature_maximum - temperature_minimum AS temperature_span, CASE WHEN syy > 0 THEN 1 - greatest(syy - coefficient * sxy, 0) / syy END AS r_squared, coefficient * (temperature_maximum - temperature_minimum) AS predicted_change,
       sqrt(greatest(syy - coefficient * sxy, 0) / (sample_count - 2)) AS residual_standard_deviation FROM g""",
    "temperature_minimum temperature_maximum coefficient correlation temperature_span r_squared predicted_change residual_standard_deviation",
    "dataset_id axis sample_count",
)
def _(spark, d):
    return imu_tools.temperature_stability(imu_resting(spark, d), KEY, min_samples=IMU_SAMPLES)


@tool(
    "imu_temperature_bins",
    f"""WITH l AS ({_BY_TEMPERATURE}), s AS (SELECT dataset_id, axis, min(t) AS lo, max(t) AS hi FROM l GROUP BY ALL HAVING max(t) > min(t)),
b AS (SELECT *, {" + ".join(f"CASE WHEN t >= lo + (hi - lo) / 10 * {k} THEN 1 ELSE 0 END" for k in range(1, 10))} AS bin FROM l JOIN s USING (dataset_id, axis))
SELECT dataset_id, axis, bin, count(*) AS sample_count, avg(t) AS temperature_mean, avg(x) AS output_mean, coalesce(stddev_samp(x), 0) AS output_standard_deviation FROM b GROUP BY ALL HAVING count(*) >= 20""",
    "temperature_mean output_mean output_standard_deviation",
    "dataset_id axis bin sample_count",
)
def _(spark, d):
    return imu_tools.temperature_bins(imu_resting(spark, d), KEY)


_SAT_AXES = " UNION ALL ".join(
    f"SELECT dataset_id, row_ord, '{a}' AS axis, CASE WHEN isfinite({a}) THEN {a} END AS x, -{r} AS low, {r} AS high FROM imu_common JOIN ({RANGE_SQL}) USING (dataset_id) WHERE {r} > 0"
    for a in imu_tools.AXES
    for r in ["a_high" if a[0] == "a" else "g_high"]
)


def _run_sql(flag: str, name: str) -> str:
    return f"""(SELECT dataset_id, axis, max(n) AS {name} FROM (SELECT dataset_id, axis, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, axis ORDER BY row_ord)
      - row_number() OVER (PARTITION BY dataset_id, axis, {flag} ORDER BY row_ord) AS island FROM f) WHERE {flag} GROUP BY dataset_id, axis, island) GROUP BY ALL)"""


@tool(
    "imu_saturation",
    f"""WITH l AS (SELECT *, high - low AS span FROM ({_SAT_AXES})),
f AS (SELECT *, coalesce(abs(x - low) <= span * 1e-6, false) AS xl, coalesce(abs(x - high) <= span * 1e-6, false) AS xh, coalesce(x <= low + span * 0.005, false) AS nl, coalesce(x >= high - span * 0.005, false) AS nh,
             coalesce(abs(x - low) <= span * 1e-6 OR abs(x - high) <= span * 1e-6, false) AS at_limit, coalesce(x <= low + span * 0.005 OR x >= high - span * 0.005, false) AS near_limit,
             coalesce(x < low - span * 1e-6 OR x > high + span * 1e-6, false) AS outside FROM l),
g AS (SELECT dataset_id, axis, count(x) AS sample_count, any_value(low) AS configured_minimum, any_value(high) AS configured_maximum, min(x) AS observed_minimum, max(x) AS observed_maximum,
        count(*) FILTER (xl) AS exact_lower_count, count(*) FILTER (xh) AS exact_upper_count, count(*) FILTER (nl) AS near_lower_count, count(*) FILTER (nh) AS near_upper_count,
        count(*) FILTER (near_limit) AS near_count, count(*) FILTER (near_limit AND NOT at_limit) AS near_not_exact_count, count(*) FILTER (outside) AS outside_count FROM f GROUP BY ALL HAVING count(x) > 0)
SELECT g.*, exact_lower_count + exact_upper_count AS exact_count, coalesce(longest_exact_run, 0) AS longest_exact_run, coalesce(longest_near_run, 0) AS longest_near_run,
       100 * (observed_maximum - observed_minimum) / (configured_maximum - configured_minimum) AS range_utilization_percent, 100 * (exact_lower_count + exact_upper_count) / sample_count AS exact_percent,
       100 * near_count / sample_count AS near_percent, 100 * outside_count / sample_count AS outside_percent,
       CASE WHEN near_count >= 5 THEN 100 * near_upper_count / near_count END AS upper_near_share_percent, CASE WHEN near_count >= 5 THEN 100 * near_lower_count / near_count END AS lower_near_share_percent
FROM g LEFT JOIN {_run_sql("at_limit", "longest_exact_run")} USING (dataset_id, axis) LEFT JOIN {_run_sql("near_limit", "longest_near_run")} USING (dataset_id, axis)""",
    "configured_minimum configured_maximum observed_minimum observed_maximum range_utilization_percent exact_percent near_percent outside_percent upper_near_share_percent lower_near_share_percent",
    "dataset_id axis sample_count exact_lower_count exact_upper_count exact_count near_lower_count near_upper_count near_count near_not_exact_count outside_count longest_exact_run longest_near_run",
)
def _(spark, d):
    return imu_tools.saturation(imu(spark, d), KEY, common_limits(read(spark, d, "recordings")))


def _six_sql(key: str, rows: str) -> str:
    return f"""WITH v AS (SELECT *, {_POSE.format("orientation_label")} AS pose FROM ({rows})),
m AS (SELECT {key}, pose, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az FROM v WHERE pose IS NOT NULL GROUP BY ALL HAVING count(*) >= 50),
s AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS sample_count, {", ".join(f"max({a}) FILTER (pose = '+{a[1].upper()}') AS p_{a}, max({a}) FILTER (pose = '-{a[1].upper()}') AS m_{a}" for a in _A)} FROM m GROUP BY 1 HAVING count(*) = 6),
f AS (SELECT {key}, sample_count, {", ".join(f"(p_{a} + m_{a}) / 2 AS {a}_bias, (p_{a} - m_{a}) / 2 / 9.80665 AS {a}_sensitivity, p_{a} - m_{a} AS {a}_plus_minus_span" for a in _A)} FROM s
      WHERE {" AND ".join(f"abs(p_{a} - m_{a}) >= 9.80665" for a in _A)}),
c AS (SELECT *, {", ".join(f"100 * ({a}_sensitivity - 1) AS {a}_sensitivity_error_percent, 1 / {a}_sensitivity AS {a}_correction_scale" for a in _A)}, sqrt(ax_bias ** 2 + ay_bias ** 2 + az_bias ** 2) AS bias_vector_magnitude FROM f),
e AS (SELECT {key}, {", ".join(f"{a}, {a}_correction_scale * ({a} - {a}_bias) AS c_{a}, {_expected(a, 'pose')} AS e_{a}" for a in _A)} FROM m JOIN c USING ({key})),
q AS (SELECT {key}, {", ".join(_six_quality(n, v) for n, v in (("raw", _A), ("corrected", tuple(f"c_{a}" for a in _A))))} FROM e GROUP BY 1)
SELECT * FROM c JOIN q USING ({key})"""


def _six_quality(name: str, v: tuple[str, ...]) -> str:
    error = " + ".join(f"({x} - e_{a}) ** 2" for x, a in zip(v, _A, strict=True))
    size = f"sqrt({' + '.join(f'{x} ** 2' for x in v)})"
    dot = " + ".join(f"{x} * e_{a}" for x, a in zip(v, _A, strict=True))
    return (
        f"sqrt(avg(({error}) / 3)) AS {name}_component_rmse, avg(abs({size} - 9.80665)) AS {name}_gravity_magnitude_mae, "
        f"avg(degrees(acos(greatest(-1, least(1, ({dot}) / ({size} * 9.80665)))))) AS {name}_mean_angular_deviation"
    )


_SIX = " ".join(f"{a}_{c}" for a in _A for c in ("bias", "sensitivity", "plus_minus_span", "sensitivity_error_percent", "correction_scale")) + " bias_vector_magnitude"
_SIX += " " + " ".join(f"{n}_{c}" for n in ("raw", "corrected") for c in ("component_rmse", "gravity_magnitude_mae", "mean_angular_deviation"))


@tool("imu_six_position", _six_sql("sensor_id", _VECTORS + " AND sensor_id IS NOT NULL"), _SIX, "sensor_id sample_count")
def _(spark, d):
    return imu_tools.six_position(imu_resting(spark, d).where("sensor_id IS NOT NULL"), ["sensor_id"])


# No sensor of the smaller test tables was turned to all six orientations: the whole bench was.
@tool("imu_six_position_bench", _six_sql("bench", f"SELECT *, 'all' AS bench FROM ({_VECTORS})"), _SIX, "bench sample_count")
def _(spark, d):
    return imu_tools.six_position(imu_resting(spark, d).withColumn("bench", F.lit("all")), ["bench"])


@tool(
    "imu_missing_orientations",
    f"""WITH v AS (SELECT DISTINCT sensor_id, {_POSE.format("orientation_label")} AS pose FROM imu_samples WHERE sensor_id IS NOT NULL AND trim(orientation_label) <> '')
SELECT s.sensor_id, o.pose AS orientation FROM (SELECT DISTINCT sensor_id FROM v) s, (SELECT unnest(['+X', '-X', '+Y', '-Y', '+Z', '-Z']) AS pose) o WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.sensor_id = s.sensor_id AND v.pose = o.pose)""",
    "",
    "sensor_id orientation",
)
def _(spark, d):
    labelled = read(spark, d, "imu_samples").where("sensor_id IS NOT NULL AND trim(orientation_label) <> ''")
    return imu_tools.missing_orientations(labelled, ["sensor_id"])


def _imu_segments(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the longest stretches of both groups of axes as x0, x1, x2; the table of the stretches)."""
    groups = [_A, _G]
    table = spectral.segment_table(samples, KEY, groups)
    return spectral.segment_rows(samples, KEY, groups, table), table.df


_BY_GROUP = [*KEY, "grp"]
_SLOTS = ["x0", "x1", "x2"]


def _named(found: DataFrame, regular: DataFrame) -> DataFrame:
    """Results by group and slot under the names of the axes, with what is told of the stretch."""
    names = F.create_map(*[F.lit(x) for g, axes in enumerate((_A, _G)) for j, a in enumerate(axes) for x in (f"{g}x{j}", a)])
    out = found.withColumn("axis", names[F.concat(F.col("grp").cast("string"), F.col("axis"))])
    return out.join(regular, _BY_GROUP).drop("grp")


def imu_spectra(samples: DataFrame) -> DataFrame:
    """Spectral metrics of all six axes."""
    series, table = _imu_segments(samples)
    found = spectral.spectrum_metrics(spectral.welch(series, _BY_GROUP, _SLOTS), _BY_GROUP)
    return _named(found, spectral.regularity(table, _BY_GROUP).drop("duration"))


def _segments_sql(table: str) -> str:
    """CTE ``seg``: dataset_id, axis, pos, x, dt, dt_cv, n of the longest continuous stretch of each group of axes."""
    parts, longs = [], []
    for g, axes in (("a", _A), ("g", _G)):
        ok = " AND ".join(f"isfinite({c})" for c in ("timestamp", *axes))
        parts.append(f"""{g}0 AS (SELECT dataset_id, row_ord, {", ".join(axes)}, CASE WHEN isfinite(timestamp) THEN timestamp END AS t, coalesce({ok}, false) AS ok FROM {table}),
{g}1 AS (SELECT {g}0.*, dt, dt_cv, coalesce(ok AND lag(ok) OVER w AND t - lag(t) OVER w > 0 AND t - lag(t) OVER w <= {spectral.CONTINUITY} * dt, false) AS linked FROM {g}0 JOIN steps USING (dataset_id) WINDOW w AS (PARTITION BY dataset_id ORDER BY row_ord)),
{g}2 AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY dataset_id ORDER BY row_ord) AS part FROM {g}1),
{g}3 AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, part) AS n FROM {g}2 WHERE ok),
{g}4 AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_ord) - 1 AS pos FROM {g}3 JOIN (SELECT dataset_id, arg_max(part, (n, -part)) AS part FROM {g}3 GROUP BY 1) USING (dataset_id, part))""")
        longs += [f"SELECT dataset_id, '{a}' AS axis, pos, {a} AS x, dt, dt_cv, n FROM {g}4" for a in axes]
    return f"""steps AS (SELECT dataset_id, median(d) AS dt, stddev_pop(d) / avg(d) AS dt_cv FROM (SELECT dataset_id, timestamp - lag(timestamp) OVER (PARTITION BY dataset_id ORDER BY row_ord) AS d FROM {table} WHERE isfinite(timestamp)) WHERE d > 0 GROUP BY 1),
{", ".join(parts)},
seg AS ({" UNION ALL ".join(longs)})"""


def _spectrum_sql(source: str, length: int, even: bool, low: float) -> str:
    """Welch metrics by dataset_id and axis of ``source`` (dataset_id, axis, pos, x, dt, dt_cv, n): the transform written out as sums."""
    size = f"least({length}, n)"
    size = f"CASE WHEN {size} > 32 AND {size} % 2 = 1 THEN {size} - 1 ELSE {size} END" if even else size
    key = "dataset_id, axis"
    return f"""w0 AS (SELECT *, CAST({size} AS BIGINT) AS len FROM {source} WHERE n >= 32),
w1 AS (SELECT *, len - least(CAST(round_even(len * 0.5, 0) AS BIGINT), len - 1) AS hop FROM w0),
w2 AS (SELECT *, 1 + (n - len) // hop AS segments FROM w1),
w3 AS (SELECT *, unnest(generate_series(0, segments - 1)) AS seg_no FROM w2),
w4 AS (SELECT *, pos - seg_no * hop AS j, 0.5 - 0.5 * cos(2 * pi() * (pos - seg_no * hop) / (len - 1)) AS taper, x - avg(x) OVER (PARTITION BY {key}, seg_no) AS y FROM w3 WHERE pos >= seg_no * hop AND pos < seg_no * hop + len),
w5 AS (SELECT *, unnest(generate_series(0, len // 2)) AS bin FROM w4),
w6 AS (SELECT {key}, seg_no, bin, any_value(segments) AS segments, any_value(len) AS len, any_value(dt) AS dt, any_value(dt_cv) AS dt_cv,
         (sum(y * taper * cos(2 * pi() * ((bin * j) % len) / len)) ** 2 + sum(y * taper * sin(2 * pi() * ((bin * j) % len) / len)) ** 2) * any_value(dt) / sum(taper * taper) AS p FROM w5 GROUP BY ALL),
w7 AS (SELECT {key}, bin, segments, len, dt, dt_cv, avg(p) * CASE WHEN bin = 0 OR (len % 2 = 0 AND bin = len // 2) THEN 1 ELSE 2 END AS psd, bin / (len * dt) AS f FROM w6 GROUP BY {key}, bin, segments, len, dt, dt_cv),
b AS (SELECT {key}, any_value(segments) AS segment_count, any_value(len) AS segment_length, any_value(f) FILTER (bin = 1) AS frequency_resolution, any_value(dt_cv) AS sampling_cv, sqrt(greatest(sum(area), 0)) AS integrated_rms
      FROM (SELECT *, (psd + lag(psd) OVER v) / 2 * (f - lag(f) OVER v) AS area FROM w7 WINDOW v AS (PARTITION BY {key} ORDER BY bin)) GROUP BY ALL),
h AS (SELECT *, lag(psd) OVER v AS l, lead(psd) OVER v AS r FROM w7 WHERE f >= {low} WINDOW v AS (PARTITION BY {key} ORDER BY bin)),
m AS (SELECT {key}, coalesce(median(psd) FILTER (psd > 0), 0) AS median_psd, arg_max(f, (psd, -f)) AS dominant_frequency, max(psd) AS dominant_psd FROM h GROUP BY ALL),
k AS (SELECT {key}, least(count(*), 5) AS peaks, arg_max(f, (psd, f)) AS first_peak_frequency FROM h JOIN m USING ({key}) WHERE psd > l AND psd >= r AND median_psd > 0 AND psd >= 10 * median_psd GROUP BY ALL)
SELECT b.*, median_psd, dominant_frequency, dominant_psd, sqrt(median_psd) AS median_amplitude_density, CASE WHEN median_psd > 0 THEN dominant_psd / median_psd END AS dominant_to_median_ratio,
       CAST(coalesce(peaks, 0) AS INTEGER) AS peak_count, first_peak_frequency, sampling_cv <= 0.02 AS regular FROM b JOIN m USING ({key}) LEFT JOIN k USING ({key})"""


_SPECTRUM = "frequency_resolution sampling_cv integrated_rms median_psd dominant_frequency dominant_psd median_amplitude_density dominant_to_median_ratio first_peak_frequency"
_SPECTRUM_OTHERS = "dataset_id axis segment_count segment_length peak_count regular"


@tool("imu_psd", f"WITH {_segments_sql('imu_common')}, {_spectrum_sql('seg', 2048, True, 0.1)}", _SPECTRUM, _SPECTRUM_OTHERS)
def _(spark, d):
    return imu_spectra(imu(spark, d))


_GENERIC_SERIES = f"""s AS (SELECT dataset_id, 'e' AS axis, e AS x, timestamp AS t, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY dataset_id) AS n, timestamp - lag(timestamp) OVER w AS d FROM ({PAIRS}) WHERE isfinite(timestamp) WINDOW w AS (PARTITION BY dataset_id ORDER BY timestamp, row_ord)),
q AS (SELECT dataset_id, median(d) AS dt, coalesce(stddev_samp(d), 0) / avg(d) AS dt_cv FROM s WHERE d > 0 GROUP BY 1), seg AS (SELECT s.*, dt, dt_cv FROM s JOIN q USING (dataset_id))"""


@tool("generic_psd", f"WITH {_GENERIC_SERIES}, {_spectrum_sql('seg', 1024, False, 0.0)}", _SPECTRUM, _SPECTRUM_OTHERS)
def _(spark, d):
    rows = generic_tools.pairs(generic(spark, d), KEY, "row_ord", "timestamp")
    series = spectral.ordered_by_time(rows, KEY, ["e"])
    found = spectral.spectrum_metrics(spectral.welch(series, KEY, ["e"], segment_length=1024, even=False), KEY, min_frequency=0.0)
    return found.join(spectral.regularity(series, KEY).drop("duration"), KEY)


#: Seconds a series must last for its flat region to be called a bias instability.
BIAS_SECONDS = 300.0


def imu_allan(samples: DataFrame, min_samples: int = 60, min_duration: float = 0.5) -> DataFrame:
    """Allan metrics of all six axes.  The test recordings are short: 60 samples and half a second instead of 2000 and 30 s."""
    series, table = _imu_segments(samples)
    found = spectral.allan_metrics(spectral.allan_curve(series, _BY_GROUP, _SLOTS, min_samples=min_samples, min_duration=min_duration), _BY_GROUP)
    out = _named(found, spectral.regularity(table, _BY_GROUP))
    return out.withColumn("bias_instability", F.when(F.col("duration") >= BIAS_SECONDS, F.col("bias_instability")))


# Running sums from the first value; the three of each difference are joined by position.
_ALLAN_SQL = f"""WITH {_segments_sql("imu_resting")},
c AS (SELECT dataset_id, axis, n, dt, dt_cv, pos + 1 AS i, sum(x - x0) OVER (PARTITION BY dataset_id, axis ORDER BY pos) AS c FROM (SELECT *, first_value(x) OVER (PARTITION BY dataset_id, axis ORDER BY pos) AS x0 FROM seg WHERE n >= 60 AND (n - 1) * dt >= 0.5)
      UNION ALL SELECT DISTINCT dataset_id, axis, n, dt, dt_cv, 0, 0.0 FROM seg WHERE n >= 60 AND (n - 1) * dt >= 0.5),
f AS (SELECT n, unnest(factors) AS m FROM (SELECT n, list_distinct(list_transform(range(40), lambda k: greatest(1, least(most, CAST(round_even(pow(10, log10(most) * k / 39), 0) AS BIGINT))))) AS factors FROM (SELECT DISTINCT n, (n - 19) // 2 AS most FROM c) WHERE most >= 2) WHERE len(factors) >= 3),
d AS (SELECT a.dataset_id, a.axis, a.n, a.dt, a.dt_cv, m, (e.c - 2 * b.c + a.c) / m AS d FROM c a JOIN f ON a.n = f.n JOIN c b ON b.dataset_id = a.dataset_id AND b.axis = a.axis AND b.i = a.i + m JOIN c e ON e.dataset_id = a.dataset_id AND e.axis = a.axis AND e.i = a.i + 2 * m),
v AS (SELECT dataset_id, axis, m, m * any_value(dt) AS tau, sqrt(0.5 * avg(d * d)) AS adev, (any_value(n) - 1) * any_value(dt) AS duration, any_value(dt_cv) AS sampling_cv FROM d GROUP BY dataset_id, axis, m),
x AS (SELECT *, log10(tau) AS lx, CASE WHEN adev > 0 THEN log10(adev) END AS ly FROM v),
y AS (SELECT *, CASE WHEN count(ly) OVER w >= 3 AND count(ly) OVER w = count(*) OVER w THEN regr_slope(ly, lx) OVER w END AS slope FROM x WINDOW w AS (PARTITION BY dataset_id, axis ORDER BY m ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
g AS (SELECT dataset_id, axis, count(*) AS points, min(adev) AS minimum_deviation, arg_min(tau, (adev, m)) AS tau_at_minimum, max(tau) AS maximum_averaging_time, any_value(duration) AS duration, any_value(sampling_cv) AS sampling_cv, any_value(sampling_cv) <= 0.02 AS regular,
        count(*) FILTER (abs(slope + 0.5) <= 0.15) AS white, median(adev * sqrt(tau)) FILTER (abs(slope + 0.5) <= 0.15) AS walk, median(slope) FILTER (abs(slope + 0.5) <= 0.15) AS ws, count(*) FILTER (abs(slope) <= 0.15) AS flat, median(adev) FILTER (abs(slope) <= 0.15) / 0.664 AS flat_level
      FROM y GROUP BY ALL)
SELECT dataset_id, axis, points, minimum_deviation, tau_at_minimum, maximum_averaging_time, CASE WHEN white >= 2 THEN walk END AS random_walk_coefficient, CASE WHEN white >= 2 THEN ws END AS white_slope,
       CASE WHEN flat >= 2 AND duration >= 300 THEN flat_level END AS bias_instability, sampling_cv, duration, regular FROM g"""


@tool(
    "imu_allan_deviation",
    _ALLAN_SQL,
    "minimum_deviation tau_at_minimum maximum_averaging_time random_walk_coefficient white_slope bias_instability sampling_cv duration",
    "dataset_id axis points regular",
)
def _(spark, d):
    return imu_allan(imu_resting(spark, d))


@tool(
    "sampling_summary",
    f"""WITH s AS ({_STEPS.format(table="generic_samples")}),
b AS (SELECT dataset_id, {_SAMPLING.format(n="sample_count", duration="duration_seconds", median="median_interval_seconds", mean="mean_interval_seconds", std="std_interval_seconds", dup="duplicate_timestamp_count", back="backward_timestamp_count")} FROM s GROUP BY 1),
g AS (SELECT dataset_id, count(*) FILTER (dt > 5 * median_interval_seconds) AS large_gap_count, max(dt) FILTER (dt > 5 * median_interval_seconds) AS largest_gap_seconds FROM s JOIN b USING (dataset_id) WHERE dt > 0 GROUP BY 1)
SELECT b.*, coalesce(large_gap_count, 0) AS large_gap_count, largest_gap_seconds, 1 / median_interval_seconds AS estimated_sampling_rate_hz, std_interval_seconds / mean_interval_seconds AS coefficient_of_variation FROM b LEFT JOIN g USING (dataset_id)""",
    "duration_seconds median_interval_seconds mean_interval_seconds std_interval_seconds largest_gap_seconds estimated_sampling_rate_hz coefficient_of_variation",
    "dataset_id sample_count duplicate_timestamp_count backward_timestamp_count large_gap_count",
)
def _(spark, d):
    return validation.sampling_summary(generic(spark, d), KEY)


_NUMERIC = ("timestamp", "measurement", "reference", "temperature", "humidity", "supply_voltage")
_LABELS = ("sensor_id", "revision", "test_cycle", "sweep_direction")


def _issue_sql(name: str, level: str, column: str | None, rows: str, share: str, test: str) -> str:
    col = "NULL::VARCHAR" if column is None else f"'{column}'"
    return f"SELECT dataset_id, '{name}' AS issue_id, {level} AS severity, {col} AS \"column\", CAST({rows} AS BIGINT) AS affected_rows, CAST({share} AS DOUBLE) AS affected_fraction FROM s WHERE {test}"


def _validator_sql() -> str:
    miss = lambda c: f"count(*) FILTER ({c} IS NULL" + (f" OR isnan({c})" if c in _NUMERIC else "") + f") AS miss_{c}"
    aggs = ", ".join([miss(c) for c in (*_NUMERIC, *_LABELS)] + [f"count(*) FILTER (isinf({c})) AS inf_{c}, min({c}) FILTER (isfinite({c})) = max({c}) FILTER (isfinite({c})) AS flat_{c}" for c in _NUMERIC])
    cols = ", ".join((*_NUMERIC, *_LABELS))
    parts = [_issue_sql("short_dataset", "'warning'", None, "n", "1", "n < 10"), _issue_sql("duplicate_rows", "'warning'", None, "dup", "dup / n", "dup > 0")]
    for c in (*_NUMERIC, *_LABELS):
        parts.append(_issue_sql("missing_values", f"CASE WHEN miss_{c} / n >= 0.2 THEN 'error' WHEN miss_{c} / n >= 0.01 THEN 'warning' ELSE 'info' END", c, f"miss_{c}", f"miss_{c} / n", f"miss_{c} > 0"))
    for c in _NUMERIC:
        parts.append(_issue_sql("infinite_values", "'error'", c, f"inf_{c}", f"inf_{c} / n", f"inf_{c} > 0"))
        parts.append(_issue_sql("constant_channel", "'info'", c, "n", "1", f"flat_{c}"))
    t = "timestamp"
    parts += [
        _issue_sql("insufficient_timestamps", "'error'", t, "ts", "ts / n", "ts < 2"),
        _issue_sql("duplicate_timestamps", "'warning'", t, "d0", "d0 / (ts - 1)", "d0 > 0"),
        _issue_sql("backward_timestamps", "'error'", t, "db", "db / (ts - 1)", "db > 0"),
        _issue_sql("no_positive_time_intervals", "'error'", t, "ts", "1", "ts >= 2 AND med IS NULL"),
        _issue_sql("irregular_sampling", "'warning'", t, "ts", "1", "cv > 0.05"),
        _issue_sql("large_time_gaps", "'warning'", t, "gaps", "gaps / (ts - 1)", "gaps > 0"),
    ]
    return f"""WITH st AS ({_STEPS.format(table="generic_samples")}),
tb AS (SELECT dataset_id, count(*) AS ts, count(*) FILTER (dt = 0) AS d0, count(*) FILTER (dt < 0) AS db, median(dt) FILTER (dt > 0) AS med, stddev_pop(dt) FILTER (dt > 0) / avg(dt) FILTER (dt > 0) AS cv FROM st GROUP BY 1),
tg AS (SELECT dataset_id, count(*) FILTER (dt > 5 * med) AS gaps FROM st JOIN tb USING (dataset_id) WHERE dt > 0 GROUP BY 1),
du AS (SELECT dataset_id, sum(k) AS dup FROM (SELECT dataset_id, {cols}, count(*) AS k FROM generic_samples GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT dataset_id, count(*) AS n, {aggs} FROM generic_samples GROUP BY 1),
s AS (SELECT g.*, coalesce(dup, 0) AS dup, coalesce(ts, 0) AS ts, d0, db, med, cv, gaps FROM g LEFT JOIN du USING (dataset_id) LEFT JOIN tb USING (dataset_id) LEFT JOIN tg USING (dataset_id))
{" UNION ALL ".join(parts)}"""


@tool("dataset_validator", _validator_sql(), "affected_fraction", 'dataset_id issue_id severity "column" affected_rows')
def _(spark, d):
    cols = generic(spark, d).select("dataset_id", "row_ord", *_NUMERIC, *_LABELS)
    return validation.validate(cols, KEY, list(_NUMERIC))


_MISSING_CELLS = " + ".join(f"CASE WHEN {c} IS NULL{f' OR isnan({c})' if c in _NUMERIC else ''} THEN 1 ELSE 0 END" for c in (*_NUMERIC, *_LABELS))


@tool(
    "dataset_verdict",
    f"""WITH c AS (SELECT dataset_id, count(*) AS row_count, count(*) * {len(_NUMERIC) + len(_LABELS)} AS total_cells, CAST(sum({_MISSING_CELLS}) AS BIGINT) AS total_missing_values FROM generic_samples GROUP BY 1),
i AS (SELECT dataset_id, count(*) AS issue_count, count(*) FILTER (severity = 'error') AS error_count, max(affected_rows) FILTER (issue_id = 'duplicate_rows') AS dup FROM ({_validator_sql()}) GROUP BY 1)
SELECT c.*, total_missing_values / total_cells AS overall_missing_fraction, coalesce(dup, 0) AS duplicate_row_count, coalesce(issue_count, 0) AS issue_count, coalesce(error_count, 0) AS error_count, coalesce(error_count, 0) = 0 AS valid FROM c LEFT JOIN i USING (dataset_id)""",
    "overall_missing_fraction",
    "dataset_id row_count total_cells total_missing_values duplicate_row_count issue_count error_count valid",
)
def _(spark, d):
    cols = generic(spark, d).select("dataset_id", "row_ord", *_NUMERIC, *_LABELS)
    return validation.verdict(cols, KEY, list(_NUMERIC))


_SPLIT = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_ord) - 1 AS pos, count(*) OVER (PARTITION BY dataset_id) AS n FROM ({PAIRS})),
s AS (SELECT *, pos >= n - greatest(1, least(n - 3, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS held FROM p WHERE n >= 4),
f AS (SELECT dataset_id, count(*) AS training_rows, regr_slope(r, m) AS gain, regr_intercept(r, m) AS "offset" FROM s WHERE NOT held GROUP BY 1 HAVING count(*) >= 3 AND var_pop(m) > 1e-15)"""


_TRAINING = """sqrt(avg((k * m + o - r) ** 2)) AS training_rmse, avg(abs(k * m + o - r)) AS training_mae, avg(k * m + o - r) AS training_bias,
       CASE WHEN var_pop(r) * count(*) > 1e-15 THEN 1 - sum((k * m + o - r) ** 2) / (var_pop(r) * count(*)) END AS training_r2"""


@tool(
    "calibration_affine",
    f'{_SPLIT} SELECT dataset_id, any_value(training_rows) AS training_rows, any_value(k) AS gain, any_value(o) AS "offset", {_TRAINING} FROM s JOIN (SELECT dataset_id, training_rows, gain AS k, "offset" AS o FROM f) USING (dataset_id) WHERE NOT held GROUP BY 1',
    'gain "offset" training_rmse training_mae training_bias training_r2',
    "dataset_id training_rows",
)
def _(spark, d):
    return calibration.fit(calibration.split_sequential(generic(spark, d), KEY), KEY)


@tool(
    "calibration_offset",
    f'{_SPLIT} SELECT dataset_id, count(*) AS training_rows, 1.0 AS gain, any_value(o) AS "offset", {_TRAINING} FROM (SELECT *, 1.0 AS k, avg(r - m) OVER (PARTITION BY dataset_id) AS o FROM s WHERE NOT held) GROUP BY 1',
    'gain "offset" training_rmse training_mae training_bias training_r2',
    "dataset_id training_rows",
)
def _(spark, d):
    return calibration.fit(calibration.split_sequential(generic(spark, d), KEY), KEY, "offset")


def _evaluation_sql() -> str:
    aggs = []
    for name, e in (("before", "(m - r)"), ("after", "(c - r)")):
        aggs.append(
            f"sqrt(avg({e} ** 2)) AS rmse_{name}, avg(abs({e})) AS mae_{name}, avg({e}) AS bias_{name}, max(abs({e})) AS max_abs_{name}, stddev_pop({e}) AS error_std_{name}, CASE WHEN sum((r - rm) ** 2) > 1e-15 THEN 1 - sum({e} ** 2) / sum((r - rm) ** 2) END AS r2_{name}"
        )
    gains = ", ".join(f"CASE WHEN abs({c}_before) > 1e-15 THEN 100 * (abs({c}_before) - abs({c}_after)) / abs({c}_before) END AS {c}_improvement_percent" for c in ("rmse", "mae", "bias", "max_abs"))
    return f"""{_SPLIT}, h AS (SELECT s.dataset_id, m, r, gain * m + "offset" AS c, avg(r) OVER (PARTITION BY s.dataset_id) AS rm FROM s JOIN f USING (dataset_id) WHERE held),
g AS (SELECT dataset_id, count(*) AS validation_rows, {", ".join(aggs)} FROM h GROUP BY 1) SELECT *, {gains}, r2_after - r2_before AS r2_change FROM g"""


@tool(
    "calibration_evaluation",
    _evaluation_sql(),
    " ".join(f"{c}_{w}" for w in ("before", "after") for c in ("rmse", "mae", "bias", "max_abs", "error_std", "r2")) + " rmse_improvement_percent mae_improvement_percent bias_improvement_percent max_abs_improvement_percent r2_change",
    "dataset_id validation_rows",
)
def _(spark, d):
    split = calibration.split_sequential(generic(spark, d), KEY)
    return calibration.evaluate(split, KEY, calibration.fit(split, KEY))


@tool("calibration_grouped_split")
def _(spark, d):
    split = calibration.split_grouped(generic(spark, d).where("sensor_id IS NOT NULL"), ["sensor_id"], "dataset_id")
    return calibration.split_shares(split, ["sensor_id"])


@tool(
    "calibration_random_split",
    f"""WITH n AS (SELECT dataset_id, count(*) AS n FROM ({PAIRS}) GROUP BY 1 HAVING count(*) >= 4),
v AS (SELECT dataset_id, n, greatest(1, least(n - 3, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS validation_rows FROM n)
SELECT dataset_id, n - validation_rows AS training_rows, validation_rows, validation_rows / n AS validation_share, abs(validation_rows / n - 0.2) > 0.1 AS deviates FROM v""",
    "validation_share",
    "dataset_id training_rows validation_rows deviates",
)
def _(spark, d):
    return calibration.split_shares(calibration.split_random(generic(spark, d), KEY), KEY)


@tool("calibration_random_evaluation")
def _(spark, d):
    split = calibration.split_random(generic(spark, d), KEY)
    return calibration.evaluate(split, KEY, calibration.fit(split, KEY))


@tool(
    "csv_import",
    """SELECT dataset_id, count(*) AS rows_read, count(*) FILTER (isfinite(measurement)) AS measured, min(measurement) FILTER (isfinite(measurement)) AS least, max(measurement) FILTER (isfinite(measurement)) AS greatest,
    sum(abs(temperature)) FILTER (isfinite(temperature)) AS warmth, max(row_ord) - min(row_ord) AS span FROM generic_samples WHERE dataset_id IS NOT NULL GROUP BY 1""",
    "least greatest warmth",
    "dataset_id rows_read measured span",
)
def _(spark, d):
    """The samples written as delimited text in two layouts, found, read, mapped and measured again."""
    samples = generic(spark, d).where("dataset_id IS NOT NULL")
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    whole = samples.select(F.col("dataset_id").alias("recording"), F.col("row_ord").alias("place"), F.col("timestamp").alias("Time"), F.col("measurement").alias("Sensor Value"), F.col("temperature").alias("Temp °C"))
    whole.where("recording % 2 = 0").write.option("header", True).csv(f"{folder}/a")
    other = whole.select("Temp °C", "place", "Sensor Value", "recording", "Time").where("recording % 2 <> 0")
    other.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{folder}/b")
    text = csv_files.read_csv(spark, folder)
    mapping = vocabulary.infer(text.columns, {"temperature": "Temp °C"})
    if problems := vocabulary.validate(mapping, text.columns, vocabulary.REQUIRED["generic"]):
        raise ValueError(problems)
    df = csv_files.numbers(vocabulary.apply(text, mapping), ["recording", "place", "timestamp", "measurement", "temperature"])
    ok = lambda c: F.when(finite(c), F.col(c))
    return df.groupBy(F.col("recording").cast("bigint").alias("dataset_id")).agg(
        F.count("*").alias("rows_read"), F.count(ok("measurement")).alias("measured"), F.min(ok("measurement")).alias("least"), F.max(ok("measurement")).alias("greatest"), F.sum(F.abs(ok("temperature"))).alias("warmth"), (F.max("place") - F.min("place")).cast("bigint").alias("span")
    )
