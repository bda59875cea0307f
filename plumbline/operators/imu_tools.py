"""Characterisation of inertial sensors, per recording or any other key.

Tables have ax, ay, az, gx, gy, gz in one unit per group of axes, ``timestamp`` in seconds, and an integer ``order``
column (file position) where a tool depends on the order of rows.  One row per group comes out (or per group and axis,
field or orientation where a tool says so); groups below the minimum sample counts give none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import finite, if_finite, safe_corr
from plumbline.functions.orientation import ORIENTATIONS, gravity_component, orientation
from plumbline.joins import Written, attach, written
from plumbline.operators.order_statistics import summary
from plumbline.operators.ordered import longest_run, with_previous, with_previous_value
from plumbline.operators.unit_graph import STANDARD_GRAVITY

ACCEL, GYRO = ("ax", "ay", "az"), ("gx", "gy", "gz")
AXES = (*ACCEL, *GYRO)
MAD_TO_SIGMA = 1.4826


def unpivot(df: DataFrame, keep: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """keep, axis, x: the finite values of each axis."""
    long = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), if_finite(a).alias("x")) for a in axes])).alias("v"))
    return long.select(*keep, F.col("v.axis").alias("axis"), F.col("v.x").alias("x")).where(F.col("x").isNotNull())


def norm(*c: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in c]))


def sampling_integrity(df: DataFrame, keys: Sequence[str], order: str = "row_ord", gap_multiplier: float = 5.0, nominal: DataFrame | None = None) -> DataFrame:
    """Sampling intervals in file order: rate, jitter, repeats, backward steps, gaps, estimated missing samples.

    ``nominal`` (keys, nominal_rate) adds the error of the measured rate.
    """
    rows = df.where(finite("timestamp")).select(*keys, order, F.col("timestamp").cast("double").alias("t"))
    steps = with_previous(rows, keys, order, ["t"]).withColumn("dt", F.col("t") - F.col("prev_t"))
    dt = F.col("dt")
    plus = F.when(dt > 0, dt)
    aggs = [
        F.count("*").alias("timestamp_count"),
        (F.max_by("t", order) - F.min_by("t", order)).alias("duration"),
        F.count(F.when(dt == 0, 1)).alias("duplicate_count"),
        F.count(F.when(dt < 0, 1)).alias("backward_count"),
        F.avg(plus).alias("mean_interval"),
        F.stddev_pop(plus).alias("interval_standard_deviation"),
        F.min(plus).alias("minimum_interval"),
        F.max(plus).alias("maximum_interval"),
    ]
    base = summary(steps, keys, aggs, {"q": plus}, source=rows).withColumn("median_interval", F.col("q")[0]).drop("q")
    base = written(base.where(F.col("median_interval").isNotNull()))
    second = attach(steps.where(dt > 0).select(*keys, "dt"), Written(base.df.select(*keys, "median_interval"), base.bytes), list(keys), "inner")
    off = F.col("dt") - F.col("median_interval")
    gap = F.col("dt") > gap_multiplier * F.col("median_interval")
    missing = F.greatest(F.rint(F.col("dt") / F.col("median_interval")), F.lit(1.0)) - 1
    more = second.groupBy(*keys).agg(
        F.sqrt(F.avg(off * off)).alias("rms_jitter"),
        F.avg(F.abs(off)).alias("mean_absolute_jitter"),
        F.max(F.abs(off)).alias("maximum_absolute_jitter"),
        F.count(F.when(gap, 1)).alias("large_gap_count"),
        F.max(F.when(gap, F.col("dt"))).alias("largest_gap"),
        F.sum(missing).cast("bigint").alias("estimated_missing"),
    )
    out = base.df.join(more, list(keys))
    out = out.withColumns(
        {
            "sampling_rate": 1 / F.col("median_interval"),
            "coefficient_of_variation": F.col("interval_standard_deviation") / F.col("mean_interval"),
            "capture_percent": 100 * F.col("timestamp_count") / (F.col("timestamp_count") + F.col("estimated_missing")),
        }
    )
    if nominal is not None:
        out = out.join(nominal.select(*keys, "nominal_rate"), list(keys), "left")
        out = out.withColumn("rate_error_percent", F.when(F.col("nominal_rate") > 0, 100 * (F.col("sampling_rate") - F.col("nominal_rate")) / F.col("nominal_rate")))
    return out


def _axis_stats(axes: Sequence[str]) -> list[Column]:
    out = []
    for a in axes:
        x = if_finite(a)
        out += [
            F.count(x).alias(f"{a}_count"),
            F.avg(x).alias(f"{a}_mean"),
            F.stddev_samp(x).alias(f"{a}_std"),
            F.sqrt(F.avg(x * x)).alias(f"{a}_rms"),
            (F.max(x) - F.min(x)).alias(f"{a}_peak_to_peak"),
        ]
    return out


def _statistics(df: DataFrame, keys: Sequence[str], axes: Sequence[str], *more: Column) -> DataFrame:
    out = summary(df, keys, [*_axis_stats(axes), *more], {f"{a}_median": if_finite(a) for a in axes})
    return out.withColumns({f"{a}_median": F.col(f"{a}_median")[0] for a in axes})


def _spread(axes: Sequence[str]) -> dict[str, Column]:
    stds = [F.col(f"{a}_std") for a in axes]
    return {
        "mean_axis_std": reduce(lambda a, b: a + b, stds) / len(stds),
        "maximum_axis_std": F.greatest(*stds),
        "noise_spread_ratio": F.when(F.least(*stds) > 0, F.greatest(*stds) / F.least(*stds)).when(F.greatest(*stds) == 0, F.lit(1.0)),
    }


def gyro_bias(df: DataFrame, keys: Sequence[str], min_samples: int = 100) -> DataFrame:
    """Zero-rate output of each gyroscope axis and of the vector."""
    out = _statistics(df, keys, GYRO).where(F.least(*[F.col(f"{a}_count") for a in GYRO]) >= min_samples)
    return out.withColumns({"bias_vector_magnitude": norm(*[F.col(f"{a}_mean") for a in GYRO]), **_spread(GYRO)})


def accelerometer_bias(df: DataFrame, keys: Sequence[str], min_samples: int = 100, gravity: float = STANDARD_GRAVITY) -> DataFrame:
    """Mean output of each axis against gravity; bias where a group has exactly one, recognised orientation."""
    label = F.trim("orientation_label")
    # One label or more: its least and greatest spelling tell, without a set of labels.
    out = _statistics(df, keys, ACCEL, F.min(label).alias("least_label"), F.max(label).alias("label"))
    out = out.where(F.least(*[F.col(f"{a}_count") for a in ACCEL]) >= min_samples)
    size = norm(*[F.col(f"{a}_mean") for a in ACCEL])
    pose = F.when(F.col("least_label") == F.col("label"), orientation("label"))
    out = out.withColumns({"orientation": pose, "mean_vector_magnitude": size, **_spread(ACCEL)})
    bias = {f"{a}_bias": F.col(f"{a}_mean") - gravity_component(F.col("orientation"), a[1].upper(), gravity) for a in ACCEL}
    out = out.withColumns({"gravity_magnitude_error": F.col("mean_vector_magnitude") - gravity, **bias})
    return out.withColumns(
        {"gravity_magnitude_error_percent": 100 * F.col("gravity_magnitude_error") / gravity, "bias_vector_magnitude": norm(*[F.col(f"{a}_bias") for a in ACCEL])}
    ).drop("least_label", "label")


def stationary_noise(df: DataFrame, keys: Sequence[str], order: str = "row_ord", min_samples: int = 500, axes: Sequence[str] = AXES) -> DataFrame:
    """Noise of each axis (one row per group and axis): standard, robust, percentile and successive-difference estimates.

    Differences are between an axis' finite values that follow one another; a value that is not finite is passed over.
    """
    keys, axes = list(keys), list(axes)
    wide = df.select(*keys, order, *[if_finite(a).alias(a) for a in axes])
    rows = with_previous_value(wide, keys, order, axes)
    aggs = []
    for a in axes:
        d = F.col(a) - F.col(f"prev_{a}")
        aggs.append(
            F.struct(
                F.lit(a).alias("axis"), F.count(a).alias("sample_count"), F.stddev_samp(a).alias("standard_deviation"), F.var_samp(a).alias("variance"), F.stddev_pop(a).alias("rms"), F.count(d).alias("differences"), F.stddev_samp(d).alias("d_std")
            ).alias(f"s_{a}")
        )
    base = written(summary(rows, keys, aggs, {f"q_{a}": F.col(a) for a in axes}, (0.05, 0.5, 0.95), source=wide))
    near = attach(wide, Written(base.df.select(*keys, *[f"q_{a}" for a in axes]), base.bytes), keys, "inner")
    every = base.df.join(summary(near, keys, [], {f"m_{a}": F.abs(F.col(a) - F.col(f"q_{a}")[1]) for a in axes}, source=wide), keys)
    long = every.select(*keys, F.explode(F.array(*[F.struct(F.col(f"s_{a}").alias("s"), F.col(f"q_{a}").alias("q"), F.col(f"m_{a}")[0].alias("mad")) for a in axes])).alias("v"))
    out = long.select(*keys, "v.s.*", "v.q", "v.mad").where(F.col("sample_count") >= min_samples)
    return out.select(
        *keys,
        "axis",
        "sample_count",
        "standard_deviation",
        "variance",
        "rms",
        "mad",
        (F.lit(MAD_TO_SIGMA) * F.col("mad")).alias("robust_sigma"),
        (F.col("q")[2] - F.col("q")[0]).alias("span_5_95"),
        F.when(F.col("differences") >= 2, F.col("d_std") / F.sqrt(F.lit(2.0))).alias("difference_noise"),
        F.when(F.col("mad") > 0, F.col("standard_deviation") / (F.lit(MAD_TO_SIGMA) * F.col("mad"))).alias("standard_to_robust_ratio"),
    )


def _three(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [finite(a) for a in axes]))


def gravity_error(df: DataFrame, keys: Sequence[str], min_samples: int = 100, gravity: float = STANDARD_GRAVITY) -> DataFrame:
    """Length of the acceleration vector of each sample against gravity."""
    size = norm(*[F.col(a).cast("double") for a in ACCEL])
    rows = _three(df, ACCEL).select(*keys, size.alias("a")).withColumn("d", F.col("a") - gravity)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.avg("a").alias("mean_magnitude"),
        F.stddev_samp("a").alias("magnitude_standard_deviation"),
        F.avg("d").alias("mean_error"),
        F.avg(F.abs("d")).alias("mean_absolute_error"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("root_mean_squared_error"),
        F.max(F.abs("d")).alias("maximum_absolute_error"),
    ).where(F.col("sample_count") >= min_samples)
    return out.withColumns({f"{c}_percent": 100 * F.col(c) / gravity for c in ("mean_error", "mean_absolute_error", "root_mean_squared_error", "maximum_absolute_error")})


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle between two vectors in degrees, NULL where one has no length."""
    dot = reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b, strict=True)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm(*a) * norm(*b))))))


def gravity_by_orientation(df: DataFrame, keys: Sequence[str], min_samples: int = 50, gravity: float = STANDARD_GRAVITY) -> DataFrame:
    """Mean vector at each orientation label: magnitude error, and vector error and angle where the label is recognised."""
    rows = _three(df, ACCEL).withColumn("label", F.trim("orientation_label")).where("label <> ''")
    out = rows.groupBy(*keys, "label").agg(F.count("*").alias("sample_count"), *[F.avg(F.col(a).cast("double")).alias(a) for a in ACCEL]).where(F.col("sample_count") >= min_samples)
    mean = [F.col(a) for a in ACCEL]
    expected = [gravity_component(F.col("orientation"), a[1].upper(), gravity) for a in ACCEL]
    out = out.withColumn("orientation", orientation("label"))
    return out.select(
        *keys,
        "label",
        "orientation",
        "sample_count",
        norm(*mean).alias("mean_vector_magnitude"),
        (100 * (norm(*mean) - gravity) / gravity).alias("magnitude_error_percent"),
        norm(*[m - e for m, e in zip(mean, expected, strict=True)]).alias("vector_error"),
        angle(mean, expected).alias("angular_deviation"),
    )


PAIRS = ((0, 1), (0, 2), (1, 2))


def axis_correlation(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = ACCEL, order: str = "row_ord", min_samples: int = 500) -> DataFrame:
    """Covariance, correlation and first-difference correlation of the three axes of a group.

    ``strongest`` is the pair with the largest absolute correlation (the first of equals); the dominant share is the
    largest eigenvalue of the covariance matrix over its trace, from the closed form for symmetric 3x3 matrices.
    Groups with a constant axis give no row.
    """
    rows = _three(df, axes).select(*keys, order, *[F.col(a).cast("double").alias(a) for a in axes])
    rows = with_previous(rows, keys, order, list(axes))
    diff = {a: F.col(a) - F.col(f"prev_{a}") for a in axes}
    aggs = [F.count("*").alias("sample_count")]
    for i, j in PAIRS:
        a, b = axes[i], axes[j]
        aggs += [
            F.covar_samp(a, b).alias(f"covariance_{a}_{b}"),
            safe_corr(F.col(a), F.col(b)).alias(f"correlation_{a}_{b}"),
            safe_corr(diff[a], diff[b]).alias(f"difference_correlation_{a}_{b}"),
        ]
    aggs += [F.var_samp(a).alias(f"_v_{a}") for a in axes]
    out = rows.groupBy(*keys).agg(*aggs).where((F.col("sample_count") >= min_samples) & (F.least(*[F.col(f"_v_{a}") for a in axes]) > 0))
    names = [f"{axes[i]}_{axes[j]}" for i, j in PAIRS]
    size = {n: F.abs(f"correlation_{n}") for n in names}
    best = F.greatest(*[F.struct(size[n].alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names)])
    # Eigenvalues q + 2 p cos(phi) of the covariance matrix.
    v = [F.col(f"_v_{a}") for a in axes]
    c01, c02, c12 = (F.col(f"covariance_{n}") for n in names)
    q = (v[0] + v[1] + v[2]) / 3
    p = F.sqrt(((v[0] - q) * (v[0] - q) + (v[1] - q) * (v[1] - q) + (v[2] - q) * (v[2] - q) + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6)
    b = [(x - q) / p for x in v]
    o01, o02, o12 = c01 / p, c02 / p, c12 / p
    det = b[0] * (b[1] * b[2] - o12 * o12) - o01 * (o01 * b[2] - o12 * o02) + o02 * (o01 * o12 - b[1] * o02)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    top = F.when(p > 0, (q + 2 * p * F.cos(phi)) / (3 * q)).otherwise(F.lit(1 / 3))
    return out.withColumns(
        {
            "maximum_absolute_correlation": best["s"],
            "strongest": best["n"],
            "maximum_absolute_difference_correlation": F.greatest(*[F.abs(f"difference_correlation_{n}") for n in names]),
            "dominant_variance_percent": 100 * top,
        }
    ).drop(*[f"_v_{a}" for a in axes])


def temperature_stability(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = AXES, min_samples: int = 500, min_span: float = 2.0) -> DataFrame:
    """Line of each axis on temperature (one row per group and axis)."""
    rows = unpivot(df.where(finite("temperature")).withColumn("_t", F.col("temperature").cast("double")), [*keys, "_t"], axes)
    t = F.col("_t")
    out = rows.groupBy(*keys, "axis").agg(
        F.count("*").alias("sample_count"),
        F.min("_t").alias("temperature_minimum"),
        F.max("_t").alias("temperature_maximum"),
        F.regr_slope("x", "_t").alias("coefficient"),
        safe_corr(F.col("x"), t).alias("correlation"),
        F.regr_syy("x", "_t").alias("_syy"),
        F.regr_sxy("x", "_t").alias("_sxy"),
    )
    out = out.withColumn("temperature_span", F.col("temperature_maximum") - F.col("temperature_minimum"))
    out = out.where((F.col("sample_count") >= min_samples) & (F.col("temperature_span") >= min_span))
    rest = F.greatest(F.col("_syy") - F.col("coefficient") * F.col("_sxy"), F.lit(0.0))
    return out.withColumns(
        {
            "r_squared": F.when(F.col("_syy") > 0, 1 - rest / F.col("_syy")),
            "predicted_change": F.col("coefficient") * F.col("temperature_span"),
            "residual_standard_deviation": F.sqrt(rest / (F.col("sample_count") - 2)),
        }
    ).drop("_syy", "_sxy")


def temperature_bins(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = AXES, bins: int = 10, min_per_bin: int = 20) -> DataFrame:
    """Mean output of each axis in equal-width temperature bins; the last edge belongs to the last bin."""
    rows = unpivot(df.where(finite("temperature")).withColumn("_t", F.col("temperature").cast("double")), [*keys, "_t"], axes)
    by = [*keys, "axis"]
    span = rows.groupBy(*by).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).where("hi > lo")
    rows = attach(rows, span, by, "inner")
    width = (F.col("hi") - F.col("lo")) / bins
    # A bin is the number of inner edges at or below the value.
    inner = [F.when(F.col("_t") >= F.col("lo") + width * k, 1).otherwise(0) for k in range(1, bins)]
    rows = rows.withColumn("bin", reduce(lambda a, b: a + b, inner))
    out = rows.groupBy(*by, "bin").agg(
        F.count("*").alias("sample_count"), F.avg("_t").alias("temperature_mean"), F.avg("x").alias("output_mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("output_standard_deviation")
    )
    return out.where(F.col("sample_count") >= min_per_bin)


def saturation(
    df: DataFrame, keys: Sequence[str], limits: DataFrame, axes: Sequence[str] = AXES, order: str = "row_ord", near_fraction: float = 0.005, exact_fraction: float = 1e-6, min_near: int = 5
) -> DataFrame:
    """Samples at, near and beyond the configured range (one row per group and axis).

    ``limits`` has keys, ``axis``, ``low`` and ``high``.  Runs follow the file order; a sample that is not finite ends a
    run.
    """
    keys, by = list(keys), [*keys, "axis"]
    pick = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    spans = limits.where("high > low AND axis IS NOT NULL").groupBy(*keys).agg(*[pick(a, c).alias(f"{c}_{a}") for a in axes for c in ("low", "high")])
    rows = attach(df.select(*keys, order, *[if_finite(a).alias(a) for a in axes]), spans, keys, "inner")
    aggs, at, near = [], {}, {}
    some = lambda c: F.count(F.when(c, 1))
    for a in axes:
        x, low, high = F.col(a), F.col(f"low_{a}"), F.col(f"high_{a}")
        span = high - low
        exact = span * exact_fraction
        exact_low, exact_high = F.abs(x - low) <= exact, F.abs(x - high) <= exact
        near_low, near_high = x <= low + span * near_fraction, x >= high - span * near_fraction
        at[a], near[a] = exact_low | exact_high, near_low | near_high
        aggs.append(
            F.struct(
                F.lit(a).alias("axis"),
                F.count(F.when(low.isNotNull(), x)).alias("sample_count"),
                F.first(low).alias("configured_minimum"),
                F.first(high).alias("configured_maximum"),
                F.min(x).alias("observed_minimum"),
                F.max(x).alias("observed_maximum"),
                some(exact_low).alias("exact_lower_count"),
                some(exact_high).alias("exact_upper_count"),
                some(near_low).alias("near_lower_count"),
                some(near_high).alias("near_upper_count"),
                some(near[a]).alias("near_count"),
                some(near[a] & ~at[a]).alias("near_not_exact_count"),
                some((x < low - exact) | (x > high + exact)).alias("outside_count"),
            ).alias(f"s_{a}")
        )
    # Wide rows are shuffled once, for the runs; the counts need no order.
    counts = rows.groupBy(*keys).agg(*aggs)
    runs = longest_run(rows, keys, order, {f"exact_{a}": at[a] for a in axes} | {f"near_{a}": near[a] for a in axes})
    every = counts.join(runs, keys, "left")
    parts = [F.struct(F.col(f"s_{a}").alias("s"), *[F.coalesce(f"{w}_{a}", F.lit(0)).alias(f"longest_{w}_run") for w in ("exact", "near")]) for a in axes]
    out = every.select(*keys, F.explode(F.array(*parts)).alias("v")).select(*keys, "v.s.*", "v.longest_exact_run", "v.longest_near_run").where("sample_count > 0")
    n = F.col("sample_count")
    enough = F.col("near_count") >= min_near
    return out.withColumns(
        {
            "range_utilization_percent": 100 * (F.col("observed_maximum") - F.col("observed_minimum")) / (F.col("configured_maximum") - F.col("configured_minimum")),
            "exact_count": F.col("exact_lower_count") + F.col("exact_upper_count"),
            "exact_percent": 100 * (F.col("exact_lower_count") + F.col("exact_upper_count")) / n,
            "near_percent": 100 * F.col("near_count") / n,
            "outside_percent": 100 * F.col("outside_count") / n,
            "upper_near_share_percent": F.when(enough, 100 * F.col("near_upper_count") / F.col("near_count")),
            "lower_near_share_percent": F.when(enough, 100 * F.col("near_lower_count") / F.col("near_count")),
        }
    )


def six_position(df: DataFrame, keys: Sequence[str], min_samples: int = 50, gravity: float = STANDARD_GRAVITY, min_span_fraction: float = 0.5) -> DataFrame:
    """Bias, sensitivity and scale of each axis from the six static orientations, and the fit before and after.

    Groups need all six orientations with ``min_samples`` each and a plausible plus-minus span on every axis.
    """
    rows = _three(df, ACCEL).withColumn("pose", orientation("orientation_label")).where(F.col("pose").isNotNull())
    means = rows.groupBy(*keys, "pose").agg(F.count("*").alias("n"), *[F.avg(F.col(a).cast("double")).alias(a) for a in ACCEL]).where(F.col("n") >= min_samples)
    pick = lambda pose, a: F.max(F.when(F.col("pose") == pose, F.col(a)))
    fit = means.groupBy(*keys).agg(
        F.count("*").alias("orientations"), F.sum("n").alias("sample_count"), *[pick(f"{s}{a[1].upper()}", a).alias(f"_{'p' if s == '+' else 'm'}_{a}") for a in ACCEL for s in "+-"]
    ).where(F.col("orientations") == len(ORIENTATIONS))
    cols = {}
    for a in ACCEL:
        p, m = F.col(f"_p_{a}"), F.col(f"_m_{a}")
        cols |= {f"{a}_bias": (p + m) / 2, f"{a}_sensitivity": (p - m) / 2 / gravity, f"{a}_plus_minus_span": p - m}
    fit = fit.withColumns(cols).drop(*[f"_{s}_{a}" for a in ACCEL for s in "pm"])
    fit = fit.where(reduce(lambda x, y: x & y, [F.abs(f"{a}_plus_minus_span") >= min_span_fraction * 2 * gravity for a in ACCEL]))
    fit = fit.withColumns(
        {f"{a}_sensitivity_error_percent": 100 * (F.col(f"{a}_sensitivity") - 1) for a in ACCEL}
        | {f"{a}_correction_scale": 1 / F.col(f"{a}_sensitivity") for a in ACCEL}
        | {"bias_vector_magnitude": norm(*[F.col(f"{a}_bias") for a in ACCEL])}
    )
    poses = means.join(fit, list(keys))
    expected = [gravity_component(F.col("pose"), a[1].upper(), gravity) for a in ACCEL]
    raw = [F.col(a) for a in ACCEL]
    fixed = [F.col(f"{a}_correction_scale") * (F.col(a) - F.col(f"{a}_bias")) for a in ACCEL]
    checks = {}
    for name, v in (("raw", raw), ("corrected", fixed)):
        error = reduce(lambda x, y: x + y, [(a - e) * (a - e) for a, e in zip(v, expected, strict=True)])
        checks[f"{name}_component_rmse"] = F.sqrt(F.avg(error / 3))
        checks[f"{name}_gravity_magnitude_mae"] = F.avg(F.abs(norm(*v) - gravity))
        checks[f"{name}_mean_angular_deviation"] = F.avg(angle(v, expected))
    quality = poses.groupBy(*keys).agg(*[c.alias(n) for n, c in checks.items()])
    return fit.drop("orientations").join(quality, list(keys))


def missing_orientations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, orientation: those of the six static orientations that no label of a group names."""
    seen = df.groupBy(*keys).agg(F.collect_set(orientation("orientation_label")).alias("seen"))  # at most six entries
    every = F.array(*[F.lit(o) for o in ORIENTATIONS])
    return seen.select(*keys, F.explode(F.array_except(every, "seen")).alias("orientation"))
