"""Characterisation of a sensor against a reference, per recording or any other key.

Every tool takes a DataFrame with ``measurement`` and ``reference`` (and what it names besides) and the grouping keys,
and gives one row per group.  Groups that do not meet the tool's minimum sample counts give no row.  Only rows on which
all values a tool needs are finite take part.

Pass structure: single-pass tools are one aggregation; tools that need a mean or a fit first write that small table once
and attach it to the rows (:func:`plumbline.joins.attach`: broadcast within a checked bound, salted otherwise).  Medians
and other percentiles are exact at any size of a group (:mod:`plumbline.operators.order_statistics`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from plumbline.columns import finite, is_close
from plumbline.joins import Written, attach, written
from plumbline.operators.order_statistics import summary
from plumbline.operators.ordered import with_previous, with_running_sum

NEAR_ZERO = 1e-15
#: 0.75 quantile of the normal distribution: scales a MAD to a z score.
NORMAL_QUARTILE = 0.6744897501960817
MAD_TO_SIGMA = 1.4826


def pairs(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Rows with finite measurement and reference, as m, r and error e."""
    m, r = F.col("measurement").cast("double"), F.col("reference").cast("double")
    return df.where(finite("measurement") & finite("reference")).select(*keys, *more, m.alias("m"), r.alias("r"), (m - r).alias("e"))


def one_minus(a: Column, b: Column) -> Column:
    return F.when(b > NEAR_ZERO, 1 - a / b)


def accuracy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bias, absolute, squared and percentage errors."""
    e, r = F.col("e"), F.col("r")
    pct = F.when(r != 0, e / F.abs(r) * 100)
    rows = pairs(df, keys)
    aggs = [
        F.count("*").alias("sample_count"),
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mean_absolute_error"),
        F.sqrt(F.avg(e * e)).alias("root_mean_squared_error"),
        F.max(F.abs(e)).alias("maximum_absolute_error"),
        F.avg(pct).alias("mean_percentage_error"),
        F.avg(F.abs(pct)).alias("mean_absolute_percentage_error"),
        F.max(F.abs(pct)).alias("maximum_absolute_percentage_error"),
    ]
    return summary(rows, keys, aggs, {"q": F.abs(e)}).withColumn("median_absolute_error", F.col("q")[0]).drop("q")


def linearity(df: DataFrame, keys: Sequence[str], min_samples: int = 5, min_levels: int = 3) -> DataFrame:
    """Least-squares line of measurement on reference and the deviations from it."""
    rows = pairs(df, keys)
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.countDistinct("r").alias("unique_reference_count"),
        (F.max("r") - F.min("r")).alias("reference_span"),
        F.regr_slope("m", "r").alias("slope"),
        F.regr_intercept("m", "r").alias("intercept"),
        F.avg("m").alias("m_mean"),
    )
    fit = written(fit.where((F.col("sample_count") >= min_samples) & (F.col("unique_reference_count") >= min_levels) & F.col("slope").isNotNull()))
    res = F.col("m") - (F.col("slope") * F.col("r") + F.col("intercept"))
    res_rows = attach(rows, fit, list(keys), "inner").withColumn("res", res)
    aggs = [
        F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("residual_rmse"),
        F.coalesce(F.stddev_samp("res"), F.lit(0.0)).alias("residual_standard_deviation"),
        F.max(F.abs("res")).alias("maximum_absolute_deviation"),
        one_minus(F.sum(F.col("res") * F.col("res")), F.sum((F.col("m") - F.col("m_mean")) * (F.col("m") - F.col("m_mean")))).alias("r_squared"),
    ]
    dev = summary(res_rows, keys, aggs, {"q": F.abs("res")}, source=rows)
    span = F.abs("slope") * F.col("reference_span")
    out = fit.df.drop("m_mean").join(dev, list(keys)).withColumns({"fitted_output_span": span, "median_absolute_deviation": F.col("q")[0]}).drop("q")
    return out.withColumn("maximum_deviation_percent_full_scale", F.when(~is_close(F.col("fitted_output_span"), 0.0), 100 * F.col("maximum_absolute_deviation") / F.col("fitted_output_span")))


def precision(df: DataFrame, keys: Sequence[str], min_samples: int = 5) -> DataFrame:
    """Spread of the error: standard, robust, interquartile, and the 95th percentile of the demeaned error."""
    rows = pairs(df, keys).select(*keys, "e")
    aggs = [F.count("*").alias("sample_count"), F.avg("e").alias("e_mean"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("standard_deviation")]
    center = written(summary(rows, keys, aggs, {"q": F.col("e")}, (0.25, 0.5, 0.75)).where(F.col("sample_count") >= min_samples))
    near = attach(rows, center, list(keys), "inner")
    off = summary(near, keys, [], {"mad": F.abs(F.col("e") - F.col("q")[1]), "far": F.abs(F.col("e") - F.col("e_mean"))}, (0.5, 0.95), source=rows)
    return center.df.join(off, list(keys)).select(
        *keys,
        "sample_count",
        "standard_deviation",
        (F.lit(MAD_TO_SIGMA) * F.col("mad")[0]).alias("robust_sigma"),
        (F.col("q")[2] - F.col("q")[0]).alias("interquartile_range"),
        F.col("far")[1].alias("p95_absolute_demeaned_error"),
    )


#: Values of a block in multiples of the tolerance.
_WIDTH = 4_096.0


def _chains(levels: DataFrame, keys: Sequence[str], level: str, tolerance: float) -> DataFrame:
    """``levels`` (sorted by value within a group) with ``_chain``: a new number after every gap wider than ``tolerance``.

    No cluster and no match crosses such a gap.  Values are looked at in blocks, never a group as a whole.
    """
    width = tolerance * _WIDTH
    before = with_previous(levels, keys, level, [level], block_rows=width)
    gap = F.coalesce(F.col(level) - F.col(f"prev_{level}") > tolerance, F.lit(True))
    return with_running_sum(before.withColumn("_gap", gap).drop(f"prev_{level}"), keys, level, {"_chain": F.when(F.col("_gap"), 1).otherwise(0).cast("bigint")}, block_rows=width).drop("_gap")


def _along_chains(df: DataFrame, keys: Sequence[str], level: str, walk: Callable[[], tuple[Callable, Callable]], columns: Sequence[str], schema: str) -> DataFrame:
    """Rows of each chain, in order of ``level``, handed one by one to a walker with little state; its results as a table.

    ``walk()`` gives ``(step, end)`` for a new chain: ``step(head, values)`` and ``end()`` return finished result rows.
    """
    head = [*keys, "_chain"]
    target = to_arrow_schema(_parse_datatype_string(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, step, end = None, None, None
        for b in batches:
            done: list[tuple] = []
            names = list(zip(*[b.column(k).to_pylist() for k in head], strict=True))
            values = list(zip(*[b.column(c).to_pylist() for c in columns], strict=True))
            for name, value in zip(names, values, strict=True):
                if name != here:
                    if end is not None:
                        done += [(*here, *r) for r in end()]
                    here, (step, end) = name, walk()
                done += [(*here, *r) for r in step(*value)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), target, strict=True)], schema=target)
        if end is not None and (rest := [(*here, *r) for r in end()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), target, strict=True)], schema=target)

    return df.repartition(*head).sortWithinPartitions(*head, level).mapInArrow(stream, schema)


def _head(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _chain bigint"


def cluster_levels(rows: DataFrame, keys: Sequence[str], level: str, tolerance: float) -> DataFrame:
    """``rows`` with ``level`` replaced by the mean of its cluster.

    Distinct levels are walked in ascending order; a level joins the running cluster while it lies within ``tolerance``
    of the mean of the rows already in it.
    """
    if tolerance <= 0:
        return rows
    keys = list(keys)
    counts = _chains(rows.groupBy(*keys, level).agg(F.count("*").alias("_n")), keys, level, tolerance)

    def walk() -> tuple[Callable, Callable]:
        state = [0.0, 0, -1]  # sum and number of the cluster's rows, its number

        def step(x: float, n: int) -> list[tuple]:
            if not state[1] or abs(x - state[0] / state[1]) > tolerance:
                state[:] = [0.0, 0, state[2] + 1]
            state[0] += x * n
            state[1] += n
            return [(x, n, state[2])]

        return step, list

    flat = _along_chains(counts, keys, level, walk, [level, "_n"], f"{_head(rows, keys)}, `{level}` double, _n bigint, _id bigint")
    means = flat.groupBy(*keys, "_chain", "_id").agg((F.sum(F.col(level) * F.col("_n")) / F.sum("_n")).alias("_mean"))
    flat = flat.join(means, [*keys, "_chain", "_id"]).select(*keys, level, "_mean")
    return rows.join(flat, [*keys, level]).drop(level).withColumnRenamed("_mean", level)


def level_table(df: DataFrame, keys: Sequence[str], *more: str, tolerance: float = 0.0) -> DataFrame:
    """Count, mean, spread and range of the measurement at each reference level."""
    rows = cluster_levels(pairs(df, keys, *more), keys, "r", tolerance)
    return rows.groupBy(*keys, *more, "r").agg(
        F.count("*").alias("n"), F.avg("m").alias("level_mean"), F.var_samp("m").alias("level_variance"), (F.max("m") - F.min("m")).alias("level_range")
    )


def repeatability(df: DataFrame, keys: Sequence[str], min_samples: int = 6, min_repeats: int = 3, min_levels: int = 2, tolerance: float = 0.0) -> DataFrame:
    """Spread of repeated measurements at equal reference levels."""
    n, var = F.col("n"), F.col("level_variance")
    levels = level_table(df, keys, tolerance=tolerance)
    total = levels.groupBy(*keys).agg(F.sum("n").alias("_all"))
    out = levels.where(n >= min_repeats).groupBy(*keys).agg(
        F.count("*").alias("level_count"),
        F.sum("n").alias("sample_count"),
        F.avg(n.cast("double")).alias("average_repeats_per_level"),
        F.sqrt(F.sum((n - 1) * var) / F.sum(n - 1)).alias("pooled_standard_deviation"),
        F.avg(F.sqrt(var)).alias("mean_within_level_standard_deviation"),
        F.max(F.sqrt(var)).alias("maximum_within_level_standard_deviation"),
        F.avg("level_range").alias("mean_within_level_range"),
        F.max("level_range").alias("maximum_within_level_range"),
    )
    return out.join(total, list(keys)).where((F.col("_all") >= min_samples) & (F.col("level_count") >= min_levels)).drop("_all")


def sensitivity(df: DataFrame, keys: Sequence[str], min_samples: int = 5, min_levels: int = 3, tolerance: float = 0.0) -> DataFrame:
    """Slopes between adjacent reference levels and between the first and the last."""
    levels = level_table(df, keys, tolerance=tolerance)
    w = Window.partitionBy(*keys).orderBy("r")
    local = F.try_divide(F.col("level_mean") - F.lag("level_mean").over(w), F.col("r") - F.lag("r").over(w))
    steps = levels.select(*keys, "r", "n", "level_mean", local.alias("local"))
    out = steps.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"),
        F.count("*").alias("level_count"),
        F.count("local").alias("interval_count"),
        F.try_divide(F.max_by("level_mean", "r") - F.min_by("level_mean", "r"), F.max("r") - F.min("r")).alias("global_sensitivity"),
        F.avg("local").alias("mean_local_sensitivity"),
        F.coalesce(F.stddev_samp("local"), F.lit(0.0)).alias("local_sensitivity_standard_deviation"),
        F.min("local").alias("minimum_local_sensitivity"),
        F.max("local").alias("maximum_local_sensitivity"),
    )
    cv = F.when(~is_close(F.col("mean_local_sensitivity"), 0.0), 100 * F.col("local_sensitivity_standard_deviation") / F.abs("mean_local_sensitivity"))
    return out.where((F.col("sample_count") >= min_samples) & (F.col("level_count") >= min_levels)).withColumn("local_sensitivity_cv", cv)


def drift(df: DataFrame, keys: Sequence[str], min_samples: int = 10, min_duration: float = 1.0, order: str = "row_ord") -> DataFrame:
    """Linear trend of the error over time and the change from the first to the last sample; one pass.

    Time counts from the first sample: slope and R2 do not depend on that, the intercept is moved there afterwards.
    """
    rows = pairs(df.where(finite("timestamp")).withColumn("_t", F.col("timestamp").cast("double")), keys, "_t", order)
    first, last = F.min_by("e", F.struct("_t", order)), F.max_by("e", F.struct("_t", order))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        (F.max("_t") - F.min("_t")).alias("duration"),
        F.regr_slope("e", "_t").alias("drift_rate"),
        (F.avg("e") - F.regr_slope("e", "_t") * (F.avg("_t") - F.min("_t"))).alias("fit_intercept"),
        F.when(F.regr_syy("e", "_t") > NEAR_ZERO, F.regr_r2("e", "_t")).alias("fit_r_squared"),
        (last - first).alias("endpoint_error_change"),
    )
    out = out.where((F.col("sample_count") >= min_samples) & (F.col("duration") >= min_duration) & F.col("drift_rate").isNotNull())
    return out.withColumn("predicted_drift", F.col("drift_rate") * F.col("duration"))


def signal_to_noise(df: DataFrame, keys: Sequence[str], min_samples: int = 10) -> DataFrame:
    """Power of the reference over power of the error."""
    out = pairs(df, keys).groupBy(*keys).agg(F.count("*").alias("sample_count"), F.var_pop("r").alias("signal_power"), F.var_pop("e").alias("noise_power"))
    out = out.where((F.col("sample_count") >= min_samples) & (F.col("signal_power") > NEAR_ZERO))
    snr = F.when(F.col("noise_power") > 1e-30, 10 * F.log10(F.col("signal_power") / F.col("noise_power")))
    return out.withColumns({"signal_rms": F.sqrt("signal_power"), "noise_rms": F.sqrt("noise_power"), "snr_db": snr})


ENVIRONMENT = ("temperature", "humidity", "supply_voltage")


def environmental_stability(df: DataFrame, keys: Sequence[str], fields: Sequence[str] = ENVIRONMENT, min_samples: int = 10, min_span: float = 0.0) -> DataFrame:
    """Association of the error with each environmental field: one row per group and field."""
    rows = pairs(df, keys, *fields)
    long = rows.select(*keys, "e", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("v"))
    long = long.select(*keys, "e", F.col("v.field").alias("field"), F.col("v.x").alias("x")).where(finite("x"))
    out = long.groupBy(*keys, "field").agg(
        F.count("*").alias("sample_count"),
        F.regr_slope("e", "x").alias("error_coefficient"),
        F.when((F.regr_syy("e", "x") > NEAR_ZERO) & (F.regr_sxx("e", "x") > NEAR_ZERO), F.regr_r2("e", "x")).alias("r_squared"),
        (F.max("x") - F.min("x")).alias("span"),
    )
    out = out.where((F.col("sample_count") >= min_samples) & (F.col("span") > min_span) & F.col("error_coefficient").isNotNull())
    return out.withColumn("predicted_error_change", F.col("error_coefficient") * F.col("span"))


def _centers(rows: DataFrame, keys: Sequence[str]) -> Written:
    """keys, e_median, e_mad: a small table, written once."""
    mid = written(summary(rows, keys, [], {"q": F.col("e")}).select(*keys, F.col("q")[0].alias("e_median")))
    near = attach(rows, mid, list(keys), "inner")
    mad = summary(near, keys, [F.first("e_median").alias("e_median")], {"q": F.abs(F.col("e") - F.col("e_median"))}, source=rows)
    return written(mad.select(*keys, "e_median", F.col("q")[0].alias("e_mad")))


def outlier_rows(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Rows with the modified z score of their error; infinite off the median where the MAD is 0."""
    rows = pairs(df, keys, *more)
    rows = attach(rows, _centers(rows, keys), list(keys), "inner")
    off = F.col("e") - F.col("e_median")
    flat = F.when(is_close(off, 0.0), F.lit(0.0)).otherwise(F.lit(float("inf")))
    z = F.when(F.col("e_mad") <= NEAR_ZERO, flat).otherwise(F.lit(NORMAL_QUARTILE) * off / F.col("e_mad"))
    return rows.withColumn("z", z)


def outliers(df: DataFrame, keys: Sequence[str], min_samples: int = 10, threshold: float = 3.5) -> DataFrame:
    """Share of errors with a modified z score beyond ``threshold``."""
    hit = F.abs("z") > threshold
    out = outlier_rows(df, keys).groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.count(F.when(hit, 1)).alias("outlier_count"),
        F.first("e_median").alias("median_error"),
        F.first("e_mad").alias("error_mad"),
        F.max(F.abs("z")).alias("maximum_absolute_z"),
    )
    return out.where(F.col("sample_count") >= min_samples).withColumn("outlier_percent", 100 * F.col("outlier_count") / F.col("sample_count"))


def hysteresis(df: DataFrame, keys: Sequence[str], min_overlap: int = 3, tolerance: float = 0.0, order: str = "row_ord") -> DataFrame:
    """Difference between up and down sweeps at matched reference levels.

    Needs exactly two sweep labels in a group; the sign is that of the label seen first.  With ``tolerance`` levels are
    matched greedily, nearest first, in ascending order of the first sweep, each level of the second at most once.
    """
    label = F.trim("sweep_direction")
    rows = df.where(label.isNotNull() & (label != "")).withColumn("sweep_direction", label)
    levels = level_table(rows, keys, "sweep_direction", tolerance=tolerance)
    seen = pairs(rows, keys, "sweep_direction", order).groupBy(*keys, "sweep_direction").agg(F.min(order).alias("first_row"))
    both = seen.groupBy(*keys).agg(F.count("*").alias("labels"), F.min_by("sweep_direction", "first_row").alias("first_label")).where("labels = 2")
    levels = levels.join(both.select(*keys, "first_label"), list(keys))
    one = levels.where("sweep_direction = first_label").select(*keys, F.col("r").alias("r"), F.col("level_mean").alias("first_mean"))
    two = levels.where("sweep_direction <> first_label").select(*keys, F.col("r").alias("r2"), F.col("level_mean").alias("second_mean"))
    if tolerance <= 0:
        matched = one.join(two.withColumnRenamed("r2", "r"), [*keys, "r"])
    else:
        matched = _greedy_match(one, two, keys, tolerance)
    d = F.col("first_mean") - F.col("second_mean")
    out = matched.groupBy(*keys).agg(
        F.count("*").alias("matched_level_count"),
        F.max(F.abs(d)).alias("maximum_absolute_hysteresis"),
        F.avg(F.abs(d)).alias("mean_absolute_hysteresis"),
        F.sqrt(F.avg(d * d)).alias("hysteresis_rms"),
        (F.max("r") - F.min("r")).alias("matched_reference_span"),
    )
    return out.where(F.col("matched_level_count") >= min_overlap)


def _greedy_match(one: DataFrame, two: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Nearest free level of the second sweep for each level of the first, in ascending order of the first."""
    keys = list(keys)
    none = F.lit(None).cast("double")
    a, b = F.col("first_mean"), F.col("second_mean")
    both = one.select(*keys, "r", a.alias("first_mean"), none.alias("second_mean")).unionByName(two.select(*keys, F.col("r2").alias("r"), none.alias("first_mean"), b.alias("second_mean")))
    # A level of both sweeps is one entry, so that values are unique within a group.
    both = both.groupBy(*keys, "r").agg(F.max("first_mean").alias("first_mean"), F.max("second_mean").alias("second_mean"))

    def walk() -> tuple[Callable, Callable]:
        waiting: deque = deque()  # levels of the first sweep whose neighbourhood is not complete yet
        free: deque = deque()  # free levels of the second sweep within reach

        def settle() -> list[tuple]:
            x, mean = waiting.popleft()
            while free and free[0][0] < x - tolerance:
                free.popleft()
            near = [(abs(y - x), y, i) for i, (y, _) in enumerate(free) if abs(y - x) <= tolerance]
            if not near:
                return []
            at = min(near)[2]
            other = free[at][1]
            del free[at]
            return [(x, mean, other)]

        def step(v: float, first: float | None, second: float | None) -> list[tuple]:
            done = []
            while waiting and waiting[0][0] + tolerance < v:
                done += settle()
            if first is not None:
                waiting.append((v, first))
            if second is not None:
                free.append((v, second))
            return done

        def end() -> list[tuple]:
            done = []
            while waiting:
                done += settle()
            return done

        return step, end

    chains = _chains(both, keys, "r", tolerance)
    out = _along_chains(chains, keys, "r", walk, ["r", "first_mean", "second_mean"], f"{_head(one, keys)}, r double, first_mean double, second_mean double")
    return out.drop("_chain")


def revision_comparison(df: DataFrame, keys: Sequence[str], min_samples: int = 5) -> DataFrame:
    """Error metrics of each hardware revision, in groups with at least two usable revisions."""
    rows = pairs(df.where(F.col("revision").isNotNull()), keys, "revision")
    e = F.col("e")
    out = rows.groupBy(*keys, "revision").agg(
        F.count("*").alias("sample_count"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.sqrt(F.avg(e * e)).alias("root_mean_squared_error"), F.max(F.abs(e)).alias("maximum_absolute_error")
    )
    out = out.where(F.col("sample_count") >= min_samples)
    return out.join(out.groupBy(*keys).count().where("count >= 2").select(*keys), list(keys), "left_semi") if keys else out
