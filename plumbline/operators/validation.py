"""Data-quality findings of recordings: one row per recording and issue.

Counts of all columns come from one aggregation; timestamps need the row before (see :mod:`.ordered`); repeated rows
are counted by a hash of all their values first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import finite
from plumbline.joins import Written, attach, written
from plumbline.operators.order_statistics import summary
from plumbline.operators.ordered import with_previous

MIN_ROWS = 10
MISSING_WARNING, MISSING_ERROR = 0.01, 0.20
NON_NUMERIC_ERROR = 0.05
IRREGULAR_CV = 0.05
GAP_MULTIPLIER = 5.0
ISSUE = "struct<issue_id:string,severity:string,column:string,affected_rows:bigint,affected_fraction:double>"


def _missing(c: str, numeric: bool) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) if numeric else x.isNull()


def _issue(test: Column, name: str, severity: Column | str, column: str | None, rows: Column, fraction: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        test,
        F.struct(
            F.lit(name).alias("issue_id"), level.alias("severity"), F.lit(column).cast("string").alias("column"), rows.cast("bigint").alias("affected_rows"), fraction.cast("double").alias("affected_fraction")
        ),
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, duplicate_rows: rows whose ``columns`` equal those of another row of the group, all of them counted."""
    same = df.groupBy(*keys, F.xxhash64(*columns).alias("_h"), *columns).agg(F.count("*").alias("n"))
    return same.where("n > 1").groupBy(*keys).agg(F.sum("n").alias("duplicate_rows"))


def sampling_summary(df: DataFrame, keys: Sequence[str], order: str = "row_ord", gap_multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """The sampling summary of each recording in file order: counts, interval statistics (population deviation), gaps."""
    rows = df.where(finite("timestamp")).select(*keys, order, F.col("timestamp").cast("double").alias("t"))
    steps = with_previous(rows, keys, order, ["t"]).withColumn("dt", F.col("t") - F.col("prev_t"))
    plus = F.when(F.col("dt") > 0, F.col("dt"))
    aggs = [
        F.count("*").alias("sample_count"),
        (F.max_by("t", order) - F.min_by("t", order)).alias("duration_seconds"),
        F.avg(plus).alias("mean_interval_seconds"),
        F.stddev_pop(plus).alias("std_interval_seconds"),
        F.count(F.when(F.col("dt") == 0, 1)).alias("duplicate_timestamp_count"),
        F.count(F.when(F.col("dt") < 0, 1)).alias("backward_timestamp_count"),
    ]
    base = summary(steps, keys, aggs, {"q": plus}, source=rows)
    done = written(base.withColumn("median_interval_seconds", F.col("q")[0]).drop("q"))
    base = done.df
    gap = F.col("dt") > gap_multiplier * F.col("median_interval_seconds")
    gaps = attach(steps.where("dt > 0").select(*keys, "dt"), Written(base.select(*keys, "median_interval_seconds"), done.bytes), list(keys), "inner")
    gaps = gaps.groupBy(*keys).agg(F.count(F.when(gap, 1)).alias("large_gap_count"), F.max(F.when(gap, F.col("dt"))).alias("largest_gap_seconds"))
    out = base.join(gaps, list(keys), "left")
    return out.withColumns(
        {
            "large_gap_count": F.coalesce("large_gap_count", F.lit(0)),
            "estimated_sampling_rate_hz": F.try_divide(F.lit(1.0), F.col("median_interval_seconds")),
            "coefficient_of_variation": F.try_divide(F.col("std_interval_seconds"), F.col("mean_interval_seconds")),
        }
    )


def validate(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], order: str = "row_ord", timestamp: str | None = "timestamp", text: dict[str, Column] | None = None) -> DataFrame:
    """keys, issue_id, severity, column, affected_rows, affected_fraction.

    ``numeric`` columns are numbers; ``text`` maps names of raw text columns to their numeric reading, for the share of
    values that are no numbers.
    """
    other = [c for c in df.columns if c not in (*keys, order, *numeric)]
    every = [*numeric, *other]
    aggs = [F.count("*").alias("n")]
    aggs += [F.count(F.when(_missing(c, c in numeric), 1)).alias(f"miss_{c}") for c in every]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [
            F.count(F.when(F.abs(x) == F.lit(float("inf")), 1)).alias(f"inf_{c}"),
            (F.min(F.when(finite(c), x)) == F.max(F.when(finite(c), x))).alias(f"flat_{c}"),
        ]
    for c, reading in (text or {}).items():
        aggs.append(F.count(F.when(F.col(c).isNotNull() & reading.isNull(), 1)).alias(f"text_{c}"))
    stats = df.groupBy(*keys).agg(*aggs).join(duplicate_rows(df, keys, every), list(keys), "left")
    n = F.col("n")
    share = lambda c: c / n
    found = [_issue(n < MIN_ROWS, "short_dataset", "warning", None, n, F.lit(1.0))]
    found.append(_issue(F.col("duplicate_rows") > 0, "duplicate_rows", "warning", None, F.col("duplicate_rows"), share(F.col("duplicate_rows"))))
    for c in every:
        m = F.col(f"miss_{c}")
        level = F.when(share(m) >= MISSING_ERROR, "error").when(share(m) >= MISSING_WARNING, "warning").otherwise("info")
        found.append(_issue(m > 0, "missing_values", level, c, m, share(m)))
    for c in numeric:
        i = F.col(f"inf_{c}")
        found.append(_issue(i > 0, "infinite_values", "error", c, i, share(i)))
        found.append(_issue(F.coalesce(F.col(f"flat_{c}"), F.lit(False)), "constant_channel", "info", c, n, F.lit(1.0)))
    for c in text or {}:
        x = F.col(f"text_{c}")
        found.append(_issue(x > 0, "non_numeric_values", F.when(share(x) >= NON_NUMERIC_ERROR, "error").otherwise("warning"), c, x, share(x)))
    if timestamp:
        timing = sampling_summary(df.withColumnRenamed(timestamp, "timestamp") if timestamp != "timestamp" else df, keys, order)
        stats = stats.join(timing, list(keys), "left")
        ts, steps = F.coalesce("sample_count", F.lit(0)), F.col("sample_count") - 1
        found.append(_issue(ts < 2, "insufficient_timestamps", "error", timestamp, ts, share(ts)))
        for c, name, level in (("duplicate_timestamp_count", "duplicate_timestamps", "warning"), ("backward_timestamp_count", "backward_timestamps", "error")):
            found.append(_issue(F.col(c) > 0, name, level, timestamp, F.col(c), F.col(c) / steps))
        found.append(_issue((ts >= 2) & F.col("median_interval_seconds").isNull(), "no_positive_time_intervals", "error", timestamp, ts, F.lit(1.0)))
        found.append(_issue(F.col("coefficient_of_variation") > IRREGULAR_CV, "irregular_sampling", "warning", timestamp, ts, F.lit(1.0)))
        found.append(_issue(F.col("large_gap_count") > 0, "large_time_gaps", "warning", timestamp, F.col("large_gap_count"), F.col("large_gap_count") / steps))
    else:
        found.append(_issue(F.lit(True), "timestamp_unavailable", "info", None, n, F.lit(1.0)))
    return stats.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("i")).select(*keys, "i.*")


def verdict(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], order: str = "row_ord", timestamp: str | None = "timestamp", text: dict[str, Column] | None = None) -> DataFrame:
    """keys, row_count, total_cells, missing values and their share, duplicate rows, issue and error counts, ``valid``.

    A recording is valid unless one of its issues (:func:`validate`) is an error.
    """
    cells = [c for c in df.columns if c not in (*keys, order)]
    missing = reduce(lambda a, b: a + b, [F.when(_missing(c, c in numeric), 1).otherwise(0) for c in cells], F.lit(0))
    counts = df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sum(missing).alias("total_missing_values"))
    issues = validate(df, keys, numeric, order, timestamp, text)
    found = issues.groupBy(*keys).agg(
        F.count("*").alias("issue_count"), F.count(F.when(F.col("severity") == "error", 1)).alias("error_count"), F.coalesce(F.max(F.when(F.col("issue_id") == "duplicate_rows", F.col("affected_rows"))), F.lit(0)).alias("duplicate_row_count")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = counts.join(found, list(keys), "left")
    total = F.col("row_count") * len(cells)
    return out.select(*keys, "row_count", total.alias("total_cells"), "total_missing_values", (F.col("total_missing_values") / total).alias("overall_missing_fraction"), zero("duplicate_row_count"), zero("issue_count"), zero("error_count"), (F.coalesce("error_count", F.lit(0)) == 0).alias("valid"))
