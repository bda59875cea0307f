"""Held-out calibration: split, fit on the training rows, evaluate on the validation rows.  Everything is keyed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.joins import attach, written
from plumbline.operators.generic_tools import NEAR_ZERO, pairs
from plumbline.operators.ordered import with_position

VALIDATION_SHARE = 0.20
MIN_TRAIN, MIN_VALIDATION = 3, 1


def _validation_count(n, share: float):
    return F.greatest(F.lit(MIN_VALIDATION), F.least(n - MIN_TRAIN, F.rint(n * share).cast("bigint")))


def split_sequential(df: DataFrame, keys: Sequence[str], order: str = "row_ord", share: float = VALIDATION_SHARE) -> DataFrame:
    """Usable pairs with ``validation``: the last rows of each group in file order."""
    rows = with_position(pairs(df, keys, order), keys, order)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_TRAIN + MIN_VALIDATION)
    rows = attach(rows, n, list(keys), "inner")
    return rows.withColumn("validation", F.col("pos") >= F.col("_n") - _validation_count(F.col("_n"), share)).drop("_n", "pos")


def split_random(df: DataFrame, keys: Sequence[str], order: str = "row_ord", share: float = VALIDATION_SHARE, seed: int = 0) -> DataFrame:
    """The same with rows drawn at random, in the exact number: those first in order of a hash of (seed, keys, order).

    Reproducible and independent of partitioning; a group is ranked in blocks of hash values, never as a whole.
    """
    drawn = F.xxhash64(F.lit(seed), *keys, F.col(order))
    rows = with_position(pairs(df, keys, order).withColumn("_h", drawn), keys, "_h", block_rows=1 << 52)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_TRAIN + MIN_VALIDATION)
    rows = attach(rows, n, list(keys), "inner")
    return rows.withColumn("validation", F.col("pos") < _validation_count(F.col("_n"), share)).drop("_n", "pos", "_h")


def split_grouped(df: DataFrame, keys: Sequence[str], group: str, order: str = "row_ord", share: float = VALIDATION_SHARE, seed: int = 0) -> DataFrame:
    """No value of ``group`` on both sides: groups in hashed order go to validation until the share is reached.

    Rows without a group take no part; recordings with fewer than two groups, or whose training side would be left with
    fewer than ``MIN_TRAIN`` rows, give none.  How far the share was missed is told by :func:`split_shares`.
    """
    rows = pairs(df.where(F.col(group).isNotNull()), keys, group, order)
    sizes = rows.groupBy(*keys, group).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(group)), group)
    every = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(every), "groups": F.count("*").over(every), "rank": F.row_number().over(w)})
    side = (F.col("before") < F.greatest(F.rint(F.col("total") * share), F.lit(MIN_VALIDATION))) & (F.col("rank") < F.col("groups"))
    sides = sizes.where("groups >= 2").select(*keys, group, "n", side.alias("validation"))
    left = F.sum(F.when(~F.col("validation"), F.col("n"))).over(every)
    sides = sides.withColumn("_left", left).where(F.col("_left") >= MIN_TRAIN)
    return attach(rows, sides.select(*keys, group, "validation"), [*keys, group], "inner")


def split_shares(split: DataFrame, keys: Sequence[str], share: float = VALIDATION_SHARE, tolerance: float = 0.10) -> DataFrame:
    """keys, training_rows, validation_rows, validation_share, and ``deviates`` where the share is further off than ``tolerance``."""
    held = F.count(F.when(F.col("validation"), 1))
    out = split.groupBy(*keys).agg((F.count("*") - held).alias("training_rows"), held.alias("validation_rows"), (held / F.count("*")).alias("validation_share"))
    return out.withColumn("deviates", F.abs(F.col("validation_share") - share) > tolerance)


def fit(split: DataFrame, keys: Sequence[str], model: str = "affine") -> DataFrame:
    """keys, gain, offset, training_rows and training metrics of reference = gain * measurement + offset.

    Affine fits of a constant measurement and groups of fewer than three training rows give no model.
    """
    train = split.where(~F.col("validation"))
    if model == "offset":
        out = train.groupBy(*keys).agg(F.count("*").alias("training_rows"), F.lit(1.0).alias("gain"), F.avg(F.col("r") - F.col("m")).alias("offset"))
    elif model == "affine":
        out = train.groupBy(*keys).agg(F.count("*").alias("training_rows"), F.regr_slope("r", "m").alias("gain"), F.regr_intercept("r", "m").alias("offset"), F.var_pop("m").alias("_v"))
        out = out.where((F.col("_v") > NEAR_ZERO) & (F.col("training_rows") >= MIN_TRAIN)).drop("_v")
    else:
        raise ValueError(f"unknown model {model}")
    found = written(out)
    # The training errors need the fitted line: a second look at the training rows.
    rows = attach(train, found, list(keys), "inner").withColumn("_e", F.col("gain") * F.col("m") + F.col("offset") - F.col("r"))
    total = F.var_pop("r") * F.count("*")
    errors = rows.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("training_rmse"),
        F.avg(F.abs("_e")).alias("training_mae"),
        F.avg("_e").alias("training_bias"),
        F.when(total > NEAR_ZERO, 1 - F.sum(F.col("_e") * F.col("_e")) / total).alias("training_r2"),
    )
    return found.df.join(errors, list(keys))


def apply(df: DataFrame, keys: Sequence[str], model: DataFrame, column: str = "m", to: str = "corrected") -> DataFrame:
    """``df`` with the corrected value."""
    rows = attach(df, model.select(*keys, "gain", "offset"), list(keys), "inner")
    return rows.withColumn(to, F.col("gain") * F.col(column) + F.col("offset")).drop("gain", "offset")


def evaluated_rows(split: DataFrame, keys: Sequence[str], model: DataFrame) -> DataFrame:
    """The validation rows with the corrected value, and the error before (``raw_error``) and after (``corrected_error``)."""
    held = apply(split.where("validation"), keys, model)
    return held.withColumns({"raw_error": F.col("m") - F.col("r"), "corrected_error": F.col("corrected") - F.col("r")})


def evaluate(split: DataFrame, keys: Sequence[str], model: DataFrame) -> DataFrame:
    """Errors on the validation rows before and after, and the improvement in percent.  No training row is used."""
    held = evaluated_rows(split, keys, model)
    spread = F.var_pop("r") * F.count("*")
    aggs = [F.count("*").alias("validation_rows")]
    for name, e in (("before", F.col("raw_error")), ("after", F.col("corrected_error"))):
        aggs += [
            F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"),
            F.avg(F.abs(e)).alias(f"mae_{name}"),
            F.avg(e).alias(f"bias_{name}"),
            F.max(F.abs(e)).alias(f"max_abs_{name}"),
            F.stddev_pop(e).alias(f"error_std_{name}"),
            F.when(spread > NEAR_ZERO, 1 - F.sum(e * e) / spread).alias(f"r2_{name}"),
        ]
    out = held.groupBy(*keys).agg(*aggs)
    gain = lambda c: F.when(F.abs(f"{c}_before") > NEAR_ZERO, 100 * (F.abs(f"{c}_before") - F.abs(f"{c}_after")) / F.abs(f"{c}_before"))
    return out.withColumns({f"{c}_improvement_percent": gain(c) for c in ("rmse", "mae", "bias", "max_abs")} | {"r2_change": F.col("r2_after") - F.col("r2_before")})
