"""Hypotheses that metrics of a recording support, with their strength: weak, moderate, strong or conflicting.

Each rule is a filter over tool results; rules on pairs of axes spread the three pairs of a group of axes over the
recordings that have them.  A hypothesis states an association, never a cause.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORRELATION = 0.7
FREQUENCY_HZ, FREQUENCY_SHARE = 0.5, 0.05
R_SQUARED = 0.5
CLIPPING_RUN = 3


def _pairs(axes: Sequence[str]) -> list[tuple[str, str]]:
    return [(axes[0], axes[1]), (axes[0], axes[2]), (axes[1], axes[2])]


def shared_periodic(spectra: DataFrame, correlations: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Two axes of a group with nearly the same dominant frequency; moderate if they are also correlated."""
    wide = spectra.where(F.col("axis").isin(*axes)).groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("dominant_frequency"))).alias(f"f_{a}") for a in axes])
    df = wide.join(correlations.select(*keys, *[f"correlation_{a}_{b}" for a, b in _pairs(axes)]), list(keys), "left")
    rows = [F.struct(F.lit(f"{a},{b}").alias("axes"), F.col(f"f_{a}").alias("fa"), F.col(f"f_{b}").alias("fb"), F.col(f"correlation_{a}_{b}").alias("r")) for a, b in _pairs(axes)]
    df = df.select(*keys, F.explode(F.array(*rows)).alias("p")).select(*keys, "p.*").where("fa > 0 AND fb > 0")
    near = F.abs(F.col("fa") - F.col("fb")) <= F.greatest(F.lit(FREQUENCY_HZ), FREQUENCY_SHARE * F.greatest("fa", "fb"))
    strength = F.when(F.abs("r") >= CORRELATION, "moderate").otherwise("weak")
    return df.where(near).select(*keys, F.lit("shared_periodic_behaviour").alias("hypothesis"), "axes", strength.alias("strength"), ((F.col("fa") + F.col("fb")) / 2).alias("evidence"))


def temperature_association(stability: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axes whose output follows temperature."""
    return stability.where(F.col("r_squared") >= R_SQUARED).select(*keys, F.lit("temperature_associated_variation").alias("hypothesis"), F.col("axis").alias("axes"), F.lit("moderate").alias("strength"), F.col("r_squared").alias("evidence"))


def boundary_clipping(saturation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples exactly at the configured limit; values beyond it contradict clipping."""
    strength = F.when(F.col("outside_count") > 0, "conflicting").when(F.col("longest_exact_run") >= CLIPPING_RUN, "strong").otherwise("moderate")
    return saturation.where("exact_count > 0").select(*keys, F.lit("range_boundary_clipping").alias("hypothesis"), F.col("axis").alias("axes"), strength.alias("strength"), F.col("exact_count").cast("double").alias("evidence"))


def unexplained_covariance(correlations: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Strongly correlated axes; whether sample-to-sample changes are correlated too tells short from slow variation."""
    rows = [F.struct(F.lit(f"{a},{b}").alias("axes"), F.col(f"correlation_{a}_{b}").alias("r"), F.col(f"difference_correlation_{a}_{b}").alias("d")) for a, b in _pairs(axes)]
    df = correlations.select(*keys, F.explode(F.array(*rows)).alias("p")).select(*keys, "p.*").where(F.abs("r") >= CORRELATION)
    name = F.when(F.abs("d") >= CORRELATION, "short_timescale_cross_axis_covariance").otherwise("slow_cross_axis_covariance")
    return df.select(*keys, name.alias("hypothesis"), "axes", F.lit("moderate").alias("strength"), F.col("r").alias("evidence"))
