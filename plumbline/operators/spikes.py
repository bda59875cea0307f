"""Problem 2: implausible spikes in measurements.

Each source (one channel of one recording) is forecast by a Kalman filter fitted to that source: a local level plus
the gain on the reference for generic sensors, a local linear trend for inertial ones.  A reading is flagged

* ``spike``: its standardised innovation exceeds the threshold in the forecasts from both sides; the update of a flagged
  reading is withheld, so whether a run of them is an excursion or a change of the source is left to the forecast's
  variance, not to its length;
* ``stuck``: it belongs to a run of equal readings, whose innovation variance has vanished: so many innovations in
  succession below the source's resolution have practically no chance, neither under the innovation variance the filter
  predicts nor by how often this source repeats a value anyway;
* ``impossible``: it lies outside the range the recording gives for it, infinite readings included.

Recordings are cut into blocks of ``block_rows`` rows; each block also sees ``halo_rows`` rows of its neighbours, so a
recording that holds a third of all rows is spread over many tasks while its edges are judged like its middle.  Within a
block the filter runs over segments of ``SEGMENT_ROWS`` side by side, again with a halo, all with their source's model.

Defined results: NULL and NaN readings are never flagged; a reading whose reference alone is missing is compared with the
references around it in time; a delivery repeated with the same time and value gets the
verdict of the first; sources of fewer than 8 readings have no normal behaviour, so only impossible readings are
flagged; rows without timestamp take the time of the row before; rows without recording have no source to be judged by
and no range, only their infinities are flagged; without a range nothing is impossible but infinities; extra columns
are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.chunks import map_whole_groups
from plumbline.joins import attach
from plumbline.operators.kalman import pad, standardised_innovations
from plumbline.operators.unit_graph import channel_units_from_values, conversions, to_common_units, unit_name

#: Standardised innovation from which a reading is a spike: generic sensors, inertial sensors.
LEVEL_THRESHOLD, TREND_THRESHOLD = 6.2, 6.2
#: Chance of a run of equal readings below which it is no ordinary repeat, and the least chance of one repeat that so few
#: readings can tell.
STUCK_CHANCE, LEAST_REPEAT = 1e-4, 0.02
BLOCK_ROWS, HALO_ROWS = 16_384, 256
#: Rows of a segment and of its halo on either side.
SEGMENT_ROWS, SEGMENT_HALO = 512, 128
#: Segments filtered side by side; they are sorted by length, so padding stays small.
SIDE_BY_SIDE = 256

_SCHEMA = "row_id bigint, dataset_id bigint, field_name string, kind string, score double"


def _run_lengths(y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of equal readings each row belongs to, and the run's number; NaN ends no run and counts not."""
    idx = np.flatnonzero(np.isfinite(y))
    length, run = np.zeros(len(y), np.int64), np.full(len(y), -1, np.int64)
    if not len(idx):
        return length, run
    group = np.cumsum(new)[idx]
    v = y[idx]
    start = np.r_[True, (v[1:] != v[:-1]) | (group[1:] != group[:-1])]
    number = np.cumsum(start) - 1
    length[idx] = np.bincount(number)[number]
    run[idx] = number
    return length, run


def _resolution(y: np.ndarray, source: np.ndarray, n_source: int) -> np.ndarray:
    """Smallest step between two values of each source."""
    out = np.zeros(n_source)
    idx = np.flatnonzero(np.isfinite(y))
    idx = idx[np.lexsort((y[idx], source[idx]))]
    v, g = y[idx], source[idx]
    step = v[1:] - v[:-1]
    real = (g[1:] == g[:-1]) & (step > 1e-12 * np.maximum(np.abs(v[1:]), np.abs(v[:-1])))
    out[:] = np.inf
    np.minimum.at(out, g[1:][real], step[real])
    return np.where(np.isfinite(out), out, 0.0)


def _stuck(y: np.ndarray, source: np.ndarray, repeated: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Rows of runs of equal readings too long for chance.

    The chance of one repeat is the share of repeats of the source outside of such runs, at least ``least`` per source.
    """
    n_source = int(source.max()) + 1 if len(source) else 0
    once = np.where(repeated, np.nan, y)
    length, run = _run_lengths(once, np.r_[True, source[1:] != source[:-1]])
    there = run >= 0
    firsts = np.zeros(len(y), bool)
    seen = np.flatnonzero(there)
    if len(seen):
        firsts[seen[np.r_[True, run[seen][1:] != run[seen][:-1]]]] = True
    total = np.maximum(np.bincount(source[there], minlength=n_source), 1)
    least = np.full(n_source, LEAST_REPEAT) if least is None else np.maximum(least, LEAST_REPEAT)
    long = np.zeros(len(y), bool)
    for _ in range(6):
        rows = np.bincount(source[there & ~long], minlength=n_source)
        runs = np.bincount(source[there & ~long & firsts], minlength=n_source)
        chance = np.clip(np.maximum((rows - runs + 0.5) / np.maximum(rows + 1, 1), least), LEAST_REPEAT, 0.98)
        new = (length > 1) & (total[source] * chance[source] ** np.maximum(length - 1, 0) < STUCK_CHANCE)
        if (new == long).all():
            break
        long = new
    return long


def _segments(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end, first and last own row) of overlapping segments; groups little longer than one stay whole."""
    n = ends - starts
    parts = np.where(n > SEGMENT_ROWS + 2 * SEGMENT_HALO, -(-n // SEGMENT_ROWS), 1)
    group = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(parts) - parts, parts)
    own0 = np.where(parts[group] > 1, starts[group] + nth * SEGMENT_ROWS, starts[group])
    own1 = np.where(parts[group] > 1, np.minimum(own0 + SEGMENT_ROWS, ends[group]), ends[group])
    return group, np.maximum(own0 - SEGMENT_HALO, starts[group]), np.minimum(own1 + SEGMENT_HALO, ends[group]), own0, own1


def _filtered(y: np.ndarray, t: np.ndarray, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, trend: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Standardised innovation of every row and usual innovation variance of every source."""
    z, usual = np.full(len(y), np.nan), np.zeros(len(starts))
    group, s0, s1, own0, own1 = _segments(starts, ends)
    by_length = np.lexsort((group, s1 - s0))
    for i in range(0, len(by_length), SIDE_BY_SIDE):
        some = by_length[i : i + SIDE_BY_SIDE]
        idx, ym, tm, xm = pad(s0[some], s1[some], y, t, x)
        owner = np.unique(group[some], return_inverse=True)[1]
        scores, variance = standardised_innovations(ym, tm, xm, trend, threshold, owner)
        own = (idx >= own0[some][None, :]) & (idx < own1[some][None, :])
        z[idx[own]] = scores[own]
        np.maximum.at(usual, group[some], np.where(np.isfinite(variance), variance, 0.0))
    return z, usual


def _judge(fields: list[str], trend: bool, threshold: float, frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    source = np.repeat(np.arange(len(starts)), ends - starts)
    t = frame["t"].to_numpy(float)
    if np.isnan(t).any():
        t = frame["t"].groupby(source).ffill().fillna(0.0).to_numpy(float)
    order = np.lexsort((frame["pos"].to_numpy(), t, source))
    frame, t = frame.iloc[order].reset_index(drop=True), t[order]
    same_time = np.r_[False, (t[1:] == t[:-1]) & (source[1:] == source[:-1])]
    home = frame["home"].to_numpy(bool)
    out = []
    for f in fields:
        y = frame[f].to_numpy(float)
        low, high = frame[f"{f}_low"].to_numpy(float), frame[f"{f}_high"].to_numpy(float)
        slack = 1e-9 * np.maximum(np.abs(low), np.abs(high))
        with np.errstate(invalid="ignore"):
            impossible = np.isinf(y) | (y < low - slack) | (y > high + slack)
        usable = np.where(np.isfinite(y) & ~impossible, y, np.nan)
        repeated = same_time & np.r_[False, y[1:] == y[:-1]]
        stuck = _stuck(usable, source, repeated)
        # Late rows break a run in file order and stray clocks break it in time order: either order will do.
        filed = np.lexsort((frame["pos"].to_numpy(), source))
        stuck[filed] |= _stuck(usable[filed], source[filed], repeated[filed])
        x = frame[f"{f}_ref"].to_numpy(float) if f"{f}_ref" in frame else np.full(len(y), np.nan)
        feed = np.where(stuck | repeated, np.nan, usable)
        z, usual = _filtered(feed, t, x, starts, ends, trend, threshold)
        # Runs whose innovations the filter's own variance makes plausible, at the source's resolution, are ordinary.
        expected = _resolution(usable, source, len(starts)) / np.sqrt(2 * np.pi * np.maximum(usual, 1e-300))
        sure = _stuck(usable, source, repeated, expected)
        sure[filed] |= _stuck(usable[filed], source[filed], repeated[filed], expected)
        stuck &= sure
        spike = np.nan_to_num(np.abs(z)) > threshold
        # A repeated delivery gets the verdict of the one before it.
        for i in np.flatnonzero(repeated):
            spike[i], stuck[i], z[i] = spike[i - 1], stuck[i - 1], z[i - 1]
        kind = np.where(impossible, "impossible", np.where(stuck, "stuck", np.where(spike, "spike", "")))
        hit = (kind != "") & home & ~np.isnan(y)
        out.append(pd.DataFrame({"row_id": frame["row_id"][hit], "dataset_id": frame["dataset_id"][hit], "field_name": f, "kind": kind[hit], "score": np.abs(z[hit])}))
    return pd.concat(out, ignore_index=True)


def _in_blocks(df: DataFrame, block_rows: int, halo_rows: int) -> DataFrame:
    """Rows of each block and, with ``home`` false, those of its neighbours within the halo."""
    at = F.col("pos") % block_rows
    own = F.floor(F.col("pos") / block_rows).cast("bigint")
    blocks = F.array_compact(F.array(own, F.when(at < halo_rows, own - 1), F.when(at >= block_rows - halo_rows, own + 1)))
    return df.withColumn("own", own).withColumn("block", F.explode(blocks)).where("block >= 0").withColumn("home", F.col("block") == F.col("own")).drop("own")


def _flags(df: DataFrame, fields: list[str], trend: bool, threshold: float, block_rows: int, halo_rows: int) -> DataFrame:
    known = df.where(F.col("dataset_id").isNotNull())
    cut = _in_blocks(known, block_rows, halo_rows)
    judged = map_whole_groups(cut, ["dataset_id", "block"], ["pos"], partial(_judge, fields, trend, threshold), _SCHEMA)
    infinite = lambda f: F.abs(f) == F.lit(float("inf"))
    rows = F.array_compact(F.array(*[F.when(infinite(f), F.lit(f)) for f in fields]))
    orphans = df.where(F.col("dataset_id").isNull()).select("row_id", "dataset_id", F.explode(rows).alias("field_name"), F.lit("impossible").alias("kind"), F.lit(None).cast("double").alias("score"))
    return judged.unionByName(orphans)


def _base(samples: DataFrame) -> list[Column]:
    return ["row_id", "dataset_id", F.coalesce("row_ord", "row_id", F.lit(0)).alias("pos"), F.when(~F.isnan("timestamp"), F.col("timestamp").cast("double")).alias("t")]


def flag_generic(samples: DataFrame, recordings: DataFrame, block_rows: int = BLOCK_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """row_id, dataset_id, field_name, kind, score of implausible ``measurement`` readings."""
    ranges = recordings.groupBy("dataset_id").agg(F.max("range_min").alias("measurement_low"), F.max("range_max").alias("measurement_high")).where(F.col("dataset_id").isNotNull())
    df = attach(samples.select("dataset_id", "row_id", "row_ord", "timestamp", "measurement", "reference"), ranges, ["dataset_id"])
    df = df.select(*_base(df), F.col("measurement").cast("double").alias("measurement"), F.col("reference").cast("double").alias("measurement_ref"), "measurement_low", "measurement_high")
    return _flags(df, ["measurement"], False, LEVEL_THRESHOLD, block_rows, halo_rows)


def full_scale(limit: str, unit: str, dimension_unit: str) -> Column:
    """A symmetric range limit in the canonical unit."""
    table = {u: s for u, (target, s, o) in conversions().items() if target == dimension_unit}
    scale = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.col(limit) * F.try_element_at(scale, unit_name(unit))


def flag_inertial(samples: DataFrame, recordings: DataFrame, channel_units: DataFrame, block_rows: int = BLOCK_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """The same for ``ax`` and ``gx``, in common units (:mod:`plumbline.operators.unit_graph`)."""
    need = ["row_id", "dataset_id", "row_ord", "timestamp", "ax", "ay", "az", "gx", "gy", "gz", "motion_state"]
    channels = channel_units_from_values(samples.select(*need), recordings, channel_units)
    # Time only orders the readings and spaces them in periods, so its unit does not matter here.
    df = to_common_units(samples.select(*need), channels.where(F.col("field_name").isin("ax", "gx")))
    limits = recordings.select(
        "dataset_id",
        full_scale("accelerometer_range_max", "accelerometer_range_unit", "m/s^2").alias("ax_high"),
        full_scale("gyroscope_range_max", "gyroscope_range_unit", "rad/s").alias("gx_high"),
    )
    limits = limits.where(F.col("dataset_id").isNotNull()).groupBy("dataset_id").agg(F.max("ax_high").alias("ax_high"), F.max("gx_high").alias("gx_high"))
    df = attach(df, limits, ["dataset_id"])
    df = df.select(*_base(df), "ax", "gx", (-F.col("ax_high")).alias("ax_low"), "ax_high", (-F.col("gx_high")).alias("gx_low"), "gx_high")
    return _flags(df, ["ax", "gx"], True, TREND_THRESHOLD, block_rows, halo_rows)
