"""Spectral density (Welch) and Allan deviation of long, evenly sampled series.

Series are cut out of recordings as the longest stretch of consecutive valid rows whose steps stay within 1.5 times the
median step.  Blocks of rows are looked at once, side by side; each yields its longest inner stretch and those at its
edges, and stretches that cross blocks are put together from that small table.  The Fourier transforms run on one Welch
segment at a time, many segments per Arrow batch; Allan deviations on blocks with the rows after them.  Averaging and
picking peaks is Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.chunks import map_whole_groups
from plumbline.columns import finite
from plumbline.joins import BROADCAST_BYTES, Written, attach, written
from plumbline.operators.order_statistics import summary
from plumbline.operators.ordered import BLOCK_ROWS, with_position, with_previous, with_previous_value, with_running_sum

CONTINUITY = 1.5
BIAS_INSTABILITY_FACTOR = 0.664


def window_of(name: str, n: int) -> np.ndarray:
    """Symmetric taper: hann, hamming or rectangular."""
    if name == "rectangular" or n == 1:
        return np.ones(n)
    k = np.cos(2 * np.pi * np.arange(n) / (n - 1))
    if name == "hann":
        return 0.5 - 0.5 * k
    if name == "hamming":
        return 0.54 - 0.46 * k
    raise ValueError(f"unknown window {name}")


_STRETCH = "_grp int, _block bigint, f_t double, f_ok boolean, l_t double, l_ok boolean, whole boolean, head_n bigint, head_to bigint, tail_n bigint, tail_from bigint, best_n bigint, best_from bigint, best_to bigint, first_at bigint, last_at bigint"


def _stretches(groups: int, keys: list[str], order: str, frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """Per block and group of axes: the valid stretches at its edges and the longest in it."""
    t, at, limit = frame["t"].to_numpy(float), frame[order].to_numpy(np.int64), CONTINUITY * frame["dt"].to_numpy(float)
    size = len(frame)
    row = np.arange(size)
    block = np.repeat(np.arange(len(starts)), ends - starts)
    step = np.r_[np.nan, t[1:] - t[:-1]]
    with np.errstate(invalid="ignore"):
        near = (step > 0) & (step <= limit)
    near[starts] = False
    out = []
    for g in range(groups):
        ok = frame[f"ok_{g}"].to_numpy(bool)
        linked = ok & near & np.r_[False, ok[:-1]]
        # A stretch begins wherever a valid row is not linked to the one before.
        begin = np.maximum.accumulate(np.where(ok & ~linked, row, -1))
        length = np.where(ok, row - begin + 1, 0)
        last = np.r_[~linked[1:], True] & ok
        done = np.flatnonzero(last)
        # The longest of a block, of equals the first.
        pick = done[np.lexsort((done, -length[done], block[done]))]
        first_of = np.r_[True, block[pick][1:] != block[pick][:-1]] if len(pick) else np.zeros(0, bool)
        best = np.full(len(starts), -1)
        best[block[pick][first_of]] = pick[first_of]
        stop = np.minimum.reduceat(np.where(linked, size, np.where(np.isin(row, starts), size, row)), starts)
        head_n = np.where(ok[starts], np.minimum(stop, ends) - starts, 0)
        tail_n = length[ends - 1]
        has = best >= 0
        out.append(
            pd.DataFrame(
                {
                    **{k: frame[k].iloc[starts].to_numpy() for k in keys},
                    "_grp": g,
                    "_block": frame["_block"].to_numpy()[starts],
                    "f_t": t[starts],
                    "f_ok": ok[starts],
                    "l_t": t[ends - 1],
                    "l_ok": ok[ends - 1],
                    "whole": head_n == ends - starts,
                    "head_n": head_n,
                    "head_to": at[starts + np.maximum(head_n, 1) - 1],
                    "tail_n": tail_n,
                    "tail_from": at[ends - np.maximum(tail_n, 1)],
                    "best_n": np.where(has, length[best], 0),
                    "best_from": at[np.where(has, begin[best], 0)],
                    "best_to": at[np.where(has, best, 0)],
                    "first_at": at[starts],
                    "last_at": at[ends - 1],
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def segment_table(df: DataFrame, keys: Sequence[str], groups: Sequence[Sequence[str]], order: str = "row_ord", block_rows: int = BLOCK_ROWS) -> Written:
    """keys, grp (number of the group of axes), first_row, last_row, n, dt, dt_cv: the longest stretch of each; small.

    A row is valid with a finite timestamp and finite values of all axes of a group.  ``dt`` is the median positive step
    over all finite timestamps and ``dt_cv`` the variation of those steps; rows without a key or an order take no part.
    """
    keys = list(keys)
    t = F.when(finite("timestamp"), F.col("timestamp").cast("double"))
    # Steps for the median are between rows with a timestamp; continuity is between neighbouring rows of the file.
    timed = with_previous_value(df.select(*keys, order, t.alias("t")), keys, order, ["t"], block_rows=block_rows)
    dt = F.col("t") - F.col("prev_t")
    plus = F.when(dt > 0, dt)
    steps = summary(timed, keys, [F.avg(plus).alias("_mean"), F.stddev_pop(plus).alias("_std")], {"q": plus}, source=df)
    steps = written(steps.select(*keys, F.col("q")[0].alias("dt"), (F.col("_std") / F.col("_mean")).alias("dt_cv")).where("dt IS NOT NULL"))
    valid = [reduce(lambda a, b: a & b, [finite(a) for a in axes], finite("timestamp")).alias(f"ok_{g}") for g, axes in enumerate(groups)]
    placed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(order).isNotNull())
    rows = df.where(placed).select(*keys, F.floor(F.col(order) / block_rows).cast("bigint").alias("_block"), F.col(order).cast("bigint").alias(order), t.alias("t"), *valid)
    rows = attach(rows, Written(steps.df.select(*keys, "dt"), steps.bytes), keys, "inner")
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    blocks = map_whole_groups(rows, [*keys, "_block"], [order], partial(_stretches, len(groups), keys, order), f"{head}, {_STRETCH}")
    blocks = blocks.join(F.broadcast(steps.df), keys) if steps.bytes <= BROADCAST_BYTES else blocks.join(steps.df, keys)
    by = [*keys, "_grp"]
    w = Window.partitionBy(*by).orderBy("_block")
    step = F.col("f_t") - F.lag("l_t").over(w)
    joined = F.coalesce(F.col("f_ok") & F.lag("l_ok").over(w) & (step > 0) & (step <= CONTINUITY * F.col("dt")), F.lit(False))
    piece = lambda part, n, lo, hi, joined: F.struct(F.lit(part).alias("part"), n.alias("n"), lo.alias("lo"), hi.alias("hi"), joined.alias("joined"))
    c = F.col
    edges = F.when(c("whole"), F.array(piece(0, c("head_n"), c("first_at"), c("last_at"), c("_joined")))).otherwise(
        F.array(piece(0, c("head_n"), c("first_at"), c("head_to"), c("_joined")), piece(1, c("tail_n"), c("tail_from"), c("last_at"), F.lit(False)))
    )
    pieces = blocks.withColumn("_joined", joined).select(*by, "_block", "dt", "dt_cv", F.explode(edges).alias("p")).select(*by, "_block", "dt", "dt_cv", "p.*")
    chain = F.sum(F.when(c("joined"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy("_block", "part").rowsBetween(Window.unboundedPreceding, 0))
    chains = pieces.withColumn("_chain", chain).where("n > 0").groupBy(*by, "_chain", "dt", "dt_cv").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_chain")
    inner = blocks.where("best_n > 0").select(*by, "dt", "dt_cv", c("best_n").alias("n"), c("best_from").alias("lo"), c("best_to").alias("hi"))
    top = chains.unionByName(inner).groupBy(*by, "dt", "dt_cv").agg(F.max(F.struct("n", (-c("lo")).alias("lo"), "hi")).alias("b"))
    return written(top.select(*keys, c("_grp").alias("grp"), (-c("b.lo")).alias("first_row"), c("b.hi").alias("last_row"), c("b.n").alias("n"), "dt", "dt_cv"))


def segment_rows(df: DataFrame, keys: Sequence[str], groups: Sequence[Sequence[str]], table: Written, order: str = "row_ord") -> DataFrame:
    """keys, grp, pos, x0 .. (values of the group's axes), dt, dt_cv, n: the rows of the stretches of ``table``, numbered from 0."""
    keys, width = list(keys), len(groups[0])
    marks = table.df.groupBy(*keys).agg(F.collect_list(F.struct("grp", "first_row", "last_row", "n", "dt", "dt_cv")).alias("_s"))  # one entry per group of axes
    axes = list(dict.fromkeys(a for g in groups for a in g))
    rows = attach(df.select(*keys, F.col(order).cast("bigint").alias(order), *[F.col(a).cast("double").alias(a) for a in axes]), marks, keys, "inner")
    rows = rows.withColumn("s", F.explode("_s")).where((F.col(order) >= F.col("s.first_row")) & (F.col(order) <= F.col("s.last_row")))
    pick = lambda j: reduce(lambda e, i: F.when(F.col("s.grp") == i, F.col(groups[i][j])).otherwise(e), range(1, len(groups)), F.col(groups[0][j]))
    rows = rows.select(*keys, F.col("s.grp").alias("grp"), order, *[pick(j).alias(f"x{j}") for j in range(width)], "s.dt", "s.dt_cv", "s.n")
    return with_position(rows, [*keys, "grp"], order).drop(order)


def longest_segment(df: DataFrame, keys: Sequence[str], axes: Sequence[str], order: str = "row_ord", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, pos, axes, dt, dt_cv, n: rows of the longest continuous stretch of each group, numbered from 0; of equals the first."""
    rows = segment_rows(df, keys, [list(axes)], segment_table(df, keys, [list(axes)], order, block_rows), order)
    return rows.select(*keys, "pos", *[F.col(f"x{j}").alias(a) for j, a in enumerate(axes)], "dt", "dt_cv", "n")


def ordered_by_time(df: DataFrame, keys: Sequence[str], axes: Sequence[str], order: str = "row_ord", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, pos, axes, dt, dt_cv, n: all valid rows of each group in order of time, equal times in file order.

    ``dt`` is the median positive step between these rows and ``dt_cv`` the variation of the positive steps.  Rows are
    numbered in blocks of time, about ``block_rows`` rows each, and the numbers of earlier blocks added.
    """
    valid = reduce(lambda a, b: a & b, [finite(a) for a in axes], finite("timestamp"))
    rows = df.where(valid).select(*keys, order, F.col("timestamp").cast("double").alias("t"), *[F.col(a).cast("double").alias(a) for a in axes])
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("_low"), F.max("t").alias("_high"))
    rows = attach(rows, span, list(keys), "inner")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    rows = rows.withColumn("_block", F.floor(share * F.ceil(F.col("n") / block_rows)).cast("bigint")).drop("_low", "_high")
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy("t", order)
    rows = rows.withColumn("_in", F.row_number().over(inside)).join(counts, [*keys, "_block"])
    rows = rows.select(*keys, (F.col("_base") + F.col("_in") - 1).cast("bigint").alias("pos"), "t", *axes, "n")
    steps = with_previous(rows.select(*keys, "pos", "t"), keys, "pos", ["t"])
    dt = F.col("t") - F.col("prev_t")
    # The generic tool takes the sample deviation of the steps, the inertial ones that of the population.
    step = summary(steps.where(dt > 0), keys, [F.coalesce(F.stddev_samp(dt), F.lit(0.0)).alias("_std"), F.avg(dt).alias("_mean")], {"q": dt}, source=df)
    step = step.select(*keys, F.col("q")[0].alias("dt"), (F.col("_std") / F.col("_mean")).alias("dt_cv"))
    return attach(rows.drop("t"), step, list(keys), "inner")


def regularity(series: DataFrame, keys: Sequence[str], limit: float = 0.02) -> DataFrame:
    """keys, sampling_cv, regular, duration of each series (or of the table of segments): irregular ones keep their results, marked as such."""
    out = series.groupBy(*keys).agg(F.first("dt_cv").alias("sampling_cv"), F.first((F.col("n") - 1) * F.col("dt")).alias("duration"))
    return out.withColumn("regular", F.col("sampling_cv") <= limit)


def welch(series: DataFrame, keys: Sequence[str], axes: Sequence[str], segment_length: int = 2048, overlap: float = 0.5, window: str = "hann", even: bool = True, least: int = 32) -> DataFrame:
    """keys, axis, bin, frequency, psd, segments, length: the averaged one-sided spectral density.

    ``series`` has keys, ``pos`` (0, 1, ..), ``dt``, ``n`` and the axes (see :func:`longest_segment`).  Segments of
    min(``segment_length``, n) samples, made even above 32 if ``even``, lose their mean and are tapered.
    """
    length = F.least(F.lit(segment_length).cast("bigint"), F.col("n"))
    if even:
        length = F.when((length > 32) & (length % 2 == 1), length - 1).otherwise(length)
    df = series.where(F.col("n") >= least).withColumn("length", length)
    lap = F.least(F.rint(F.col("length") * overlap).cast("bigint"), F.col("length") - 1)
    df = df.withColumn("step", F.col("length") - lap)
    df = df.withColumn("segments", 1 + F.floor((F.col("n") - F.col("length")) / F.col("step")))
    low = F.greatest(F.ceil((F.col("pos") - F.col("length") + 1) / F.col("step")), F.lit(0))
    high = F.least(F.floor(F.col("pos") / F.col("step")), F.col("segments") - 1)
    df = df.withColumns({"lo": low, "hi": high}).where("lo <= hi").withColumn("seg", F.explode(F.sequence("lo", "hi")))
    names = list(axes)
    keyed = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def transform(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        parts = []
        lengths = frame["length"].to_numpy()[starts]
        values = frame[names].to_numpy(float)
        for size in np.unique(lengths):
            some = starts[(lengths == size) & (ends - starts == size)]
            if not len(some):
                continue
            taper = window_of(window, int(size))
            x = values[some[:, None] + np.arange(size)[None, :]]
            x = (x - x.mean(axis=1, keepdims=True)) * taper[None, :, None]
            rate = 1.0 / frame["dt"].to_numpy(float)[some]
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2 / (rate[:, None, None] * np.sum(taper**2))
            if size % 2 == 0:
                power[:, 1:-1] *= 2
            else:
                power[:, 1:] *= 2
            bins = power.shape[1]
            part = frame.iloc[np.repeat(some, bins)][[*keys, "segments", "length", "dt"]].reset_index(drop=True)
            part["bin"] = np.tile(np.arange(bins), len(some))
            for j, name in enumerate(names):
                part[name] = power[:, :, j].ravel()
            parts.append(part)
        return pd.concat(parts, ignore_index=True) if parts else frame.iloc[:0].assign(bin=0)

    schema = f"{keyed}, segments bigint, length bigint, dt double, bin bigint, " + ", ".join(f"{n} double" for n in names)
    spectra = map_whole_groups(df.select(*keys, "seg", "pos", "segments", "length", "dt", *names), [*keys, "seg"], ["pos"], transform, schema)
    mean = spectra.groupBy(*keys, "bin", "segments", "length", "dt").agg(*[F.avg(n).alias(n) for n in names])
    long = mean.select(*keys, "bin", "segments", "length", "dt", F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).alias("psd")) for n in names])).alias("v"))
    return long.select(*keys, F.col("v.axis").alias("axis"), "bin", (F.col("bin") / (F.col("length") * F.col("dt"))).alias("frequency"), F.col("v.psd").alias("psd"), "segments", "length")


def spectrum_metrics(spectrum: DataFrame, keys: Sequence[str], min_frequency: float = 0.1, peak_ratio: float = 10.0, max_peaks: int = 5) -> DataFrame:
    """Integrated RMS, median density, dominant frequency and prominent peaks of each axis.

    Peaks are above the bin before and not below the bin after, at least ``peak_ratio`` times the median.
    """
    by = [*keys, "axis"]
    w = Window.partitionBy(*by).orderBy("bin")
    df = spectrum.withColumns({"p_psd": F.lag("psd").over(w), "p_f": F.lag("frequency").over(w)})
    area = F.sum((F.col("psd") + F.col("p_psd")) / 2 * (F.col("frequency") - F.col("p_f")))
    # Peaks need both neighbours at or above the lowest frequency analysed.
    high = spectrum.where(F.col("frequency") >= min_frequency).withColumns({"left": F.lag("psd").over(w), "right": F.lead("psd").over(w)})
    top = high.groupBy(*by).agg(F.median(F.when(F.col("psd") > 0, F.col("psd"))).alias("median_psd"), F.max(F.struct("psd", (-F.col("frequency")).alias("f"))).alias("d"))
    top = top.select(*by, F.coalesce("median_psd", F.lit(0.0)).alias("median_psd"), (-F.col("d.f")).alias("dominant_frequency"), F.col("d.psd").alias("dominant_psd"))
    peaks = high.join(top.select(*by, "median_psd"), by).where((F.col("psd") > F.col("left")) & (F.col("psd") >= F.col("right")) & (F.col("median_psd") > 0) & (F.col("psd") >= peak_ratio * F.col("median_psd")))
    found = peaks.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.struct("psd", "frequency")), asc=False), 1, max_peaks).alias("peaks"))
    base = df.groupBy(*by).agg(F.first("segments").alias("segment_count"), F.first("length").alias("segment_length"), F.min(F.when(F.col("bin") == 1, F.col("frequency"))).alias("frequency_resolution"), F.sqrt(F.greatest(area, F.lit(0.0))).alias("integrated_rms"))
    out = base.join(top, by).join(found, by, "left")
    return out.withColumns(
        {
            "median_amplitude_density": F.sqrt("median_psd"),
            "dominant_to_median_ratio": F.when(F.col("median_psd") > 0, F.col("dominant_psd") / F.col("median_psd")),
            "peak_count": F.coalesce(F.size("peaks"), F.lit(0)),
            "first_peak_frequency": F.try_element_at("peaks", F.lit(1))["frequency"],
        }
    ).drop("peaks")


def averaging_factors(n: int, points: int = 40, min_pairs: int = 20) -> list[int]:
    """Distinct integer cluster sizes, evenly spaced on a logarithmic scale, that leave ``min_pairs`` differences."""
    most = (n - min_pairs + 1) // 2
    if most < 2:
        return []
    return [int(m) for m in np.unique(np.clip(np.rint(np.logspace(0, np.log10(most), points)).astype(int), 1, most))]


#: Rows after a block that it also sees; averaging factors up to half of it are computed within blocks.
ALLAN_HALO = 32_768


def allan_curve(series: DataFrame, keys: Sequence[str], axes: Sequence[str], points: int = 40, min_pairs: int = 20, min_samples: int = 2000, min_duration: float = 30.0, block_rows: int = BLOCK_ROWS, halo_rows: int = ALLAN_HALO) -> DataFrame:
    """keys, axis, m, tau, adev: overlapping Allan deviation.

    With C the running sum, the difference of neighbouring cluster means at i is (C[i+2m] - 2 C[i+m] + C[i]) / m.  Blocks
    that also see the ``halo_rows`` rows after them compute all factors up to half the halo at once, from a running sum
    of their own.  Only series longer than a block have greater factors; for those the running sums of the whole series
    are sent to the three places each is needed at.
    """
    keys, axes = list(keys), list(axes)
    df = series.where((F.col("n") >= min_samples) & ((F.col("n") - 1) * F.col("dt") >= min_duration))
    head = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    own = F.floor(F.col("pos") / block_rows).cast("bigint")
    before = F.when((F.col("pos") % block_rows < halo_rows) & (own > 0), own - 1)
    cut = df.withColumn("_block", F.explode(F.array_compact(F.array(own, before)))).select(*keys, "_block", "pos", "n", "dt", *axes)

    def near(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        parts = []
        values, pos, total = frame[axes].to_numpy(float), frame["pos"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            n = int(total[a])
            factors = [m for m in averaging_factors(n, points, min_pairs) if _is_near(m, n, block_rows, halo_rows)]
            if len(averaging_factors(n, points, min_pairs)) < 3 or not factors:
                continue
            sums = np.concatenate([np.zeros((1, len(axes))), np.cumsum(values[a:b] - values[a], axis=0)])
            home = int(min(block_rows - pos[a] % block_rows, b - a))
            for m in factors:
                # Starts of this block whose 2 m rows lie in the series.
                count = min(home, n - 2 * m + 1 - int(pos[a]), b - a - 2 * m + 1)
                if count <= 0:
                    continue
                d = (sums[2 * m : 2 * m + count] - 2 * sums[m : m + count] + sums[:count]) / m
                parts.append([*[frame[k].iloc[a] for k in keys], m, float(frame["dt"].iloc[a]), count, *np.square(d).sum(axis=0)])
        return pd.DataFrame(parts, columns=[*keys, "m", "dt", "pairs", *axes])

    schema = f"{head}, m bigint, dt double, pairs bigint, " + ", ".join(f"`{a}` double" for a in axes)
    sums = map_whole_groups(cut, [*keys, "_block"], ["pos"], near, schema)
    longest = df.agg(F.max("n")).first()[0] or 0
    if longest > block_rows:
        sums = sums.unionByName(_far_sums(df.where(F.col("n") > block_rows), keys, axes, points, min_pairs, block_rows, halo_rows))
    avar = sums.groupBy(*keys, "m", "dt").agg(*[(0.5 * F.sum(x) / F.sum("pairs")).alias(x) for x in axes])
    long = avar.select(*keys, "m", "dt", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.sqrt(a).alias("adev")) for a in axes])).alias("v"))
    return long.select(*keys, F.col("v.axis").alias("axis"), "m", (F.col("m") * F.col("dt")).alias("tau"), F.col("v.adev").alias("adev"))


def _is_near(m: int, n: int, block_rows: int, halo_rows: int) -> bool:
    """Whether a block sees all rows the factor needs: always where the series is one block."""
    return n <= block_rows or 2 * m <= halo_rows


def _far_sums(df: DataFrame, keys: list[str], axes: list[str], points: int, min_pairs: int, block_rows: int, halo_rows: int) -> DataFrame:
    """The sums of squares for factors beyond the halo: C[i], C[i+m] and C[i+2m] meet by a grouped sum on (m, i)."""

    def far(n):
        return [m for m in averaging_factors(n, points, min_pairs) if not _is_near(m, n, block_rows, halo_rows)]

    # One row per series, not per sample.
    sizes = df.where("pos = 0").select(*keys, F.udf(far, "array<int>")("n").alias("factors"), *[F.col(a).alias(f"_0_{a}") for a in axes]).where(F.size("factors") > 0)
    # Sums of values without their first one: no large offset accumulates.
    df = attach(df, sizes, keys, "inner")
    sums = with_running_sum(df, keys, "pos", {f"c_{a}": F.col(a) - F.col(f"_0_{a}") for a in axes}, block_rows)
    cols = [f"c_{a}" for a in axes]
    zero = sums.where("pos = 0").select(*keys, F.lit(0).cast("bigint").alias("i"), "n", "dt", "factors", *[F.lit(0.0).alias(c) for c in cols])
    c = zero.unionByName(sums.select(*keys, (F.col("pos") + 1).alias("i"), "n", "dt", "factors", *cols)).withColumn("m", F.explode(F.col("factors").cast("array<bigint>")))
    places = F.explode(F.array(*[F.struct((F.col("i") - k * F.col("m")).alias("at"), F.lit(w).alias("w")) for k, w in ((0, 1.0), (1, -2.0), (2, 1.0))]))
    c = c.withColumn("p", places).where((F.col("p.at") >= 0) & (F.col("p.at") <= F.col("n") - 2 * F.col("m")))
    d = c.groupBy(*keys, "m", "dt", F.col("p.at").alias("at")).agg(*[(F.sum(F.col(x) * F.col("p.w")) / F.col("m")).alias(x) for x in cols])
    return d.groupBy(*keys, "m", "dt").agg(F.count("*").alias("pairs"), *[F.sum(F.col(x) * F.col(x)).alias(a) for a, x in zip(axes, cols, strict=True)])


def allan_metrics(curve: DataFrame, keys: Sequence[str], slope_tolerance: float = 0.15) -> DataFrame:
    """Minimum, white-noise coefficient and bias instability of each axis from the slopes of its curve.

    Slopes are local lines over five points in logarithms; a region needs at least two points within the tolerance.
    """
    by = [*keys, "axis"]
    w = Window.partitionBy(*by).orderBy("m").rowsBetween(-2, 2)
    x, y = F.log10("tau"), F.log10(F.when(F.col("adev") > 0, F.col("adev")))
    df = curve.withColumns({"x": x, "y": y})
    df = df.withColumns({"slope": F.regr_slope("y", "x").over(w), "around": F.count("y").over(w), "rows": F.count("*").over(w)})
    slope = F.when((F.col("around") >= 3) & (F.col("around") == F.col("rows")), F.col("slope"))
    df = df.withColumn("slope", slope)
    white, flat = F.abs(F.col("slope") + 0.5) <= slope_tolerance, F.abs("slope") <= slope_tolerance
    out = df.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.min("adev").alias("minimum_deviation"),
        F.min_by("tau", F.struct("adev", "m")).alias("tau_at_minimum"),
        F.max("tau").alias("maximum_averaging_time"),
        F.count(F.when(white, 1)).alias("white_points"),
        F.median(F.when(white, F.col("adev") * F.sqrt("tau"))).alias("random_walk_coefficient"),
        F.median(F.when(white, F.col("slope"))).alias("white_slope"),
        F.count(F.when(flat, 1)).alias("flat_points"),
        (F.median(F.when(flat, F.col("adev"))) / BIAS_INSTABILITY_FACTOR).alias("bias_instability"),
    )
    keep = lambda n, c: F.when(F.col(n) >= 2, F.col(c)).alias(c)
    return out.select(
        *by, "points", "minimum_deviation", "tau_at_minimum", "maximum_averaging_time", keep("white_points", "random_walk_coefficient"), keep("white_points", "white_slope"), keep("flat_points", "bias_instability")
    )
