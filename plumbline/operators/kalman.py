"""Vectorised Kalman filtering of many short sources at once (plain NumPy).

Sources are padded into a (time, source) matrix and all of them are advanced by one sample per step, so the Python
loop runs over the longest source of the chunk and not over rows.  :mod:`plumbline.operators.spikes` decides how
Spark cuts the rows into chunks.

Two models, each with two states:

* ``level``: y[k] = level[k] + gain * x[k] + noise, level a random walk, gain a constant with a prior;
* ``trend``: y[k] = level[k] + noise, level[k+1] = level[k] + slope[k] * dt, slope a random walk.

The process-to-noise ratio of each source is the maximum-likelihood member of a fixed grid; the noise variance is
concentrated out.  A long source is cut into overlapping segments, columns of their own, whose likelihoods are pooled.

Forecasts run forwards and, the same filter on reversed time, backwards.  A reading is judged by the weaker of its two
standardised innovations: an excursion is foreseen from neither side, while a lasting change is from one.  The innovation
variance is adapted to the innovations around (a burst of movement raises them all), and updates of flagged readings
are withheld, so a forecast's variance grows through an excursion until a change of the source is as plausible.
"""

from __future__ import annotations

import numpy as np

#: Process-to-noise variance ratios tried for each source.
LEVEL_RATIOS = (0.0, 1e-3, 1e-2, 0.1, 1.0)
TREND_RATIOS = (1e-8, 1e-5, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0)


def pad(starts: np.ndarray, ends: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows [starts[i], ends[i]) of each column as column i of a NaN-padded matrix; the index matrix comes first."""
    length = int((ends - starts).max()) if len(starts) else 0
    idx = starts[None, :] + np.arange(length)[:, None]
    inside = idx < ends[None, :]
    idx = np.where(inside, idx, 0)
    return (np.where(inside, idx, -1), *(np.where(inside, c[idx], np.nan) for c in columns))


def clipped_scale(e: np.ndarray, k: float = 5.0, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise mean and standard deviation after repeated k-sigma clipping; NaN entries are ignored."""
    if not e.shape[0]:
        return np.full(e.shape[1], np.nan), np.full(e.shape[1], np.nan)
    # The clipping starts from a wide quantile span: a median deviation is far too small for one-sided noise.
    ordered = np.sort(e, axis=0)
    n = np.isfinite(ordered).sum(axis=0)
    at = lambda q: np.take_along_axis(ordered, np.floor(q * np.maximum(n - 1, 0)).astype(int)[None, :], axis=0)[0]
    center, sd = at(0.5), np.maximum(at(0.9) - at(0.1), 1e-300)
    for _ in range(rounds):
        keep = np.abs(e - center) <= k * sd
        count = np.maximum(keep.sum(axis=0), 1)
        kept = np.where(keep, e, 0.0)
        mean = kept.sum(axis=0) / count
        new = np.sqrt(np.where(keep, (e - mean) ** 2, 0.0).sum(axis=0) / count)
        center, sd = np.where(n > 0, mean, center), np.where(new > 0, new, sd)
    return center, sd


def run_filter(y, use, dt, x, r, ratio, trend, level0, level_sd, second_sd):
    """Predicted mean and variance (without noise) of every sample from the samples before it.

    ``second_sd`` is the prior deviation of the gain (level model) or of the slope (trend model).
    """
    length, s = y.shape
    mean, var = np.empty((length, s)), np.empty((length, s))
    a, b = level0.copy(), np.zeros(s)
    p00, p01, p11 = level_sd**2, np.zeros(s), second_sd**2
    q = r * ratio
    y0 = np.where(use, y, 0.0)
    weight = use.astype(float)
    for k in range(length):
        if trend:
            d = dt[k]
            a = a + d * b
            p00 = p00 + d * (2 * p01 + d * p11) + q * d * d * d / 3
            p01 = p01 + d * p11 + q * d * d / 2
            p11 = p11 + q * d
            m, h0, h1 = a, p00, p01
            v = p00
        else:
            h = x[k]
            p00 = p00 + q * dt[k]
            m = a + h * b
            h0, h1 = p00 + h * p01, p01 + h * p11
            v = h0 + h * h1
        mean[k], var[k] = m, v
        w = weight[k] / (v + r)
        nu = (y0[k] - m) * w
        a = a + h0 * nu
        b = b + h1 * nu
        p00 = np.maximum(p00 - h0 * h0 * w, 0.0)
        p01 = p01 - h0 * h1 * w
        p11 = np.maximum(p11 - h1 * h1 * w, 0.0)
    return mean, var


def fit_ratio(y, use, dt, x, r, trend, level0, level_sd, second_sd, owner):
    """Per column: (noise variance, ratio) of greatest concentrated likelihood over the grid, pooled over columns of one owner."""
    grid = TREND_RATIOS if trend else LEVEL_RATIOS
    pool = lambda v: np.bincount(owner, v)[owner]
    best = np.full(y.shape[1], np.inf)
    out_r, out_q = r.copy(), np.full(y.shape[1], grid[0])
    n = use.sum(axis=0)
    top = np.floor(0.95 * np.maximum(n - 1, 0)).astype(int)[None, :]
    # All members of the grid are filtered at once, as columns beside each other.
    beside = lambda v: np.tile(v, len(grid))
    wide = [np.tile(v, (1, len(grid))) for v in (y, use, dt, x)]
    means, variances = run_filter(*wide, beside(r), np.repeat(grid, y.shape[1]), trend, beside(level0), beside(level_sd), beside(second_sd))
    for k, ratio in enumerate(grid):
        columns = slice(k * y.shape[1], (k + 1) * y.shape[1])
        mean, var = means[:, columns], variances[:, columns]
        f = (var + r) / r
        u = np.where(use, (y - mean) ** 2 / (f * r), np.nan)
        # Trimmed: the share of spikes is unknown here and must not choose the model.
        limit = np.take_along_axis(np.sort(u, axis=0), top, axis=0)
        inner = u <= limit
        count = np.maximum(inner.sum(axis=0), 1)
        s2 = np.maximum(pool(np.where(inner, u, 0.0).sum(axis=0)) / pool(count), 1e-30)
        cost = pool(count) * np.log(s2) + pool(np.where(inner, np.log(f), 0.0).sum(axis=0))
        better = (cost < best - 1e-9) & (pool(n) > 4)
        best = np.where(better, cost, best)
        out_q = np.where(better, ratio, out_q)
        out_r = np.where(better, r * s2 / 0.8, out_r)
    return out_r, out_q


def forecasts(y, use, dt, x, r, ratio, trend, level0, level_sd, second_sd):
    """Standardised innovations by the weaker of both forecasts, and the forward innovation variances.

    Near an end of a source the forecast from that end knows little; where its variance is over four times the other's
    the other alone counts.
    """
    back = np.concatenate([np.zeros((1, y.shape[1])), dt[:0:-1]], axis=0)
    both = [np.concatenate(v, axis=1) for v in ((y, y[::-1]), (use, use[::-1]), (dt, back), (x, x[::-1]))]
    m, v = run_filter(*both, *[np.tile(c, 2) for c in (r, ratio)], trend, *[np.tile(c, 2) for c in (level0, level_sd, second_sd)])
    n = y.shape[1]
    mf, vf, mb, vb = m[:, :n], v[:, :n], m[:, n:], v[:, n:]
    ff, fb = vf + r, vb[::-1] + r
    zf, zb = (y - mf) / np.sqrt(ff), (y - mb[::-1]) / np.sqrt(fb)
    weaker = np.where(zf * zb <= 0, 0.0, np.where(np.abs(zf) <= np.abs(zb), zf, zb))
    return np.where(ff > 4 * fb, zb, np.where(fb > 4 * ff, zf, weaker)), ff


def _regress(e, h):
    """Column-wise clipped least squares of e on h: (intercept, slope, residual, scale)."""
    a, _ = clipped_scale(e)
    b = np.zeros(e.shape[1])
    for _ in range(3):
        res = e - a - b * h
        _, s = clipped_scale(res)
        keep = np.abs(res) <= 5 * s
        n = np.maximum(keep.sum(axis=0), 1)
        hm, em = np.where(keep, h, 0.0).sum(axis=0) / n, np.where(keep, e, 0.0).sum(axis=0) / n
        vh = np.where(keep, (h - hm) ** 2, 0.0).sum(axis=0)
        b = np.where(vh > 0, np.where(keep, (h - hm) * (e - em), 0.0).sum(axis=0) / np.where(vh > 0, vh, 1.0), 0.0)
        a = em - b * hm
    res = e - a - b * h
    return a, b, res, clipped_scale(res)[1]


def _suspects(y, lengths=(1, 2, 3, 4, 6, 8, 12, 16, 24, 32), k=6.0):
    """Runs of samples that lie off the line between their neighbours, all on one side.

    "Off" is more than k times what the same statistic usually is in the source; only a start for the filter, which
    judges these samples again.  Runs of more than three also need a jump at either end, against the straight
    continuation of the two samples beyond it: a smooth wave of movement has none.
    """
    length = y.shape[0]
    out = np.zeros(y.shape, bool)
    jump_in, jump_out = np.full(y.shape, np.nan), np.full(y.shape, np.nan)
    if length >= 3:
        jump_in[2:] = y[2:] - 2 * y[1:-1] + y[:-2]
        jump_out[:-2] = jump_in[2:]
    scale = k * clipped_scale(jump_in)[1]
    leaps_in, leaps_out = np.abs(jump_in) > scale, np.abs(jump_out) > scale
    may_in, may_out = leaps_in | np.isnan(jump_in), leaps_out | np.isnan(jump_out)
    for w in lengths:
        if length < w + 2:
            break
        left, right = y[: length - w - 1], y[w + 1 :]
        off = np.stack([y[1 + j : length - w + j] - (left + (right - left) * (j + 1) / (w + 1)) for j in range(w)])
        _, usual = clipped_scale(off[w // 2])
        one_side = (off > 0).all(axis=0) | (off < 0).all(axis=0)
        hit = one_side & (np.abs(off).min(axis=0) > k * np.where(np.isfinite(usual), usual, np.inf))
        if w > 3:
            first, last = slice(1, length - w), slice(w, length - 1)
            hit &= may_in[first] & may_out[last] & (leaps_in[first] | leaps_out[last])
        for j in range(w):
            out[1 + j : length - w + j] |= hit
    return out


def _shifted(z, by):
    out = np.zeros_like(z)
    if by > 0:
        out[by:] = z[:-by]
    else:
        out[:by] = z[-by:]
    return out


def _fill_reference(y, t, x, x_mean, short=6):
    """``x`` with every missing reference of a source that has others filled from its neighbours in time.

    Between two references the line through them is taken, at either end the nearest one.  Where at most ``short`` rows
    in a row lack the reference, a step may lie anywhere among them: of the values between both neighbours the one that
    explains the reading best (after bias and gain of the source) is taken, so no step of the reference is an excursion.
    """
    with_ref = np.isfinite(x)
    gap = ~with_ref & np.isfinite(t) & with_ref.any(axis=0)
    if not gap.any():
        return x
    a, b, _, _ = _regress(y - x, np.where(with_ref, x - x_mean, 0.0))
    b = np.clip(np.nan_to_num(b), -0.5, 0.5)
    row = np.arange(len(x))[:, None]
    before = np.maximum.accumulate(np.where(with_ref, row, -1), axis=0)
    after = np.minimum.accumulate(np.where(with_ref, row, len(x))[::-1], axis=0)[::-1]
    before, after = np.where(before < 0, after, before), np.where(after >= len(x), before, after)
    before, after = np.clip(before, 0, len(x) - 1), np.clip(after, 0, len(x) - 1)
    left, right = np.take_along_axis(x, before, axis=0), np.take_along_axis(x, after, axis=0)
    t0, t1 = np.take_along_axis(t, before, axis=0), np.take_along_axis(t, after, axis=0)
    share = np.where(t1 > t0, (t - t0) / np.where(t1 > t0, t1 - t0, 1.0), 0.5)
    line = left + (right - left) * np.clip(share, 0.0, 1.0)
    best = np.clip((y - a + b * x_mean) / (1 + b), np.minimum(left, right), np.maximum(left, right))
    return np.where(gap, np.where((after - before - 1 <= short) & np.isfinite(best), best, line), x)


def standardised_innovations(y, t, x, trend, threshold, owner=None, rounds=4, span=8):
    """(standardised innovations, usual innovation variance) of each sample of each source (column), flagged updates withheld.

    ``y``, ``t``, ``x``: (time, source) matrices padded with NaN; ``x`` is the reference, NaN where absent; a source that
    has any is compared with references filled from their neighbours where they are missing.
    ``owner`` numbers the source of each column; columns of one source share its model.  The innovations have the shape of
    y (NaN where y is NaN), the variance is one number a column.  Sources of fewer than 8 samples get zeros: nothing is known
    about their normal behaviour.
    """
    owner = np.arange(y.shape[1]) if owner is None else owner
    with np.errstate(all="ignore"):
        step = np.diff(t, axis=0)
        ordered = np.sort(np.where(step > 0, step, np.nan), axis=0)
        n = np.isfinite(ordered).sum(axis=0)
        period = np.take_along_axis(ordered, (np.maximum(n - 1, 0) // 2)[None, :], axis=0)[0] if len(ordered) else np.ones(y.shape[1])
        period = np.where(np.isfinite(period) & (period > 0), period, 1.0)
        dt = np.concatenate([np.zeros((1, y.shape[1])), np.clip(np.nan_to_num(step / period), 0, 1e4)], axis=0)
        known = np.isfinite(y)
        with_ref = np.isfinite(x)
        has_ref = with_ref.any(axis=0)
        x_mean = np.where(with_ref, x, 0.0).sum(axis=0) / np.maximum(with_ref.sum(axis=0), 1)
        x = _fill_reference(y, t, x, x_mean)
        with_ref = np.isfinite(x)
        e = np.where(with_ref | ~has_ref, y - np.where(has_ref & with_ref, x, 0.0), np.nan)
        known = known & np.isfinite(e)
        h = np.where(with_ref & has_ref, x - x_mean, 0.0)
        center, sd = clipped_scale(e)
        if trend:
            _, s1 = clipped_scale(np.diff(e, axis=0))
            _, s2 = clipped_scale(e[2:] - 2 * e[1:-1] + e[:-2])
            s = np.minimum(s1 / np.sqrt(2), s2 / np.sqrt(6))
            out = _suspects(e)
            second_sd = 3 * s1
        else:
            center, _, res, s = _regress(e, h)
            out = np.abs(res) > 6 * s
            second_sd = np.where(has_ref, 0.05, 0.0)
        floor = 1e-9 * np.maximum(np.abs(center), 1e-6)
        s = np.where(np.isfinite(s), np.maximum(s, floor), 1.0)
        center = np.where(np.isfinite(center), center, 0.0)
        second_sd = np.where(np.isfinite(second_sd), second_sd, 0.0)
        level_sd = 10 * np.maximum(np.where(np.isfinite(sd), sd, s), s)
        prior = (trend, center, level_sd, second_sd)
        r, q = fit_ratio(e, known & ~out, dt, h, s**2, *prior, owner)
        r = np.maximum(r, floor**2)
        z, usual = np.zeros(y.shape), r
        for _ in range(rounds):
            z, f = forecasts(e, known & ~out, dt, h, r, q, *prior)
            size = np.where(known, np.abs(z), 0.0)
            inner = known & (size < 5)
            k = np.sqrt(np.where(inner, z * z, 0.0).sum(axis=0) / np.maximum(inner.sum(axis=0), 1))
            k = np.where(k > 0, k, 1.0)
            z, size = z / k, size / k
            ordered = np.sort(np.where(known, f, np.inf), axis=0)
            usual = np.take_along_axis(ordered, (known.sum(axis=0) // 2)[None, :].clip(max=len(f) - 1), axis=0)[0] * k * k
            # Adapted variance: a burst of movement raises the innovations of its whole neighbourhood.
            # Withheld readings do not count among them.
            others = np.where(out, np.inf, size)
            near = np.sort(np.stack([_shifted(others, j) for j in range(-span, span + 1) if j]), axis=0)
            some = np.isfinite(near).sum(axis=0)
            near = np.where(some > 0, np.take_along_axis(near, np.minimum(some // 2, 2 * span - 1)[None], axis=0)[0], 0.0)
            near = np.where(np.isfinite(near), near, 0.0)
            z, size = z / np.maximum(1.0, 1.4826 * near), size / np.maximum(1.0, 1.4826 * near)
            peak = size >= np.maximum.reduce([_shifted(size, j) for j in (-3, -2, -1, 1, 2, 3)])
            new = (size > threshold) & (out | peak)
            if (new == out).all():
                break
            out = new
        z = np.where(np.isfinite(y) & (known.sum(axis=0) >= 8), np.where(known, z, 0.0), np.nan)
        return np.where(np.isfinite(y), np.nan_to_num(z), np.nan), np.where(np.isfinite(usual), usual, r)
