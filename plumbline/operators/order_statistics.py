"""Exact percentiles of groups of any size, several columns at once.

``percentile`` and ``median`` hold every distinct value of a group in one task.  Here a bounded sketch per group
(``percentile_approx``) first brackets each percentile; then the rows below a bracket are counted, and only the few rows
inside it are ranked.  The bracket's width is chosen by the group's size, the result never depends on it: a bracket that
missed its ranks would raise an error.  Where the size of the whole input proves that no group can hold many values,
the plain aggregate does the same in one pass.

Defined results: NULL and NaN values are left out; a column without values gives NULL; ties count as often as they
occur; groups with NULL keys are groups like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.joins import attach, input_bytes, written

#: Sketch error is at most a share of 1 / ACCURACY of a group's rows.
ACCURACY = 10_000
#: (rows from which it holds, half width of the bracket as a share of rows): two ranks and the sketch's error at least.
WIDTHS = ((20_000, 4 / ACCURACY), (200, 0.0105))
#: Inputs of at most so many bytes have groups that one task can hold.
SMALL_BYTES = 64 << 20


def summary(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], values: dict[str, Column], probabilities: Sequence[float] = (0.5,), source: DataFrame | None = None) -> DataFrame:
    """keys, ``aggs`` and, per name in ``values``, the array of its percentiles.

    ``source`` is a table that all values of ``rows`` come from, where that is simpler to look at.
    """
    if input_bytes(rows if source is None else source) <= SMALL_BYTES:
        plain = [F.percentile(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.array(*[F.lit(float(p)) for p in probabilities])).alias(n) for n, c in values.items()]
        return rows.groupBy(*keys).agg(*aggs, *plain)
    found = percentiles(rows, keys, values, probabilities)
    return null_safe_join(rows.groupBy(*keys).agg(*aggs), found, keys) if aggs else found


def percentiles(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """keys and, per name in ``values``, the array of its percentiles (linear between ranks), for groups of any size."""
    keys, names, ps = list(keys), list(values), list(probabilities)
    number = lambda c: F.when(~F.isnan(c), c)
    rows = rows.select(F.struct(*keys).alias("_k") if keys else F.lit(0).alias("_k"), *[number(c.cast("double")).alias(f"v_{n}") for n, c in values.items()])
    asked = [min(max(p + s * w, 0.0), 1.0) for _, w in WIDTHS for p in ps for s in (-1, 1)]
    aggs = []
    for n in names:
        aggs += [F.count(f"v_{n}").alias(f"n_{n}"), F.percentile_approx(f"v_{n}", asked, ACCURACY).alias(f"b_{n}")]
    sketch = rows.groupBy("_k").agg(*aggs)

    def bracket(n: str, j: int) -> tuple[Column, Column]:
        at = lambda i, s: F.col(f"b_{n}")[2 * (i * len(ps) + j) + s]
        low, high = F.lit(float("-inf")), F.lit(float("inf"))
        for i in reversed(range(len(WIDTHS))):
            big = F.col(f"n_{n}") >= WIDTHS[i][0]
            low, high = F.when(big, at(i, 0)).otherwise(low), F.when(big, at(i, 1)).otherwise(high)
        return low, high

    marks = []
    for n in names:
        for j in range(len(ps)):
            low, high = bracket(n, j)
            marks += [low.alias(f"l_{n}_{j}"), high.alias(f"h_{n}_{j}")]
    brackets = written(sketch.select("_k", *[f"n_{n}" for n in names], *marks))
    near = attach(rows, brackets, ["_k"], "inner")
    entries = []
    for i, n in enumerate(names):
        v = F.col(f"v_{n}")
        for j in range(len(ps)):
            inside = F.when(v >= F.col(f"l_{n}_{j}"), v)
            entries.append(F.when(v <= F.col(f"h_{n}_{j}"), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n_{n}").alias("n"), inside.alias("v"))))
    long = near.select("_k", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("_k", "e.*")
    # Rows below a bracket have no value any more: they are one counted entry, before any shuffle.
    counted = long.groupBy("_k", "i", "j", "n", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("_k", "i", "j").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(w))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in ps]), F.col("j") + 1)
    pos = p * (F.col("n") - 1)
    first = F.floor(pos + 1e-9)
    part = F.greatest(pos - first, F.lit(0.0))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    got = ranked.groupBy("_k", "i", "j", "n").agg(at(first).alias("x0"), at(first + 1).alias("x1"), below.alias("below"))
    step = F.when(part < 1e-9, F.lit(0.0)).otherwise((F.col("x1") - F.col("x0")) * part)
    missed = (F.col("below") > first) | F.col("x0").isNull() | ((part >= 1e-9) & F.col("x1").isNull())
    exact = F.when(missed, F.raise_error(F.lit("a bracket missed its percentile")).cast("double")).otherwise(F.col("x0") + step)
    got = got.select("_k", "i", "j", exact.alias("x"))
    wide = got.groupBy("_k").agg(*[F.array(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("x"))) for j in range(len(ps))]).alias(n) for i, n in enumerate(names)])
    return wide.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *names)


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``a`` joined with ``b`` (one row per group) on keys of which NULL equals NULL."""
    pack = lambda df: df.withColumn("_k", F.struct(*keys))
    return pack(a).join(pack(b).drop(*keys), ["_k"], how).drop("_k")
