"""Problem 3: irregular readings onto a regular grid.

With P the nominal period of a recording, slot k stands for the time k * P and holds the readings with
floor(timestamp / P + 0.5) = k.  The result has one row per slot from the first to the last slot with a reading:

* ``observed``: a reading lies in the slot; the one nearest to k * P is taken;
* ``filled``: the value at k * P of a shape-preserving monotone cubic (Fritsch-Carlson) through the readings of the
  segment;
* ``gap``: a slot of a run of more than ``max_gap`` empty slots; the value stays NULL.  Segments end at such runs.

Time is cut into shards of ``shard_slots`` slots, so a recording of any length is spread over tasks.  The cubic of an
interval needs two readings on either side; the shards exchange those through a table of at most four edge readings
per shard.  Everything is built-in expressions.

Defined results: rows without timestamp or finite measurement are no readings; recordings without a positive nominal
period, without a reading or with a NULL id give no rows; equal distances to the slot time go to the smaller row_ord,
then row_id; a segment of one reading fills nothing, of two readings is a straight line; runs of millions of empty
slots come out in pieces, never as one array; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.columns import finite
from plumbline.joins import attach

#: Slots of one time shard.
SHARD_SLOTS = 8_192
#: Empty slots in a row that are still filled.
MAX_GAP = 5
#: Empty slots produced at once.
PIECE = 65_536


def _secant(a: Column, b: Column) -> Column:
    return (b["v"] - a["v"]) / (b["t"] - a["t"])


def _inner_slope(a: Column, b: Column, c: Column) -> Column:
    """Weighted harmonic mean of the secants around b, 0 at a local extremum."""
    h0, h1 = b["t"] - a["t"], c["t"] - b["t"]
    d0, d1 = _secant(a, b), _secant(b, c)
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(F.signum(d0) * F.signum(d1) <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end_slope(a: Column, b: Column, c: Column) -> Column:
    """One-sided three-point slope at a, limited so that the cubic keeps the shape of the data."""
    h0, h1 = F.abs(b["t"] - a["t"]), F.abs(c["t"] - b["t"])
    d0, d1 = _secant(a, b), _secant(b, c)
    d = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(d0), F.lit(0.0)).when((F.signum(d0) != F.signum(d1)) & (F.abs(d) > 3 * F.abs(d0)), 3 * d0).otherwise(d)


def _slope(before: Column, at: Column, after: Column, beyond: Column) -> Column:
    """Slope at ``at``: inner with both neighbours, else one-sided with ``beyond`` on the known side, else the secant."""
    return F.when(before.isNotNull(), _inner_slope(before, at, after)).when(beyond.isNotNull(), _end_slope(at, after, beyond)).otherwise(_secant(at, after))


def _cubic(a: dict[str, Column], b: dict[str, Column], da: Column, db: Column, t: Column) -> Column:
    h = b["t"] - a["t"]
    s = (t - a["t"]) / h
    return (
        (2 * s * s * s - 3 * s * s + 1) * a["v"]
        + (s * s * s - 2 * s * s + s) * h * da
        + (3 * s * s - 2 * s * s * s) * b["v"]
        + (s * s * s - s * s) * h * db
    )


def readings_by_slot(samples: DataFrame, recordings: DataFrame, value: str, shard_slots: int) -> DataFrame:
    """dataset_id, shard, slot_no, period, p: struct(t, v, slot), n: readings of the slot; partitioned by (dataset_id, shard)."""
    periods = recordings.where(F.col("nominal_period_s") > 0).groupBy("dataset_id").agg(F.max("nominal_period_s").alias("period"))
    ok = finite("timestamp") & finite(value) & F.col("dataset_id").isNotNull()
    rows = samples.where(ok).select("dataset_id", "row_ord", "row_id", F.col("timestamp").cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    rows = attach(rows, periods, ["dataset_id"], "inner")
    rows = rows.withColumn("slot_no", F.floor(F.col("t") / F.col("period") + 0.5).cast("bigint"))
    rows = rows.withColumn("shard", F.floor(F.col("slot_no") / shard_slots).cast("bigint"))
    # Grouping by keys that include those of the exchange reuses it: raw rows are shuffled once.
    nearest = F.struct(F.abs(F.col("t") - F.col("slot_no") * F.col("period")), "row_ord", "row_id", "t", "v")
    slots = rows.repartition("dataset_id", "shard").groupBy("dataset_id", "shard", "slot_no").agg(F.min(nearest).alias("best"), F.count("*").alias("n"), F.first("period").alias("period"))
    return slots.select("dataset_id", "shard", "slot_no", "period", "n", F.struct(F.col("best.t").alias("t"), F.col("best.v").alias("v"), F.col("slot_no").alias("slot")).alias("p"))


def regular_grid(samples: DataFrame, recordings: DataFrame, value: str = "measurement", max_gap: int = MAX_GAP, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """dataset_id, slot_no, slot_time, value, status, readings."""
    slots = readings_by_slot(samples, recordings, value, shard_slots)
    w = Window.partitionBy("dataset_id", "shard").orderBy("slot_no")
    near = slots.select("*", *[F.lag("p", i).over(w).alias(f"b{i}") for i in (1, 2)], *[F.lead("p", i).over(w).alias(f"a{i}") for i in (1, 2)])

    # Halo: the last and first two readings of each shard, seen in the order of the shards of a recording.
    edge = near.where(F.col("b2").isNull() | F.col("a2").isNull())
    v = Window.partitionBy("dataset_id").orderBy("slot_no")
    edge = edge.select("dataset_id", "shard", "slot_no", *[F.lag("p", i).over(v).alias(f"b{i}") for i in (1, 2)], *[F.lead("p", i).over(v).alias(f"a{i}") for i in (1, 2)])
    halo = edge.groupBy("dataset_id", "shard").agg(
        F.min_by("b1", "slot_no").alias("h_b1"), F.min_by("b2", "slot_no").alias("h_b2"), F.max_by("a1", "slot_no").alias("h_a1"), F.max_by("a2", "slot_no").alias("h_a2")
    )
    df = near.join(halo, ["dataset_id", "shard"], "left")
    b1, a1 = F.coalesce("b1", "h_b1"), F.coalesce("a1", "h_a1")
    a2 = F.when(F.col("a1").isNull(), F.col("h_a2")).when(F.col("a2").isNull(), F.col("h_a1")).otherwise(F.col("a2"))
    df = df.select("dataset_id", "slot_no", "period", "n", "p", b1.alias("before"), a1.alias("after"), a2.alias("beyond"))

    here, after = F.col("p"), F.col("after")
    missing = F.coalesce(after["slot"] - F.col("slot_no") - 1, F.lit(0))
    joined = lambda x, y: F.coalesce(y["slot"] - x["slot"] - 1 <= max_gap, F.lit(False))
    before = F.when(joined(F.col("before"), here), F.col("before"))
    beyond = F.when(joined(after, F.col("beyond")), F.col("beyond"))
    fill = (missing > 0) & (missing <= max_gap)
    df = df.select(
        "dataset_id",
        "slot_no",
        "period",
        "n",
        # Plain columns: fields of structs are not pruned correctly through the two explodes below.
        *[side[c].alias(f"{name}_{c}") for name, side in (("here", here), ("next", after)) for c in ("t", "v")],
        missing.alias("missing"),
        F.when(fill, _slope(before, here, after, beyond)).alias("da"),
        # The slope at the right end is the mirror image: its inner neighbours are here and beyond.
        F.when(fill, F.when(beyond.isNotNull(), _inner_slope(here, after, beyond)).when(before.isNotNull(), _end_slope(after, here, before)).otherwise(_secant(here, after))).alias("db"),
    )
    df = df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("missing") / PIECE).cast("int"))))
    low = F.col("slot_no") + F.col("piece").cast("bigint") * PIECE
    high = F.least(low + PIECE - 1, F.col("slot_no") + F.col("missing"))
    df = df.withColumn("k", F.explode(F.sequence(low, high)))
    time = F.col("k") * F.col("period")
    seen = F.col("k") == F.col("slot_no")
    filled = F.col("da").isNotNull()
    ends = [{c: F.col(f"{name}_{c}") for c in ("t", "v")} for name in ("here", "next")]
    return df.select(
        "dataset_id",
        F.col("k").alias("slot_no"),
        time.alias("slot_time"),
        F.when(seen, F.col("here_v")).when(filled, _cubic(*ends, F.col("da"), F.col("db"), time)).alias("value"),
        F.when(seen, F.lit("observed")).when(filled, F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
        F.when(seen, F.col("n")).otherwise(F.lit(0)).alias("readings"),
    )
