"""Problem 7: mixing sources to target weights.

A time-varying curriculum: over training progress t from 0 to 1 source s is drawn with weight

    w_s(t) = share_s * (1 + ramp_s * (2 t - 1)),        -1 <= ramp_s <= 1,

where the ramps are first centred on their mean (weighted by share) and, should one leave -1 to 1 by that, scaled back:
so the weights of all sources have the same sum at every t and the mix is equally dense throughout.  The demand of s up to t is total * share_s * ((1 - ramp_s) t + ramp_s t**2), which at t = 1 is the target share.  A
document that begins after c tokens of its source is placed at the t where that demand reaches c: the integral of the
schedule, inverted.  Sorting all documents by t gives the training order.

A source is repeated in whole passes, each in an order of its own, until its demand is met or ``max_repeats`` passes
are used; the report gives the shares really reached.

The running token count of a source, which may hold a third of all rows, comes from two levels: sums per hash bucket
(a small table, accumulated in order of the buckets) and running sums inside a bucket, of ``BUCKET_DOCUMENTS`` documents
about.

Defined results: sources are compared without case, blanks and separators; documents of no target source, without
source or without tokens take no part; a target source without documents is reported with share 0; max_repeats below 1
counts as 0; repeated target rows of a source count once (the largest share); an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.joins import Written, attach, written

#: Documents of a source in one hash bucket, about; the number of buckets follows the largest source.
BUCKET_DOCUMENTS = 20_000


def source_key(c: str | Column) -> Column:
    """A source's name without case, blanks and separators."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+", "")


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None, capacity: int | None = None) -> DataFrame:
    """One row per target source: source, key, share, repeats, available, demand, reachable.

    ``sized`` has doc_id, source, tokens.  Documents of more than ``capacity`` tokens take no part.  ``total`` is the
    size of the mix in tokens; by default that of all documents that take part, of whatever source.
    """
    fit = _fitting(sized, capacity)
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_key("source").alias("key")).agg(
        F.max_by("source", "target_share").alias("source"), F.max("target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("repeats")
    )
    have = fit.groupBy(source_key("source").alias("key")).agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    if total is None:
        total = fit.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    df = wanted.join(have.where(F.col("key").isNotNull()), "key", "left").withColumn("total", F.lit(total).cast("bigint"))
    repeats = F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(0))
    df = df.select("key", "source", "share", repeats.alias("repeats"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("share") * F.col("total")).alias("demand"), "total")
    return df.withColumn("reachable", F.col("available") * F.col("repeats") >= F.col("demand"))


def _fitting(sized: DataFrame, capacity: int | None) -> DataFrame:
    return sized if capacity is None else sized.where(F.col("tokens") <= capacity)


def scheduled(goals: DataFrame, ramps: dict[str, float] | None) -> DataFrame:
    """Sources of ``goals`` that take part, with ``passes`` and ``ramp``: centred, so that all weights sum to the same at every t."""
    slope = F.lit(0.0)
    for name, r in (ramps or {}).items():
        if not -1 <= r <= 1:
            raise ValueError(f"ramp of {name} is not within -1 and 1: {r}")
        slope = F.when(F.col("key") == source_key(F.lit(name)), F.lit(float(r))).otherwise(slope)
    every = Window.partitionBy()  # one row per source
    passes = F.least(F.col("repeats"), F.ceil(F.try_divide(F.col("demand"), F.col("available")))).cast("int")
    df = goals.where("available > 0 AND demand > 0").withColumns({"passes": passes, "ramp": slope}).where("passes > 0")
    df = df.withColumn("ramp", F.col("ramp") - F.sum(F.col("ramp") * F.col("share")).over(every) / F.sum("share").over(every))
    return df.withColumn("ramp", F.col("ramp") / F.greatest(F.max(F.abs("ramp")).over(every), F.lit(1.0)))


def mix(sized: DataFrame, targets: DataFrame, ramps: dict[str, float] | None = None, total: int | None = None, capacity: int | None = None, bucket_documents: int = BUCKET_DOCUMENTS, goals: DataFrame | None = None) -> DataFrame:
    """doc_id, source, pass_no, tokens, position: the documents of the mix, range-sorted by position.

    ``ramps`` gives the slope of a source's weight over training, by name as in ``targets``; 0 where absent.  ``goals``
    is the result of :func:`plan`, where it is at hand.
    """
    goals = plan(sized, targets, total, capacity) if goals is None else goals
    goals = scheduled(goals, ramps)
    done = written(goals.select("key", F.col("source").alias("name"), "available", "documents", "demand", "passes", "ramp"))
    most = done.df.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    buckets = max(16, -(-most // bucket_documents))
    docs = _fitting(sized, capacity).where("tokens > 0").select("doc_id", "tokens", source_key("source").alias("key"))
    rows = attach(docs, Written(done.df.drop("documents"), done.bytes), ["key"], "inner").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    rows = rows.withColumn("at", F.xxhash64("doc_id", "pass_no")).withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 20), F.lit(buckets)))
    sums = rows.groupBy("key", "pass_no", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("key").orderBy("pass_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "pass_no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "pass_no", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.join(sums, ["key", "pass_no", "bucket"])
    start = F.col("base") + F.col("inner")
    rows = rows.withColumn("start", start).where(F.col("start") < F.col("demand"))
    # A source that runs dry is spread over the whole of training, not over its first part.
    u = F.col("start") / F.least(F.col("demand"), F.col("available") * F.col("passes"))
    r = F.col("ramp")
    position = F.when(F.abs(r) < 1e-9, u).otherwise(F.try_divide((F.sqrt((1 - r) * (1 - r) + 4 * r * u) - (1 - r)), 2 * r))
    return rows.select("doc_id", F.col("name").alias("source"), "pass_no", "tokens", (position + 0.0).alias("position")).orderBy("position", "doc_id", "pass_no")


def report(mixed: DataFrame, goals: DataFrame) -> DataFrame:
    """source, target_share, reached_share, tokens, demand, documents, passes, reached (whether the demand was met)."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("pass_no").alias("passes"))
    df = goals.select("source", F.col("share").alias("target_share"), "demand").join(got, "source", "left")
    df = df.withColumn("mixed", F.sum("tokens").over(Window.partitionBy()))  # one row per source
    zero = F.lit(0)
    share = F.coalesce(F.try_divide(F.col("tokens"), F.col("mixed")), F.lit(0.0))
    df = df.select("source", "target_share", share.alias("reached_share"), *[F.coalesce(c, zero).alias(c) for c in ("tokens", "documents", "passes")], "demand")
    return df.withColumn("reached", F.col("tokens") >= F.col("demand"))
