"""Queries of the operators tagged llm (problems 4 and 6 to 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import finite
from plumbline.joins import attach, written
from plumbline.llm import dyadic_quantiles, mixing, packing, text_types, tokens
from plumbline.plans.catalogue import Catalogue
from plumbline.session import read, shared_folder

catalogue = Catalogue()

P4_KEYS = ["sensor_id", "revision"]
P4_PROBABILITIES = (0.05, 0.5, 0.95)
P4_FACTOR = 2.75


def _p4_digest(spark: SparkSession, d: str) -> DataFrame:
    return dyadic_quantiles.digest(read(spark, d, "generic_samples"), P4_KEYS, "measurement")


def _lopsided(p05: Column, p50: Column, p95: Column) -> Column:
    return F.greatest(p95 - p50, p50 - p05) > P4_FACTOR * F.least(p95 - p50, p50 - p05)


@catalogue.query(
    "p4_found",
    f"""
WITH g AS (SELECT sensor_id, revision, quantile_cont(measurement, [0.05, 0.5, 0.95]) AS q FROM generic_samples
           WHERE isfinite(measurement) AND sensor_id IS NOT NULL AND revision IS NOT NULL GROUP BY ALL)
SELECT sensor_id, revision FROM g WHERE greatest(q[3] - q[2], q[2] - q[1]) > {P4_FACTOR} * least(q[3] - q[2], q[2] - q[1])
""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups with one tail of the distribution much longer than the other.

    The digest's intervals decide; only groups they leave open are ranked exactly.
    """
    samples = read(spark, d, "generic_samples").where(F.col("sensor_id").isNotNull() & F.col("revision").isNotNull())
    shared_folder(spark)
    # A few rows per group, read by both branches below.
    marks = dyadic_quantiles.percentiles(dyadic_quantiles.digest(samples, P4_KEYS, "measurement"), P4_KEYS, P4_PROBABILITIES).checkpoint()
    at = lambda p, c: F.max(F.when(F.col("p") == p, F.col(c)))
    wide = marks.groupBy(*P4_KEYS).agg(*[at(p, c).alias(f"{c}{i}") for i, p in enumerate(P4_PROBABILITIES) for c in ("low", "high")])
    up_low, up_high = F.col("low2") - F.col("high1"), F.col("high2") - F.col("low1")
    down_low, down_high = F.col("low1") - F.col("high0"), F.col("high1") - F.col("low0")
    yes = (up_low > P4_FACTOR * down_high) | (down_low > P4_FACTOR * up_high)
    no = (up_high <= P4_FACTOR * down_low) & (down_high <= P4_FACTOR * up_low)
    judged = wide.select(*P4_KEYS, yes.alias("yes"), (~yes & ~no).alias("open"))
    still = marks.join(judged.where("open").select(*P4_KEYS), P4_KEYS, "left_semi")
    exact = dyadic_quantiles.exact_percentiles(samples, still, P4_KEYS, "measurement")
    exact = exact.groupBy(*P4_KEYS).agg(*[F.max(F.when(F.col("p") == p, F.col("exact"))).alias(f"q{i}") for i, p in enumerate(P4_PROBABILITIES)])
    return judged.where("yes").select(*P4_KEYS).unionByName(exact.where(_lopsided(F.col("q0"), F.col("q1"), F.col("q2"))).select(*P4_KEYS))


@catalogue.query("p4_percentiles")
def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per sensor and revision with the interval certain to hold each."""
    return dyadic_quantiles.percentiles(_p4_digest(spark, d), P4_KEYS, (0.05, 0.25, 0.5, 0.75, 0.95))


@catalogue.query("p4_merged_days")
def p4_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from digests of single days, merged into those of the whole."""
    by_day = read(spark, d, "generic_samples").withColumn("day", F.to_date("ingested_at"))
    days = dyadic_quantiles.digest(by_day, [*P4_KEYS, "day"], "measurement")
    return dyadic_quantiles.percentiles(dyadic_quantiles.merge(days, P4_KEYS), P4_KEYS, (0.05, 0.25, 0.5, 0.75, 0.95))


#: Error bound of the coarse digest below: small enough to be useful, large enough that every revision is compressed.
P4_COARSE = 0.05


@catalogue.query(
    "p4_rank_error",
    f"""
WITH v AS (SELECT coalesce(revision, '-') AS revision FROM generic_samples WHERE isfinite(measurement))
SELECT revision, CAST(p AS DOUBLE) AS p, count(*) AS "rows", true AS within_bound FROM v, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) GROUP BY ALL
""",
)
def p4_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of a compressed digest per revision, and whether their rank error keeps within eps * n."""
    samples = read(spark, d, "generic_samples").withColumn("revision", F.coalesce("revision", F.lit("-"))).select("revision", "measurement")
    marks = dyadic_quantiles.percentiles(dyadic_quantiles.digest(samples, ["revision"], "measurement", P4_COARSE), ["revision"], (0.05, 0.25, 0.5, 0.75, 0.95))
    marks = written(marks.groupBy("revision").agg(F.collect_list(F.struct("p", "rows", "low", "high")).alias("m")))
    rows = attach(samples.where(finite("measurement")), marks, ["revision"], "inner").select("revision", "measurement", F.explode("m").alias("m"))
    count = lambda c: F.count(F.when(c, 1))
    v = F.col("measurement")
    got = rows.groupBy("revision", "m.p").agg(F.max("m.rows").alias("rows"), count(v <= F.col("m.low")).alias("upto_low"), count(v < F.col("m.high")).alias("below_high"))
    # The rank asked for lies between both ends, and neither end is further from it than the bound.
    rank, slack = F.col("p") * (F.col("rows") - 1), P4_COARSE * F.col("rows") + 2
    within = (F.col("upto_low") <= rank + 1) & (F.col("below_high") >= rank) & (rank - F.col("upto_low") <= slack) & (F.col("below_high") - rank <= slack)
    return got.select("revision", "p", "rows", within.alias("within_bound"))


#: Slope of a source's weight over training: what is written by experts comes late.
RAMPS = {"marketplace": -0.4, "field_reports": 0.5, "lab_notes": 0.5}


def _capacity(spark: SparkSession, d: str) -> int:
    return read(spark, d, "container_specs").agg(F.max("capacity_tokens")).first()[0]


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, written once: every branch of a plan reads them from there."""
    shared_folder(spark)
    return tokens.sized(read(spark, d, "documents")).checkpoint()


@catalogue.query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no container holds whole: those the packing has to cut."""
    return packing.pack(_sized(spark, d), _capacity(spark, d)).where("piece = 1").select("doc_id")


@catalogue.query("p6_packed")
def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container."""
    return packing.pack(_sized(spark, d), _capacity(spark, d))


@catalogue.query("p6_containers")
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers with their fill."""
    size = _capacity(spark, d)
    return packing.containers(packing.pack(_sized(spark, d), size), size)


@catalogue.query("p6_invariants", "SELECT count(*) AS documents, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull, 0::BIGINT AS split_without_need, true AS well_filled FROM documents")
def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must keep: every token once, no container overfull, nothing split that fits, little room unused."""
    sized, size = _sized(spark, d), _capacity(spark, d)
    packed = packing.pack(sized, size)
    shared_folder(spark)
    packed = packed.checkpoint()
    per_doc = packed.groupBy("doc_id").agg(F.sum("size").alias("packed"), F.count("*").alias("pieces"))
    docs = sized.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(per_doc, "doc_id", "left")
    docs = docs.agg(F.count("*").alias("documents"), F.sum(F.abs(F.col("tokens") - F.coalesce("packed", F.lit(-1)))).alias("lost_tokens"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= size), 1)).alias("split_without_need"))
    bins = packing.containers(packed, size).agg(F.count(F.when(F.col("unused") < 0, 1)).alias("overfull"), (F.sum("tokens") >= 0.9 * size * F.count("*")).alias("well_filled"))
    # Two tables of one row each meet on a constant.
    return docs.withColumn("one", F.lit(1)).join(bins.withColumn("one", F.lit(1)), "one").drop("one")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix and its goals."""
    sized, size = _sized(spark, d), _capacity(spark, d)
    goals = written(mixing.plan(sized, read(spark, d, "mix_targets"), capacity=size)).df
    return mixing.mix(sized, read(spark, d, "mix_targets"), RAMPS, capacity=size, goals=goals), goals


@catalogue.query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose part of the mix ends short of their demand."""
    return mixing.report(*_mixed(spark, d)).where("NOT reached").select("source")


@catalogue.query("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix in training order."""
    return _mixed(spark, d)[0]


@catalogue.query("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.report(*_mixed(spark, d))


@catalogue.query("p7_invariants", "SELECT max(source) AS source, true AS within_repeats, true AS share_as_due, true AS even FROM mix_targets GROUP BY regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', '', 'g')")
def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What a mix must keep, per source: no more repeats than allowed, tokens as due, and its schedule in every tenth of training."""
    mixed, goals = _mixed(spark, d)
    shared_folder(spark)
    mixed = mixed.checkpoint()
    ramp = F.coalesce(F.col("ramp"), F.lit(0.0))
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.max("pass_no").alias("passes"), *[F.sum(F.when(F.col("position") < k / 10, F.col("tokens"))).alias(f"u{k}") for k in range(1, 10)])
    df = goals.join(mixing.scheduled(goals, RAMPS).select("source", "ramp"), "source", "left").join(per, "source", "left")
    got, due = F.coalesce("tokens", F.lit(0)), F.least(F.col("demand"), F.col("available") * F.col("repeats"))
    even = F.lit(True)
    for k in range(1, 10):
        want = got * ((1 - ramp) * (k / 10) + ramp * (k / 10) ** 2)
        even = even & (F.abs(F.coalesce(f"u{k}", F.lit(0)) - want) <= F.coalesce("largest", F.lit(0)) + 1)
    return df.select("source", (F.coalesce("passes", F.lit(0)) <= F.col("repeats")).alias("within_repeats"), ((got >= due) & (got <= due + F.coalesce("largest", F.lit(0)))).alias("share_as_due"), even.alias("even"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return text_types.text_types(read(spark, d, "documents"), read(spark, d, "common_words"))


@catalogue.query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are for the most part no natural prose."""
    return _types(spark, d).where("text_type = 'junk'").select("doc_id")


@catalogue.query("p8_types")
def p8_types(spark: SparkSession, d: str) -> DataFrame:
    """Text type of every document with the posterior and the statistics asked for."""
    known = lambda c: F.when(~F.col("absent"), c)
    shares = [known(F.round(c, 6)).alias(c) for c in ("mean_word_length", "symbol_share", "terminal_share", "common_share")]
    return _types(spark, d).select("doc_id", "text_type", F.round("junk", 6).alias("junk"), known(F.col("word_count")).alias("word_count"), *shares)


@catalogue.query("p8_accuracies")
def p8_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """What was learned of each labelling function."""
    stats = text_types.statistics(read(spark, d, "documents"), read(spark, d, "common_words"))
    return text_types.posterior(text_types.votes(stats))[1]


_PLAIN = r"""regexp_replace(regexp_replace(text, '(?i)<br\s*/?>|</p>|</li>', chr(10), 'g'), '<[a-zA-Z/][^<>]{0,80}>', ' ', 'g')"""
_SHARES = [c for c in text_types.STATISTICS if c not in text_types.WHOLE]


@catalogue.query(
    "p8_statistics",
    rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS plain FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(plain, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS tokens,
        list_filter(regexp_split_to_array(lower(plain), '[^\p{{L}}\p{{M}}]+'), lambda w: w <> '') AS words,
        list_filter(list_transform(regexp_split_to_array(plain, '[\n\v\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x)), lambda x: x <> '') AS lines,
        length(regexp_replace(plain, '[ \t\n\v\f\r]+', '', 'g')) AS chars,
        length(regexp_replace(plain, '[\p{{L}}\p{{M}}\p{{N}} \t\n\v\f\r.,;:!?''"()’“”„«»¿¡-]+', '', 'g')) AS symbols,
        length(regexp_replace(plain, '[^\p{{N}}]+', '', 'g')) AS digits, length(regexp_replace(plain, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS letters,
        length(regexp_replace(plain, '[^|>#=/\\_{{}}\[\]<;*•~,]+', '', 'g')) AS separators FROM d),
c AS (SELECT list(DISTINCT lower(word)) AS listed FROM common_words),
n AS (SELECT *, len(tokens) AS nt, len(words) AS nw, len(lines) AS nl, list_distinct(words) AS kinds,
        coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS in_lines, list_filter(lines, lambda x: regexp_matches(x, '^([-•*·–▪#>|+=~]|\d+[.)][ \t\n\v\f\r]|\[[ xX]\])')) AS items FROM t, c)
SELECT doc_id, CAST(nt AS INTEGER) AS word_count, round(coalesce(chars / nullif(nt, 0), 0), 6) AS mean_word_length, round(coalesce(symbols / nullif(chars, 0), 0), 6) AS symbol_share,
       round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["''”’»)\]\p{{So}} \t\n\v\f\r]*$'))) / nullif(nl, 0), 0), 6) AS terminal_share,
       round(coalesce(len(list_filter(words, lambda w: list_contains(listed, w))) / nullif(nw, 0), 0), 6) AS common_share,
       CAST(nl AS INTEGER) AS line_count, round(coalesce(nt / nullif(nl, 0), 0), 6) AS words_per_line, round(coalesce(digits / nullif(chars, 0), 0), 6) AS digit_share,
       round(coalesce(letters / nullif(chars, 0), 0), 6) AS letter_share, round(coalesce(list_sum(list_transform(items, lambda x: length(x))) / nullif(in_lines, 0), 0), 6) AS bullet_share,
       CAST(len(list_filter(kinds, lambda w: list_contains(listed, w))) AS INTEGER) AS common_kinds,
       round(coalesce(len(list_filter(words, lambda w: regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{{5}}|^[bcdfghjklmnpqrstvwxz]{{3,}}$') OR
         len(list_filter(range(1, length(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0)) / nullif(nw, 0), 0), 6) AS rough_share,
       CAST(coalesce(list_max(list_transform(words, lambda w: length(w))), 0) AS DOUBLE) AS longest_word, CAST(len(kinds) AS INTEGER) AS distinct_words, CAST(nw AS INTEGER) AS letter_words,
       round(coalesce(separators / nullif(nt, 0), 0), 6) AS separators_per_word
FROM n
""",
)
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of every text."""
    stats = text_types.statistics(read(spark, d, "documents"), read(spark, d, "common_words"))
    return stats.where("NOT absent").select("doc_id", *[F.round(c, 6).alias(c) if c in _SHARES else c for c in text_types.STATISTICS])
