"""Queries of the core's data-preparation operators (problems 1, 2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import if_finite
from plumbline.functions.rounding import rounded, rounded_sql
from plumbline.operators import error_parse, regular_grid, spikes, unit_graph
from plumbline.plans.catalogue import Catalogue
from plumbline.plans.common_units import both_channels_sql, both_tables_sql
from plumbline.session import read

catalogue = Catalogue()

# One alternative of the pattern per delimiter: a field is enclosed text with doubled quotes, or text without quotes.
_FIELD = """' *"(?:[^"]|"")*" *|[^"' || d || ']*'"""
_P1_SQL = f"""
WITH head AS (
  SELECT file_id, h, CASE greatest(n1, n2, n3, n4) WHEN n1 THEN ',' WHEN n2 THEN ';' WHEN n3 THEN chr(9) ELSE '|' END AS d
  FROM (SELECT *, length(h) - length(replace(h, ',', '')) AS n1, length(h) - length(replace(h, ';', '')) AS n2,
               length(h) - length(replace(h, chr(9), '')) AS n3, length(h) - length(replace(h, '|', '')) AS n4
        FROM (SELECT file_id, replace(replace(line_text, chr(65279), ''), '"', '') AS h FROM issue_lines WHERE line_no = 1))),
line AS (
  SELECT l.line_id, l.line_text AS t, list_transform(string_split(h, d), lambda x: trim(x)) AS cols, CASE d WHEN '|' THEN '\\|' ELSE d END AS d,
         d AS raw
  FROM issue_lines l LEFT JOIN head USING (file_id) WHERE l.line_no > 1),
cut AS (
  SELECT line_id, cols, t, regexp_full_match(t, '(' || {_FIELD} || ')(' || d || '(' || {_FIELD} || '))*') AS shaped,
         list_transform(regexp_extract_all(raw || t, d || '(' || {_FIELD} || ')', 1),
                        lambda x: trim(CASE WHEN trim(x) LIKE '"%' THEN replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"') ELSE x END)) AS f
  FROM line),
named AS (
  SELECT line_id, shaped AND len(f) = len(cols) AS shaped,
         f[list_position(cols, 'dataset_id')] AS dataset_id, f[list_position(cols, 'issue_id')] AS issue_id, f[list_position(cols, 'severity')] AS severity,
         f[list_position(cols, 'affected_rows')] AS affected_rows, f[list_position(cols, 'affected_fraction')] AS affected_fraction
  FROM cut)
"""
_P1_VALID = """coalesce(shaped AND regexp_full_match(dataset_id, '[0-9]+') AND issue_id IN (SELECT issue_id FROM issue_types)
  AND severity IN ('info', 'warning', 'error') AND regexp_full_match(affected_rows, '[0-9]*')
  AND (affected_fraction = '' OR (regexp_full_match(affected_fraction, '([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
       AND try_cast(affected_fraction AS DOUBLE) BETWEEN 0 AND 1)), false)"""
_P1_TYPED = f"""
SELECT line_id, (SELECT any_value(file_id) FROM issue_lines l WHERE l.line_id = named.line_id) AS file_id, CAST(CAST(dataset_id AS DECIMAL(38, 0)) AS VARCHAR) AS dataset_id, issue_id, severity,
       CAST(try_cast(affected_rows AS DECIMAL(38, 0)) AS VARCHAR) AS affected_rows, try_cast(affected_fraction AS DOUBLE) AS affected_fraction
FROM named WHERE {_P1_VALID}"""
_P1_REASON = """
SELECT reason, count(*) AS lines FROM (
  SELECT CASE WHEN t IS NULL THEN 'no text' WHEN cols IS NULL THEN 'no header' WHEN NOT coalesce(shaped, false) THEN 'structure' WHEN dataset_id IS NULL THEN 'header has no dataset_id'
    WHEN issue_id IS NULL THEN 'header has no issue_id' WHEN severity IS NULL THEN 'header has no severity' WHEN NOT regexp_full_match(dataset_id, '[0-9]+') THEN 'dataset_id is not digits only'
    WHEN issue_id NOT IN (SELECT issue_id FROM issue_types) THEN 'issue_id is unknown' WHEN severity NOT IN ('info', 'warning', 'error') THEN 'severity is not info, warning or error'
    WHEN NOT regexp_full_match(affected_rows, '[0-9]*') THEN 'affected_rows is not digits only' ELSE 'affected_fraction is not a number from 0 to 1' END AS reason
  FROM named JOIN line USING (line_id) WHERE NOT """ + _P1_VALID + ") GROUP BY 1"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.parse_issues(read(spark, d, "issue_lines"), read(spark, d, "issue_types"))


@catalogue.query("p1_found", f"{_P1_SQL} SELECT line_id FROM named WHERE NOT {_P1_VALID}")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no valid issue."""
    return _parsed(spark, d).where(~F.col("valid") & (F.col("line_no") > 1)).select("line_id")


@catalogue.query("p1_loaded", _P1_SQL + _P1_TYPED)
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid issues as typed rows; whole numbers as text, as long ones leave every engine's integers."""
    text = [F.col(c).cast("string").alias(c) for c in ("dataset_id", "affected_rows")]
    return _parsed(spark, d).where("valid").select("line_id", "file_id", "issue_id", "severity", *text, "affected_fraction")


@catalogue.query("p1_reasons", _P1_SQL + _P1_REASON)
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines per kind of reason."""
    return _parsed(spark, d).where(~F.col("valid")).groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count("*").alias("lines"))


@catalogue.query("p1_rejected")
def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Every other line with the reason and the number of edits that would make it well formed."""
    return _parsed(spark, d).where(~F.col("valid")).select("line_id", "file_id", "line_no", "line_text", "cost", "reason")


def _channels(spark: SparkSession, d: str, table: str) -> DataFrame:
    return unit_graph.channel_units_from_values(read(spark, d, table), read(spark, d, "recordings"), read(spark, d, "channel_units"))


SAMPLE_TABLES = ("generic_samples", "imu_samples")


@catalogue.query("p5_found", both_channels_sql('SELECT dataset_id, field_name FROM channels WHERE partial OR scale <> 1 OR "offset" <> 0'))
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Channels stored, wholly or in part, in other than the canonical units."""
    both = [unit_graph.not_canonical(_channels(spark, d, t)) for t in SAMPLE_TABLES]
    return both[0].unionByName(both[1])


@catalogue.query("p5_channels", both_channels_sql("SELECT * FROM channels"))
def p5_channels(spark: SparkSession, d: str) -> DataFrame:
    """Every channel with its unit, what was stated, and the function into the canonical unit."""
    both = [unit_graph.with_functions(_channels(spark, d, t)) for t in SAMPLE_TABLES]
    return both[0].unionByName(both[1])


def _ranges_sql() -> str:
    """Both sample tables in common units, per recording and channel the number and range of finite values."""
    parts = []
    for t, name in (("generic_samples", "generic_common"), ("imu_samples", "imu_common")):
        fields = [f for f in unit_graph.DIMENSION if f in (("timestamp", "temperature", "supply_voltage") if t == "generic_samples" else ("timestamp", "temperature", "ax", "ay", "az", "gx", "gy", "gz"))]
        parts += [f"SELECT dataset_id, '{f}' AS field_name, count(*) AS n, min({f}) AS low, max({f}) AS high FROM {name} WHERE isfinite({f}) GROUP BY 1" for f in fields]
    return both_tables_sql(" UNION ALL ".join(parts))


@catalogue.query("p5_converted", _ranges_sql())
def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    """Per recording and channel the range of the values in common units."""
    parts = []
    for t in SAMPLE_TABLES:
        df = unit_graph.to_common_units(read(spark, d, t), _channels(spark, d, t))
        fields = [f for f in unit_graph.DIMENSION if f in df.columns]
        long = df.select("dataset_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), if_finite(f).alias("v")) for f in fields])).alias("r"))
        parts.append(long.groupBy("dataset_id", "r.field_name").agg(F.count("r.v").alias("n"), F.min("r.v").alias("low"), F.max("r.v").alias("high")))
    return parts[0].unionByName(parts[1]).where("n > 0")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(read(spark, d, "generic_samples"), read(spark, d, "recordings"))


_P3_SLOTS = """
  SELECT DISTINCT dataset_id, CAST(floor(timestamp / p + 0.5) AS BIGINT) AS slot_no
  FROM generic_samples JOIN (SELECT dataset_id, max(nominal_period_s) AS p FROM recordings WHERE nominal_period_s > 0 GROUP BY 1) USING (dataset_id)
  WHERE isfinite(timestamp) AND isfinite(measurement)"""


@catalogue.query(
    "p3_found",
    f"""
WITH s AS ({_P3_SLOTS}),
n AS (SELECT *, lead(slot_no) OVER (PARTITION BY dataset_id ORDER BY slot_no) AS nxt FROM s)
SELECT dataset_id, unnest(generate_series(slot_no + 1, nxt - 1)) AS slot_no FROM n WHERE nxt > slot_no + 1
""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods between a recording's first and last reading that hold none."""
    return _grid(spark, d).where(F.col("status") != "observed").select("dataset_id", "slot_no")


# The Fritsch-Carlson slopes and the Hermite form, written out.
_P3_VALUES = f"""
WITH p AS (SELECT dataset_id, max(nominal_period_s) AS p FROM recordings WHERE nominal_period_s > 0 GROUP BY 1),
r AS (SELECT dataset_id, p, CAST(floor(timestamp / p + 0.5) AS BIGINT) AS k, timestamp AS t, measurement AS v, row_ord, row_id FROM generic_samples JOIN p USING (dataset_id) WHERE isfinite(timestamp) AND isfinite(measurement)),
s AS (SELECT dataset_id, k, any_value(p) AS p, arg_min(t, (abs(t - k * p), row_ord, row_id)) AS t, arg_min(v, (abs(t - k * p), row_ord, row_id)) AS v FROM r GROUP BY 1, 2),
n AS (SELECT *, lead(k) OVER w AS k1, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lag(k) OVER w AS kb, lag(t) OVER w AS tb, lag(v) OVER w AS vb, lead(k, 2) OVER w AS k2, lead(t, 2) OVER w AS t2, lead(v, 2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY dataset_id ORDER BY k)),
g AS (SELECT *, t1 - t AS h, (v1 - v) / (t1 - t) AS m, CASE WHEN k - kb - 1 <= {regular_grid.MAX_GAP} THEN t - tb END AS hb, CASE WHEN k - kb - 1 <= {regular_grid.MAX_GAP} THEN (v - vb) / (t - tb) END AS mb,
        CASE WHEN k2 - k1 - 1 <= {regular_grid.MAX_GAP} THEN t2 - t1 END AS ha, CASE WHEN k2 - k1 - 1 <= {regular_grid.MAX_GAP} THEN (v2 - v1) / (t2 - t1) END AS ma FROM n WHERE k1 - k - 1 BETWEEN 1 AND {regular_grid.MAX_GAP}),
e AS (SELECT *, ((2 * h + ha) * m - h * ma) / (h + ha) AS xa, ((2 * h + hb) * m - h * mb) / (h + hb) AS xb FROM g),
d AS (SELECT *, CASE WHEN hb IS NOT NULL THEN CASE WHEN sign(mb) * sign(m) <= 0 THEN 0 ELSE (3 * h + 3 * hb) / ((2 * h + hb) / mb + (h + 2 * hb) / m) END
                     WHEN ha IS NOT NULL THEN CASE WHEN sign(xa) <> sign(m) THEN 0 WHEN sign(m) <> sign(ma) AND abs(xa) > 3 * abs(m) THEN 3 * m ELSE xa END ELSE m END AS da,
                CASE WHEN ha IS NOT NULL THEN CASE WHEN sign(m) * sign(ma) <= 0 THEN 0 ELSE (3 * h + 3 * ha) / ((2 * ha + h) / m + (ha + 2 * h) / ma) END
                     WHEN hb IS NOT NULL THEN CASE WHEN sign(xb) <> sign(m) THEN 0 WHEN sign(m) <> sign(mb) AND abs(xb) > 3 * abs(m) THEN 3 * m ELSE xb END ELSE m END AS db FROM e),
u AS (SELECT *, unnest(generate_series(k + 1, k1 - 1)) AS slot_no FROM d),
x AS (SELECT *, (slot_no * p - t) / h AS z FROM u)
SELECT dataset_id, slot_no, (2 * z * z * z - 3 * z * z + 1) * v + (z * z * z - 2 * z * z + z) * h * da + (3 * z * z - 2 * z * z * z) * v1 + (z * z * z - z * z) * h * db AS value FROM x"""


@catalogue.query("p3_values", rounded_sql(_P3_VALUES, ["value"], ["dataset_id", "slot_no"]))
def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """The filled periods with their values."""
    return rounded(_grid(spark, d).where("status = 'filled'").select("dataset_id", "slot_no", "value"))


@catalogue.query("p3_grid")
def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row per nominal period of every generic recording."""
    return _grid(spark, d)


@catalogue.query(
    "p3_summary",
    f"""
WITH s AS ({_P3_SLOTS}),
n AS (SELECT *, lead(slot_no) OVER (PARTITION BY dataset_id ORDER BY slot_no) - slot_no - 1 AS missing FROM s)
SELECT dataset_id, CAST(count(*) AS BIGINT) AS observed, CAST(coalesce(sum(missing) FILTER (missing <= {regular_grid.MAX_GAP}), 0) AS BIGINT) AS filled,
       CAST(coalesce(sum(missing) FILTER (missing > {regular_grid.MAX_GAP}), 0) AS BIGINT) AS in_gaps FROM n GROUP BY 1
""",
)
def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Observed, filled and marked periods of each recording."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return _grid(spark, d).groupBy("dataset_id").agg(count("observed").alias("observed"), count("filled").alias("filled"), count("gap").alias("in_gaps"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    recordings = read(spark, d, "recordings")
    generic = spikes.flag_generic(read(spark, d, "generic_samples"), recordings)
    return generic.unionByName(spikes.flag_inertial(read(spark, d, "imu_samples"), recordings, read(spark, d, "channel_units")))


@catalogue.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that are spikes, stuck or physically impossible."""
    return _flagged(spark, d).select("row_id", "field_name")


@catalogue.query("p2_by_kind")
def p2_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings per recording, channel and kind."""
    return _flagged(spark, d).groupBy("dataset_id", "field_name", "kind").agg(F.count("*").alias("readings"), F.max("score").alias("highest_score"))
