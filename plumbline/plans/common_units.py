"""Sample tables in common units for the registered queries, the stationary gate, and both in SQL.

The SQL derives the unit of every channel from the same evidence as :mod:`plumbline.operators.unit_graph` with exact
instead of approximate quantiles, so the tools' results can be compared on converted values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.joins import attach
from plumbline.operators import imu_tools, unit_graph
from plumbline.operators.spikes import full_scale
from plumbline.session import read


def common_units(spark: SparkSession, d: str, table: str = "imu_samples") -> DataFrame:
    """A sample table in s, m/s^2, rad/s, degC and V."""
    samples, recordings = read(spark, d, table), read(spark, d, "recordings")
    channels = unit_graph.channel_units_from_values(samples, recordings, read(spark, d, "channel_units"))
    return unit_graph.to_common_units(samples, channels)


def common_limits(recordings: DataFrame) -> DataFrame:
    """dataset_id, axis, low, high: full scale in m/s^2 and rad/s; none where the limit or its unit is unknown."""
    high = {
        "a": full_scale("accelerometer_range_max", "accelerometer_range_unit", "m/s^2"),
        "g": full_scale("gyroscope_range_max", "gyroscope_range_unit", "rad/s"),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), high[a[0]].alias("high")) for a in imu_tools.AXES])
    out = recordings.where("dataset_id IS NOT NULL").select("dataset_id", F.explode(rows).alias("r")).where("r.high > 0")
    return out.groupBy("dataset_id", "r.axis").agg(F.max("r.high").alias("high")).withColumn("low", -F.col("high"))


def stationary_state(controlled: bool | None = True) -> Column:
    """True, False or NULL (unknown): what a recording's description says of its resting.

    ``controlled`` is what a controlled orientation means to a tool.
    """
    mode = F.col("test_mode")
    return F.coalesce("expected_stationary", F.when(mode == "imu_stationary", True).when(mode == "imu_controlled_orientation", controlled).when(mode == "imu_dynamic", False))


def states(recordings: DataFrame, controlled: bool | None = True) -> DataFrame:
    """dataset_id, stationary, one row per recording."""
    known = recordings.where("dataset_id IS NOT NULL").groupBy("dataset_id").agg(F.max("expected_stationary").alias("expected_stationary"), F.max("test_mode").alias("test_mode"))
    return known.select("dataset_id", stationary_state(controlled).alias("stationary"))


def resting(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """``samples`` without the recordings that are known to move; tools of resting sensors skip those."""
    moving = states(recordings).where("NOT stationary").select("dataset_id", F.lit(True).alias("_moves"))
    return attach(samples, moving, ["dataset_id"]).where(F.col("_moves").isNull()).drop("_moves")


# ---- the same in SQL ----


def _spelled(x: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN '{u}'" for u, names in unit_graph.SPELLINGS.items() for n in names)
    return f"(CASE lower(trim({x})) {cases} END)"


def _pick(pairs: list[tuple[str, str]], x: str) -> str:
    return f"(CASE {x} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in pairs)} END)"


def _header(x: str) -> str:
    inner = rf"regexp_extract({x}, '(?:\[(.+)\]|\((.+)\)| / (.+)|_in_(.+))$')"
    return _spelled(rf"regexp_replace(regexp_replace({inner}, '^(\[|\(| / |_in_)', ''), '[\])]$', '')")


_DIMS = list(unit_graph.DIMENSION.items())
_TARGETS = [(f, unit_graph.CANONICAL[dim]) for f, dim in _DIMS]


def _statements_sql() -> str:
    said = " ".join(f"WHEN dim = '{dim}' AND regexp_matches(t, '{p}') THEN '{u}'" for dim, u, p in unit_graph.note_patterns())
    fields = ", ".join(f"'{f}'" for f, _ in _DIMS)
    return f"""st_note AS (SELECT dataset_id, array_to_string(list_filter(string_split(lower(max(notes)), ';'), lambda c: NOT regexp_matches(c, '{unit_graph.OTHER_MATTER}')), ';') AS t FROM recordings GROUP BY 1),
st_unit AS (SELECT dataset_id, field_name, min({_spelled("units")}) AS u, min({_header("source_column")}) AS h, min({_spelled("original_units")}) AS o FROM channel_units WHERE field_name IN ({fields}) GROUP BY ALL),
stated AS (SELECT dataset_id, field_name, coalesce(u, h, CASE {said} END, o) AS stated FROM (SELECT st_unit.*, t, {_pick(_DIMS, "field_name")} AS dim FROM st_unit LEFT JOIN st_note USING (dataset_id)))"""


def _fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def _size(axes: tuple[str, ...]) -> str:
    return f"sqrt({' + '.join(f'{_fin(a)} * {_fin(a)}' for a in axes)})"


_GROUPS = {"generic_samples": ["temperature", "supply_voltage"], "imu_samples": ["temperature", "a"]}
_FIELDS = {"generic_samples": ["timestamp", "temperature", "supply_voltage"], "imu_samples": ["timestamp", "temperature", *imu_tools.AXES]}


def _value(n: str) -> str:
    return _size(imu_tools.ACCEL) if n == "a" else _fin(n)


def _band_sql(n: str, x: str) -> str:
    cuts, most = unit_graph._BANDS[n][0], 1e4 if n == "a" else 1e6
    return f"(CASE WHEN abs({x}) < {most} THEN {' + '.join(f'CASE WHEN {x} > {c} THEN 1 ELSE 0 END' for c in cuts)} END)"


def channels_sql(table: str, p: str) -> str:
    """CTEs up to ``{p}ch`` (dataset_id, field_name, unit, partial, stated) of a sample table; needs ``stated``."""
    groups, fields, moves = _GROUPS[table], _FIELDS[table], table == "imu_samples"
    w = "PARTITION BY dataset_id ORDER BY coalesce(row_ord, row_id, 0)"
    axes = [imu_tools.ACCEL, imu_tools.GYRO] if moves else []
    lags = "".join(f", abs({_fin(a)} - lag({_fin(a)}) OVER ({w})) AS d_{a}" for g in axes for a in g)
    bands = "".join(f", {_value(n)} AS x_{n}, {_band_sql(n, _value(n))} AS b_{n}" for n in groups)
    sizes = f", {_size(imu_tools.GYRO)} AS g_len" if moves else ""
    moving = ", lower(trim(motion_state)) = 'moving' AS moving" if moves else ""
    prior = "".join(
        f", last_value(CASE WHEN b_{n} IS NOT NULL THEN b_{n} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_{n}, last_value(CASE WHEN b_{n} IS NOT NULL THEN x_{n} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q_{n}"
        for n in groups
    )
    aggs = ["quantile_disc(CASE WHEN step > 0 THEN step END, 0.5) AS step", *[f"count(*) FILTER (isfinite({f})) AS n_{f}" for f in fields]]
    for n in groups:
        for i in range(len(unit_graph._BAND_UNITS[n])):
            aggs += [f"count(*) FILTER (b_{n} = {i}) AS {n}_{i}", f"count(*) FILTER (b_{n} = {i} AND p_{n} = {i}) AS {n}_pair_{i}"]
        aggs.append(f"count(*) FILTER (p_{n} <> b_{n} AND greatest(x_{n}, q_{n}) >= {unit_graph._BANDS[n][1]} * least(x_{n}, q_{n})) AS {n}_jumps")
    if moves:
        aggs += [f"quantile_disc(d_{a}, 0.5) AS d_{a}" for g in axes for a in g]
        aggs += [f"quantile_disc(x_a, {q}) AS a_p{int(q * 100)}" for q in (0.1, 0.5, 0.9)]
        aggs += ["quantile_disc(CASE WHEN b_a = 2 THEN x_a END, 0.5) AS a_high", "quantile_disc(g_len, 0.5) AS g_p50", "avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END) AS moving_share", "count(moving) AS labelled"]
    said = ", ".join(f"max(stated) FILTER (field_name = '{f}') AS s_{f}" for f in fields)
    canonical = {"temperature": "degC", "supply_voltage": "V", "a": "m/s^2"}
    picks, mixes = [], []
    for n in groups:
        rows = ", ".join(f"{{'n': {n}_{i}, 'i': {-i}, 'u': '{u}', 'pairs': {n}_pair_{i}}}" for i, u in enumerate(unit_graph._BAND_UNITS[n]))
        picks.append(f"list_sort([{rows}], 'DESC') AS r_{n}")
        mixes.append(f"(r_{n}[2].pairs >= {unit_graph.LONG_STRETCH} OR (r_{n}[2].pairs >= 1 AND {n}_jumps >= 1)) AS m_{n}")
    moved = (
        "coalesce(CASE WHEN labelled > 0 THEN moving_share > 0.5 END, CASE WHEN test_mode = 'imu_dynamic' THEN true WHEN test_mode IN ('imu_stationary', 'imu_controlled_orientation') THEN false END, NOT resting, (a_p90 - a_p10) / nullif(a_p50, 0) > 0.1, false)"
        if moves
        else "false"
    )
    units = {"timestamp": "CASE WHEN sc IS NULL THEN 's' ELSE arg_min_unit END"}
    partial = {"timestamp": "false"}
    for n in groups:
        unit = f"CASE WHEN m_{n} AND r_{n}[1].u = '{canonical[n]}' THEN r_{n}[2].u ELSE r_{n}[1].u END"
        if n != "a":
            units[n], partial[n] = unit, f"m_{n}"
    own_cols, single_cols = [], []
    if moves:
        for g, can, logs in (
            (imu_tools.ACCEL, "m/s^2", {"g": -math.log10(unit_graph.STANDARD_GRAVITY), "mg": 3 - math.log10(unit_graph.STANDARD_GRAVITY), "cm/s^2": 2.0}),
            (imu_tools.GYRO, "rad/s", {"deg/s": math.log10(180 / math.pi), "mdeg/s": math.log10(180 / math.pi) + 3}),
        ):
            for f in g:
                o = [x for x in g if x != f]
                ratio = f"(CASE WHEN d_{o[0]} * d_{o[1]} > 0 AND d_{f} > 0 THEN log10(d_{f} / sqrt(d_{o[0]} * d_{o[1]})) END)"
                rest = " AND ".join(f"coalesce(s_{x}, '{can}') = '{can}'" for x in o)
                said_own = [f"CASE WHEN s_{f} = '{u}' AND {rest} AND abs({ratio} - ({e!r})) < CASE WHEN mv THEN 0.75 ELSE 0.5 END THEN '{u}' END" for u, e in logs.items()]
                seen = [f"CASE WHEN NOT mv AND abs({ratio} - ({e!r})) < 0.35 THEN '{u}' END" for u, e in logs.items()]
                own_cols.append(f"coalesce({', '.join(said_own + seen)}) AS o_{f}")
            single_cols.append(f"coalesce({', '.join(f'o_{f}' for f in g)}) IS NOT NULL AS one_{g[0][0]}")
        stated = "coalesce(" + ", ".join(f"CASE WHEN s_{f} IN ('mg', 'cm/s^2') THEN s_{f} END" for f in imu_tools.ACCEL) + ")"
        ua = "CASE WHEN m_a AND r_a[1].u = 'm/s^2' THEN r_a[2].u ELSE r_a[1].u END"
        group = f"CASE WHEN {ua} = 'high' THEN CASE WHEN mv AND {stated} IS NOT NULL THEN {stated} WHEN a_high < 990 THEN 'cm/s^2' ELSE 'mg' END ELSE {ua} END"
        r0, m0 = unit_graph.RATE_REST, unit_graph.RATE_MOVING
        rate = lambda c: f"CASE WHEN g_p50 < {c[0]} THEN 'rad/s' WHEN g_p50 < {c[1]} THEN 'deg/s' ELSE 'mdeg/s' END"
        for f in imu_tools.ACCEL:
            units[f], partial[f] = f"CASE WHEN one_a THEN coalesce(o_{f}, 'm/s^2') ELSE {group} END", "NOT one_a AND m_a"
        for f in imu_tools.GYRO:
            units[f] = f"CASE WHEN one_g THEN coalesce(o_{f}, 'rad/s') WHEN g_p50 IS NULL THEN 'rad/s' WHEN mv THEN {rate(m0)} ELSE {rate(r0)} END"
            partial[f] = "false"
    near = "list_sort([" + ", ".join(f"{{'d': abs(sc - {e}), 'u': '{u}'}}" for u, e in (("s", 0), ("ms", 3), ("us", 6), ("ns", 9))) + "])[1].u"
    long = " UNION ALL ".join(f"SELECT dataset_id, '{f}' AS field_name, {units[f]} AS unit, coalesce({partial[f]}, false) AS partial, s_{f} AS stated, n_{f} AS n FROM {p}f" for f in fields)
    return f"""{p}a AS (SELECT *, {_fin("timestamp")} - lag({_fin("timestamp")}) OVER ({w}) AS step{lags}{bands}{sizes}{moving} FROM {table}),
{p}b AS (SELECT *{prior} FROM {p}a),
{p}c AS (SELECT dataset_id, {", ".join(aggs)} FROM {p}b GROUP BY 1),
{p}d AS (SELECT *, {", ".join(picks)}, {moved} AS mv, CASE WHEN step / period > 0 THEN log10(step / period) END AS sc
  FROM {p}c LEFT JOIN (SELECT dataset_id, max(nominal_period_s) AS period, max(test_mode) AS test_mode, max(expected_stationary) AS resting FROM recordings GROUP BY 1) USING (dataset_id) LEFT JOIN (SELECT dataset_id, {said} FROM stated GROUP BY 1) USING (dataset_id)),
{p}e AS (SELECT *, {", ".join([*mixes, *own_cols])}, {near} AS arg_min_unit FROM {p}d),
{p}f AS (SELECT *{"".join(f", {c}" for c in single_cols)} FROM {p}e),
{p}ch AS (SELECT * EXCLUDE (n) FROM ({long}) WHERE n > 0)"""


_FUNCTIONS = "unit_functions AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{t}', {s!r}::DOUBLE, {o!r}::DOUBLE)" for u, (t, s, o) in sorted(unit_graph.conversions().items())) + ') AS v(unit, target, scale, "offset"))'


def with_functions_sql(p: str) -> str:
    """CTE ``{p}fn``: the channels with target, scale and offset."""
    return f'{p}fn AS (SELECT c.* EXCLUDE (want), uf.target AS target, scale, "offset" FROM (SELECT *, {_pick(_TARGETS, "field_name")} AS want FROM {p}ch) c LEFT JOIN unit_functions uf ON uf.unit = c.unit AND uf.target = c.want)'


def converted_sql(table: str, p: str, name: str) -> str:
    """CTE ``name``: the sample table in common units."""
    fields, groups = _FIELDS[table], _GROUPS[table]
    group_of = {f: ("a" if f in imu_tools.ACCEL else f) for f in fields if f in imu_tools.ACCEL or f in groups}
    pick = ", ".join(f"any_value(scale) FILTER (field_name = '{f}') AS k_{f}, any_value(\"offset\") FILTER (field_name = '{f}') AS o_{f}, any_value(partial) FILTER (field_name = '{f}') AS p_{f}" for f in fields)
    w = "PARTITION BY dataset_id ORDER BY coalesce(row_ord, row_id, 0)"
    told = ", ".join(f"({_band_sql(n, _value(n))} = {1 if n == 'a' else 0}) AS t_{n}" for n in groups)
    near = ", ".join(
        f"coalesce(last_value(t_{n} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t_{n} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), true) AS c_{n}" for n in groups
    )
    exprs = ", ".join(f"CASE WHEN k_{f} IS NULL{f' OR (p_{f} AND c_{group_of[f]})' if f in group_of else ''} THEN {f} ELSE {f} * k_{f} + o_{f} END AS {f}" for f in fields)
    return f"{name} AS (SELECT * REPLACE ({exprs}) FROM (SELECT *, {near} FROM (SELECT *, {told} FROM {table})) LEFT JOIN (SELECT dataset_id, {pick} FROM {p}fn GROUP BY 1) USING (dataset_id))"


def common_sql(select: str, table: str = "imu_samples", name: str = "imu_common") -> str:
    """``select``, which reads ``name``, with the CTEs that make it."""
    parts = [_statements_sql(), channels_sql(table, "u"), _FUNCTIONS, with_functions_sql("u"), converted_sql(table, "u", name)]
    if "imu_resting" in select:
        parts.append(f"imu_resting AS (SELECT * FROM {name} WHERE dataset_id NOT IN {MOVING_SQL})")
    head = ",\n".join(parts)
    return f"WITH {head},\n{select[5:]}" if select.startswith("WITH ") else f"WITH {head}\n{select}"


def both_channels_sql(select: str) -> str:
    """``select``, which reads ``channels`` (of both sample tables, with functions), with the CTEs that make it."""
    head = [_statements_sql(), channels_sql("generic_samples", "v"), channels_sql("imu_samples", "u"), _FUNCTIONS, with_functions_sql("v"), with_functions_sql("u")]
    return "WITH " + ",\n".join(head) + f",\nchannels AS (SELECT * FROM vfn UNION ALL SELECT * FROM ufn)\n{select}"


def both_tables_sql(select: str) -> str:
    """``select``, which reads ``generic_common`` and ``imu_common``, with the CTEs that make them."""
    head = [_statements_sql(), channels_sql("generic_samples", "v"), channels_sql("imu_samples", "u"), _FUNCTIONS, with_functions_sql("v"), with_functions_sql("u")]
    head += [converted_sql("generic_samples", "v", "generic_common"), converted_sql("imu_samples", "u", "imu_common")]
    return "WITH " + ",\n".join(head) + f"\n{select}"


def stationary_sql(controlled: str = "true") -> str:
    return f"coalesce(expected_stationary, CASE test_mode WHEN 'imu_stationary' THEN true WHEN 'imu_controlled_orientation' THEN {controlled} WHEN 'imu_dynamic' THEN false END)"


def _scaled(limit: str, unit: str, target: str) -> str:
    cases = " ".join(f"WHEN '{u}' THEN {s!r}" for u, (t, s, _) in unit_graph.conversions().items() if t == target)
    return f"max({limit} * CASE {_spelled(unit)} {cases} END)"


#: dataset_id, a_high, g_high: full scale in common units.
RANGE_SQL = f"SELECT dataset_id, {_scaled('accelerometer_range_max', 'accelerometer_range_unit', 'm/s^2')} AS a_high, {_scaled('gyroscope_range_max', 'gyroscope_range_unit', 'rad/s')} AS g_high FROM recordings GROUP BY 1"
#: Recordings known to move, for WHERE dataset_id NOT IN.
MOVING_SQL = f"(SELECT dataset_id FROM (SELECT dataset_id, max(expected_stationary) AS expected_stationary, max(test_mode) AS test_mode FROM recordings WHERE dataset_id IS NOT NULL GROUP BY 1) WHERE NOT {stationary_sql()})"
