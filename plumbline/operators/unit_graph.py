"""Problem 5: quantities recorded in different units.

Conversions are edges of a graph whose nodes are units: ``value_in_target = scale * value + offset``.  The shortest
composition from every unit to the canonical unit of its dimension is computed once (breadth first, fewest edges),
every other path of the graph is checked to give the same function, and the resulting table (one row per unit, a few
dozen, fixed with the graph) is equi-joined with the channels on source unit and canonical target.

Which unit a channel is stored in is decided from its *values* first: the statements in ``units``, ``original_units``,
column headers and notes contradict each other and the values.  Evidence per recording comes from mergeable
aggregates (approximate quantiles and counts), so a recording that holds a third of all rows stays spread over tasks:

* ``timestamp``: median positive step over the nominal period;
* ``temperature``, ``supply_voltage``: which of the plausible bands of degC / degF / K and V / mV the values lie in;
* accelerometer: length of the (ax, ay, az) vector against gravity; a single axis in a unit of its own shows by its
  noise against that of the other two, together with its statement;
* gyroscope: length of (gx, gy, gz) against what resting and moving recordings show.

A recording whose values lie in two bands in stretches of successive rows, with a jump of about the units' ratio
between them, changed unit on the way (``partial``), however short the stretch; single stray readings are none.  Its rows
are converted one by one, by the band of the row, or that of the nearest rows where a row itself does not tell.

Defined results: channels without a finite value get no row; NULL or infinite values stay as they are; recordings
missing from ``recordings`` or ``channel_units`` are judged by values alone, with no nominal period their timestamps
count as seconds; repeated statement rows count once; extra columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.columns import finite, if_finite
from plumbline.joins import attach

STANDARD_GRAVITY = 9.80665
#: (from, to, scale, offset): value in ``to`` = scale * value in ``from`` + offset.  Several paths on purpose.
EDGES = (
    ("ms", "s", 1e-3, 0.0),
    ("us", "ms", 1e-3, 0.0),
    ("ns", "us", 1e-3, 0.0),
    ("us", "s", 1e-6, 0.0),
    ("min", "s", 60.0, 0.0),
    ("h", "min", 60.0, 0.0),
    ("h", "s", 3600.0, 0.0),
    ("g", "m/s^2", STANDARD_GRAVITY, 0.0),
    ("mg", "g", 1e-3, 0.0),
    ("cm/s^2", "m/s^2", 1e-2, 0.0),
    ("ft/s^2", "m/s^2", 0.3048, 0.0),
    ("deg/s", "rad/s", math.pi / 180, 0.0),
    ("mdeg/s", "deg/s", 1e-3, 0.0),
    ("rpm", "deg/s", 6.0, 0.0),
    ("rpm", "rad/s", math.pi / 30, 0.0),
    ("degF", "degC", 5 / 9, -160 / 9),
    ("K", "degC", 1.0, -273.15),
    ("degR", "K", 5 / 9, 0.0),
    ("degR", "degF", 1.0, -459.67),
    ("mV", "V", 1e-3, 0.0),
    ("uV", "mV", 1e-3, 0.0),
    ("kV", "V", 1e3, 0.0),
)
CANONICAL = {"time": "s", "acceleration": "m/s^2", "rate": "rad/s", "temperature": "degC", "voltage": "V"}
DIMENSION = {
    "timestamp": "time",
    "temperature": "temperature",
    "supply_voltage": "voltage",
    **dict.fromkeys(("ax", "ay", "az"), "acceleration"),
    **dict.fromkeys(("gx", "gy", "gz"), "rate"),
}
# Spellings of units, lower case, without blanks around.
SPELLINGS = {
    "s": ("s", "sec", "second", "seconds"),
    "ms": ("ms", "msec", "millisecond", "milliseconds"),
    "us": ("us", "µs", "μs", "usec", "microsecond", "microseconds"),
    "ns": ("ns", "nsec", "nanosecond", "nanoseconds"),
    "min": ("min", "minute", "minutes"),
    "h": ("h", "hr", "hour", "hours"),
    "m/s^2": ("m/s^2", "m/s2", "m/s²", "mps2", "meters/second^2", "meter/second^2", "meters per second squared"),
    "g": ("g", "g0", "g-force", "gravity", "standard gravity", "multiples of standard gravity"),
    "mg": ("mg", "milli-g", "milli g", "millig"),
    "cm/s^2": ("cm/s^2", "cm/s2", "cm/s²", "gal"),
    "rad/s": ("rad/s", "rad/sec", "radians/s", "radians/sec", "radians per second"),
    "deg/s": ("deg/s", "°/s", "dps", "degrees/sec", "degrees/s", "deg/sec", "degrees per second"),
    "mdeg/s": ("mdeg/s", "mdps", "milli-deg/s", "millideg/s", "milli-degrees per second"),
    "rpm": ("rpm",),
    "degC": ("c", "°c", "degc", "deg c", "celsius"),
    "degF": ("f", "°f", "degf", "deg f", "fahrenheit"),
    "K": ("k", "kelvin"),
    "V": ("v", "volt", "volts"),
    "mV": ("mv", "millivolt", "millivolts"),
    "uV": ("uv", "microvolt", "microvolts"),
}
#: Bands of the accelerometer vector's length: below 3.3 multiples of gravity, below 60 m/s^2, above mg or cm/s^2.
ACCEL_BANDS = (3.3, 60.0)
#: Bands of the gyroscope vector's median length, resting and moving: rad/s, deg/s, mdeg/s.
RATE_REST, RATE_MOVING = (0.018, 3.0), (2.0, 300.0)
#: Successive rows in a band that count as a stretch even where the jump into it was not seen (at a block's edge).
LONG_STRETCH = 1_000
#: Rows of a recording handled by one window; steps over the edges of these blocks are not needed.
BLOCK_ROWS = 65_536


def conversions() -> dict[str, tuple[str, float, float]]:
    """unit -> (canonical unit, scale, offset) by the shortest composition; raises where two paths disagree."""
    graph: dict[str, list[tuple[str, float, float]]] = {}
    for a, b, scale, offset in EDGES:
        graph.setdefault(a, []).append((b, scale, offset))
        graph.setdefault(b, []).append((a, 1 / scale, -offset / scale))
    out: dict[str, tuple[str, float, float]] = {}
    for target in CANONICAL.values():
        to = {target: (1.0, 0.0)}  # unit -> function into target
        queue = deque([target])
        while queue:
            u = queue.popleft()
            scale, offset = to[u]
            for v, s, o in graph.get(u, []):
                # u -> v is s*x + o, hence v -> u is (y - o) / s, then u -> target.
                into = (scale / s, offset - scale * o / s)
                if v not in to:
                    to[v] = into
                    queue.append(v)
                elif not (math.isclose(to[v][0], into[0], rel_tol=1e-9) and math.isclose(to[v][1], into[1], rel_tol=1e-9, abs_tol=1e-9)):
                    raise ValueError(f"two paths from {v} to {target} disagree: {to[v]} and {into}")
        for u, f in to.items():
            if u in out and out[u][0] != target:
                raise ValueError(f"{u} leads to {out[u][0]} and {target}")
            out[u] = (target, *f)
    return out


def conversion_table(spark: SparkSession) -> DataFrame:
    """unit, target, scale, offset: one row per unit of the fixed graph."""
    rows = [(u, *f) for u, f in sorted(conversions().items())]
    return spark.createDataFrame(rows, "unit string, target string, scale double, offset double")


def target_unit(field: str | Column) -> Column:
    """The canonical unit of a field."""
    table = F.create_map(*[F.lit(x) for f, dim in DIMENSION.items() for x in (f, CANONICAL[dim])])
    return F.try_element_at(table, F.col(field) if isinstance(field, str) else field)


def unit_name(c: str | Column) -> Column:
    """Our name of a unit spelled in text, else NULL."""
    pairs = [F.lit(x) for u, names in SPELLINGS.items() for n in names for x in (n, u)]
    text = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.try_element_at(F.create_map(*pairs), text)


def header_unit(c: str | Column) -> Column:
    """The unit a column header names: 'acc_x [g]', 'Temp(°C)', 'Time / ms', 'gx_in_dps'."""
    text = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_extract(text, r"(?:\[(.+)\]|\((.+)\)| / (.+)|_in_(.+))$", 0)
    return unit_name(F.regexp_replace(F.regexp_replace(inner, r"^(\[|\(| / |_in_)", ""), r"[\])]$", ""))


#: Words by which notes speak of the channels of a dimension.
CHANNEL_WORDS = {
    "rate": "gyro|gyroscope|angular|rates?",
    "acceleration": "acc|accel|accelerometer|acceleration",
    "temperature": "temp|temperature|probe",
    "time": "time|clock|counter",
    "voltage": "supply|rail|voltage",
}
#: Clauses with these words speak of something else than the stored values.
OTHER_MATTER = r"\b(range|sheet|vendor|not)\b"


def note_patterns() -> list[tuple[str, str, str]]:
    """(dimension, unit, pattern): a clause that names a channel and after it a unit of its dimension."""
    of = {u: dim for dim, target in CANONICAL.items() for u, (t, _, _) in conversions().items() if t == target}
    quoted = lambda n: re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", n)
    return [(of[u], u, rf"\b(?:{CHANNEL_WORDS[of[u]]})\b(?:[^;]*[^;\w/°-])?(?:{'|'.join(quoted(n) for n in names)})(?:$|[^\w/^²-])") for u, names in SPELLINGS.items()]


def statements(channel_units: DataFrame, recordings: DataFrame) -> DataFrame:
    """dataset_id, field_name, stated: the unit said, by ``units``, the header, the notes and ``original_units`` in turn."""
    dims = F.create_map(*[F.lit(x) for p in DIMENSION.items() for x in p])
    cu = channel_units.where(F.col("field_name").isin(*DIMENSION)).select(
        "dataset_id", "field_name", unit_name("units").alias("u"), header_unit("source_column").alias("h"), unit_name("original_units").alias("o")
    )
    cu = cu.groupBy("dataset_id", "field_name").agg(*[F.min(c).alias(c) for c in ("u", "h", "o")])
    clauses = F.filter(F.split(F.lower(F.max("notes")), ";"), lambda c: ~c.rlike(OTHER_MATTER))
    notes = recordings.groupBy("dataset_id").agg(F.array_join(clauses, ";").alias("t")).where("t <> ''")
    said = [F.when(F.col("dim") == dim, F.when(F.col("t").rlike(p), F.lit(u))) for dim, u, p in note_patterns()]
    joined = cu.join(notes, "dataset_id", "left").withColumn("dim", dims[F.col("field_name")]).withColumn("n", F.coalesce(*said))
    return joined.select("dataset_id", "field_name", F.coalesce("u", "h", "n", "o").alias("stated"))


#: Bands of a channel's values, lowest first: (name of the band's counts, cuts, least ratio of a jump between bands).
_BANDS = {"temperature": ((48.0, 150.0), 0.0), "supply_voltage": ((60.0,), 10.0), "a": (ACCEL_BANDS, 3.0)}


def _band_of(x: Column, cuts: tuple[float, ...], most: float) -> Column:
    """Number of the band a value lies in, NULL for none."""
    band = sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.when(x.isNotNull() & (F.abs(x) < most), band)


def _band_counts(n: str, cuts: tuple[float, ...]) -> list[Column]:
    """Rows per band, rows that follow one of the same band, and jumps into another one."""
    out = []
    for i in range(len(cuts) + 1):
        here = F.col(f"b_{n}") == i
        out += [F.count(F.when(here, 1)).alias(f"{n}_{i}"), F.count(F.when(here & (F.col(f"p_{n}") == i), 1)).alias(f"{n}_pair_{i}")]
    return [*out, F.count(F.when(F.col(f"j_{n}"), 1)).alias(f"{n}_jumps")]


def _length(fields: tuple[str, ...]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [if_finite(f) * if_finite(f) for f in fields]))


def evidence(samples: DataFrame, recordings: DataFrame, period: str = "nominal_period_s") -> DataFrame:
    """One row per recording of a sample table with what its values say (see the module text)."""
    have = set(samples.columns)
    axes = [tuple(p + x for x in "xyz") for p in "ag" if {p + x for x in "xyz"} <= have]
    fields = [f for f in DIMENSION if f in have]
    key = F.coalesce(F.col("row_ord"), F.col("row_id"), F.lit(0))
    block = Window.partitionBy("dataset_id", F.floor(key / BLOCK_ROWS)).orderBy(key)
    moving = F.lower(F.trim("motion_state")) == "moving" if "motion_state" in have else F.lit(None).cast("boolean")
    keep = ["row_ord", "row_id", *fields, *(["motion_state"] if "motion_state" in have else [])]
    df = samples.select("dataset_id", *keep)
    step = if_finite("timestamp") - F.lag(if_finite("timestamp")).over(block)
    noise = [F.abs(if_finite(f) - F.lag(if_finite(f)).over(block)).alias(f"d_{f}") for g in axes for f in g]
    lengths = [_length(g).alias("a_len" if g[0] == "ax" else "g_len") for g in axes]
    banded = {f: if_finite(f) for f in ("temperature", "supply_voltage") if f in have} | ({"a": _length(axes[0])} if ("ax", "ay", "az") in axes else {})
    bands = []
    for n, x in banded.items():
        cuts, ratio = _BANDS[n]
        b = _band_of(x, cuts, 1e4 if n == "a" else 1e6)
        # The last row before that has a band: rows without one do not tear a stretch.
        seen = F.when(b.isNotNull(), F.struct(b.alias("b"), x.alias("x")))
        before = F.last(seen, ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1))
        jump = (before["b"] != b) & (F.greatest(x, before["x"]) >= ratio * F.least(x, before["x"]))
        bands += [b.alias(f"b_{n}"), before["b"].alias(f"p_{n}"), jump.alias(f"j_{n}")]
    df = df.select("dataset_id", *fields, F.when(step > 0, step).alias("step"), *noise, *lengths, *bands, moving.alias("moving"))
    q = lambda c, p: F.percentile_approx(c, p, 1000)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    aggs = [F.count("*").alias("n"), q("step", 0.5).alias("step"), share(F.coalesce("moving", F.lit(False))).alias("moving_share"), F.count("moving").alias("labelled")]
    aggs += [F.count(F.when(finite(f), 1)).alias(f"n_{f}") for f in fields]
    aggs += [q(f"d_{f}", 0.5).alias(f"d_{f}") for g in axes for f in g]
    for n in banded:
        aggs += _band_counts(n, _BANDS[n][0])
    if "a" in banded:
        a = F.col("a_len")
        aggs += [q("a_len", p).alias(n) for p, n in ((0.1, "a_p10"), (0.5, "a_p50"), (0.9, "a_p90"))]
        aggs += [q(F.when(F.col("b_a") == 2, a), 0.5).alias("a_high")]
    if ("gx", "gy", "gz") in axes:
        aggs += [q("g_len", 0.5).alias("g_p50")]
    df = df.groupBy("dataset_id").agg(*aggs)
    info = recordings.groupBy("dataset_id").agg(F.max(period).alias("period"), F.max("test_mode").alias("test_mode"), F.max("expected_stationary").alias("resting"))
    return df.join(info, "dataset_id", "left")


def _is_moving() -> Column:
    spread = (F.col("a_p90") - F.col("a_p10")) / F.col("a_p50")
    return F.coalesce(
        F.when(F.col("labelled") > 0, F.col("moving_share") > 0.5),
        F.when(F.col("test_mode") == "imu_dynamic", F.lit(True)).when(F.col("test_mode").isin("imu_stationary", "imu_controlled_orientation"), F.lit(False)),
        ~F.col("resting"),
        spread > 0.1,
        F.lit(False),
    )


def _ranked(n: str, names: list[str]) -> Column:
    """The bands of a channel, fullest first."""
    rows = [F.struct(F.col(f"{n}_{i}").alias("n"), F.lit(-i).alias("i"), F.lit(u).alias("u"), F.col(f"{n}_pair_{i}").alias("pairs")) for i, u in enumerate(names)]
    return F.slice(F.sort_array(F.array(*rows), asc=False), 1, 2)


_BAND_UNITS = {"temperature": ["degC", "degF", "K"], "supply_voltage": ["V", "mV"], "a": ["g", "m/s^2", "high"]}


def _with_bands(df: DataFrame, groups: list[str]) -> DataFrame:
    """``df`` with ``u_<group>``, the unit of the rows that are not canonical or of all, and ``m_<group>``: whether it changes on the way."""
    canonical = {"temperature": "degC", "supply_voltage": "V", "a": "m/s^2"}
    df = df.withColumns({f"_r_{n}": _ranked(n, _BAND_UNITS[n]) for n in groups})
    pairs = lambda n: F.col(f"_r_{n}")[1]["pairs"]
    df = df.withColumns({f"m_{n}": (pairs(n) >= LONG_STRETCH) | ((pairs(n) >= 1) & (F.col(f"{n}_jumps") >= 1)) for n in groups})
    first = lambda n: F.col(f"_r_{n}")[0]["u"]
    return df.withColumns({f"u_{n}": F.when(F.col(f"m_{n}") & (first(n) == canonical[n]), F.col(f"_r_{n}")[1]["u"]).otherwise(first(n)) for n in groups})


def _moving() -> Column:
    return F.col("_moves")


def _axis_unit(f: str, others: tuple[str, str], canonical: str, logs: dict[str, float]) -> Column:
    """A unit of its own for one axis: its noise differs from the others' as that unit does.

    Resting axes have nearly equal noise, so the ratio is enough; moving ones differ, so the unit must be stated too.
    """
    r = F.log10(F.try_divide(F.col(f"d_{f}"), F.sqrt(F.col(f"d_{others[0]}") * F.col(f"d_{others[1]}"))))
    stated, rest = F.col(f"s_{f}"), [F.coalesce(F.col(f"s_{o}"), F.lit(canonical)) == canonical for o in others]
    slack = F.when(_moving(), F.lit(0.75)).otherwise(F.lit(0.5))
    said = [F.when((stated == u) & rest[0] & rest[1] & (F.abs(r - e) < slack), F.lit(u)) for u, e in logs.items()]
    seen = [F.when(~_moving() & (F.abs(r - e) < 0.35), F.lit(u)) for u, e in logs.items()]
    return F.coalesce(*said, *seen)


def channel_units_from_values(samples: DataFrame, recordings: DataFrame, channel_units: DataFrame) -> DataFrame:
    """dataset_id, field_name, unit, partial, stated: the unit each stored channel really is in.

    ``partial`` channels hold canonical values in some rows and ``unit`` in the others.
    """
    ev = evidence(samples, recordings)
    have = set(samples.columns)
    fields = [f for f in DIMENSION if f in have]
    said = statements(channel_units, recordings).groupBy("dataset_id").pivot("field_name", list(DIMENSION)).agg(F.first("stated"))
    df = ev.join(said.select("dataset_id", *[F.col(f).alias(f"s_{f}") for f in DIMENSION]), "dataset_id", "left")

    groups = [n for n, f in (("temperature", "temperature"), ("supply_voltage", "supply_voltage"), ("a", "ax")) if f in have]
    df = _with_bands(df.withColumn("_moves", _is_moving() if "ax" in have else F.lit(False)), groups)
    no = F.lit(False)
    unit: dict[str, Column] = {}
    partial: dict[str, Column] = dict.fromkeys(fields, no)
    scale = F.log10(F.try_divide(F.col("step"), F.col("period")))
    times = {"s": 0.0, "ms": 3.0, "us": 6.0, "ns": 9.0}
    unit["timestamp"] = F.coalesce(F.least(*[F.struct(F.abs(scale - e).alias("d"), F.lit(u).alias("u")) for u, e in times.items()])["u"], F.lit("s"))
    unit["timestamp"] = F.when(scale.isNull(), F.lit("s")).otherwise(unit["timestamp"])
    if "temperature" in have:
        unit["temperature"], partial["temperature"] = F.col("u_temperature"), F.col("m_temperature")
    if "supply_voltage" in have:
        unit["supply_voltage"], partial["supply_voltage"] = F.col("u_supply_voltage"), F.col("m_supply_voltage")
    if "ax" in have:
        a = ("ax", "ay", "az")
        logs = {"g": -math.log10(STANDARD_GRAVITY), "mg": 3 - math.log10(STANDARD_GRAVITY), "cm/s^2": 2.0}
        df = df.withColumns({f"_own_{f}": _axis_unit(f, tuple(o for o in a if o != f), "m/s^2", logs) for f in a})
        own = {f: F.col(f"_own_{f}") for f in a}
        single = F.coalesce(*own.values()).isNotNull()
        stated = F.coalesce(*[F.when(F.col(f"s_{f}").isin("mg", "cm/s^2"), F.col(f"s_{f}")) for f in a])
        # Both lie near 1000 at rest; gravity tells them apart unless the recording moves, then the statement does.
        high = F.when(_moving() & stated.isNotNull(), stated).otherwise(F.when(F.col("a_high") < 990, F.lit("cm/s^2")).otherwise(F.lit("mg")))
        mixed = F.col("m_a")
        group = F.when(F.col("u_a") == "high", high).otherwise(F.col("u_a"))
        for f in a:
            unit[f] = F.when(single, F.coalesce(own[f], F.lit("m/s^2"))).otherwise(group)
            partial[f] = ~single & mixed
    if "gx" in have:
        g = ("gx", "gy", "gz")
        logs = {"deg/s": math.log10(180 / math.pi), "mdeg/s": math.log10(180 / math.pi) + 3}
        df = df.withColumns({f"_own_{f}": _axis_unit(f, tuple(o for o in g if o != f), "rad/s", logs) for f in g})
        own = {f: F.col(f"_own_{f}") for f in g}
        single = F.coalesce(*own.values()).isNotNull()
        m = F.col("g_p50")
        pick = lambda cuts: F.when(m < cuts[0], F.lit("rad/s")).when(m < cuts[1], F.lit("deg/s")).otherwise(F.lit("mdeg/s"))
        group = F.when(_moving(), pick(RATE_MOVING)).otherwise(pick(RATE_REST))
        for f in g:
            unit[f] = F.when(single, F.coalesce(own[f], F.lit("rad/s"))).when(m.isNull(), F.lit("rad/s")).otherwise(group)
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), unit[f].alias("unit"), F.coalesce(partial[f], no).alias("partial"), F.col(f"s_{f}").alias("stated"), F.col(f"n_{f}").alias("n")) for f in fields])
    return df.select("dataset_id", F.explode(rows).alias("r")).select("dataset_id", "r.*").where("n > 0").drop("n")


def with_functions(units: DataFrame) -> DataFrame:
    """The channel table equi-joined with the conversion table on source unit and canonical target: adds target, scale and offset."""
    table = conversion_table(units.sparkSession)
    # The table is as large as the fixed graph.
    return units.withColumn("target", target_unit("field_name")).join(F.broadcast(table), ["unit", "target"], "left")


def to_common_units(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """``samples`` with every stored channel converted to s, m/s^2, rad/s, degC and V; other columns untouched.

    ``channels`` is the result of :func:`channel_units_from_values` for the same table.
    """
    have = set(samples.columns)
    fields = [f for f in DIMENSION if f in have]
    wide = with_functions(channels).groupBy("dataset_id").agg(
        *[F.first(F.when(F.col("field_name") == f, F.struct("scale", "offset", "partial")), ignorenulls=True).alias(f"_f_{f}") for f in fields]
    )
    df = attach(samples, wide, ["dataset_id"])
    groups = {"a": ("ax", "ay", "az"), "temperature": ("temperature",), "supply_voltage": ("supply_voltage",)}
    groups = {n: tuple(f for f in g if f in fields) for n, g in groups.items() if set(g) & set(fields) and (n != "a" or set(g) <= have)}
    changes = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_f_{f}")["partial"], F.lit(False)) for g in groups.values() for f in g], F.lit(False))
    # Only recordings that change unit need the order of their rows.
    some, rest = df.where(changes), df.where(~changes)
    key = F.coalesce(F.col("row_ord"), F.col("row_id"), F.lit(0))
    block = Window.partitionBy("dataset_id", F.floor(key / BLOCK_ROWS)).orderBy(key)
    up, down = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    own = {n: _row_is_canonical(n) for n in groups}
    near = {f"_c_{n}": F.coalesce(F.last(c, ignorenulls=True).over(up), F.first(c, ignorenulls=True).over(down), F.lit(True)) for n, c in own.items()}
    some = some.withColumns(near)
    rest = rest.withColumns({f"_c_{n}": F.lit(False) for n in groups})
    df = rest.unionByName(some)
    group_of = {f: n for n, g in groups.items() for f in g}
    exprs = {}
    for f in fields:
        c, fn = F.col(f).cast("double"), F.col(f"_f_{f}")
        whole = c * fn["scale"] + fn["offset"]
        stays = fn.isNull() | fn["scale"].isNull()
        if f in group_of:
            stays = stays | (fn["partial"] & F.col(f"_c_{group_of[f]}"))
        exprs[f] = F.when(stays, c).otherwise(whole)
    return df.withColumns(exprs).drop(*[f"_f_{f}" for f in fields], *near)


def _row_is_canonical(n: str) -> Column:
    """For channels that change unit on the way: whether this row is in the canonical unit, NULL where it does not tell."""
    x = _length(("ax", "ay", "az")) if n == "a" else if_finite(n)
    return _band_of(x, _BANDS[n][0], 1e4 if n == "a" else 1e6) == (1 if n == "a" else 0)


def not_canonical(channels: DataFrame) -> DataFrame:
    """dataset_id and field_name of channels whose function into the canonical unit is not the identity, wholly or in part."""
    changed = F.col("partial") | (F.col("scale") != 1) | (F.col("offset") != 0)
    return with_functions(channels).where(changed).select("dataset_id", "field_name")
