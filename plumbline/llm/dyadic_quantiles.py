"""Problem 4: percentiles of very large numeric columns.

Values are quantised to a bounded, ordered universe of 2**32 codes (a logarithmic scale of both signs, about one part
in a million of the value).  A group's values are then summarised by counts at nodes of the dyadic tree over the
universe: a node that holds less than n / k rows together with its sibling and parent is added to the parent.  Digests
of parts are merged by adding the counts of equal nodes and compressing again, in any grouping (files, days, tasks).

Guarantee, whatever the data and the merge order: no inner node holds more than n / k rows, so the rank of a reported
value is off by at most LEVELS * n / k = ``eps`` * n.  Groups of fewer than k rows are never compressed: their ranks
are exact.  ``percentiles`` returns a value together with the interval that is certain to hold the exact percentile.

Work at scale: each task digests its own rows before any shuffle (at most about 3 k nodes a group), and digests are
merged in rounds of 256 parts each until one is left, so no task reads more than about 256 * 3 k nodes of a group.

Defined results: NULL, NaN and infinite values are left out; a group without finite values gives no row; NULL keys
form groups of their own; ties and repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from plumbline.chunks import map_whole_groups
from plumbline.columns import finite
from plumbline.joins import attach, written

LEVELS = 32
#: Rank error as a share of the rows of a group.
EPS = 0.005
_HALF = 1 << (LEVELS - 1)
_STEPS = float(1 << 20)  # codes per unit of the logarithm
_TINY = 1e-6  # below this the scale is linear
#: Rows a task gathers before it digests them, and nodes it may hold before it hands its digests on.
BUFFER_ROWS, BUFFER_NODES = 1 << 20, 1 << 22
#: Digests merged at once.
FAN_IN = 256
#: Parts a bracket is cut into before its rows are ranked.
SUB_BRACKETS = 4096


def code(value: Column) -> Column:
    """Order-preserving code of a finite double in 0 .. 2**32 - 1."""
    a = F.abs(value)
    log = F.when(a > 1e140, F.log(a) + F.lit(float(np.log(2 / _TINY)))).otherwise(F.log(a / _TINY + F.sqrt((a / _TINY) * (a / _TINY) + 1)))
    return (F.floor(F.signum(value) * log * _STEPS) + F.lit(_HALF)).cast("bigint")


def value_at(codes: np.ndarray) -> np.ndarray:
    """Smallest value of each code (of 2**32: just above the largest)."""
    y = (codes.astype(np.float64) - _HALF) / _STEPS
    a = np.abs(y)
    with np.errstate(over="ignore"):
        out = np.where(a > 300, np.exp(a + np.log(_TINY / 2)), _TINY * np.sinh(np.minimum(a, 300)))
    return np.sign(y) * np.minimum(out, 1.797e308 / (1 + 1e-8))


def add_up(g: np.ndarray, level: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of equal (group, level, node) added, sorted by them."""
    if not len(g):
        return g, level, node, n
    order = np.lexsort((node, level, g))
    g, level, node, n = g[order], level[order], node[order], n[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (level[1:] != level[:-1]) | (node[1:] != node[:-1])])
    return g[first], level[first], node[first], np.add.reduceat(n, first)


def compress(g: np.ndarray, level: np.ndarray, node: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Bottom-up compression of the digests of many groups (codes 0..) at once."""
    g, level, node, n = add_up(g, level, node, n)
    if not len(g):
        return g, level, node, n
    least = np.bincount(g, weights=n).astype(np.int64) // k
    if not least.any():
        return g, level, node, n
    done: list[tuple[np.ndarray, ...]] = []
    busy = least[g] > 0
    done.append((g[~busy], level[~busy], node[~busy], n[~busy]))
    g, level, node, n = g[busy], level[busy], node[busy], n[busy]
    up_g, up_node, up_n = (np.empty(0, np.int64) for _ in range(3))
    for at in range(LEVELS):
        here, above = level == at, level == at + 1
        cg, _, cnode, cn = add_up(np.r_[g[here], up_g], np.zeros(here.sum() + len(up_g), np.int64), np.r_[node[here], up_node], np.r_[n[here], up_n])
        if len(cg):
            parent = cnode >> 1
            first = np.flatnonzero(np.r_[True, (cg[1:] != cg[:-1]) | (parent[1:] != parent[:-1])])
            pg, pnode, pn = cg[first], parent[first], np.add.reduceat(cn, first)
            # What the parent already holds counts too.
            key = pg * (1 << (LEVELS + 1)) + pnode
            own = g[above] * (1 << (LEVELS + 1)) + node[above]
            pos = np.searchsorted(own, key)
            held = np.zeros(len(key), np.int64)
            if len(own):
                hit = own[np.minimum(pos, len(own) - 1)] == key
                held[hit] = n[above][pos[hit]]
            merge = pn + held < least[pg]
            up_g, up_node, up_n = pg[merge], pnode[merge], pn[merge]
            kept = ~np.repeat(merge, np.diff(np.r_[first, len(cg)]))
            done.append((cg[kept], np.full(kept.sum(), at, np.int64), cnode[kept], cn[kept]))
        else:
            up_g, up_node, up_n = (np.empty(0, np.int64) for _ in range(3))
    top = level == LEVELS
    done.append((np.r_[g[top], up_g], np.full(top.sum() + len(up_g), LEVELS, np.int64), np.r_[node[top], up_node], np.r_[n[top], up_n]))
    return add_up(*(np.concatenate(x) for x in zip(*done, strict=True)))


def _nodes_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    out = T.StructType([df.schema[c] for c in keys])
    return out.add("level", T.IntegerType()).add("node", T.LongType()).add("n", T.LongType())


def digest(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS) -> DataFrame:
    """Compressed dyadic counts per group: keys, level, node, n."""
    keys = list(keys)
    k = int(np.ceil(LEVELS / eps))
    rows = df.where(finite(value)).select(*keys, code(F.col(value).cast("double")).alias("node"))
    out = _nodes_schema(rows, keys).add("part", T.IntegerType())
    target = to_arrow_schema(out)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        held: pd.DataFrame | None = None
        waiting: list[pa.RecordBatch] = []

        def fold() -> pd.DataFrame:
            new = pa.Table.from_batches(waiting).to_pandas()
            waiting.clear()
            new["level"], new["n"] = 0, 1
            both = new if held is None else pd.concat([held, new], ignore_index=True)
            return _compressed(both, keys, k)

        def handed(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            frame["part"] = part
            yield from pa.Table.from_pandas(frame[target.names], schema=target, preserve_index=False).to_batches(max_chunksize=1 << 16)

        size = 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= BUFFER_ROWS:
                held, size = fold(), 0
                if len(held) > BUFFER_NODES:
                    yield from handed(held)
                    held = None
        if size:
            held = fold()
        if held is not None and len(held):
            yield from handed(held)

    return merge(rows.mapInArrow(local, out), keys, eps, tasks=_tasks(rows))


def _compressed(frame: pd.DataFrame, keys: Sequence[str], k: int) -> pd.DataFrame:
    if keys:
        g = frame.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy(np.int64)
    else:
        g = np.zeros(len(frame), np.int64)
    first = np.unique(g, return_index=True)[1]
    names = frame.iloc[first][list(keys)].reset_index(drop=True)
    cg, level, node, n = compress(g, frame["level"].to_numpy(np.int64), frame["node"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), k)
    out = names.iloc[cg].reset_index(drop=True)
    out["level"], out["node"], out["n"] = level.astype(np.int32), node, n
    return out


def _tasks(df: DataFrame) -> int:
    """At least the number of tasks that read ``df``: scans are cut by files and by bytes, shuffles by the session's settings."""
    conf = df.sparkSession.conf
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = max(1, int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return max(len(df.inputFiles()) + 2 * size // split, int(conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def merge(nodes: DataFrame, keys: Sequence[str], eps: float = EPS, tasks: int = FAN_IN) -> DataFrame:
    """One compressed digest per group from the digests of any parts (keys, level, node, n and possibly ``part``).

    Digests of up to ``tasks`` numbered parts are merged ``FAN_IN`` at a time until one is left.
    """
    keys = list(keys)
    k = int(np.ceil(LEVELS / eps))
    schema = _nodes_schema(nodes, keys)

    def together(names: list[str], frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        g = np.repeat(np.arange(len(starts)), ends - starts)
        cg, level, node, n = compress(g, frame["level"].to_numpy(np.int64), frame["node"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), k)
        out = frame[names].iloc[starts[cg]].reset_index(drop=True)
        out["level"], out["node"], out["n"] = level.astype(np.int32), node, n
        return out

    if "part" in nodes.columns:
        within = [*keys, "part"]
        first = T.StructType([*schema.fields, nodes.schema["part"]])
        while tasks > FAN_IN:
            nodes = nodes.withColumn("part", F.floor(F.col("part") / FAN_IN).cast(nodes.schema["part"].dataType))
            nodes = map_whole_groups(nodes, within, [], partial(together, within), _ddl(first))
            tasks = -(-tasks // FAN_IN)
    return map_whole_groups(nodes.select(*schema.names), keys, [], partial(together, keys), _ddl(schema))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def percentiles(nodes: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, rows, p, value, low, high, least, most: each percentile (linear between ranks) and the interval certain to hold it.

    ``least`` to ``most`` is certain to hold both order statistics the percentile lies between.
    """
    keys = list(keys)
    head = T.StructType([nodes.schema[c] for c in keys])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + (", " if keys else "") + "rows bigint, p double, value double, low double, high double, least double, most double"
    probs = np.asarray(probabilities, float)

    def read_off(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        level, node, n = (frame[c].to_numpy(np.int64) for c in ("level", "node", "n"))
        low, high = value_at(node << level), value_at((node + 1) << level)
        pick, rows, out = [], [], []
        for a, b in zip(starts, ends, strict=True):
            total = int(n[a:b].sum())
            pos = probs * (total - 1)
            r0 = np.floor(pos)
            part = pos - r0
            bounds, ends = [], []
            low_edge = low[a:b]
            for edge in (low_edge, high[a:b]):
                order = np.argsort(edge, kind="stable")
                cum = np.cumsum(n[a:b][order])
                at = lambda r: edge[order][np.minimum(np.searchsorted(cum, r + 1), b - a - 1)]
                first, second = at(r0), at(np.minimum(r0 + 1, total - 1))
                bounds.append(first + (second / 2 - first / 2) * part * 2)
                ends.append(first if edge is low_edge else second)
            # Codes are floors of a rounded logarithm: one part in 10**9 covers its error.
            lo, least = (x - 1e-9 * np.abs(x) - 1e-15 for x in (bounds[0], ends[0]))
            hi, most = (x + 1e-9 * np.abs(x) + 1e-15 for x in (bounds[1], ends[1]))
            pick += [a] * len(probs)
            rows += [total] * len(probs)
            out.append(np.stack([probs, (lo + hi) / 2, lo, hi, least, most], axis=1))
        res = frame.iloc[pick][keys].reset_index(drop=True)
        res["rows"] = rows
        res[["p", "value", "low", "high", "least", "most"]] = np.concatenate(out)
        return res

    if not keys:
        nodes, keys_in = nodes.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_in = keys
    return map_whole_groups(nodes, keys_in, [], read_off, schema)


def exact_percentiles(df: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact percentiles of the groups in ``brackets`` (a result of :func:`percentiles`): keys, p, exact.

    Rows below a bracket are counted, those inside it (about 2 eps of a group) are counted per part of the bracket, and
    only the parts that hold the wanted ranks are ranked: no task sees more than a small share of a bracket.
    """
    keys = list(keys)
    first = F.floor(F.col("p") * (F.col("rows") - 1))
    entry = F.struct("p", "rows", "least", "most", first.alias("r0"), F.least(first + 1, F.col("rows") - 1).alias("r1"))
    marks = written(brackets.groupBy(*keys).agg(F.collect_list(entry).alias("marks")))  # one entry per probability
    rows = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("v"))
    rows = attach(rows, marks, keys, "inner").select(*keys, "v", F.explode("marks").alias("m")).where(F.col("v") <= F.col("m.most"))
    low = code(F.col("m.least"))
    share = (code(F.col("v")) - low) / (code(F.col("m.most")) - low + 1)
    sub = F.when(F.col("v") >= F.col("m.least"), F.least(F.floor(share * SUB_BRACKETS), F.lit(SUB_BRACKETS - 1)).cast("int")).otherwise(F.lit(-1))
    rows = rows.select(*keys, "m.p", "m.rows", "m.r0", "m.r1", sub.alias("sub"), "v")
    by = [*keys, "p", "rows", "r0", "r1"]
    counts = rows.groupBy(*by, "sub").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("sub")  # at most SUB_BRACKETS + 1 rows
    counts = counts.withColumn("upto", F.sum("c").over(w)).withColumn("base", F.col("upto") - F.col("c"))
    holds = lambda r: (F.col("base") <= F.col(r)) & (F.col(r) < F.col("upto"))
    parts = counts.where(holds("r0") | holds("r1")).select(*keys, "p", "sub", "base")
    inner = attach(rows, parts, [*keys, "p", "sub"], "inner").groupBy(*by, "sub", "base", "v").agg(F.count("*").alias("c"))
    upto = F.col("base") + F.sum("c").over(Window.partitionBy(*by, "sub").orderBy("v"))
    ranked = inner.withColumn("upto", upto)
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("v")))
    out = ranked.groupBy(*by).agg(at("r0").alias("x0"), at("r1").alias("x1"))
    return out.select(*keys, "p", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("p") * (F.col("rows") - 1) - F.col("r0"))).alias("exact"))
