"""Joins of a large table with a table of descriptions (one row per source, file or group)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_folder

#: Descriptions of at most this many bytes in memory may be broadcast; beyond it the join is shuffled with salted keys.
BROADCAST_BYTES = 32 << 20
#: Parts a key of the large side is cut into when the join is shuffled.
SALTS = 16


#: Bytes of the tables written so far, by the number of the data set that holds them.
_SIZES: dict[int, int] = {}


@dataclass
class Written:
    """A table that was computed once and lies in the shared folder, with its size as rows in memory."""

    df: DataFrame
    bytes: int


def _bytes_of(x: Column, kind: T.DataType) -> Column:
    """Bytes of a value in Spark's row format, about; 8 for whatever has a fixed width."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(x), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(x[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + _bytes_of(v, kind.elementType)) if not _fixed(kind.elementType) else F.size(x) * 8
        return F.lit(24) + F.greatest(F.coalesce(each, F.lit(0)), F.lit(0)).cast("bigint")
    if isinstance(kind, T.MapType):
        return _bytes_of(F.map_keys(x), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(x), T.ArrayType(kind.valueType))
    return F.lit(8)


def _fixed(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))


def written(small: DataFrame) -> Written:
    """``small`` computed once, into the shared folder, its bytes summed on the way; later steps read it from there."""
    shared_folder(small.sparkSession)
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in small.schema), F.lit(16))
    seen = Observation()
    df = small.observe(seen, F.sum(width.cast("bigint")).alias("bytes")).checkpoint()
    size = seen.get.get("bytes") or 0
    _SIZES[df._jdf.queryExecution().analyzed().rdd().id()] = size
    return Written(df, size)


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables ``df`` is made of: written ones as counted, others by the optimiser's knowledge."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        known = _SIZES.get(leaf.rdd().id()) if leaf.nodeName() == "Scan ExistingRDD" or "LogicalRDD" in leaf.getClass().getName() else None
        total += known if known is not None else int(str(leaf.stats().sizeInBytes()))
    return total


def attach(big: DataFrame, small: DataFrame | Written, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small`` on equal keys; ``small`` must hold one row per key.

    ``small``, mostly an aggregate of a large table, is written once and its bytes are summed.  Within ``limit`` it is
    broadcast and ``big`` keeps its partitioning; beyond it both sides are shuffled on (key, salt), so that a key that
    holds a third of ``big`` is spread over ``salts`` tasks.
    """
    done = small if isinstance(small, Written) else written(small)
    if done.bytes <= limit:
        return big.join(F.broadcast(done.df), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if "map<" not in t]), F.lit(salts)).cast("int"))
    spread = done.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
