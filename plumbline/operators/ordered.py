"""Order-dependent columns of recordings of any length.

A window over a whole recording would put all of its rows into one task.  Here rows are cut into blocks of
``block_rows`` consecutive order values; windows run inside blocks, and what has to cross a block's edge (the row
before it, the sum up to it, the run that reaches it) goes through a table of one row per block.

``order`` must be an integer column that is unique within a group.  Rows without a key or without an order have no
place in any order: they are kept, with NULL for what depends on it, and are nobody's neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.chunks import map_whole_groups

BLOCK_ROWS = 65_536
#: Parts the rows without a place are spread over.
SPARE = 256


def _placed(keys: Sequence[str], order: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(order).isNotNull())


def _blocks(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """``df`` with ``_block`` and ``_spare`` (0 for rows with a place), partitioned by block."""
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]), F.lit(SPARE)).cast("int") + 1
    spare = F.when(_placed(keys, order), F.lit(0)).otherwise(hashed)
    return df.withColumns({"_block": F.floor(F.col(order) / block_rows).cast("bigint"), "_spare": spare}).repartition(*keys, "_block", "_spare")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the values of ``columns`` in the row before, NULL in the first row of a group."""
    b = _blocks(df, keys, order, block_rows)
    inside = Window.partitionBy(*keys, "_block", "_spare").orderBy(order)
    row = F.struct(*columns)
    last = b.where("_spare = 0").groupBy(*keys, "_block", "_spare").agg(F.max_by(row, order).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block")
    edge = last.select(*keys, "_block", "_spare", F.lag("_last").over(before).alias("_edge"))
    out = b.withColumns({"_in": F.lag(row).over(inside), "_first": F.row_number().over(inside) == 1}).join(edge, [*keys, "_block", "_spare"], "left")
    prev = F.when(F.col("_spare") == 0, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_in")))
    return out.withColumn("_prev", prev).select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in columns])


def with_previous_value(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with, for each of ``columns``, its last value before the row that is not NULL."""
    b = _blocks(df, keys, order, block_rows)
    inside = Window.partitionBy(*keys, "_block", "_spare").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    last = b.where("_spare = 0").groupBy(*keys, "_block", "_spare").agg(*[F.max_by(c, there(c)).alias(f"_l_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.select(*keys, "_block", "_spare", *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_e_{c}") for c in columns])
    out = b.withColumns({f"_i_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns}).join(edge, [*keys, "_block", "_spare"], "left")
    return out.select(*df.columns, *[F.when(F.col("_spare") == 0, F.coalesce(f"_i_{c}", f"_e_{c}")).alias(f"{prefix}{c}") for c in columns])


def with_running_sum(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the sums of ``values`` up to and including each row."""
    b = _blocks(df.withColumns({f"_v_{n}": c for n, c in values.items()}), keys, order, block_rows)
    inside = Window.partitionBy(*keys, "_block", "_spare").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = b.where("_spare = 0").groupBy(*keys, "_block", "_spare").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    base = total.select(*keys, "_block", "_spare", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    out = b.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in values}).join(base, [*keys, "_block", "_spare"], "left")
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values])


def with_position(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the number of the row in its group, from 0."""
    out = with_running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, block_rows)
    return out.withColumn(name, F.col(name) - 1)


def _runs_in_blocks(names: list[str], keys: list[str], frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """Per block and flag: rows, run at the start, run at the end and longest run."""
    n = ends - starts
    row = np.arange(len(frame))
    out = []
    for i, name in enumerate(names):
        on = frame[name].to_numpy(bool)
        # A block's runs lie between its edges and its rows that are off.
        new = np.zeros(len(frame), bool)
        new[starts] = True
        last_off = np.maximum.accumulate(np.where(~on, row, np.where(new, row - 1, -1)))
        so_far = row - last_off
        first_off = np.minimum.reduceat(np.where(on, len(frame), row), starts)
        out.append(
            pd.DataFrame(
                {
                    **{k: frame[k].iloc[starts].to_numpy() for k in keys},
                    "_block": frame["_block"].to_numpy()[starts],
                    "_flag": i,
                    "_rows": n,
                    "_head": np.minimum(first_off, ends) - starts,
                    "_tail": so_far[ends - 1],
                    "_most": np.maximum.reduceat(so_far, starts),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flags: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per group and flag the longest run of consecutive rows in which the flag is true; all flags in one pass.

    Each block yields its longest run and the runs at its edges; runs that cross blocks are put together from those.
    """
    keys, names = list(keys), list(flags)
    in_blocks = _runs_in_blocks
    block = F.floor(F.col(order) / block_rows).cast("bigint").alias("_block")
    b = df.where(_placed(keys, order)).select(*keys, block, order, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{head}, _block bigint, _flag int, _rows bigint, _head bigint, _tail bigint, _most bigint"

    def runs(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        return in_blocks(names, keys, frame, starts, ends)

    blocks = map_whole_groups(b, [*keys, "_block"], [order], runs, schema)
    # Blocks that are on throughout carry a run on: a chain is some of those and the block after them.
    before = Window.partitionBy(*keys, "_flag").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chain = F.coalesce(F.sum(F.when(F.col("_head") < F.col("_rows"), 1).otherwise(0)).over(before), F.lit(0))
    chains = blocks.withColumn("_chain", chain).groupBy(*keys, "_flag", "_chain").agg(
        F.sum("_head").alias("_heads"), F.max(F.when(F.col("_head") < F.col("_rows"), F.col("_tail"))).alias("_tail"), F.max("_most").alias("_most")
    )
    over = F.col("_heads") + F.coalesce(F.lag("_tail").over(Window.partitionBy(*keys, "_flag").orderBy("_chain")), F.lit(0))
    found = chains.withColumn("_longest", F.greatest(over, "_most"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_flag") == i, F.col("_longest"))).cast("bigint").alias(n) for i, n in enumerate(names)])
