"""Vectorised work on many whole groups at once.

``applyInPandas`` calls Python once per group, which is slow for many small groups.  Here Spark shuffles and sorts by
the key, and a Python task sees its partition as a stream of chunks, each holding many *whole* groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows after which a chunk is handed on at the next group boundary.
CHUNK_ROWS = 65_536


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a new group starts in a table sorted by ``keys``; NULL equals NULL."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def map_whole_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``fn(frame, starts, ends)`` over chunks of whole groups, sorted by ``keys`` and ``order``.

    One group must fit one task: callers bound it (blocks of a recording, compressed digests).
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    target = to_arrow_schema(struct)
    keys = list(keys)

    def chunk(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], table.num_rows)
        out = fn(table.to_pandas(), starts, ends)
        if len(out):
            yield from pa.Table.from_pandas(out[target.names], schema=target, preserve_index=False).to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                starts = group_starts(table, keys)
                last = int(starts[-1])
                if last:
                    yield from chunk(table.slice(0, last), starts[:-1])
                    table = table.slice(last).combine_chunks()
                held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held)
            yield from chunk(table, group_starts(table, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
