"""Problem 1: rows that fail to parse.

Every raw line is parsed at minimum cost: a dynamic program reads the line token by token (quote, delimiter, blanks,
other text) and may delete or insert quotes and delimiters, each at cost 1, until the line is a well-formed record with
as many fields as its file's header.  Cost 0 means the line is well formed as it stands; such a line is loaded if its
values have the declared types.  Otherwise the edit operations of the cheapest parse are the reason for rejecting it.

The line is first reduced to its *shape* (one symbol per quote or delimiter, one per run of blanks or of other text),
and the dynamic program runs once per distinct (shape, field count) of an Arrow batch: well-formed lines share a
handful of shapes, so almost all of the work is a dictionary lookup.

Defined results: a line without a number (NULL or below 1) is rejected as ``no line number``; whole numbers are
decimal(38,0) and longer ones rejected as ``beyond 38 digits``; a NULL line is rejected as ``no text``; an empty line is one empty field; a file without a header
line rejects all of its lines as ``no header``; a header without one of the typed columns leaves that column NULL and
unchecked, except ``dataset_id``, ``issue_id`` and ``severity``, which every valid issue needs; repeated lines are
judged one by one; extra columns of the input are carried along unless their name clashes with an output column.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.joins import attach

#: Delimiters a header line may use.
DELIMITERS = (",", ";", "\t", "|")
SEVERITIES = ("info", "warning", "error")
_REQUIRED = ("dataset_id", "issue_id", "severity")
_TYPED = (*_REQUIRED, "affected_rows", "affected_fraction")
_DECIMAL = r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

PARSE_SCHEMA = T.StructType().add("cost", T.IntegerType()).add("edits", T.ArrayType(T.StringType())).add("fields", T.ArrayType(T.StringType()))

# States of the dynamic program within a field.
_START, _BARE, _QUOTED, _CLOSED = range(4)


def shape_of(line: str, delimiter: str) -> tuple[str, list[int]]:
    """Symbols q, d, b (blanks), x (other text) of a line and where each token starts."""
    out: list[str] = []
    at: list[int] = []
    last = ""
    for i, c in enumerate(line):
        if c == '"':
            s = "q"
        elif c == delimiter:
            s = "d"
        elif c == " " or (c == "\t" and delimiter != "\t"):
            s = "b"
        else:
            s = "x"
        if s in "qd" or s != last:
            out.append(s)
            at.append(i)
        last = s
    return "".join(out), at


def cheapest_parse(shape: str, fields: int) -> tuple[int, tuple[str, ...]]:
    """Cost and edit operations of the cheapest parse of ``shape`` into ``fields`` fields.

    The dynamic program runs over (symbol, finished fields, state) in order of cost, so a well-formed line visits one
    state per symbol.  Each operation names the edit and the field (from 1) it happens in.  Among equal costs keeping a
    symbol comes before deleting it and deleting before inserting, so the result is the same everywhere.
    """
    n, most = len(shape), fields - 1
    came: dict[tuple[int, int, int], tuple[tuple[int, int, int] | None, str]] = {}
    queue: deque = deque([(0, (0, 0, _START), None, "")])
    while queue:
        cost, node, parent, what = queue.popleft()
        if node in came:
            continue
        came[node] = (parent, what)
        i, k, state = node
        if i == n and k == most and state != _QUOTED:
            edits: list[str] = []
            at: tuple[int, int, int] | None = node
            while at is not None:
                at, what = came[at]
                if what:
                    edits.append(what)
            return cost, tuple(reversed(edits))
        free: list[tuple[int, int, int]] = []
        if i < n:
            c = shape[i]
            if c == "x":
                if state != _CLOSED:
                    free.append((i + 1, k, _QUOTED if state == _QUOTED else _BARE))
            elif c == "b":
                free.append((i + 1, k, state))
            elif c == "d":
                if state == _QUOTED:
                    free.append((i + 1, k, state))
                elif k < most:
                    free.append((i + 1, k + 1, _START))
                queue.append((cost + 1, (i + 1, k, state), node, f"delete delimiter in field {k + 1}"))
            else:
                if state == _START:
                    free.append((i + 1, k, _QUOTED))
                elif state == _QUOTED:
                    free.append((i + 1, k, _CLOSED))
                    if shape[i + 1 : i + 2] == "q":
                        free.append((i + 2, k, _QUOTED))
                queue.append((cost + 1, (i + 1, k, state), node, f"delete quote in field {k + 1}"))
        if state == _QUOTED:
            queue.append((cost + 1, (i, k, _CLOSED), node, f"insert quote in field {k + 1}"))
        else:
            if state == _START:
                queue.append((cost + 1, (i, k, _QUOTED), node, f"insert quote in field {k + 1}"))
            if k < most:
                queue.append((cost + 1, (i, k + 1, _START), node, f"insert delimiter in field {k + 1}"))
        for to in free:
            queue.appendleft((cost, to, node, ""))
    return n + 1, ("no parse",)


def cut(line: str, delimiter: str) -> list[str]:
    """Fields of a line that parses at cost 0."""
    if '"' not in line:
        return [f.strip() for f in line.split(delimiter)]
    out: list[str] = []
    field_from, quoted = 0, False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append(line[field_from:i])
            field_from = i + 1
    out.append(line[field_from:])
    out = [f.strip(" \t") for f in out]
    return [(f[1:-1].replace('""', '"') if f[:1] == '"' else f).strip() for f in out]


@F.pandas_udf(PARSE_SCHEMA)
def _parse(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[str, int], tuple[int, tuple[str, ...]]] = {}
    for lines, delimiters, counts in parts:
        costs, edits, fields = [], [], []
        for line, d, n in zip(lines.tolist(), delimiters.tolist(), counts.tolist(), strict=True):
            if line is None or d is None or n != n or n is None:
                costs.append(None)
                edits.append(None)
                fields.append(None)
                continue
            shape, n = shape_of(line, d)[0], int(n)
            got = known.get((shape, n))
            if got is None:
                got = cheapest_parse(shape, n)
                if len(known) < 100_000:
                    known[shape, n] = got
            costs.append(got[0])
            edits.append(list(got[1]))
            fields.append(cut(line, d) if got[0] == 0 else None)
        yield pd.DataFrame({"cost": pd.Series(costs, dtype="Int32"), "edits": edits, "fields": fields})


def headers(lines: DataFrame) -> DataFrame:
    """file_id, delimiter and header (trimmed names in order) of each file's line 1."""
    text = F.regexp_replace(F.col("line_text"), "^﻿", "")
    counts = [F.struct((F.length(text) - F.length(F.translate(text, d, ""))).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    top = F.greatest(*counts)["d"]
    # \Q..\E: the delimiter is text, not a pattern.
    names = F.transform(F.split(F.translate(F.translate(text, '"', ""), "\r", ""), F.concat(F.lit("\\Q"), top, F.lit("\\E"))), F.trim)
    first = lines.where((F.col("line_no") == 1) & F.col("line_text").isNotNull() & F.col("file_id").isNotNull())
    # A file id with two header lines takes the one with the smallest line_id.
    first = first.groupBy("file_id").agg(F.min_by("line_text", F.struct("line_id", "line_text")).alias("line_text"))
    return first.select("file_id", top.alias("delimiter"), names.alias("header"))


def parse_issues(lines: DataFrame, issue_types: DataFrame) -> DataFrame:
    """One row per line that is not a header (line_no 1): typed issue columns, ``valid``, ``cost``, ``edits`` and ``reason``.

    ``issue_types`` is the fixed catalogue of issue ids; it is joined on equality like any other table.
    """
    own = ["line_id", "file_id", "line_no", "line_text"]
    made = {"delimiter", "header", "parsed", "known_issue", "valid", "reason", "cost", "edits", *_TYPED}
    extra = [c for c in lines.columns if c not in own and c not in made]
    body = lines.where(F.col("line_no").isNull() | (F.col("line_no") != 1)).select(*own, *extra)
    df = attach(body, headers(lines), ["file_id"])
    parsed = df.withColumn("parsed", _parse("line_text", "delimiter", F.size("header").cast("double")))

    def field(name: str) -> Column:
        at = F.array_position("header", F.lit(name))
        return F.when(at > 0, F.try_element_at("parsed.fields", at.cast("int")))

    names = {f"_{c}": field(c) for c in _TYPED}
    df = parsed.select(*own, *extra, "header", F.col("parsed.cost").alias("cost"), F.col("parsed.edits").alias("edits"), *[v.alias(k) for k, v in names.items()])
    known = issue_types.select(F.col("issue_id").alias("_issue_id"), F.lit(True).alias("known_issue")).where(F.col("_issue_id").isNotNull()).distinct()
    df = attach(df, known, ["_issue_id"])

    def missing(c: str) -> Column:
        return F.array_position("header", F.lit(c)) == 0

    fraction = F.col("_affected_fraction")
    value = F.when(fraction.rlike(_DECIMAL), fraction.try_cast("double"))
    empty = lambda c: F.coalesce(c == "", F.lit(False))
    long = lambda c: F.length(F.regexp_replace(c, "^0+", "")) > 38
    faults = [
        (F.col("line_no").isNull() | (F.col("line_no") < 1), F.lit("no line number")),
        (F.col("line_text").isNull(), F.lit("no text")),
        (F.col("header").isNull(), F.lit("no header")),
        (F.col("cost") > 0, F.concat(F.lit("structure: "), F.array_join("edits", "; "))),
        *[(missing(c), F.lit(f"header has no {c}")) for c in _REQUIRED],
        (~F.col("_dataset_id").rlike(r"^[0-9]+$"), F.lit("dataset_id is not digits only")),
        (F.col("known_issue").isNull(), F.lit("issue_id is unknown")),
        (~F.col("_severity").isin(*SEVERITIES), F.lit("severity is not info, warning or error")),
        (~(empty(F.col("_affected_rows")) | F.col("_affected_rows").rlike(r"^[0-9]+$")), F.lit("affected_rows is not digits only")),
        (long(F.col("_dataset_id")), F.lit("dataset_id is beyond 38 digits")),
        (long(F.col("_affected_rows")), F.lit("affected_rows is beyond 38 digits")),
        (fraction.isNotNull() & ~(empty(fraction) | F.coalesce((value >= 0) & (value <= 1), F.lit(False))), F.lit("affected_fraction is not a number from 0 to 1")),
    ]
    reason = F.coalesce(*[F.when(test, why) for test, why in faults])
    valid = F.col("reason").isNull()
    return df.withColumn("reason", reason).select(
        *own,
        *extra,
        valid.alias("valid"),
        "reason",
        "cost",
        "edits",
        F.when(valid, F.col("_dataset_id").try_cast("decimal(38,0)")).alias("dataset_id"),
        F.when(valid, F.col("_issue_id")).alias("issue_id"),
        F.when(valid, F.col("_severity")).alias("severity"),
        F.when(valid, F.col("_affected_rows").try_cast("decimal(38,0)")).alias("affected_rows"),
        F.when(valid, value).alias("affected_fraction"),
    )
