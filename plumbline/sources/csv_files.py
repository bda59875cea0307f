"""Delimited text files as tables of text with their file order.

Each file's layout (encoding, delimiter, header) is sniffed by tasks from its first bytes; files of one layout are read
together in splits, and layouts are brought together by column name.  ``row_ord`` numbers the rows of each file in order
without bringing them together: splits are counted, the counts accumulated, and rows numbered within their split.

Defined results: a column that a file does not have is NULL there; blank files and files without a readable header give
no rows and are reported by :func:`layouts` (files of no bytes are not even listed); header names are trimmed, unnamed columns numbered, repeated names suffixed.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.columns import num_text
from plumbline.joins import attach

DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 8_192
# Texts that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def sniff(head: bytes, delimiter: str | None = None) -> tuple[str, str, list[str]]:
    """(encoding, delimiter, warnings) of a file's first bytes."""
    warnings = []
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            # The cut may fall inside a character.
            text = head.decode(encoding) if len(head) < SNIFF_BYTES else head[: head.rfind(b"\n") + 1 or None].decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        encoding, text = "iso-8859-1", head.decode("latin-1")
        warnings.append("not UTF-8: read as Latin-1")
    if delimiter is None:
        lines = [x for x in text.splitlines() if x.strip()][:20]
        # The delimiter that cuts most lines into the same number of fields, more than one.
        score = {d: (sum(x.count(d) == lines[0].count(d) for x in lines), lines[0].count(d)) for d in DELIMITERS if lines and lines[0].count(d)}
        if score:
            delimiter = max(score, key=lambda d: (score[d], -DELIMITERS.index(d)))
        else:
            delimiter = ","
            warnings.append("no delimiter found: comma assumed")
    return encoding, delimiter, warnings


#: Bytes within which a header line must end, and the most layouts a folder may have.
HEADER_BYTES, LAYOUTS = 1 << 20, 1_000


def _names(header: list[str]) -> list[str]:
    names, seen = [], {}
    for i, raw in enumerate(header):
        name = raw.lstrip("\ufeff").strip() or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return names


def layouts(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """path, length, encoding, delimiter, header, problem of every file below ``path``; no content is read but the heads."""
    # Without their content binary files are a listing.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for at, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                system, inner = fs.FileSystem.from_uri(at)
                with system.open_input_stream(inner) as f:
                    head = f.read(SNIFF_BYTES)
                    while b"\n" not in head and len(head) < min(length, HEADER_BYTES):
                        head += f.read(SNIFF_BYTES)
                if not head.strip():
                    out.append((at, length, None, None, None, "empty"))
                    continue
                encoding, cut, warnings = sniff(head, delimiter)
                try:
                    first = next(csv.reader(io.StringIO(head.decode("utf-8" if encoding.startswith("utf") else "latin-1", "ignore")), delimiter=cut))
                except (csv.Error, StopIteration) as e:
                    out.append((at, length, encoding, cut, None, f"no header: {e}"))
                    continue
                out.append((at, length, "UTF-8" if encoding.startswith("utf") else "ISO-8859-1", cut, _names(first), "; ".join(warnings) or None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "length", "encoding", "delimiter", "header", "problem"])

    return files.mapInArrow(look, "path string, length bigint, encoding string, delimiter string, header array<string>, problem string")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = False) -> DataFrame:
    """Columns as text under their header names, NULL for missing, plus ``source_file`` and ``row_ord``."""
    groups = layouts(spark, path, delimiter).where("header IS NOT NULL").groupBy("encoding", "delimiter", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    found = sorted(groups.limit(LAYOUTS + 1).collect(), key=lambda r: (r["header"], r["delimiter"], r["encoding"]))  # names of files, which a listing holds anyway
    if not found:
        raise ValueError(f"no data in {path}")
    if len(found) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} layouts in {path}")
    parts = [_read_layout(spark, r["paths"], r["encoding"], r["delimiter"], r["header"], multi_line) for r in found]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in df.columns if c not in ("source_file", "row_ord")]
    return df.select(*[F.col(f"`{n}`") for n in names], "source_file", "row_ord")


def _read_layout(spark: SparkSession, paths: list[str], encoding: str, delimiter: str, names: list[str], multi_line: bool) -> DataFrame:
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(paths)
    blank = lambda c: F.when(~F.trim(c).isin(*MISSING), c)
    df = df.select(*[blank(F.col(f"`{n}`")).alias(n) for n in names], F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = df.groupBy("source_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = attach(df, splits, ["source_file", "_start"], "inner")
    return out.select(*[F.col(f"`{n}`") for n in names], "source_file", (F.col("_base") + F.col("_id") - F.col("_first")).alias("row_ord"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as doubles; text that is no number becomes NULL."""
    return df.withColumns({c: num_text(F.col(f"`{c}`")) for c in columns})


def non_numeric(column: str) -> tuple[Column, Column]:
    """(raw text, its numeric reading) for :func:`plumbline.operators.validation.validate`."""
    return F.col(f"`{column}`"), num_text(F.col(f"`{column}`"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, missing, distinct, numeric, least, greatest, kind: one pass over all columns.

    ``kind`` is what all present values could be read as: integer, number, boolean or text; ``empty`` without any.
    Least and greatest are in order of text.
    """
    aggs = []
    for c in columns:
        x = F.col(f"`{c}`").cast("string")
        some = lambda t, x=x: F.count(F.when(t, x))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("present"),
                (F.count("*") - F.count(x)).alias("missing"),
                F.countDistinct(x).alias("distinct"),
                some(num_text(x).isNotNull()).alias("numeric"),
                some(x.rlike(r"^\s*[+-]?\d+\s*$")).alias("_whole"),
                some(F.lower(F.trim(x)).isin("true", "false")).alias("_truth"),
                F.min(x).alias("least"),
                F.max(x).alias("greatest"),
            )
        )
    one = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    n = F.col("present")
    kind = F.when(n == 0, "empty").when(F.col("_whole") == n, "integer").when(F.col("numeric") == n, "number").when(F.col("_truth") == n, "boolean").otherwise("text")
    return one.withColumn("kind", kind).drop("_whole", "_truth")
