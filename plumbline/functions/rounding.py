"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value that ends in a 5 would round by the last bit of a sum; this moves it off the tie.
_OFF_TIE = 1.0000000003


def significant(x: Column, digits: int = 6, zero: float = 1e-11) -> Column:
    """``x`` with so many significant digits; magnitudes below ``zero`` are 0."""
    y = x * F.lit(_OFF_TIE)
    e = F.lit(digits - 1) - F.floor(F.log10(F.abs(y)))
    up, down = F.pow(F.lit(10.0), e), F.pow(F.lit(10.0), -e)
    whole = F.when(e >= 0, F.floor(y * up + 0.5)).otherwise(F.floor(y / down + 0.5))
    # Read back from decimal text: the nearest double, which products with powers of ten are not.
    value = F.concat(whole.cast("bigint").cast("string"), F.lit("e"), (-e).cast("bigint").cast("string")).cast("double")
    return F.when(F.abs(x) < zero, F.lit(0.0)).when(F.abs(x) < F.lit(float("inf")), value)


def significant_sql(x: str, digits: int = 6, zero: float = 1e-11) -> str:
    """The same for DuckDB."""
    e = f"({digits - 1} - floor(log10(abs(v * {_OFF_TIE}))))"
    y = f"v * {_OFF_TIE}"
    return (
        f"list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN v IS NULL OR NOT isfinite(v) THEN NULL WHEN abs(v) < {zero} THEN 0.0 "
        f"ELSE CAST(CAST(CAST(CASE WHEN {e} >= 0 THEN floor({y} * pow(10.0, {e}) + 0.5) ELSE floor({y} / pow(10.0, -{e}) + 0.5) END AS BIGINT) AS VARCHAR) || 'e' || CAST(CAST(-{e} AS BIGINT) AS VARCHAR) AS DOUBLE) END)[1]"
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded to so many significant digits."""
    return df.select(*[significant(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def rounded_sql(select: str, doubles: list[str], others: list[str], digits: int = 6) -> str:
    """``select`` wrapped so that its columns come out as from :func:`rounded`."""
    cols = [*others, *[f"{significant_sql(c, digits)} AS {c}" for c in doubles]]
    return f"WITH _r AS ({select}) SELECT {', '.join(cols)} FROM _r"
