"""Column helpers that stay inside Spark's generated code.

Numbers follow one convention everywhere: text is cast with :func:`num` (NULL where it is no number), NaN counts as
missing, and :func:`finite` is true only for a present, non-infinite value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java accepts suffixes such as 1.0d; plain decimal numbers only are numbers here.
NUMERIC = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: str | Column) -> Column:
    """Value as DOUBLE, NULL for NaN."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def num_text(c: str | Column) -> Column:
    """Text as DOUBLE where it is a decimal number (infinities included), else NULL."""
    t = F.lower(F.trim(col(c)))
    value = F.regexp_replace(F.regexp_replace(t, "^([+-]?)inf$", "$1infinity"), "^[+-]?nan$", "")
    return F.when(t.rlike(NUMERIC), value.try_cast("double"))


def finite(c: str | Column) -> Column:
    """True for a present value that is neither NaN nor infinite; never NULL."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def if_finite(c: str | Column) -> Column:
    """The value where it is finite, else NULL."""
    return F.when(finite(c), col(c).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation clipped to [-1, 1]; NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def safe_std(x: Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))


def is_close(a: Column, b: Column | float, tol: float = 1e-15) -> Column:
    return F.abs(a - b) <= F.lit(tol)
