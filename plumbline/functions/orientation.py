"""Labels of static orientations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIENTATIONS = ("+X", "-X", "+Y", "-Y", "+Z", "-Z")


def orientation(label: str | Column) -> Column:
    """+X .. -Z of a label in one of its spellings (sign before or after the axis, plus, positive, minus, negative), else NULL."""
    text = F.translate(F.lower(F.trim(F.col(label) if isinstance(label, str) else label)), " _", "")
    words = F.regexp_replace(F.regexp_replace(text, "^(plus|positive)", "+"), "^(minus|negative)", "-")
    sign_first = F.regexp_replace(words, r"^([xyz])([+-])$", "$2$1")
    return F.when(sign_first.rlike(r"^[+-][xyz]$"), F.upper(sign_first))


def gravity_component(label: Column, axis: str, gravity: float) -> Column:
    """Expected reading of ``axis`` (X, Y or Z) at rest in an orientation."""
    return F.when(label == f"+{axis}", F.lit(gravity)).when(label == f"-{axis}", F.lit(-gravity)).when(label.isNotNull(), F.lit(0.0))
