"""Column expressions that operators share. None raises on zero denominators or non-finite input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b as double; ``default`` where b is 0 or null."""
    got = F.try_divide(a.cast("double"), b.cast("double"))
    return got if default is None else F.coalesce(got, F.lit(default))


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def nulled(x: Column) -> Column:
    """Non-finite values as null, so that aggregates skip them."""
    return F.when(finite(x), x)


def sign(x: Column) -> Column:
    """-1, 0 or 1; unlike signum there is no negative zero."""
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def round6(x: Column) -> Column:
    """Rounded for output, without negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(values: Column) -> Column:
    """Position of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def share(condition: Column) -> Column:
    """Share of rows where the condition holds (null counts as not); 0 without rows."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the JSON of a struct of ``parts``."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
