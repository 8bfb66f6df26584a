"""Column expressions over vectors (arrays of numbers), computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.lit([float(v) for v in values]).cast("array<double>") if len(values) else F.expr("cast(array() as array<double>)")


def as_double(v: ColumnOrName) -> Column:
    return _col(v).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product; null if either is null. Summed in order of position, so it is the same on every run."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: ColumnOrName, floor: float = 0.0) -> Column:
    """The vector over its length, or over ``floor`` if that is larger. A zero vector without a floor gives nulls."""
    length = F.greatest(norm(v), F.lit(floor)) if floor else F.nullif(norm(v), F.lit(0.0))
    return F.transform(as_double(v), lambda x: x / length)


def linear(*terms: tuple[float, ColumnOrName]) -> Column:
    """The weighted sum of vectors of one length."""
    parts = [F.transform(as_double(v), _times(w)) for w, v in terms]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda x, y: x + y)
    return out


def _times(w: float):
    return lambda x: x * w


def squared_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b))


def rbf_kernel(distance: ColumnOrName, width: float) -> Column:
    """exp(-distance / width); the distance is not squared."""
    return F.exp(-_col(distance) / F.lit(float(width)))


def threshold_kernel(distance: ColumnOrName, width: float) -> Column:
    return F.when(_col(distance) <= width, 1.0).otherwise(0.0)


def sigmoid(x: ColumnOrName, slope: float = 1.0, shift: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(_col(x) + shift) * slope))
