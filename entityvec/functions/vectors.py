"""Vector arithmetic on array columns, all JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(
        a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def scale_pixels(a: Column) -> Column:
    return F.transform(a, lambda v: (v / 255.0).cast("float"))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """Unit vector; the norm is evaluated once per row, not once per element."""
    length = F.greatest(norm(a), F.lit(eps))
    return F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x.cast("double") / n)


def euclidean(a: Column, b: Column, eps: float = 0.0) -> Column:
    """p=2 distance; ``eps`` is added to each difference as the usual loss does."""
    return F.sqrt(_total(F.transform(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double") + eps),
        lambda d: d * d)))


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))
