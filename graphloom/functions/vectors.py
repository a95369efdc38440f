"""Vector column functions."""

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b):
    """Cosine in double precision over the length of ``a``; 0 when a norm is 0."""
    b = F.slice(b, 1, F.greatest(F.size(a), F.lit(1)))
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)
