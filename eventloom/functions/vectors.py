"""Vector arithmetic on array columns, inside the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length; unchanged if that is 0."""
    doubles = F.transform(a, lambda x: x.cast("double"))
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(doubles, lambda x: x / n)).otherwise(doubles))[0]


def mean_pool(rows: DataFrame, key: str, vector: str, eps: float = 1e-12) -> DataFrame:
    """key, vector: unit vectors averaged by position, and the mean made a unit vector again.

    Averages are per (key, position), so partial aggregation runs before the shuffle whatever the size of a key.
    Null vectors do not count.
    """
    parts = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(unit(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    pooled = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p.x).alias("m"))
    return pooled.select(key, F.transform("m", lambda x: x / F.greatest(norm(F.col("m")), F.lit(eps))).alias(vector))
