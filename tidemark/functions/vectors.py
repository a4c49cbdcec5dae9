"""Dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 for vectors of different or no length, or of zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(usable, F.least(F.greatest(dot(a, b) / norms, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two map<string,double>."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    shared = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    norms = norm(a) * norm(b)
    return F.when(norms > 0, F.least(F.greatest(shared / norms, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def mean_vector(rows: DataFrame, vec: str, *keys: str) -> DataFrame:
    """keys, mean: the mean of each component, partial sums map-side."""
    parts = rows.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(*keys).agg(listed.alias("mean"))
