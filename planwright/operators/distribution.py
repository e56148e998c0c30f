"""How values are spread: equal bins with the far tail folded into the last, or groups of equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int = 20, tail: float = 0.99) -> DataFrame:
    """bin (from 0), low, high, n, total, mean; values above the ``tail`` quantile are in the last bin."""
    v = F.col(value).cast("double")
    edge = df.filter(v.isNotNull()).agg(F.min(v).alias("lo"), F.percentile(v, F.lit(tail)).alias("hi"))
    wide = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    placed = df.filter(v.isNotNull()).crossJoin(F.broadcast(edge)).withColumn("bin", F.least(F.floor((v - F.col("lo")) / wide), F.lit(bins - 1)).cast("int"))
    out = placed.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"))
    return out.select("bin", (F.col("lo") + F.col("bin") * wide).alias("low"), (F.col("lo") + (F.col("bin") + 1) * wide).alias("high"), "n", "total", "mean")


def quantile_groups(df: DataFrame, value: str, groups: int = 4) -> DataFrame:
    """Quartiles, quintiles, deciles: grp (from 1), n, low, high, total, by the exact quantiles of the values."""
    v = F.col(value).cast("double")
    some = df.filter(v.isNotNull())
    bounds = some.agg(F.percentile(v, F.array(*(F.lit(i / groups) for i in range(1, groups)))).alias("bounds"))
    placed = some.crossJoin(F.broadcast(bounds)).withColumn("grp", F.size(F.filter("bounds", lambda b: b < v)) + 1)
    return placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))
