"""Joins of intervals: which of many holds each of many others, without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths below 2 ** 6 share a level.
FIRST_LEVEL = 6


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows of ``inner`` (key, a, b, ...) with each row of ``outer`` (key, lo, hi, ...) of the same key whose [lo, hi) holds their [a, b).

    Outer intervals are indexed by dyadic cells of about their own length, two at most, and an inner one asks one cell for each level in use
    (at most 57), so n inner and m outer intervals of a key cost neither n x m rows nor a loop; what comes out is what nests. Empty outer
    intervals hold nothing. The other columns of the two tables must have different names.
    """
    level = F.greatest(F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double"))).cast("int"), F.lit(FIRST_LEVEL))
    indexed = outer.where(F.col("lo") < F.col("hi")).where(F.col(key).isNotNull()).withColumn("_level", level)
    indexed = indexed.withColumn("_cell", F.explode(F.array_distinct(F.array(F.expr("shiftright(lo, _level)"), F.expr("shiftright(hi - 1, _level)")))))
    used = sorted(r["_level"] for r in indexed.select("_level").distinct().collect())
    asked = inner.where("a is not null and b is not null").withColumn("_level", F.explode(F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")))
    asked = asked.withColumn("_cell", F.expr("shiftright(a, _level)"))
    return asked.join(indexed, [key, "_level", "_cell"]).where("lo <= a and b <= hi").drop("_level", "_cell")
