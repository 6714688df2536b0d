"""Joins of intervals that overlap, where both sides are large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Borders that cut the line; a bucket holds about this part of all starts, or one start that is more frequent.
BUCKETS = 1024


def borders(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> list:
    """At most buckets - 1 quantiles of the starts of both sides, ascending. left, right: (low)."""
    starts = left.select("low").union(right.select("low"))
    found = starts.agg(F.percentile_approx("low", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first()["q"]
    return sorted({q for q in found or [] if q is not None})


def _bucket(at: Column, cuts: list) -> Column:
    """How many cuts lie at or before a place, by halving the list."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(at < F.lit(cuts[middle]), _bucket(at, cuts[:middle])).otherwise(_bucket(at, cuts[middle + 1 :]) + middle + 1)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """All pairs of rows (columns l and r, structs) with equal keys whose closed intervals [low, high] meet.

    The line is cut at quantiles of the starts. An interval stands in all buckets that it reaches, and meets the starts of
    the other side there; a pair is reported by the bucket of its later start alone (of equal starts, by the right one's), so
    no pair comes twice. An interval that covers a bucket overlaps every start in it, so only the two buckets at its ends
    hold candidates that fail. Neither side is broadcast, and a hot key is as many join keys as it has buckets. Rows with a
    null key or bound, and empty intervals, meet nothing.
    """
    sound = lambda df: df.where(" and ".join([f"`{k}` is not null" for k in keys] + ["low <= high"]))
    left, right = sound(left), sound(right)
    cuts = borders(left, right, buckets)
    names = [f"__k{i}" for i in range(len(keys))]

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows by the bucket of their start, and rows by all buckets that they reach."""
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], "low", "high")
        first = packed.withColumn("bucket", _bucket(F.col("low"), cuts))
        return first, first.withColumn("bucket", F.explode(F.sequence("bucket", _bucket(F.col("high"), cuts))))

    (l_start, l_all), (r_start, r_all) = sides(left), sides(right)
    named = lambda df, tag: df.select(F.col("row").alias(tag), *names, "bucket", F.col("low").alias(f"{tag}_low"), F.col("high").alias(f"{tag}_high"))
    on = [*names, "bucket"]
    later_right = named(l_all, "l").join(named(r_start, "r"), on).where("l_low <= r_low and r_low <= l_high").select("l", "r")
    later_left = named(l_start, "l").join(named(r_all, "r"), on).where("r_low < l_low and l_low <= r_high").select("l", "r")
    return later_right.unionByName(later_left)
