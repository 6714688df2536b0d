"""Integrity checks that return the rows at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("tx_id").distinct()
    first = edges.join(ids, F.col("txId1") == F.col("tx_id"), "left_anti")
    second = edges.join(ids, F.col("txId2") == F.col("tx_id"), "left_anti")
    return first.union(second).distinct()


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contiguity(rows: DataFrame, column: str) -> DataFrame:
    """Whether a column holds 0..n-1, each once."""
    distinct = rows.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    s = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(column).alias("distinct_n"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    return s.select("n", "distinct_n", "least", "greatest", F.coalesce((F.col("n") == F.col("distinct_n")) & (F.col("least") == 0) & (F.col("greatest") == F.col("n") - 1), F.lit(True)).alias("ok"))


def causality_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is not older than their target, by id or by step."""
    u = nodes.select(F.col("tx_id").alias("txId1"), F.col("time_step").alias("s1"))
    v = nodes.select(F.col("tx_id").alias("txId2"), F.col("time_step").alias("s2"))
    return edges.join(u, "txId1").join(v, "txId2").where("txId1 >= txId2 or s1 > s2").select("txId1", "txId2", "s1", "s2")


#: Ranges of rows that are compared by their digests, and the prime that sums of hashes are taken by.
RANGES, PRIME = 4096, (1 << 61) - 1


def digests(rows: DataFrame, columns: list[str], key: list[str], ranges: int = RANGES) -> DataFrame:
    """(range, n, a, b): of every range of hashes of the key the number of rows and two sums of hashes of whole rows.

    The sums do not depend on the order of rows and count each as often as it occurs. Nulls are told from other values, and a
    null in one column from one in another.
    """
    whole = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashed = lambda seed: F.pmod(F.xxhash64(F.lit(seed), *whole), F.lit(PRIME)).cast("decimal(20,0)")
    sums = rows.groupBy(_range(key, ranges)).agg(F.count(F.lit(1)).alias("n"), F.sum(hashed(1)).alias("a"), F.sum(hashed(2)).alias("b"))
    return sums.select("range", "n", (F.col("a") % PRIME).alias("a"), (F.col("b") % PRIME).alias("b"))


def _range(key: list[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(ranges)).alias("range")


def differing(left: DataFrame, right: DataFrame, columns: list[str], key: list[str] | None = None, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in ranges whose digests differ; none if the tables are equal as multisets.

    Equal tables cost two aggregations, and what is shuffled is a row per range. Of tables that differ in a few rows only the
    ranges of these are left to compare: a row of one side alone stays, whatever its key.
    """
    key = key or columns
    d = digests(left, columns, key, ranges).join(digests(right, columns, key, ranges).select("range", F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2")), "range", "full")
    other = [r["range"] for r in d.where("not (n <=> n2 and a <=> a2 and b <=> b2)").select("range").collect()]  # RANGES at most
    pick = lambda df: df.where(_range(key, ranges).isin(other)) if other else df.limit(0)
    return pick(left), pick(right)


def unequal(left: DataFrame, right: DataFrame, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """(columns, n_left, n_right) of every row that one side has more often than the other."""
    a, b = differing(left, right, columns, None, ranges)
    both = a.select(*columns, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(b.select(*columns, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return both.groupBy(*columns).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right")).where("n_left <> n_right")


def coverage_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and of which."""
    return unequal(left.select(key).distinct(), right.select(key).distinct(), [key]).select(key, F.when(F.col("n_right") == 0, "left").otherwise("right").alias("side"))
