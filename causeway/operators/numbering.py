"""Dense numbers in order of any columns, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def _sorted_runs(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """rows as a stored table with `__run`, the range of `order` that each lies in, and `__at`, its place within.

    Ranges are cut at sampled quantiles, whatever the type of the columns, so a value that many rows share, or ids spread
    over all 64 bits, make runs of like size as long as `order` tells rows apart. The places are counted as the sorted
    rows are written.
    """
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", at)).withColumn("__run", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def numbered(rows: DataFrame, order: list[str | Column], name: str, within: list[str] = ()) -> DataFrame:
    """rows with a dense number from 0 in order of `order`, counted anew for each value of `within`.

    Rows are sorted into runs, and a run's numbers start behind what earlier runs hold. Windows see a row per run, or per
    run and value of `within`, never the rows. `order` should tell rows apart; rows that it does not are numbered in an
    order that is fixed once they are written. Nulls count as one value of `within`.
    """
    runs = _sorted_runs(rows, [*within, *order])
    keys = [F.col(k) for k in within]
    sizes = runs.groupBy("__run", *within).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__run", *within, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__before"))
    same = F.col("r.__run") == F.col("b.__run")
    for k in within:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    return runs.alias("r").join(before.alias("b"), same).select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("__before") + F.col("__at")).cast("bigint").alias(name))
