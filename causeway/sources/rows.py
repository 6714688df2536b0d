"""Text files as rows with their place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(file: DataFrame) -> DataFrame:
    """The rows of one file with `__id`, which holds the part that a row was read in and its place there; parts are read in the file's order."""
    return file.withColumn("__id", F.monotonically_increasing_id())


def starts(rows: DataFrame) -> DataFrame:
    """(__part, __before): the rows ahead of each part of placed rows. Only the sizes of the parts meet in one task."""
    sizes = rows.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def in_order(rows: DataFrame, before: DataFrame, name: str = "__row") -> DataFrame:
    """Placed rows with dense numbers from 0 in the file's order, in place of `__id`."""
    numbered = rows.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(before), "__part")  # a row per part of the file
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__id"], (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def with_rows(file: DataFrame, name: str = "__row") -> DataFrame:
    """The rows of one file with dense numbers from 0 in the file's order, however many parts it is read in. It is read twice."""
    rows = placed(file)
    return in_order(rows, starts(rows), name)
