"""Temporal split, leak-free edges, metrics, thresholds, scaling and tests of effects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shuffled

#: Partition, first step, last step.
PARTS = [("train", 1, 30), ("validation", 31, 40), ("test", 41, 49)]


def part(step: Column) -> Column:
    out = F
    for name, low, high in PARTS:
        out = out.when(step.between(low, high), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("step outside of 1..49: "), F.coalesce(step.cast("string"), F.lit("null")))))


def label(kind: Column) -> Column:
    """1 for class 1, 0 for class 2, null for unknown."""
    return F.when(kind == "1", 1).when(kind == "2", 0)


def with_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the partition of both ends; edges of unknown ends are dropped."""
    ends = nodes.select("tx_id", part(F.col("time_step")).alias("p"))
    u, v = ends.select(F.col("tx_id").alias("txId1"), F.col("p").alias("p1")), ends.select(F.col("tx_id").alias("txId2"), F.col("p").alias("p2"))
    return shuffled(shuffled(edges).join(u, "txId1")).join(v, "txId2")


def partition_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, txId1, txId2): edges within one partition, without loops."""
    return with_parts(edges, nodes).where("p1 = p2 and txId1 <> txId2").select(F.col("p1").alias("part"), "txId1", "txId2")


def filter_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of what the filter did; a loop is never cross-partition."""
    loop, cross = F.expr("txId1 = txId2"), F.expr("p1 <> p2")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    kept = ~loop & ~cross
    return with_parts(edges, nodes).agg(
        F.count(F.lit(1)).alias("input"), n(loop).alias("self_loops"), n(cross).alias("cross_partition"), n(kept).alias("retained"), *(n(kept & (F.col("p1") == name)).alias(f"retained_{name}") for name, *_ in PARTS))


def confusion(rows: DataFrame, threshold: float, by: list[str], k: int | None = None) -> DataFrame:
    """Per group of rows (y, score, tx_id): tp, fp, tn, fn, n, n_positive, n_negative, positive_rate, threshold, precision, recall, f1; with k also k and the hits among the k top scores.

    What is undefined is null: f1 and recall without positives. Top-k ranks by score, then by id. Rows without a label are
    left out. A threshold outside 0..1, a k that is no positive whole number, and scores that are null or not finite are
    refused, the scores as rows are read.
    """
    if not (isinstance(threshold, (int, float)) and 0 <= threshold <= 1):  # NaN is not between
        raise ValueError("threshold must be finite and in 0..1")
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k <= 0):
        raise ValueError("k must be a positive whole number")
    finite = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & (F.abs(F.col("score").cast("double")) < float("inf"))
    rows = rows.where("y is not null").withColumn("score", F.when(finite, F.col("score")).otherwise(F.raise_error(F.lit("scores must be finite")).cast(rows.schema["score"].dataType)))
    yes, pred = F.col("y") == 1, F.col("score") >= threshold
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    aggs = [n(yes & pred).alias("tp"), n(~yes & pred).alias("fp"), n(~yes & ~pred).alias("tn"), n(yes & ~pred).alias("fn"), F.count(F.lit(1)).alias("n")]
    out = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.select("*", (tp + fn).alias("n_positive"), (fp + F.col("tn")).alias("n_negative"), ((tp + fn) / F.nullif("n", F.lit(0))).alias("positive_rate"), F.lit(float(threshold)).alias("threshold"))
    out = out.select("*", F.when(tp + fn > 0, F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0))).otherwise(0.0)).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"), F.when(tp + fn > 0, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))
    if k is None:
        return out
    top = top_k(rows, k, by).groupBy(*by).agg(F.sum("y").cast("bigint").alias("hits"), F.count(F.lit(1)).alias("k_effective"))
    out = out.join(top, by, "left") if by else out.crossJoin(F.broadcast(top))
    return out.select("*", F.lit(k).alias("k"), (F.col("hits") / F.col("k_effective")).alias("precision_at_k"), (F.col("hits") / F.nullif(tp + fn, F.lit(0))).alias("recall_at_k"))


def top_k(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k rows of each group with the highest scores, lower ids first.

    A group's rows are dealt over salts that keep k rows each before they meet.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("tx_id").alias("i"))
    keep = F.struct(order.alias("o"), "score", "tx_id", "y").alias("r")
    salted = rows.select(*by, F.pmod(F.xxhash64("tx_id"), F.lit(64)).alias("salt"), keep)
    first = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k)
    from pyspark.sql import Window

    part_ = salted.withColumn("n", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("r.o"))).where(F.col("n") <= k)
    lists = part_.groupBy(*by).agg(first("r").alias("t"))  # 64 salts of k rows each
    return lists.select(*by, F.posexplode("t").alias("rank", "r")).select(*by, (F.col("rank") + 1).alias("rank"), "r.tx_id", "r.score", "r.y")


def per_step(rows: DataFrame, threshold: float, k: int, low: int = 41, high: int = 49) -> DataFrame:
    """confusion() of each step, also of steps without rows."""
    steps = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("time_step"))
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn", "n", "n_positive", "n_negative")}
    out = steps.join(confusion(rows, threshold, ["time_step"], k), "time_step", "left")
    return out.select(*(counts.get(c, F.col(c)) for c in out.columns))


def macro(steps: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column over the steps, null unless every step has it, and how many have."""
    return steps.agg(*(F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(f"macro_{c}") for c in columns), *(F.count(c).alias(f"steps_{c}") for c in columns))


def micro(steps: DataFrame) -> DataFrame:
    """Metrics of the pooled counts of steps with rows."""
    s = steps.where("n > 0").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "hits", "k_effective")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(
        "tp", "fp", "fn", F.when(tp + fn > 0, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("micro_f1"), (F.col("hits") / F.nullif(F.col("k_effective"), F.lit(0))).alias("micro_precision_at_k"),
        (F.col("hits") / F.nullif(tp + fn, F.lit(0))).alias("micro_recall_at_k"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """(i, threshold, f1) of the 101 cut-offs i * 0.01; 0 where undefined.

    One pass counts the rows by the highest cut-off they reach; suffix sums over 102 rows do the rest.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    guess = F.floor(F.col("score") * 100).cast("int")
    # the nearest cut-offs decide, as products in double precision
    reach = F.when((guess + 1) * 0.01 <= F.col("score"), guess + 1).when(guess * 0.01 <= F.col("score"), guess).otherwise(guess - 1)
    bins = rows.groupBy(F.least(F.greatest(reach, F.lit(-1)), F.lit(100)).alias("i")).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    every = spark.range(-1, 101).select(F.col("id").cast("int").alias("i")).join(bins, "i", "left").fillna(0)
    above = Window.orderBy(F.desc("i"))
    total = Window.partitionBy()
    sums = every.select("i", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("predicted"), F.sum("p").over(total).alias("positives")).where("i >= 0")
    return sums.select("i", (F.col("i") * 0.01).alias("threshold"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("positives"), F.lit(0)), F.lit(0.0)).alias("f1"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The lowest cut-off with the highest f1."""
    return threshold_sweep(rows).orderBy(F.desc("f1"), "i").limit(1)


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean_c and scale_c: population deviation, 1 for constant columns."""
    sd = lambda c: F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c))
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(sd(c).alias(f"scale_{c}") for c in columns))


def scaled(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns standardized by the one row of scaler()."""
    joined = rows.crossJoin(F.broadcast(fitted))
    return joined.select(*(((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def two_sided_p(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of Student's t, null for none: the share of cos(x)**(df - 1) beyond atan(|t| / sqrt(df)), by Simpson's rule.

    Past 12 / sqrt(df) the integrand is nothing in double precision, so the steps are spent before it.
    """
    end = F.least(F.lit(math.pi / 2), 12 / F.sqrt(df))
    start = F.least(F.atan(F.abs(t) / F.sqrt(df)), end)

    def area(low: Column) -> Column:
        width = (end - low) / steps
        weight = lambda i: F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.cos(low + width * i), df - 1)) * width

    return F.when(t.isNotNull(), area(start) / area(F.lit(0.0)))


def paired_effect(rows: DataFrame, delta: str = "delta") -> DataFrame:
    """n, mean, t, Cohen's dz and p of paired differences; t, dz and p are null if there are fewer than two or no spread."""
    s = rows.agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("sd"))
    ok = (F.col("n") >= 2) & (F.abs("sd") > 1e-8)
    return s.select("n", "mean_delta", F.when(ok, F.col("mean_delta") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(ok, F.col("mean_delta") / F.col("sd")).alias("cohen_dz")).withColumn("p", two_sided_p(F.col("t"), F.col("n") - 1))


def welch(rows: DataFrame, arm: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t, its degrees of freedom, the pooled Cohen's d and p of two arms."""
    agg = lambda x, s: [F.count(F.when(F.col(arm) == x, F.col(value))).alias(f"n{s}"), F.avg(F.when(F.col(arm) == x, F.col(value))).alias(f"m{s}"), F.var_samp(F.when(F.col(arm) == x, F.col(value))).alias(f"v{s}")]
    s = rows.agg(*agg(a, "a"), *agg(b, "b"))
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (qa + qb > 0)
    df = (qa + qb) ** 2 / (qa**2 / (F.col("na") - 1) + qb**2 / (F.col("nb") - 1))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return s.select("na", "nb", F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(qa + qb)).alias("t"), F.when(ok, df).alias("df"), F.when(ok, (F.col("ma") - F.col("mb")) / pooled).alias("cohen_d")).withColumn("p", two_sided_p(F.col("t"), F.col("df")))


def binary_f1(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """f1 of rows (y, score) at a threshold, 0 where it is undefined, as training compares it."""
    yes, pred = F.col("y") == 1, F.col("score") >= threshold
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return rows.agg(F.coalesce(2.0 * n(yes & pred) / F.nullif(2 * n(yes & pred) + n(~yes & pred) + n(yes & ~pred), F.lit(0)), F.lit(0.0)).alias("f1"))


def clamped_scaler(rows: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """One row of mean_c and scale_c: sample deviation, never under `least`."""
    sd = lambda c: F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(least))
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(sd(c).alias(f"scale_{c}") for c in columns))


def balanced(rows: DataFrame) -> DataFrame:
    """Labeled rows (y 0 or 1) with `weight`, which makes both classes count alike: all over twice the class."""
    labeled = rows.where("y is not null")
    sums = labeled.agg(F.count(F.lit(1)).alias("__all"), F.sum("y").alias("__ones"))
    of_class = F.when(F.col("y") == 1, F.col("__ones")).otherwise(F.col("__all") - F.col("__ones"))
    return labeled.crossJoin(F.broadcast(sums)).withColumn("weight", F.col("__all") / (2 * of_class)).drop("__all", "__ones")  # one row


def stacked(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Both views' nodes as one graph's, with the masks of the labeled rows to fit on and to stop by."""
    labeled = F.col("y").isNotNull()
    mark = lambda rows, fit: rows.withColumn("fit", labeled & F.lit(fit)).withColumn("judge", labeled & F.lit(not fit))
    return mark(train, True).unionByName(mark(validation, False))


def view_metrics(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """per_step() over the steps of the part that the rows' steps lie in; over the steps seen if they lie in several."""
    bounds = rows.agg(F.min("time_step").alias("a"), F.max("time_step").alias("b")).first()
    for _, low, high in PARTS:
        if bounds["a"] is not None and low <= bounds["a"] and bounds["b"] <= high:
            return per_step(rows, threshold, k, low, high)
    return confusion(rows, threshold, ["time_step"], k)


def over_seeds(rows: DataFrame, by: str, values: list[str], coverage: str) -> DataFrame:
    """Mean of each value over the seeds of an arm, null if any is, and the least coverage."""
    mean = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(f"{c}_mean")
    return rows.groupBy(by).agg(*map(mean, values), F.min(coverage).alias(f"{coverage}_min"))
