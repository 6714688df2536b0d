"""Slots, phases, eligibility and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots(volume: DataFrame, n: int) -> DataFrame:
    """(slot, step): n slots over steps by largest remainder; ties go to the earlier step, no volume at all means equal weights.

    volume: (step, weight), a row per step, which is the only thing the windows order.
    """
    if n <= 0:
        return volume.select(F.lit(0).cast("bigint").alias("slot"), F.col("step").cast("int").alias("step")).where("false")
    every = Window.partitionBy()
    weight = F.when(F.sum("weight").over(every) == 0, F.lit(1)).otherwise(F.col("weight"))
    shared = volume.select("step", weight.alias("w")).withColumn("share", F.col("w") * F.lit(n) / F.sum("w").over(every).cast("double"))
    floors = shared.withColumn("base", F.floor("share")).withColumn("left", F.lit(n) - F.sum("base").over(every)).withColumn("rest", F.col("share") - F.col("base"))
    counts = floors.withColumn("more", (F.row_number().over(Window.orderBy(F.desc("rest"), "step")) <= F.col("left")).cast("int")).select("step", (F.col("base") + F.col("more")).alias("count"))
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return starts.where("count > 0").select(F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("slot"), F.col("step").cast("int").alias("step")).withColumn("slot", F.col("slot").cast("bigint"))


def with_phase(rows: DataFrame, phases: list[dict]) -> DataFrame:
    """rows with phase_id, keep_probability and novel of the first phase that holds their step."""
    def pick(field):
        out = F.lit(None)
        for p in reversed(phases):
            value = F.array(*map(F.lit, p["novel_profile_ids"])).cast("array<string>") if field == "novel_profile_ids" else F.lit(p[field])
            out = F.when(F.col("step").between(p["step_min"], p["step_max"]), value).otherwise(out)
        return out

    return rows.select("*", pick("phase_id").alias("phase_id"), pick("illicit_keep_probability").cast("double").alias("keep_probability"), pick("novel_profile_ids").alias("novel"))


def eligible(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows by profile with whether the phase admits it: novel profiles only where listed, other illicit ones only where some are kept.

    profiles: (profile_id, class_policy, negative_kind), the registry.
    """
    novel, illicit = F.col("negative_kind") == "novel_illicit", F.col("class_policy") == "illicit"
    ok = F.when(novel, F.array_contains("novel", F.col("profile_id"))).otherwise(~illicit | (F.col("keep_probability") > 0))
    return rows.crossJoin(F.broadcast(profiles)).select(*rows.columns, "profile_id", ok.alias("eligible"))  # seven profiles


def uniform(*keys: Column) -> Column:
    """A draw in [0, 1) that depends only on the keys, by a digest that any engine can replay."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / float(1 << 48)


def quota_sample(rows: DataFrame, group: str, row_id: str, quota: int, seed: int) -> DataFrame:
    """quota rows of each group without replacement, by the order of a draw."""
    order = Window.partitionBy(group).orderBy(uniform(F.lit(seed), F.col(row_id)), row_id)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= quota).drop("__r")


def weighted_pick(rows: DataFrame, choices: list[tuple[str, float]], draw: Column, name: str) -> DataFrame:
    """rows with the first choice, in the list's order, at which the running weight reaches the draw; else the last."""
    total, running, out = sum(w for _, w in choices), 0.0, F
    steps = []
    for choice, w in choices:
        running += w
        steps.append((choice, running))
    for choice, bound in steps:
        out = out.when(draw * total <= bound, choice)
    return rows.withColumn(name, out.otherwise(choices[-1][0]))
