"""Node features: the semantic matrix and the structural seven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shuffled

BASE = [
    "in_degree", "out_degree", "value_out", "value_in", "net_flow", "log_ratio_in_out", "max_in_amount", "mean_in_amount", "max_out_amount", "mean_out_amount", "min_in_amount", "in_age_min", "in_age_mean", "in_age_max", "out_age_mean",
    "value_per_in", "value_per_out", "in_amount_std", "out_amount_std", "edge_hours_mean_in", "edge_hours_mean_out", "has_incoming", "has_outgoing", "time_step_norm",
]
CHAIN = ["chain_btc", "chain_eth", "chain_trx", "cross_chain_in", "cross_chain_out"]
DERIVED, STEPS = 141, 49


def _log(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def enriched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (txId1, txId2, amount, timestamp) with age and whether they cross chains."""
    u = nodes.select(F.col("tx_id").alias("txId1"), F.col("time_step").alias("s1"), F.col("chain").alias("c1"))
    v = nodes.select(F.col("tx_id").alias("txId2"), F.col("time_step").alias("s2"), F.col("chain").alias("c2"))
    return edges.join(u, "txId1").join(v, "txId2").select("txId1", "txId2", "amount", "timestamp", (F.col("s2") - F.col("s1")).alias("age"), (F.col("c1") != F.col("c2")).cast("int").alias("cross"))


def semantic(nodes: DataFrame, edges: DataFrame, chains: bool = True) -> DataFrame:
    """tx_id and the 24 base columns of every node, with `chains` also the five chain columns.

    One aggregation by direction; both combine before their shuffle. Edges that bring age and cross along are not joined again.
    """
    e = edges if {"age", "cross"} <= set(edges.columns) else enriched(edges, nodes)
    sides = {}
    for side, end in (("in", "txId2"), ("out", "txId1")):
        sides[side] = e.groupBy(F.col(end).alias("tx_id")).agg(
            F.count(F.lit(1)).alias(f"{side}_n"), F.sum("amount").alias(f"{side}_sum"), F.min("amount").alias(f"{side}_min"), F.max("amount").alias(f"{side}_max"), F.avg("amount").alias(f"{side}_mean"), F.stddev_samp("amount").alias(f"{side}_std"),
            F.min("age").alias(f"{side}_age_min"), F.avg("age").alias(f"{side}_age_mean"), F.max("age").alias(f"{side}_age_max"), F.avg("timestamp").alias(f"{side}_when"), F.sum("cross").alias(f"{side}_cross"))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = nodes.select("tx_id", "time_step", "chain").join(sides["in"], "tx_id", "left").join(sides["out"], "tx_id", "left")
    base = [
        z("in_n"), z("out_n"), _log(z("out_sum")), _log(z("in_sum")), z("in_sum") - z("out_sum"), _log(z("in_sum")) - _log(z("out_sum")), _log(z("in_max")), _log(z("in_mean")), _log(z("out_max")), _log(z("out_mean")), _log(z("in_min")),
        z("in_age_min"), z("in_age_mean"), z("in_age_max"), z("out_age_mean"), z("in_mean"), z("out_mean"), _log(z("in_std")), _log(z("out_std")), z("in_when") / 3600, z("out_when") / 3600,
        (z("in_n") > 0).cast("double"), (z("out_n") > 0).cast("double"), F.col("time_step") / STEPS,
    ]
    chain = [*((F.col("chain") == k).cast("double") for k in range(3)), z("in_cross"), z("out_cross")]
    return rows.select("tx_id", *(c.alias(n) for c, n in zip(base, BASE)), *(c.alias(n) for c, n in zip(chain, CHAIN) if chains))


def derived(base: DataFrame) -> DataFrame:
    """tx_id and `derived`, the array of 141 products of base columns; logs are shared."""
    logs = base.select("tx_id", F.array(*BASE).alias("s")).select("tx_id", "s", F.transform("s", lambda x: F.log1p(F.abs(x) + 1e-9)).alias("l"))

    def product(k: int) -> Column:
        return F.col("l")[k % 24] * F.col("l")[k // 24 % 24] * (1 + 0.01 * F.abs(F.col("s")[k // 576 % 24]))

    return logs.select("tx_id", F.array(*(product(k) for k in range(DERIVED))).alias("derived"))


def structural(nodes: DataFrame, edges: DataFrame, node_id: str = "tx_id", step: str = "time_step") -> DataFrame:
    """The seven structural features; parallel edges count for degrees, once for neighbours; foreign endpoints are dropped."""
    pairs = edges.groupBy("txId1", "txId2").agg(F.count(F.lit(1)).alias("n"))
    ins = pairs.groupBy(F.col("txId2").alias(node_id)).agg(F.sum("n").alias("in_degree"), F.count(F.lit(1)).alias("in_unique_neighbors"))
    outs = pairs.groupBy(F.col("txId1").alias(node_id)).agg(F.sum("n").alias("out_degree"), F.count(F.lit(1)).alias("out_unique_neighbors"))
    rows = shuffled(shuffled(nodes.select(node_id, step)).join(ins, node_id, "left")).join(outs, node_id, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return rows.select(
        node_id, z("in_degree").alias("in_degree"), z("out_degree").alias("out_degree"), z("in_unique_neighbors").alias("in_unique_neighbors"), z("out_unique_neighbors").alias("out_unique_neighbors"),
        (z("in_degree") > 0).cast("int").alias("has_incoming"), (z("out_degree") > 0).cast("int").alias("has_outgoing"), (F.col(step) / STEPS).alias("step_norm"))


def propagated(nodes: DataFrame, edges: DataFrame, columns: list[str], hops: int = 2, node_id: str = "tx_id") -> DataFrame:
    """node_id and the columns with their means over outgoing neighbours, once per hop (suffix _1, _2, ...); 0 without any."""
    out = now = nodes.select(node_id, *columns)
    for hop in range(1, hops + 1):
        means = shuffled(edges).join(now.withColumnRenamed(node_id, "txId2"), "txId2").groupBy(F.col("txId1").alias(node_id)).agg(*(F.avg(c).alias(c) for c in columns))
        now = shuffled(nodes.select(node_id)).join(means, node_id, "left").select(node_id, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
        out = shuffled(out).join(now.select(node_id, *(F.col(c).alias(f"{c}_{hop}") for c in columns)), node_id)
    return out
