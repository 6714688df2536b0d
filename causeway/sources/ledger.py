"""Transaction-graph views over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 49


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_nodes(events: DataFrame) -> DataFrame:
    """A transaction per event: id, step 1..49, sending and receiving entity, chain, class, amount and a stand-in score."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))
    step = F.least(F.lit(STEPS), F.floor(micros * STEPS / F.lit(2592000000000)).cast("int") + 1)
    kind = F.when(F.col("event_type") == "error", "1").when(F.col("event_type").isin("purchase", "view"), "2").otherwise("unknown")
    return events.select(
        F.col("event_id").alias("tx_id"), step.alias("time_step"), F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").cast("bigint").alias("recv"),
        (F.col("user_id") % 3).alias("chain"), kind.alias("class"), F.round(F.col("value") * 100).cast("bigint").alias("amount_minor"), (F.col("event_id") * 7919 % 1000 / 1000.0).alias("score"))


def tx_multi(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Parallel edges from customers to suppliers; supplier ids are moved out of the customers' range."""
    pairs = orders.select("o_orderkey", "o_custkey").join(lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.select(F.col("o_custkey").alias("txId1"), (F.col("l_suppkey") + 1000000).alias("txId2"), F.col("l_extendedprice").alias("amount"))
