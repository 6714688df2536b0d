"""As-of lookups: the last write before a probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order values that one window works on together.
SPAN = 1 << 20


def last_before(probes: DataFrame, writes: DataFrame, key: str, at: str, span: int = SPAN) -> DataFrame:
    """Each probe (key, at, ...) with `last`: the greatest `at` of a write of its key that is under the probe's, or null.

    Probes and writes run through one window in order of `at`, probes first, so that nobody sees a write of its own
    moment. The windows are cut by key and by spans of `at`. The last writes of the spans are carried forward once, over
    the distinct (key, span) of probes and writes, and joined by these. A key that holds a great part of all rows is thus
    spread over as many windows and join keys as it has spans. Null keys find nothing.
    """
    bucket = F.floor(F.col(at) / span)
    w = writes.select(key, at).where(F.col(key).isNotNull()).withColumn("__span", bucket)
    p = probes.withColumn("__span", bucket)
    both = p.withColumn("__kind", F.lit(0)).withColumn("__w", F.lit(None).cast("bigint")).unionByName(w.withColumn("__kind", F.lit(1)).withColumn("__w", F.col(at)), allowMissingColumns=True)
    order = Window.partitionBy(key, "__span").orderBy(at, "__kind")
    near = both.withColumn("__near", F.last("__w", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("__kind = 0").drop("__kind", "__w")
    ends = w.select(key, "__span", F.col(at).alias("__end")).unionByName(p.where(F.col(key).isNotNull()).select(key, "__span", F.lit(None).cast("bigint").alias("__end")))
    earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span of the key
    carried = ends.groupBy(key, "__span").agg(F.max("__end").alias("__end")).select(key, "__span", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    return near.join(carried, [key, "__span"], "left").select(*probes.columns, F.coalesce("__near", "__carry").alias("last"))


def least_entered(probes: DataFrame, entered: DataFrame, pool: list[str], at: str, excluded: list[str], span: int = SPAN) -> DataFrame:
    """Each probe (pool, at, ...) with `least`: the least entity that entered its pool before `at` and is none of the two excluded columns.

    entered: (pool, entity, since), each entity once. Of any set the least that is none of two is among the three least,
    so these are kept as of every moment: within spans of `since` by windows, and over earlier spans by one carry.
    """
    names = ["m1", "m2", "m3"]

    def running(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        along = Window.partitionBy(*by).orderBy(*order)
        # each level's stream is built from windows of the one before, so every level is a step of its own
        now = rows.withColumn("__s", F.col("entity"))
        for name in names:
            now = now.withColumn(name, F.min("__s").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__l", F.min("__s").over(along.rowsBetween(Window.unboundedPreceding, -1)))
            now = now.withColumn("__s", F.when(F.col("__s").isNotNull() & F.col("__l").isNotNull(), F.greatest("__s", "__l")))
        return now.drop("__s", "__l")

    e = running(entered.select(*pool, "entity", "since").withColumn("__span", F.floor(F.col("since") / span)), [*pool, "__span"], ["since", "entity"])
    p = probes.withColumn("__span", F.floor(F.col(at) / span))
    three = F.struct(*names)
    both = p.withColumn("__at", F.col(at)).withColumn("__kind", F.lit(0)).withColumn("__m", F.lit(None).cast(e.select(three.alias("x")).schema["x"].dataType)).unionByName(
        e.select(*pool, "__span", F.col("since").alias("__at"), F.lit(1).alias("__kind"), three.alias("__m")), allowMissingColumns=True)
    order = Window.partitionBy(*pool, "__span").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("__near", F.last("__m", ignorenulls=True).over(order)).where("__kind = 0").drop("__at", "__kind", "__m")
    # the three least of each span, carried over the distinct spans
    whole = e.groupBy(*pool, "__span").agg(F.max_by(three, F.struct("since", "entity")).alias("m")).select(*pool, "__span", F.explode(F.array_compact(F.array("m.m1", "m.m2", "m.m3"))).alias("entity"))
    sums = running(whole, pool, ["__span", "entity"]).groupBy(*pool, "__span").agg(F.max_by(three, "entity").alias("m"))
    asked = sums.unionByName(p.select(*pool, "__span").distinct().withColumn("m", F.lit(None).cast(sums.schema["m"].dataType))).groupBy(*pool, "__span").agg(F.first("m", ignorenulls=True).alias("m"))
    carried = asked.select(*pool, "__span", F.last("m", ignorenulls=True).over(Window.partitionBy(*pool).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    all_six = F.array(*[F.col(f"{s}.{n}") for s in ("__near", "__carry") for n in names])
    free = F.filter(all_six, lambda x: x.isNotNull() & ~F.coalesce(x.isin(*[F.col(c) for c in excluded]), F.lit(False)))
    return near.join(carried, [*pool, "__span"], "left").select(*probes.columns, F.array_min(free).alias("least"))


def causal_edges(nodes: DataFrame) -> DataFrame:
    """(edge_id, txId1, txId2): each transaction's sender spends from the last transaction it received before."""
    found = last_before(nodes.select("tx_id", "actor").withColumnRenamed("actor", "entity"), nodes.select(F.col("recv").alias("entity"), "tx_id"), "entity", "tx_id")
    return found.where("last is not null").select(F.col("last").alias("txId1"), F.col("tx_id").alias("txId2"))


def fallback_sources(nodes: DataFrame) -> DataFrame:
    """(tx_id, source): for transactions whose sender never received, the least entity of the receiver's chain that did, and is neither.

    Only the first receipt of each entity matters.
    """
    first = nodes.groupBy(F.col("recv").alias("entity")).agg(F.min("tx_id").alias("since")).where("entity is not null")
    own = nodes.select("tx_id", "actor", "recv").join(first.withColumnRenamed("entity", "actor"), "actor", "left").where("since is null or since >= tx_id")
    probes = own.select("tx_id", "actor", "recv", (F.col("recv") % 3).alias("pool"))
    return least_entered(probes, first.withColumn("pool", F.col("entity") % 3), ["pool"], "tx_id", ["actor", "recv"]).select("tx_id", F.col("least").alias("source"))


def edge_attributes(edges: DataFrame, nodes: DataFrame, scale: int = 1200) -> DataFrame:
    """(txId1, txId2, amount, timestamp) of each edge: the target's amount, and when both ends exist."""
    u, v = nodes.select(F.col("tx_id").alias("txId1"), F.col("time_step").alias("s1")), nodes.select(F.col("tx_id").alias("txId2"), F.col("time_step").alias("s2"), "amount_minor")
    return edges.join(u, "txId1").join(v, "txId2").select("txId1", "txId2", F.round(F.col("amount_minor") / 100, 2).alias("amount"), (scale * (F.greatest("s1", "s2") - 1)).cast("bigint").alias("timestamp"))


def attributed_edges(nodes: DataFrame, scale: int = 1200) -> DataFrame:
    """causal_edges with amount, timestamp, age and cross: the target's amount, when both ends exist, steps between them and whether chains differ.

    What is known of the target comes along with its lookup, so that only the source's step and chain are joined.
    """
    probes = nodes.select("tx_id", F.col("actor").alias("entity"), F.col("time_step").alias("s2"), F.col("chain").alias("c2"), "amount_minor")
    found = last_before(probes, nodes.select(F.col("recv").alias("entity"), "tx_id"), "entity", "tx_id").where("last is not null")
    source = nodes.select(F.col("tx_id").alias("last"), F.col("time_step").alias("s1"), F.col("chain").alias("c1"))
    return found.join(source, "last").select(
        F.col("last").alias("txId1"), F.col("tx_id").alias("txId2"), F.round(F.col("amount_minor") / 100, 2).alias("amount"), (scale * (F.greatest("s1", "s2") - 1)).cast("bigint").alias("timestamp"),
        (F.col("s2") - F.col("s1")).alias("age"), (F.col("c1") != F.col("c2")).cast("int").alias("cross"))
