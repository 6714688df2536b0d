"""The generator: typed entities under quotas and drift, causal edges by as-of lookups, instances as trees.

Draws are functions of the seed, a stream, the row and nothing else, so any partitioning gives the same ledger. State
that a sequential simulator would carry (the last transaction an entity received) is an as-of lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, schedule
from ..operators.forest import Forest
from ..operators.numbering import numbered
from ..storage import stored
from .config import Config, DriftError
from .registry import ACTIONS, AMOUNTS, CHAINS, PROFILES, native_entity_id

#: Streams of draws.
POPULATION, SCHEDULE, ACTION, ACTOR, COUNTERPARTY, BRIDGE, AMOUNT, DRIFT = range(1, 9)
_TOWARDS_ACTOR = ("hub_in", "mix_in")


@dataclass
class Ledger:
    """Tables of a generated ledger."""

    config: Config
    entities: DataFrame
    events: DataFrame
    nodes: DataFrame
    edges: DataFrame
    instances: DataFrame
    forest: Forest


def _draw(config: Config, stream: int, *keys: Column) -> Column:
    return schedule.uniform(F.lit(config.seed), F.lit(stream), *keys)


def entities(spark: SparkSession, config: Config) -> DataFrame:
    """(entity_id, profile_id, chain_id, ordinal in its profile and chain): numbered by profile, chains by weight over those enabled."""
    first, parts = 0, []
    for p in sorted(config.quotas):
        count = config.quotas[p][0]
        weights = [(CHAINS[c]["chain_id"], w) for c, w in PROFILES[p].chain_weights if config.chains[c] and w > 0]
        if not weights:
            raise ValueError(f"profile has no enabled chain: {p}")
        rows = spark.range(first, first + count).select(F.col("id").alias("entity_id"), F.lit(p).alias("profile_id"))
        parts.append(schedule.weighted_pick(rows, weights, _draw(config, POPULATION, F.col("entity_id")), "chain_id"))
        first += count
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    from pyspark.sql import Window

    return stored(out.withColumn("ordinal", F.row_number().over(Window.partitionBy("profile_id", "chain_id").orderBy("entity_id")) - 1))


def assigned(config: Config, slots: DataFrame) -> DataFrame:
    """(slot, step, profile_id): each profile's quota from the slots it may have, novel profiles first, then by name."""
    left = stored(schedule.with_phase(slots, config.phases))
    done = None
    for p in sorted(config.quotas, key=lambda x: (PROFILES[x].negative_kind != "novel_illicit", x)):
        quota = config.quotas[p][1]
        if not quota:
            continue
        number = sorted(PROFILES).index(p)
        novel = PROFILES[p].negative_kind == "novel_illicit"
        ok = F.array_contains("novel", p) if novel else F.lit(True)
        if PROFILES[p].class_policy == "illicit" and not novel:
            ok = _draw(config, DRIFT, F.lit(number), F.col("slot")) < F.col("keep_probability")
        # a draw made unique by the slot orders the eligible; spans of it are numbered apart
        key = (_draw(config, SCHEDULE, F.lit(number), F.col("slot")) * (1 << 30)).cast("bigint") * (1 << 32) + F.col("slot")
        ranked = stored(numbered(left.where(ok).select("slot", "step", key.alias("key")), ["key"], "rank").where(F.col("rank") < quota).select("slot", "step", F.lit(p).alias("profile_id")))
        if ranked.count() < quota:
            raise DriftError(f"not enough eligible steps for profile: {p}")
        done = ranked if done is None else done.unionByName(ranked)
        left = stored(left.join(ranked.select("slot"), "slot", "left_anti"))
    if not left.isEmpty():
        raise DriftError("behavior scheduler left unassigned slots")
    return done


def _pools(spark: SparkSession, people: DataFrame) -> DataFrame:
    """(action_id, profile_id, chain_id, cross, groups): where an actor's counterparties may come from. A few rows per action."""
    counted = {(r["profile_id"], r["chain_id"]): r["n"] for r in people.groupBy("profile_id", "chain_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # profiles by chains
    # the order of the registries, on which draws rely
    sizes = {(p, c["chain_id"]): counted[p, c["chain_id"]] for p in PROFILES for c in CHAINS.values() if (p, c["chain_id"]) in counted}
    rows = []
    for a in ACTIONS.values():
        for p, chain in sizes:
            for cross in (False, True):
                groups = [(q, c, n - (q == p and c == chain), PROFILES[q].activity_weight, q == p and c == chain) for q in a.counterparty_profiles for (r, c), n in sizes.items() if r == q]
                same = [g for g in groups if (g[1] != chain) == cross and g[2] > 0]
                groups = same if cross or same else [g for g in groups if g[2] > 0]
                rows.append((a.action_id, p, chain, cross, groups))
    return spark.createDataFrame(rows, "action_id string, profile_id string, chain_id string, cross boolean, groups array<struct<profile:string,chain:string,n:bigint,w:double,own:boolean>>")


def _pick(rows: DataFrame, pools: DataFrame, cross: Column, draw: Column) -> DataFrame:
    """rows with cp_profile, cp_chain and cp_ordinal of a counterparty drawn by weight; never the actor itself."""
    joined = rows.withColumn("cross", cross).withColumn("u", draw).join(F.broadcast(pools).withColumnRenamed("chain_id", "actor_chain"), ["action_id", "profile_id", "actor_chain", "cross"], "left")
    total = F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["n"] * g["w"])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("struct<profile:string,chain:string,n:bigint,w:double,own:boolean,left:double>").alias("g"))

    def step(acc, g):
        more = acc["s"] + g["n"] * g["w"]
        hit = acc["g"].isNull() & (F.col("u") * F.col("total") < more)
        return F.struct(more.alias("s"), F.when(hit, F.struct(g["profile"].alias("profile"), g["chain"].alias("chain"), g["n"].alias("n"), g["w"].alias("w"), g["own"].alias("own"), ((F.col("u") * F.col("total") - acc["s"]) / g["w"]).alias("left"))).otherwise(acc["g"]).alias("g"))

    found = joined.withColumn("total", total).withColumn("g", F.aggregate("groups", start, step, lambda a: a["g"]))
    index = F.least(F.floor("g.left"), F.col("g.n") - 1)
    ordinal = F.when(F.col("g.own") & (index >= F.col("actor_ordinal")), index + 1).otherwise(index)
    return found.select(*rows.columns, F.col("g.profile").alias("cp_profile"), F.col("g.chain").alias("cp_chain"), ordinal.cast("int").alias("cp_ordinal"))


def events(spark: SparkSession, config: Config, slots: DataFrame, people: DataFrame) -> DataFrame:
    """The events, before sources: actor, action, counterparty, target, preferred source, amount."""
    slot = F.col("slot")
    names = F.create_map(*[x for p in PROFILES for x in (F.lit(p), F.array(*map(F.lit, PROFILES[p].action_ids)))])
    counts = F.create_map(*[x for p, (n, _) in config.quotas.items() for x in (F.lit(p), F.lit(n))])
    starts, first = {}, 0
    for p in sorted(config.quotas):
        starts[p] = first
        first += config.quotas[p][0]
    offset = F.create_map(*[x for p, n in starts.items() for x in (F.lit(p), F.lit(n).cast("bigint"))])
    acts = names[F.col("profile_id")]
    rows = slots.select("slot", "step", "profile_id", acts[F.floor(_draw(config, ACTION, slot) * F.size(acts)).cast("int")].alias("action_id"), (offset[F.col("profile_id")] + F.floor(_draw(config, ACTOR, slot) * counts[F.col("profile_id")])).alias("actor"))
    who = people.select(F.col("entity_id").alias("actor"), F.col("chain_id").alias("actor_chain"), F.col("ordinal").alias("actor_ordinal"))
    rows, pools = rows.join(who, "actor"), _pools(spark, people)
    one = _pick(rows, pools, F.col("action_id") == "bridge_link", _draw(config, COUNTERPARTY, slot))
    # an action that would leave the chain becomes a bridge, with another counterparty
    again = (F.col("action_id") != "bridge_link") & (F.col("cp_chain") != F.col("actor_chain"))
    stay = one.where(~again)
    moved = _pick(one.where(again).withColumn("action_id", F.lit("bridge_link")).select(*rows.columns), pools, F.lit(True), _draw(config, BRIDGE, slot))
    drawn = stay.unionByName(moved)
    cp = people.select(F.col("profile_id").alias("cp_profile"), F.col("chain_id").alias("cp_chain"), F.col("ordinal").alias("cp_ordinal"), F.col("entity_id").alias("counterparty"))
    drawn = drawn.join(cp, ["cp_profile", "cp_chain", "cp_ordinal"], "left")
    in_ = F.col("action_id").isin(*_TOWARDS_ACTOR)
    low = F.create_map(*[x for a in ACTIONS.values() for x in (F.lit(a.action_id), F.array(*map(F.lit, AMOUNTS[a.amount_policy])))])[F.col("action_id")]
    amount = (low[0] + F.floor(_draw(config, AMOUNT, slot) * (low[1] - low[0] + 1))).cast("bigint")
    return drawn.select(
        slot.alias("event_id"), "step", "profile_id", "action_id", "actor", "actor_chain", "counterparty", F.when(in_, F.col("actor")).otherwise(F.col("counterparty")).alias("target"), F.when(in_, F.col("counterparty")).otherwise(F.col("actor")).alias("preferred"),
        F.when(in_, F.col("actor_chain")).otherwise(F.col("cp_chain")).alias("chain_id"), amount.alias("amount_minor"))


def with_sources(drawn: DataFrame, people: DataFrame) -> DataFrame:
    """Events with source_entity and source_tx: the preferred source's last receipt, else that of the least entity the action allows."""
    writes = drawn.select(F.col("target").alias("entity"), "event_id")
    first = stored(asof.last_before(drawn.withColumn("entity", F.col("preferred")), writes, "entity", "event_id").drop("entity").withColumnRenamed("last", "tx1"))
    received = writes.groupBy("entity").agg(F.min("event_id").alias("since")).join(people.select(F.col("entity_id").alias("entity"), F.col("profile_id").alias("p"), F.col("chain_id").alias("c")), "entity")
    # an action draws on the entities of some profiles on its chain, a bridge on those on the others
    chains = [v["chain_id"] for v in CHAINS.values()]
    pools = [(a.action_id, here, p, c) for a in ACTIONS.values() for here in chains for p in a.counterparty_profiles for c in chains if (c != here) == (a.action_id == "bridge_link")]
    pools = first.sparkSession.createDataFrame(pools, "action_id string, chain_id string, p string, c string")
    lacking = first.where("tx1 is null").select("event_id", "actor", "target", "action_id", "chain_id").join(F.broadcast(pools), ["action_id", "chain_id"])  # actions by chains and profiles
    second = asof.least_entered(lacking, received, ["p", "c"], "event_id", ["actor", "target"]).groupBy("event_id").agg(F.min("least").alias("entity")).where("entity is not null")
    found = asof.last_before(second, writes, "entity", "event_id").select("event_id", F.col("entity").alias("entity2"), F.col("last").alias("tx2"))
    return first.join(found, "event_id", "left").select("*", F.when(F.col("tx1").isNotNull(), F.col("preferred")).otherwise(F.col("entity2")).alias("source_entity"), F.coalesce("tx1", "tx2").alias("source_tx"))


def generate(spark: SparkSession, config: Config, volume: DataFrame) -> Ledger:
    """A ledger; volume: (step, weight) of the 49 steps."""
    config.check()
    if volume.count() != 49:
        raise ValueError("behavior simulation requires a 49-step volume profile")
    people = entities(spark, config)
    drawn = stored(events(spark, config, assigned(config, schedule.slots(volume, config.n_txs)), people))
    done = stored(with_sources(drawn, people))
    bridge = F.when(F.col("action_id") == "bridge_link", F.concat("actor_chain", F.lit("->"), "chain_id"))
    roles = F.array_sort(F.array_distinct(F.array_compact(F.array("actor", "target", "counterparty", "source_entity"))))
    edges = numbered(done.where("source_tx is not null").select(F.col("source_tx").alias("txId1"), F.col("event_id").alias("txId2"), "event_id", "chain_id", "action_id", "amount_minor", F.col("step").alias("timestamp"), bridge.alias("bridge_id")), ["txId2"], "edge_id")
    kinds = F.create_map(*[F.lit(x) for a in ACTIONS.values() for x in (a.action_id, a.edge_kind)])
    edges = stored(edges.select("edge_id", "txId1", "txId2", "event_id", "chain_id", kinds[F.col("action_id")].alias("kind"), F.col("action_id").alias("role"), "amount_minor", "timestamp", "bridge_id"))
    trees = Forest(done.select(F.col("event_id").alias("tx_id")), edges)
    inst = stored(trees.instances())
    classes = F.create_map(*[F.lit(x) for a in ACTIONS.values() for x in (a.action_id, a.target_class)])
    joined = done.join(inst.select(F.col("node").alias("event_id"), "instance_id"), "event_id")
    nodes = stored(joined.select(F.col("event_id").alias("tx_id"), F.col("step").alias("time_step"), classes[F.col("action_id")].alias("cls"), F.col("action_id").alias("role"), F.col("profile_id").alias("scheme"), "event_id", roles.alias("entity_ids"), "chain_id", "instance_id"))
    one = lambda c: F.array_compact(F.array(c))
    listed = stored(joined.select(
        "event_id", "instance_id", "step", F.col("actor").alias("actor_entity_id"), F.array("counterparty").alias("counterparty_entity_ids"), "action_id", "profile_id", one("source_tx").alias("source_tx_ids"), F.col("event_id").alias("target_tx_id"),
        F.col("target").alias("target_entity_id"), "amount_minor", "chain_id", bridge.alias("bridge_id"), one("source_entity").alias("source_entity_ids")))
    bounds = nodes.select(F.explode("entity_ids").alias("entity_id"), "time_step").groupBy("entity_id").agg(F.min("time_step").alias("first_step"), F.max("time_step").alias("last_step"))
    kind = F.create_map(*[F.lit(x) for p in PROFILES.values() for x in (p.profile_id, p.entity_type)])
    records = people.join(bounds, "entity_id", "left").select("entity_id", "profile_id", F.lit(1).alias("profile_version"), kind[F.col("profile_id")].alias("entity_type"), "chain_id", native_entity_id(config.seed, F.col("entity_id"), F.col("chain_id")).alias("native_entity_id"), "first_step", "last_step")
    return Ledger(config, stored(records), listed, nodes, edges, stored(instances(nodes, edges)), trees)


def instances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per instance; lists are as long as the instance."""
    own = edges.join(nodes.select(F.col("tx_id").alias("txId2"), "instance_id"), "txId2").groupBy("instance_id").agg(F.array_sort(F.collect_list("edge_id")).alias("edge_ids"))
    path = nodes.groupBy("instance_id", "chain_id").agg(F.min("tx_id").alias("f")).groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "chain_id"))), lambda x: x["chain_id"]).alias("chain_path"))
    people = nodes.select("instance_id", F.explode("entity_ids").alias("e")).groupBy("instance_id").agg(F.array_sort(F.collect_set("e")).alias("entity_ids"))
    rolled = nodes.groupBy("instance_id").agg(
        F.min_by("scheme", "tx_id").alias("profile_id"), F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.array_sort(F.collect_list("tx_id")).alias("node_ids"), F.min("time_step").alias("step_min"), F.max("time_step").alias("step_max"),
        F.array_sort(F.collect_set("scheme")).alias("profile_ids"))
    none = F.expr("cast(array() as array<bigint>)")
    return rolled.join(people, "instance_id").join(path, "instance_id").join(own, "instance_id", "left").select(
        "instance_id", "profile_id", "entity_ids", "event_ids", "node_ids", F.coalesce("edge_ids", none).alias("edge_ids"), F.array("step_min", "step_max").alias("temporal_window"), "chain_path", "profile_ids")
