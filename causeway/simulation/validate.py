"""Integrity rules of a bundle. Each rule is a query for rows at fault; all run, and the first fault in order is raised.

Order is that of blocks, then rows, then rules within a row.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, checks
from ..operators.forest import Forest
from ..sources import json_ranges
from ..storage import stored
from . import bundle, registry
from .bundle import FILES, read_table, sha256
from .config import Config, check_phases, parse
from .generate import Ledger, instances
from .registry import ACTIONS, CHAINS, PROFILES


class Invalid(ValueError):
    """A bundle that breaks a rule."""


class Rules:
    """Collects queries of faults. Rules over one table's rows share one pass."""

    def __init__(self):
        self.parts: list[DataFrame] = []
        self.count = 0

    def add(self, block: int, message: str, faults: DataFrame, row: str | None = None) -> None:
        """Every row of faults breaks the rule."""
        at = F.col(row).cast("bigint") if row else F.lit(0).cast("bigint")
        self.parts.append(faults.select(F.lit(block).alias("block"), at.alias("row"), F.lit(self.count).alias("rule"), F.lit(message).alias("message")))
        self.count += 1

    def rows(self, block: int, table: DataFrame, row: str, rules: list[tuple[str, Column]]) -> None:
        """Rows on which a condition holds break its rule; null is no fault."""
        broken = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(self.count + k).alias("rule"), F.lit(m).alias("message"))) for k, (m, c) in enumerate(rules))))
        self.parts.append(table.select(F.lit(block).alias("block"), F.col(row).cast("bigint").alias("row"), F.explode(broken).alias("b")).select("block", "row", "b.rule", "b.message"))
        self.count += len(rules)

    def same(self, block: int, what: str, stored: DataFrame, derived: DataFrame, key: str, columns: list[str], near: tuple[str, ...] = ()) -> None:
        """Stored rows must be the derived ones, column by column; columns in `near` up to rounding."""
        if not near:  # columns that must be equal as they stand: only ranges whose digests differ are joined
            every = [key, *columns]
            kinds = dict(stored.dtypes)
            derived = derived.select(*[F.col(c) if kind == kinds[c] else F.col(c).cast(kinds[c]) for c, kind in derived.select(*every).dtypes])  # hashes of equal numbers of other types differ
            stored, derived = checks.differing(stored.select(*every), derived, every, [key])
        s, d = stored.withColumn("__s", F.lit(True)).alias("s"), derived.withColumn("__d", F.lit(True)).alias("d")
        both = s.join(d, F.col(f"s.{key}") == F.col(f"d.{key}"), "full").withColumn("__row", F.coalesce(f"s.{key}", f"d.{key}"))
        met = F.col("__s") & F.col("__d")
        differ = lambda c: F.abs(F.col(f"s.{c}") - F.col(f"d.{c}")) > 1e-9 + 1e-9 * F.abs(F.col(f"d.{c}")) if c in near else ~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}"))
        self.rows(block, both, "__row", [(f"{what} do not cover their source", F.col("__s").isNull() | F.col("__d").isNull()), *((f"{what}: {c} does not match", met & differ(c)) for c in columns)])
        self.add(block, f"{what} occur twice", stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)

    def faults(self) -> DataFrame:
        """(block, row, rule, message) of everything at fault."""
        every = self.parts[0]
        for p in self.parts[1:]:
            every = every.unionByName(p)
        return every

    def raise_first(self) -> None:
        if self.parts:
            for r in self.faults().groupBy().agg(F.min(F.struct("block", "row", "rule", "message")).alias("m")).where("m is not null").collect():
                raise Invalid(r["m"]["message"])
        self.parts = []


def need(ok: bool, message: str) -> None:
    if not ok:
        raise Invalid(message)


def validate_tables(spark: SparkSession, root: str | Path) -> dict[str, DataFrame]:
    """The base contract: ids, steps, finite features, classes, edges and their attributes."""
    t = {name: read_table(spark, root, name).cache() for name in FILES}
    rules = Rules()
    f, c, e, a = (t[n] for n in ("features", "classes", "edgelist", "edge_attributes"))
    values = [F.col(f"feat_{k}") for k in range(2, bundle.FEATURES + 2)]
    rules.add(0, "features contain a duplicate txId", checks.duplicates(f, ["txId"]))
    rules.add(0, "txId must be contiguous from 0", checks.contiguity(f, "txId").where("not ok"))
    rules.add(0, "time_step must be within 1..49", f.where("time_step is null or time_step not between 1 and 49"))
    rules.add(0, "features must be finite", f.where(F.exists(F.array(*values), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    rules.add(1, "classes contain a duplicate txId", checks.duplicates(c, ["txId"]))
    rules.add(1, "class must be 1, 2 or unknown", c.where("class is null or class not in ('1', '2', 'unknown')"))
    rules.add(1, "classes do not cover the features", checks.coverage_diff(f, c, "txId"))
    rules.add(2, "edge endpoint is not a transaction", checks.orphans(e.select("txId1", "txId2"), f.select(F.col("txId").alias("tx_id"))))
    rules.add(3, "edge attributes must be row-aligned with the edges", e.alias("e").join(a.alias("a"), "__row", "full").where("not (e.txId1 <=> a.txId1 and e.txId2 <=> a.txId2)"))
    rules.add(3, "edge amount must be finite and non-negative", a.where("amount is null or isnan(amount) or amount < 0 or amount = double('Infinity')"))
    rules.add(3, "edge timestamp must be a non-negative integer", a.where("timestamp is null or timestamp < 0"))
    try:
        rules.raise_first()
    except PySparkException as x:
        raise Invalid(f"bundle CSV can't be read: {str(x).splitlines()[0]}") from x
    return t


def validate_features(spark: SparkSession, t: dict[str, DataFrame], chains: DataFrame) -> None:
    """Stored features equal those worked out anew; chains: (tx_id, chain)."""
    nodes = t["features"].select(F.col("txId").alias("tx_id"), "time_step").join(chains, "tx_id")
    again = bundle.matrix(nodes, t["edge_attributes"].select("txId1", "txId2", "amount", "timestamp"))
    both = t["features"].alias("s").join(again.alias("r"), "txId")
    wrong = [F.abs(F.col(f"s.feat_{k}") - F.col(f"r.feat_{k}")) > 1e-9 + 1e-9 * F.abs(F.col(f"r.feat_{k}")) for k in range(2, bundle.FEATURES + 2)]
    rules = Rules()
    rules.add(0, "semantic features do not match the graph", both.where(F.exists(F.array(*wrong), lambda x: x)), "txId")
    rules.raise_first()


#: Sections of the manifest as tables: where each stands and its fields.
_SECTIONS = {
    "events": ("behavior.events", "event_id bigint, instance_id bigint, step int, actor_entity_id bigint, counterparty_entity_ids array<bigint>, action_id string, profile_id string, source_tx_ids array<bigint>, target_tx_id bigint, target_entity_id bigint, amount_minor bigint, chain_id string, bridge_id string, source_entity_ids array<bigint>"),
    "entities": ("behavior.entities", "entity_id bigint, profile_id string, profile_version int, entity_type string, chain_id string, native_entity_id string, first_step int, last_step int"),
    "instances": ("behavior.instances", "instance_id bigint, profile_id string, entity_ids array<bigint>, event_ids array<bigint>, node_ids array<bigint>, edge_ids array<bigint>, temporal_window array<int>, chain_path array<string>, profile_ids array<string>"),
    "truth": ("ground_truth", "txId bigint, scheme string, role string, class string, instance_id bigint, event_id bigint, entity_ids array<bigint>, chain_id string"),
    "edge_truth": ("edge_attribute_ground_truth", "edge_id bigint, txId1 bigint, txId2 bigint, pattern_type string, instance_id bigint, role string, amount double, event_id bigint, chain_id string, edge_kind string"),
    "instance_truth": ("instance_ground_truth", "instance_id bigint, pattern_type string, anchor_node_id bigint, anchor_role string, entity_type string, max_anchor_distance bigint, temporal_window array<int>, node_ids array<bigint>, edge_ids array<bigint>, articulation_points array<bigint>, anchored boolean, holdout boolean, train_excluded boolean, profile_id string, profile_ids array<string>, entity_ids array<bigint>, event_ids array<bigint>, chain_path array<string>"),
    "anchors": ("anchor_registry.anchors", "instance_id bigint, anchor_node_id bigint, anchor_role string, entity_type string, pattern_type string, max_anchor_distance bigint, k_hop_neighborhoods map<string,array<bigint>>"),
    "profile_nodes": ("behavior.behavioral_profiles.nodes", "txId bigint, profile_id string, entity_type string, class_policy string, behavior_params map<string,string>, entity_ids array<bigint>, chain_id string"),
    "node_records": ("behavior.chain_metadata.node_records", "txId bigint, chain_id string, chain_key string, native_tx_id string, native_entity_id string, native_id_is_synthetic boolean"),
    "edge_records": ("behavior.chain_metadata.edge_records", "edge_id bigint, event_id bigint, txId1 bigint, txId2 bigint, source_chain_id string, target_chain_id string, kind string, role string, csv_amount double, timestamp int, native_amount_minor bigint, bridge_id string"),
    "bridge_records": ("behavior.chain_metadata.bridge_records", "bridge_id string, event_id bigint, edge_id bigint, source_chain_id string, target_chain_id string"),
}


def _at(manifest: dict, path: str):
    for name in path.split("."):
        need(isinstance(manifest, dict) and name in manifest, f"manifest section is missing: {path}")
        manifest = manifest[name]
    return manifest


def fields(schema: str) -> list[str]:
    """The names of a schema's fields."""
    return [x.strip().split()[0] for x in re.split(r", (?=\w+ )", schema)]


def sections(spark: SparkSession, path: str | Path, size: int = json_ranges.RANGE) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest without its records, tables of the records by name). Tasks read and check the records, each a range of the file."""
    document = json_ranges.Document(spark, path, size)
    m, places = document.read({at for at, _ in _SECTIONS.values()})
    for at, _ in _SECTIONS.values():
        _at(m, at)
        need(at in places, f"manifest section is no list: {at}")
    found = stored(document.records(places, {at: set(fields(schema)) for at, schema in _SECTIONS.values()}))
    fault = found.where("fault is not null").agg(F.min(F.struct("place", "fault")).alias("f")).first()["f"]
    need(fault is None, f"manifest {fault['fault'] if fault else ''}")
    parsed = lambda at, schema: found.where(F.col("section") == at).select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return m, {name: parsed(at, schema) for name, (at, schema) in _SECTIONS.items()}


def manifest_rules(m: dict) -> Config:
    """What the parts of a manifest that are no tables must hold; the configuration they tell of."""
    for name in ("seed", "config", "sha256", "anchor_registry", "retrieval_specs", "feature_semantics", "decoys", "holdout", "behavior"):
        need(name in m, f"manifest section is missing: {name}")
    b = m["behavior"]
    try:
        config = parse(m["config"])
    except ValueError as x:
        raise Invalid(f"manifest configuration is invalid: {x}") from x
    need(m["config"] == config.as_dict(), "manifest configuration is not whole")
    said = [
        ("behavior contract version is not supported", b.get("contract_version") == "behavior.p0.v1"), ("behavior registry version does not match", _at(b, "behavioral_profiles.registry_version") == 1),
        ("behavior registry digest mismatch", _at(b, "behavioral_profiles.registry_sha256") == registry.digest()), ("manifest seed does not match its configuration", m["seed"] == config.seed),
        ("draws follow another contract", _at(b, "rng_contract") == bundle.RNG_CONTRACT), ("drift schedule differs from the configuration", _at(b, "drift_schedule.configured") == m["config"]["behavior"]["drift"]),
        ("realized drift does not cover the phases", [p["phase_id"] for p in _at(b, "drift_schedule.realized")] == [p["phase_id"] for p in config.phases]),
        ("drift phase bounds do not match", [(p["step_min"], p["step_max"]) for p in _at(b, "drift_schedule.realized")] == [(p["step_min"], p["step_max"]) for p in config.phases]),
        ("chain registry does not match", _at(b, "chain_metadata.chains") == [{"chain_key": k, **v} for k, v in CHAINS.items()]), ("chain identities are not synthetic", _at(b, "chain_metadata.identity_scope") == "synthetic"),
        ("sanctions hold more than provenance", b.get("sanctions_anchor_map") == bundle.SANCTIONS), ("calibration does not match", b.get("calibration") == bundle.CALIBRATION), ("there are decoys", m["decoys"] == []),
        ("feature layout does not match", m["feature_semantics"] == bundle.FEATURE_SEMANTICS), ("holdout does not match the configuration", m["holdout"] == {"windows_active": bool(config.holdout), "entries": config.holdout}),
        ("retrieval specification does not match", m["retrieval_specs"] == bundle.retrieval_specs(config)),
        ("anchor configuration does not match", (_at(m, "anchor_registry.per_1000_nodes"), _at(m, "anchor_registry.min_anchor_distance")) == (config.per_1000_nodes, config.min_anchor_distance)),
    ]
    for message, ok in said:
        need(ok, message)
    check_phases(config.phases)
    return config


def derived(spark: SparkSession, config: Config, t: dict[str, DataFrame]) -> Ledger:
    """The ledger that events, entities, steps and edges imply; t also holds nodes (tx_id, time_step) and edges (edge_id, txId1, txId2)."""
    e = t["events"]
    look = lambda field: F.create_map(*[F.lit(x) for a in ACTIONS.values() for x in (a.action_id, getattr(a, field))])[F.col("action_id")]
    trees = Forest(t["nodes"], t["edges"].select("txId1", "txId2"))
    member = trees.instances().select(F.col("node").alias("tx_id"), "instance_id")
    roles = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("actor_entity_id", "target_entity_id"), "counterparty_entity_ids", "source_entity_ids"))))
    made = e.select(F.col("event_id").alias("tx_id"), look("target_class").alias("cls"), F.col("action_id").alias("role"), F.col("profile_id").alias("scheme"), "event_id", roles.alias("entity_ids"), "chain_id")
    nodes = stored(t["nodes"].join(member, "tx_id").join(made, "tx_id"))
    edges = stored(t["edges"].join(e.select(F.col("event_id").alias("txId2"), "event_id", "chain_id", look("edge_kind").alias("kind"), F.col("action_id").alias("role"), "amount_minor", F.col("step").alias("timestamp"), "bridge_id"), "txId2"))
    return Ledger(config, t["entities"], e, nodes, edges, stored(instances(nodes, edges)), trees)


def event_rules(rules: Rules, config: Config, t: dict[str, DataFrame], ledger: Ledger) -> None:
    """Events against entities, registries, steps, sources and edges."""
    events, people, nodes = t["events"], t["entities"], t["nodes"]
    listed = lambda f: F.create_map(*[x for a in ACTIONS.values() for x in (F.lit(a.action_id), f(a))])[F.col("action_id")]
    names = lambda values: F.array(*map(F.lit, values))
    person = lambda column, name: people.select(F.col("entity_id").alias(column), F.col("profile_id").alias(f"{name}_profile"), F.col("chain_id").alias(f"{name}_chain"))
    with_id = lambda column, name: events.select("event_id", "action_id", F.explode(column).alias(f"{name}_id")).join(person(f"{name}_id", name), f"{name}_id", "left")
    others = with_id("counterparty_entity_ids", "cp").groupBy("event_id").agg(
        F.bool_or(F.col("cp_profile").isNull()).alias("cp_unknown"), F.bool_or(~F.array_contains(listed(lambda a: names(a.counterparty_profiles)), F.col("cp_profile"))).alias("cp_refused"))
    givers = with_id("source_entity_ids", "giver").groupBy("event_id").agg(F.bool_or(F.col("giver_profile").isNull()).alias("giver_unknown"))
    steps = nodes.select(F.col("tx_id").alias("source_tx"), F.col("time_step").alias("source_step"))
    came = events.select("event_id", F.explode("source_tx_ids").alias("source_tx")).join(steps, "source_tx", "left").join(t["edges"].select(F.col("txId1").alias("source_tx"), F.col("txId2").alias("event_id"), "edge_id"), ["source_tx", "event_id"], "left")
    came = came.groupBy("event_id").agg(F.bool_or(F.col("source_step").isNull()).alias("tx_unknown"), F.max("source_tx").alias("latest_tx"), F.max("source_step").alias("latest_step"), F.bool_or(F.col("edge_id").isNull()).alias("no_edge"))
    e = events.join(nodes.select(F.col("tx_id").alias("target_tx_id"), "time_step"), "target_tx_id", "left").join(person("actor_entity_id", "actor"), "actor_entity_id", "left").join(person("target_entity_id", "target"), "target_entity_id", "left")
    e = e.join(others, "event_id", "left").join(givers, "event_id", "left").join(came, "event_id", "left")
    bridge, crosses = F.col("action_id") == "bridge_link", F.col("actor_chain") != F.col("target_chain")
    low, high = (listed(lambda a, k=k: F.lit(registry.AMOUNTS[a.amount_policy][k])) for k in (0, 1))
    named = F.concat("actor_chain", F.lit("->"), "chain_id")
    twice = lambda c: F.size(c) != F.size(F.array_distinct(c))
    aim = F.when(F.col("action_id").isin("hub_in", "mix_in"), F.col("actor_entity_id")).otherwise(F.get("counterparty_entity_ids", F.lit(0)))
    rules.add(20, "event IDs must be contiguous", checks.contiguity(events, "event_id").where("not ok"))
    rules.add(20, "event target transaction occurs twice", checks.duplicates(events, ["target_tx_id"]))
    rules.add(20, "events do not cover the transactions", checks.coverage_diff(events.select(F.col("target_tx_id").alias("tx_id")), nodes, "tx_id"))
    rules.rows(21, e, "event_id", [
        ("event target transaction must be its own", (F.col("event_id") != F.col("target_tx_id")) | F.col("time_step").isNull()), ("event step does not match its transaction", F.col("step") != F.col("time_step")), ("event action is unknown", ~F.col("action_id").isin(*ACTIONS)),
        ("event actor is unknown", F.col("actor_profile").isNull()), ("event profile does not match its actor", F.col("profile_id") != F.col("actor_profile")), ("event action is not allowed for the profile", ~F.array_contains(listed(lambda a: names(a.actor_profiles)), F.col("profile_id"))),
        ("bridge event stays on its chain", bridge & ~crosses), ("bridge event ID does not match its chains", bridge & ~F.col("bridge_id").eqNullSafe(named)), ("event without a bridge has a bridge ID", ~bridge & F.col("bridge_id").isNotNull()),
        ("event leaves its chain without a bridge", ~bridge & crosses), ("event amount is outside its policy", ~F.col("amount_minor").between(low, high) | F.col("amount_minor").isNull()), ("event has no counterparty", F.size("counterparty_entity_ids") == 0),
        ("event counterparty occurs twice", twice("counterparty_entity_ids")), ("event counterparty is unknown", F.col("cp_unknown")), ("event counterparty is not allowed for the action", F.col("cp_refused")), ("event counterparty is its actor", F.array_contains("counterparty_entity_ids", F.col("actor_entity_id"))),
        ("event target entity is unknown", F.col("target_chain").isNull()), ("event target entity does not match its direction", aim != F.col("target_entity_id")), ("event chain does not match its target entity", F.col("chain_id") != F.col("target_chain")),
        ("event source entity occurs twice", twice("source_entity_ids")), ("event source entity and source transaction are not paired", F.size("source_entity_ids") != F.size("source_tx_ids")), ("event source entity is unknown", F.col("giver_unknown")),
        ("event source transaction occurs twice", twice("source_tx_ids")), ("event source transaction is unknown", F.col("tx_unknown")), ("event source transaction is not before it", F.col("latest_tx") >= F.col("event_id")), ("event source transaction is in the future", F.col("latest_step") > F.col("step")),
        ("event source transaction has no edge", F.col("no_edge")),
    ])
    sourced = events.where(F.size("source_tx_ids") + F.size("source_entity_ids") > 0).select("event_id", F.get("source_entity_ids", F.lit(0)).alias("entity"), F.get("source_tx_ids", F.lit(0)).alias("tx"))
    last = asof.last_before(sourced, events.select(F.col("target_entity_id").alias("entity"), "event_id"), "entity", "event_id")
    rules.add(22, "event source entity did not receive the source transaction last", last.where("not (tx <=> last)"), "event_id")
    edges = t["edges"].select("txId1", "txId2")
    made = events.where(F.size("source_tx_ids") > 0).select(F.col("source_tx_ids")[0].alias("txId1"), F.col("target_tx_id").alias("txId2"))
    rules.add(23, "edges do not match the events", edges.exceptAll(made).union(made.exceptAll(edges)))
    rules.add(23, "edge is not causal", checks.causality_violations(edges, nodes))
    rules.add(23, "edge occurs twice", checks.duplicates(edges, ["txId1", "txId2"]))
    rules.add(23, "edge is a loop", edges.where("txId1 = txId2"))


def entity_rules(rules: Rules, config: Config, t: dict[str, DataFrame]) -> None:
    """Entities against registries, quotas and the events they take part in."""
    people, events = t["entities"], t["events"]
    kinds = F.create_map(*[F.lit(x) for p in PROFILES.values() for x in (p.profile_id, p.entity_type)])
    on = [CHAINS[c]["chain_id"] for c, enabled in config.chains.items() if enabled]
    rules.add(10, "entity IDs must be contiguous", checks.contiguity(people, "entity_id").where("not ok"))
    rules.add(10, "native entity ID occurs twice", checks.duplicates(people, ["native_entity_id"]))
    roles = F.array_compact(F.concat(F.array("actor_entity_id", "target_entity_id"), "counterparty_entity_ids", "source_entity_ids"))
    bounds = events.select("step", F.explode(roles).alias("entity_id")).groupBy("entity_id").agg(F.min("step").alias("a"), F.max("step").alias("z"))
    rules.rows(11, people.join(bounds, "entity_id", "left"), "entity_id", [
        ("entity profile is unknown", ~F.col("profile_id").isin(*PROFILES)), ("entity profile version does not match", F.col("profile_version") != 1), ("entity type does not match its profile", kinds[F.col("profile_id")] != F.col("entity_type")),
        ("entity chain is unknown", ~F.col("chain_id").isin(*[c["chain_id"] for c in CHAINS.values()])), ("entity chain is not enabled", ~F.col("chain_id").isin(*on)), ("native entity ID is not synthetic", ~F.col("native_entity_id").startswith("synthetic-")),
        ("native entity ID does not match", registry.native_entity_id(config.seed, F.col("entity_id"), F.col("chain_id")) != F.col("native_entity_id")),
        ("entity steps do not match its events", ~(F.col("first_step").eqNullSafe(F.col("a")) & F.col("last_step").eqNullSafe(F.col("z")))),
    ])
    quotas = people.sparkSession.createDataFrame([(p, n, x) for p, (n, x) in config.quotas.items()], "profile_id string, want bigint, txs bigint")
    for rows, column, message in ((people, "want", "entity quota is not met"), (events, "txs", "transaction quota is not met")):
        had = rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
        rules.add(12, message, quotas.join(had, "profile_id", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce(column, F.lit(0))))


def record_rules(rules: Rules, config: Config, t: dict[str, DataFrame], ledger: Ledger, realized: list[dict]) -> None:
    """Every section of records against the same section worked out anew."""
    spark = t["events"].sparkSession
    nodes = ledger.nodes.withColumnRenamed("tx_id", "txId").withColumnRenamed("cls", "class")
    pick = lambda table, key, field: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, getattr(v, field))])[F.col(key)]
    params = {"action_id": F.col("role"), "amount_policy_id": pick(ACTIONS, "role", "amount_policy"), "profile_amount_policy_id": pick(PROFILES, "scheme", "amount_policy"), "channel": pick(ACTIONS, "role", "channel"), "temporal_pattern": F.lit("scheduler")}
    profiles = nodes.select("txId", F.col("scheme").alias("profile_id"), pick(PROFILES, "scheme", "entity_type").alias("entity_type"), pick(PROFILES, "scheme", "class_policy").alias("class_policy"), "entity_ids", "chain_id", *(c.alias(k) for k, c in params.items()))
    told = t["profile_nodes"].select("*", *(F.col("behavior_params")[k].alias(k) for k in params)).drop("behavior_params")
    rules.same(31, "profile nodes", told, profiles, "txId", ["profile_id", "entity_type", "class_policy", "entity_ids", "chain_id", *params])
    rules.add(40, "event instance is not its component", t["events"].join(ledger.nodes.select("event_id", F.col("instance_id").alias("i")), "event_id").where("i <> instance_id"), "event_id")
    rules.add(40, "instance IDs must be contiguous", checks.contiguity(t["instances"], "instance_id").where("not ok"))
    rules.same(41, "instances", t["instances"], ledger.instances, "instance_id", ["profile_id", "entity_ids", "event_ids", "node_ids", "edge_ids", "temporal_window", "chain_path", "profile_ids"])
    found = stored(bundle.retrieval(ledger)).withColumn("pattern_type", F.col("profile_id")).withColumn("articulation_points", F.col("cuts"))
    rules.same(45, "instance ground truth", t["instance_truth"], found, "instance_id", [c for c in t["instance_truth"].columns if c != "instance_id"])
    hops = min(max(config.k_hop_range or (0,)), 1 << 20)
    chosen = found.where("anchored").select("root", F.col("anchor_node_id").alias("anchor"), F.col("max_anchor_distance").alias("max_distance"))
    shells = ledger.forest.shells(chosen, max(hops, 1)).where(F.col("hop") <= hops).select("root", F.struct(F.col("hop").cast("string").alias("k"), F.col("nodes").alias("v")).alias("s"))
    shells = shells.groupBy("root").agg(F.array_sort(F.collect_list("s")).alias("shells"))
    anchors = found.where("anchored").join(shells, "root", "left").withColumn("shells", F.coalesce("shells", F.expr("cast(array() as array<struct<k:string,v:array<bigint>>>)")))
    entries = F.array_sort(F.transform(F.map_entries("k_hop_neighborhoods"), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))))
    rules.same(46, "anchors", t["anchors"].withColumn("shells", entries), anchors, "instance_id", ["anchor_node_id", "anchor_role", "entity_type", "pattern_type", "max_anchor_distance", "shells"])
    rules.same(50, "ground truth", t["truth"], nodes, "txId", ["scheme", "role", "class", "instance_id", "event_id", "entity_ids", "chain_id"])
    attrs = bundle.attributes(ledger).select("edge_id", "amount")
    owner = ledger.nodes.select(F.col("tx_id").alias("txId2"), "instance_id").join(ledger.instances.select("instance_id", F.col("profile_id").alias("pattern_type")), "instance_id")
    edges = ledger.edges.join(attrs, "edge_id").join(owner, "txId2").withColumnRenamed("kind", "edge_kind")
    rules.same(52, "edge ground truth", t["edge_truth"], edges, "edge_id", ["txId1", "txId2", "pattern_type", "instance_id", "role", "amount", "event_id", "chain_id", "edge_kind"], near=("amount",))
    records = bundle.node_records(ledger).withColumnRenamed("tx_id", "txId").withColumn("native_id_is_synthetic", F.lit(True))
    rules.same(55, "chain node records", t["node_records"], records, "txId", ["chain_id", "chain_key", "native_tx_id", "native_entity_id", "native_id_is_synthetic"])
    rules.add(55, "native transaction ID occurs twice", checks.duplicates(t["node_records"], ["native_tx_id"]))
    rules.rows(55, t["node_records"], "txId", [("native transaction ID is no digest", ~F.col("native_tx_id").rlike("^(0x)?[0-9a-f]{64}$")), ("native transaction ID has the prefix of another chain", F.col("native_tx_id").startswith("0x") != (F.col("chain_id") == CHAINS["ethereum"]["chain_id"]))])
    rules.same(56, "chain edge records", t["edge_records"], bundle.edge_records(ledger), "edge_id", [c for c in t["edge_records"].columns if c != "edge_id"], near=("csv_amount",))
    rules.same(57, "bridge records", t["bridge_records"], bundle.bridge_records(ledger), "event_id", ["bridge_id", "edge_id", "source_chain_id", "target_chain_id"])
    said = [(p["phase_id"], kind, v, n, k) for k, p in enumerate(realized) for kind in ("class", "profile", "chain") for v, n in p[f"{kind}_counts"].items()] + [(p["phase_id"], "all", "all", p["node_count"], k) for k, p in enumerate(realized)]
    counts = bundle.drift_counts(ledger)
    counts = counts.union(counts.where("kind = 'class'").groupBy("phase_id").agg(F.sum("n").alias("n")).select("phase_id", F.lit("all"), F.lit("all"), "n")).withColumnRenamed("n", "m")
    drift = spark.createDataFrame(said, "phase_id string, kind string, v string, n bigint, k int").join(counts, ["phase_id", "kind", "v"], "full")
    keep = F.create_map(*[F.lit(x) for p in config.phases for x in (p["phase_id"], float(p["illicit_keep_probability"]))])[F.col("phase_id")]
    novel = F.create_map(*[x for p in config.phases for x in (F.lit(p["phase_id"]), F.array(*map(F.lit, p["novel_profile_ids"])).cast("array<string>"))])[F.col("phase_id")]
    illicit, new = ([p.profile_id for p in PROFILES.values() if p.class_policy == "illicit" and (p.negative_kind == "novel_illicit") == is_new] for is_new in (False, True))
    rules.rows(60, drift, "k", [
        ("realized drift does not match", ~F.col("n").eqNullSafe(F.col("m"))), ("a phase that keeps nothing illicit holds some", (F.col("kind") == "profile") & F.col("v").isin(*illicit) & (keep == 0) & (F.col("m") > 0)),
        ("a novel profile is outside of its phases", (F.col("kind") == "profile") & F.col("v").isin(*new) & ~F.array_contains(novel, F.col("v")) & (F.col("m") > 0))])


def table_rules(spark: SparkSession, config: Config, t: dict[str, DataFrame], realized: list[dict]) -> Rules:
    """All rules over tables: those of the sections, nodes (tx_id, time_step) and edges (edge_id, txId1, txId2)."""
    rules, ledger = Rules(), derived(spark, config, t)
    entity_rules(rules, config, t)
    event_rules(rules, config, t, ledger)
    record_rules(rules, config, t, ledger, realized)
    return rules


def validate_behavior(spark: SparkSession, root: str | Path) -> None:
    """The whole bundle: hashes, tables, features and the behavior block against each other."""
    root = Path(root)
    m, t = sections(spark, root / "manifest.json")
    need(isinstance(m.get("sha256"), dict) and set(m["sha256"]) == set(FILES), "manifest must hash the four CSV files")
    for name, file in FILES.items():
        need(m["sha256"][name] == sha256(root / file), f"CSV hash mismatch: {name}")
    files = validate_tables(spark, root)
    config = manifest_rules(m)
    t = {name: x.cache() for name, x in t.items()}
    t["nodes"] = files["features"].select(F.col("txId").alias("tx_id"), "time_step")
    t["edges"] = files["edgelist"].select(F.col("__row").alias("edge_id"), "txId1", "txId2")
    rules = table_rules(spark, config, t, m["behavior"]["drift_schedule"]["realized"])
    label = F.when(F.col("g.class") == "illicit", "1").when(F.col("g.class") == "licit", "2").otherwise("unknown")
    rules.add(51, "class file does not match the ground truth", t["truth"].alias("g").join(files["classes"].alias("c"), "txId").where(label != F.col("c.class")), "txId")
    again = bundle.attributes(Ledger(config, None, None, t["nodes"], t["edges"].join(t["events"].select(F.col("event_id").alias("txId2"), "amount_minor"), "txId2"), None, None))
    own = files["edge_attributes"].withColumnRenamed("__row", "edge_id")
    rules.same(53, "edge attributes", own, again, "edge_id", ["txId1", "txId2", "amount", "timestamp"], near=("amount",))
    try:
        rules.raise_first()
    except PySparkException as x:
        raise Invalid(f"manifest record can't be read: {str(x).splitlines()[0]}") from x
    validate_features(spark, files, t["truth"].select(F.col("txId").alias("tx_id"), bundle.chain_number(F.col("chain_id")).alias("chain")))
    for df in (*files.values(), *t.values()):
        df.unpersist()
