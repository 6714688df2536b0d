"""The bundle of a ledger: four CSV files and a manifest, written and read."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..operators.schedule import with_phase
from ..sources import single_file
from ..sources.rows import with_rows
from ..sources.single_file import write_csv
from ..storage import stored
from . import registry
from .config import Config
from .generate import Ledger
from .registry import ACTIONS, CHAINS, PROFILES

# Names of the files and their columns.
FILES = {"features": "elliptic_txs_features.csv", "classes": "elliptic_txs_classes.csv", "edgelist": "elliptic_txs_edgelist.csv", "edge_attributes": "elliptic_txs_edge_attributes.csv"}
FEATURES = 165
SCHEMAS = {
    "features": "txId bigint, time_step int, " + ", ".join(f"feat_{k} double" for k in range(2, FEATURES + 2)), "classes": "txId bigint, class string", "edgelist": "txId1 bigint, txId2 bigint", "edge_attributes": "txId1 bigint, txId2 bigint, amount double, timestamp bigint",
}


# Fixed values of the contract: the constant sections of a manifest. The draws are this engine's own.
SANCTIONS = {"schema_version": "1.0.0", "status": "provenance_only", "real_address_payload_loaded": False, "records": []}
CALIBRATION = {"schema_version": "1.0.0", "status": "not_evaluated", "positive_class": "1", "negative_class": "2", "unknown_policy": "exclude", "score_semantics": "uncalibrated_model_score"}
RNG_CONTRACT = {"generator": "counter-based md5", "namespaces": ["behavior:population", "behavior:schedule", "behavior:transition", "behavior:amount", "behavior:drift"]}
FEATURE_SEMANTICS = {"mode": "semantic", "column_layout": {str(k): n for k, n in enumerate(features.BASE)}, "chain_column_layout": {str(k + 24): n for k, n in enumerate(features.CHAIN)}}


def retrieval_specs(config: Config) -> dict:
    """How vectors and neighbourhoods are found; its keys are of the contract."""
    return {
        "node_vector_dim": 2 + FEATURES, "vectors_file": FILES["features"], "node_id_column": "txId", "node_vector_lookup": "row = first headerless column value, txId == node id", "anchor_key": "anchor_node_id", "entity_type_key": "entity_type",
        "neighborhood_field": "k_hop_neighborhoods", "default_k": min(max(config.k_hop_range or (0,)), 1 << 20), "feature_mode": "semantic"}


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def attributes(ledger: Ledger) -> DataFrame:
    """edge_id, txId1, txId2, amount, timestamp."""
    step = ledger.nodes.select("tx_id", "time_step")
    e = ledger.edges.join(step.select(F.col("tx_id").alias("txId1"), F.col("time_step").alias("s1")), "txId1").join(step.select(F.col("tx_id").alias("txId2"), F.col("time_step").alias("s2")), "txId2")
    return e.select("edge_id", "txId1", "txId2", F.round(F.col("amount_minor") / 100, 2).alias("amount"), (ledger.config.timestamp_scale * (F.greatest("s1", "s2") - 1)).cast("bigint").alias("timestamp"))


def chain_number(column):
    """0, 1, 2 in order of the chain registry."""
    out = F.lit(None)
    for k, c in enumerate(CHAINS.values()):
        out = F.when(column == c["chain_id"], k).otherwise(out)
    return out


def matrix(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """txId, time_step and the 165 feature columns; nodes: (tx_id, time_step, chain) with chain 0..2."""
    base = features.semantic(nodes, attrs)
    rows = base.join(features.derived(base), "tx_id").join(nodes.select("tx_id", F.col("time_step").alias("__step")), "tx_id")
    columns = [*features.BASE, *features.CHAIN, *(F.col("derived")[k] for k in range(len(features.CHAIN), features.DERIVED))]
    return rows.select(F.col("tx_id").alias("txId"), F.col("__step").alias("time_step"), *((F.col(c) if isinstance(c, str) else c).alias(f"feat_{k + 2}") for k, c in enumerate(columns)))


def retrieval(ledger: Ledger) -> DataFrame:
    """Instances with anchor, its role and eccentricity, articulation points, holdout and whether they are anchored."""
    c, nodes = ledger.config, ledger.nodes
    roots = ledger.forest.instances().where("node = root").select("root", "instance_id")
    anchors = ledger.forest.anchors(c.prefer_central_anchors).join(roots, "root").select("instance_id", "root", F.col("anchor").alias("anchor_node_id"), F.col("max_distance").alias("max_anchor_distance"))
    cut = ledger.forest.articulation_points().select(F.col("node").alias("tx_id")).join(nodes.select("tx_id", "instance_id"), "tx_id").groupBy("instance_id").agg(F.array_sort(F.collect_list("tx_id")).alias("articulation_points"))
    kinds = F.create_map(*[F.lit(x) for p in PROFILES.values() for x in (p.profile_id, p.entity_type)])
    limit = max(c.per_1000_nodes * c.n_txs // 1000, 1)  # anchors in different trees are never close to each other
    out = ledger.instances.join(anchors, "instance_id").join(cut, "instance_id", "left").join(nodes.select(F.col("tx_id").alias("anchor_node_id"), F.col("role").alias("anchor_role")), "anchor_node_id")
    hold = F.lit(None)
    for e in reversed(c.holdout):
        hold = F.when((F.col("profile_id") == e["pattern"]) & (F.col("temporal_window")[0] <= e["step_max"]) & (F.col("temporal_window")[1] >= e["step_min"]), F.lit(e["train_excluded"])).otherwise(hold)
    none = F.expr("cast(array() as array<bigint>)")
    return out.select("*", kinds[F.col("profile_id")].alias("entity_type"), F.coalesce("articulation_points", none).alias("cuts"), hold.isNotNull().alias("holdout"), F.coalesce(hold, F.lit(False)).alias("train_excluded"), (F.col("instance_id") < limit).alias("anchored"))


@dataclass
class Rows:
    """A list of a JSON file whose records are the rows of a table in order of a column, which is left out if it begins with an underscore."""

    table: DataFrame
    order: str


def pieces(value: Any) -> list[str | single_file.Body]:
    """JSON of nested mappings whose leaves may be Rows, as texts and bodies in turn; what is not finite is refused."""
    if isinstance(value, dict):
        out: list = []
        for k, (name, x) in enumerate(value.items()):
            out += [("," if k else "{") + json.dumps(name, ensure_ascii=False) + ":", *pieces(x)]
        return [*out, "}" if value else "{}"]
    if isinstance(value, Rows):
        body = single_file.json_rows(value.table, [value.order])
        return [body, "]"] if body.size else ["[]"]
    return [json.dumps(value, ensure_ascii=False, allow_nan=False)]


def write(ledger: Ledger, out_dir: str | Path) -> None:
    """The bundle. Its files are single by contract; tasks write the rows of each, every one its own range of bytes."""
    out, c = Path(out_dir), ledger.config
    if "data/raw" in out.resolve().as_posix():
        raise ValueError("refusing to generate inside data/raw")
    out.mkdir(parents=True, exist_ok=True)
    nodes, attrs = ledger.nodes, attributes(ledger)
    labels = F.when(F.col("cls") == "illicit", "1").when(F.col("cls") == "licit", "2").otherwise("unknown")
    numbered = nodes.select("tx_id", "time_step", chain_number(F.col("chain_id")).alias("chain"))
    write_csv(matrix(numbered, attrs), out / FILES["features"], ["txId"], header=False)
    write_csv(nodes.select(F.col("tx_id").alias("txId"), labels.alias("class")), out / FILES["classes"], ["txId"])
    by_id = attrs.withColumnRenamed("edge_id", "_edge_id")
    write_csv(by_id.select("_edge_id", "txId1", "txId2"), out / FILES["edgelist"], ["_edge_id"])
    write_csv(by_id, out / FILES["edge_attributes"], ["_edge_id"])
    single_file.write_pieces(out / "manifest.json", pieces(manifest(ledger, attrs, {k: sha256(out / f) for k, f in FILES.items()})))


def manifest(ledger: Ledger, attrs: DataFrame, digests: dict[str, str]) -> dict:
    """The sections of the manifest; those of records are tables."""
    c, nodes, edges = ledger.config, ledger.nodes, ledger.edges
    shown = stored(retrieval(ledger))
    hops = min(max(c.k_hop_range or (0,)), 1 << 20)
    named = shown.withColumn("pattern_type", F.col("profile_id")).withColumn("articulation_points", F.col("cuts"))
    anchored = named.where("anchored")
    shells = ledger.forest.shells(anchored.select("root", F.col("anchor_node_id").alias("anchor"), F.col("max_anchor_distance").alias("max_distance")), max(hops, 1)).where(F.col("hop") <= hops)
    near = shells.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("hop").cast("string").alias("k"), F.col("nodes").alias("v"))))).alias("k_hop_neighborhoods"))
    anchors = anchored.join(near, "root", "left").withColumn("k_hop_neighborhoods", F.coalesce("k_hop_neighborhoods", F.expr("cast(map() as map<string,array<bigint>>)")))
    truth = edges.join(nodes.select(F.col("tx_id").alias("txId2"), "instance_id"), "txId2").join(attrs.select("edge_id", "amount"), "edge_id").join(ledger.instances.select("instance_id", F.col("profile_id").alias("pattern_type")), "instance_id")
    truth = truth.select("edge_id", "txId1", "txId2", "pattern_type", "instance_id", "role", "amount", "event_id", "chain_id", F.col("kind").alias("edge_kind"), F.struct("instance_id", "edge_id").alias("_order"))
    entry = ["instance_id", "pattern_type", "anchor_node_id", "anchor_role", "entity_type", "max_anchor_distance", "temporal_window", "node_ids", "edge_ids", "articulation_points", "anchored", "holdout", "train_excluded", "profile_id", "profile_ids", "entity_ids", "event_ids", "chain_path"]
    return {
        "seed": c.seed, "config": c.as_dict(), "sha256": digests,
        "ground_truth": Rows(nodes.select(F.col("tx_id").alias("txId"), "scheme", "role", F.col("cls").alias("class"), "instance_id", "event_id", "entity_ids", "chain_id"), "txId"), "instance_ground_truth": Rows(named.select(*entry), "instance_id"),
        "edge_attribute_ground_truth": Rows(truth, "_order"),
        "anchor_registry": {"per_1000_nodes": c.per_1000_nodes, "min_anchor_distance": c.min_anchor_distance, "anchors": Rows(anchors.select("instance_id", "anchor_node_id", "anchor_role", "entity_type", "pattern_type", "max_anchor_distance", "k_hop_neighborhoods"), "instance_id")},
        "retrieval_specs": retrieval_specs(c), "feature_semantics": FEATURE_SEMANTICS, "decoys": [], "holdout": {"windows_active": bool(c.holdout), "entries": c.holdout}, "behavior": behavior(ledger),
    }


def node_records(ledger: Ledger) -> DataFrame:
    """Nodes with chain_key, native_tx_id and native_entity_id, that of the first participant on the node's chain."""
    keys = F.create_map(*[F.lit(x) for k, v in CHAINS.items() for x in (v["chain_id"], k)])
    people = ledger.entities.select(F.col("entity_id").alias("e"), F.col("chain_id").alias("ec"), "native_entity_id")
    native = ledger.nodes.select("tx_id", "chain_id", F.explode("entity_ids").alias("e")).join(people, "e").where("ec = chain_id").groupBy("tx_id").agg(F.min_by("native_entity_id", "e").alias("native_entity_id"))
    return ledger.nodes.join(native, "tx_id", "left").withColumn("chain_key", keys[F.col("chain_id")]).withColumn("native_tx_id", registry.native_tx_id(ledger.config.seed, F.col("tx_id"), F.col("chain_id")))


def edge_records(ledger: Ledger) -> DataFrame:
    """Edges with the chains of both ends."""
    ends = ledger.nodes.select(F.col("tx_id").alias("txId1"), F.col("chain_id").alias("source_chain_id"))
    return ledger.edges.join(ends, "txId1").select(
        "edge_id", "event_id", "txId1", "txId2", "source_chain_id", F.col("chain_id").alias("target_chain_id"), "kind", "role", (F.col("amount_minor") / 100).alias("csv_amount"), "timestamp", F.lit(None).cast("bigint").alias("native_amount_minor"), "bridge_id")


def bridge_records(ledger: Ledger) -> DataFrame:
    """Bridge events with their edge, if they have one, and the chains of actor and target."""
    people = ledger.entities.select(F.col("entity_id").alias("actor_entity_id"), F.col("chain_id").alias("source_chain_id"))
    found = ledger.events.where("bridge_id is not null").join(ledger.edges.select("event_id", "edge_id"), "event_id", "left").join(people, "actor_entity_id")
    return found.select("bridge_id", "event_id", "edge_id", "source_chain_id", F.col("chain_id").alias("target_chain_id"))


def drift_counts(ledger: Ledger) -> DataFrame:
    """(phase_id, kind, v, n): nodes of each phase by class, profile and chain, zeros too."""
    c = ledger.config
    kinds = [("class", "cls", ("illicit", "licit", "unknown")), ("profile", "scheme", sorted(c.quotas)), ("chain", "chain_id", sorted(x["chain_id"] for x in CHAINS.values()))]
    keys = ledger.nodes.sparkSession.createDataFrame([(p["phase_id"], kind, v) for p in c.phases for kind, _, values in kinds for v in values], "phase_id string, kind string, v string")
    phased = with_phase(ledger.nodes.withColumnRenamed("time_step", "step"), c.phases)
    seen = phased.select("phase_id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("v")) for kind, column, _ in kinds])).alias("x")).groupBy("phase_id", "x.kind", "x.v").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(seen, ["phase_id", "kind", "v"], "left").fillna(0)


def behavior(ledger: Ledger) -> dict:
    """The behavior block: profiles, tables, realized drift, chain metadata and the constant sections."""
    c = ledger.config
    counts = {(r["phase_id"], r["kind"], r["v"]): r["n"] for r in drift_counts(ledger).collect()}  # phases by classes, profiles and chains
    histogram = lambda phase, kind: {v: counts[phase, kind, v] for v in sorted(v for p, k, v in counts if (p, k) == (phase, kind))}
    realized = [{"phase_id": p["phase_id"], "step_min": p["step_min"], "step_max": p["step_max"], "node_count": sum(histogram(p["phase_id"], "class").values()), **{f"{kind}_counts": histogram(p["phase_id"], kind) for kind in ("class", "profile", "chain")}} for p in c.phases]
    pick = lambda table, key, field: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, getattr(v, field))])[F.col(key)]
    params = F.struct(F.col("role").alias("action_id"), pick(ACTIONS, "role", "amount_policy").alias("amount_policy_id"), pick(PROFILES, "scheme", "amount_policy").alias("profile_amount_policy_id"), pick(ACTIONS, "role", "channel").alias("channel"), F.lit("scheduler").alias("temporal_pattern"))
    profiles = ledger.nodes.select(F.col("tx_id").alias("txId"), F.col("scheme").alias("profile_id"), pick(PROFILES, "scheme", "entity_type").alias("entity_type"), pick(PROFILES, "scheme", "class_policy").alias("class_policy"), params.alias("behavior_params"), "entity_ids", "chain_id")
    records = node_records(ledger).select(F.col("tx_id").alias("txId"), "chain_id", "chain_key", "native_tx_id", "native_entity_id", F.lit(True).alias("native_id_is_synthetic"))
    return {
        "contract_version": "behavior.p0.v1", "behavioral_profiles": {"registry_version": 1, "registry_sha256": registry.digest(), "nodes": Rows(profiles, "txId")},
        "entities": Rows(ledger.entities, "entity_id"), "events": Rows(ledger.events, "event_id"), "instances": Rows(ledger.instances, "instance_id"),
        "drift_schedule": {"schema_version": "1.0.0", "configured": {"phases": c.phases}, "realized": realized},
        "chain_metadata": {"schema_version": "1.0.0", "identity_scope": "synthetic", "chains": [{"chain_key": k, **v} for k, v in CHAINS.items()], "node_records": Rows(records, "txId"), "edge_records": Rows(edge_records(ledger), "edge_id"), "bridge_records": Rows(bridge_records(ledger), "event_id")},
        "sanctions_anchor_map": SANCTIONS, "calibration": CALIBRATION, "rng_contract": RNG_CONTRACT,
    }


def volume(spark: SparkSession, stats_dir: str | Path) -> DataFrame:
    """(step, weight) of volume.npy: 49 integers, none negative."""
    import numpy as np

    path = Path(stats_dir) / "volume.npy"
    if not path.is_file():
        raise ValueError(f"missing volume profile: {path}")
    x = np.load(path, allow_pickle=False)
    if x.shape != (49,) or x.dtype.kind not in "iu" or (x < 0).any():
        raise ValueError("volume must be 49 non-negative integers")
    return spark.createDataFrame([(k + 1, int(w)) for k, w in enumerate(x)], "step int, weight bigint")


def read_json(path: str | Path) -> dict:
    """A JSON object without NaN or infinities."""

    def refuse(value):
        raise ValueError(f"JSON constant is not allowed: {value}")

    out = json.loads(Path(path).read_text(encoding="utf-8"), parse_constant=refuse)
    if not isinstance(out, dict):
        raise ValueError("manifest must be an object")
    return out


def read_table(spark: SparkSession, root: str | Path, name: str) -> DataFrame:
    """One CSV of a bundle, strictly by its schema; rows carry their number in the file as __row."""
    options = {"header": name != "features", "mode": "FAILFAST", "enforceSchema": name == "features"}
    return with_rows(spark.read.schema(SCHEMAS[name]).csv(f"{root}/{FILES[name]}", **options))


def write_report(path: str | Path, report: dict, forbidden: str | Path | None = None) -> None:
    """Replace a JSON report in one step; never below the forbidden folder."""
    path = Path(path).resolve()
    if forbidden is not None and path.is_relative_to(Path(forbidden).resolve()):
        raise ValueError("report path is inside the raw directory")
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=".report-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(report, f, indent=2, ensure_ascii=False, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
