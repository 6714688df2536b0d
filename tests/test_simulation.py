"""A small ledger from configuration to report."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from causeway.simulation import bundle, config, registry, validate
from causeway.simulation.generate import generate

QUOTAS = {"ordinary_wallet": (4, 300), "exchange_hub": (2, 150), "miner_payout": (2, 100), "wallet_provider": (2, 100), "individual": (4, 200), "mixer": (2, 100), "wash_round_trip": (2, 50)}


@pytest.fixture(scope="module")
def ledger(spark):
    volume = spark.range(1, 50).select(F.col("id").cast("int").alias("step"), F.lit(100).alias("weight"))
    return generate(spark, config.Config(n_txs=1000, quotas=QUOTAS), volume)


@pytest.fixture(scope="module")
def root(ledger, tmp_path_factory):
    out = tmp_path_factory.mktemp("bundle")
    bundle.write(ledger, out)
    return out


def test_ledger(ledger):
    assert ledger.nodes.count() == 1000 and ledger.entities.count() == 18
    assert {r["scheme"]: r["count"] for r in ledger.nodes.groupBy("scheme").count().collect()} == {p: t for p, (_, t) in QUOTAS.items()}
    assert ledger.edges.where("txId1 >= txId2").count() == 0 and ledger.edges.where("kind = 'bridge_link'").count() > 0
    assert ledger.edges.where("(kind = 'bridge_link') <> (bridge_id is not null)").count() == 0
    illicit = ledger.nodes.where("cls = 'illicit'")
    assert illicit.where("scheme = 'mixer' and time_step >= 40").count() == 0 and illicit.where("scheme = 'wash_round_trip' and time_step < 45").count() == 0


def test_bundle_is_valid_and_tampering_is_found(spark, root, tmp_path):
    validate.validate_behavior(spark, root)

    def tampered(change):
        copy = tmp_path / str(len(list(tmp_path.iterdir())))
        shutil.copytree(root, copy)
        m = json.loads((copy / "manifest.json").read_text())
        change(m, copy)
        (copy / "manifest.json").write_text(json.dumps(m))
        with pytest.raises(ValueError) as caught:
            validate.validate_behavior(spark, copy)
        return str(caught.value)

    def source(m, _):
        e = next(e for e in m["behavior"]["events"] if e["source_tx_ids"])
        e["source_entity_ids"][0] = (e["source_entity_ids"][0] + 1) % 18

    def bridge(m, _):
        next(e for e in m["behavior"]["events"] if e["bridge_id"])["bridge_id"] = None

    def classes(m, copy):
        path = copy / bundle.FILES["classes"]
        path.write_text(path.read_text().replace(",1\n", ",2\n", 1))

    assert "source entity" in tampered(source)
    assert "bridge event ID" in tampered(bridge)
    assert "hash mismatch" in tampered(classes)


#: A change of a manifest and what must be said of it. Each takes records of its own, so that one run finds all.
TAMPERS = {
    "event source entity did not receive the source transaction last": lambda m: next(e for e in m["behavior"]["events"] if e["source_tx_ids"])["source_entity_ids"].__setitem__(0, 17),
    "bridge event ID does not match its chains": lambda m: next(e for e in m["behavior"]["events"] if e["bridge_id"]).update(bridge_id="x"),
    "event amount is outside its policy": lambda m: m["behavior"]["events"][900].update(amount_minor=-5), "event step does not match its transaction": lambda m: m["behavior"]["events"][901].update(step=49), "event action is unknown": lambda m: m["behavior"]["events"][902].update(action_id="steal"),
    "event actor is unknown": lambda m: m["behavior"]["events"][903].update(actor_entity_id=99), "event has no counterparty": lambda m: m["behavior"]["events"][904].update(counterparty_entity_ids=[]),
    "event counterparty occurs twice": lambda m: m["behavior"]["events"][905].update(counterparty_entity_ids=m["behavior"]["events"][905]["counterparty_entity_ids"] * 2), "event counterparty is unknown": lambda m: m["behavior"]["events"][906].update(counterparty_entity_ids=[55]),
    "event target entity is unknown": lambda m: m["behavior"]["events"][907].update(target_entity_id=77), "event source transaction is not before it": lambda m: m["behavior"]["events"][908].update(source_tx_ids=[908], source_entity_ids=[1]),
    "event source entity and source transaction are not paired": lambda m: m["behavior"]["events"][909].update(source_entity_ids=[]), "event profile does not match its actor": lambda m: m["behavior"]["events"][910].update(profile_id="nobody"),
    "event instance is not its component": lambda m: m["behavior"]["events"][911].update(instance_id=4_000), "event target transaction occurs twice": lambda m: m["behavior"]["events"][912].update(target_tx_id=913),
    "entity type does not match its profile": lambda m: m["behavior"]["entities"][0].update(entity_type="x"), "native entity ID does not match": lambda m: m["behavior"]["entities"][1].update(native_entity_id="synthetic-0"), "entity chain is unknown": lambda m: m["behavior"]["entities"][2].update(chain_id="x"),
    "entity steps do not match its events": lambda m: m["behavior"]["entities"][3].update(first_step=48), "entity profile version does not match": lambda m: m["behavior"]["entities"][4].update(profile_version=2),
    "profile nodes: channel does not match": lambda m: m["behavior"]["behavioral_profiles"]["nodes"][5]["behavior_params"].update(channel="x"), "profile nodes: class_policy does not match": lambda m: m["behavior"]["behavioral_profiles"]["nodes"][6].update(class_policy="x"),
    "profile nodes occur twice": lambda m: m["behavior"]["behavioral_profiles"]["nodes"].append(m["behavior"]["behavioral_profiles"]["nodes"][7]),
    "instances: chain_path does not match": lambda m: m["behavior"]["instances"][0].update(chain_path=[]), "instances: temporal_window does not match": lambda m: m["behavior"]["instances"][0].update(temporal_window=[2, 2]),
    "instance ground truth: anchor_node_id does not match": lambda m: m["instance_ground_truth"][0].update(anchor_node_id=1), "instance ground truth: holdout does not match": lambda m: m["instance_ground_truth"][0].update(holdout=True),
    "instance ground truth: articulation_points does not match": lambda m: m["instance_ground_truth"][0].update(articulation_points=[0]), "anchors: shells does not match": lambda m: m["anchor_registry"]["anchors"][0]["k_hop_neighborhoods"].update({"1": [5]}),
    "anchors do not cover their source": lambda m: m["anchor_registry"]["anchors"].pop(), "ground truth: class does not match": lambda m: m["ground_truth"][20].update({"class": "unknown"}), "ground truth: entity_ids does not match": lambda m: m["ground_truth"][21].update(entity_ids=[]),
    "ground truth do not cover their source": lambda m: m["ground_truth"].pop(), "edge ground truth: amount does not match": lambda m: m["edge_attribute_ground_truth"][0].update(amount=1e9), "edge ground truth: role does not match": lambda m: m["edge_attribute_ground_truth"][1].update(role="x"),
    "chain node records: native_tx_id does not match": lambda m: m["behavior"]["chain_metadata"]["node_records"][0].update(native_tx_id="ab"), "native transaction ID is no digest": lambda m: None,
    "chain node records: native_id_is_synthetic does not match": lambda m: m["behavior"]["chain_metadata"]["node_records"][1].update(native_id_is_synthetic=False), "chain edge records: native_amount_minor does not match": lambda m: m["behavior"]["chain_metadata"]["edge_records"][0].update(native_amount_minor=4),
    "chain edge records: target_chain_id does not match": lambda m: m["behavior"]["chain_metadata"]["edge_records"][1].update(target_chain_id="x"), "bridge records do not cover their source": lambda m: m["behavior"]["chain_metadata"]["bridge_records"].pop(),
    "bridge records occur twice": lambda m: m["behavior"]["chain_metadata"]["bridge_records"].append(m["behavior"]["chain_metadata"]["bridge_records"][0]), "realized drift does not match": lambda m: m["behavior"]["drift_schedule"]["realized"][0]["class_counts"].update(licit=1),
}


def test_every_kind_of_tampering_is_found(spark, root, tmp_path):
    m = json.loads((root / "manifest.json").read_text())
    for change in TAMPERS.values():
        change(m)
    files = {n: bundle.read_table(spark, root, n) for n in ("features", "edgelist")}
    (tmp_path / "m.json").write_text(json.dumps(m))
    t = validate.sections(spark, tmp_path / "m.json", 1 << 16)[1]
    t |= {"nodes": files["features"].select(F.col("txId").alias("tx_id"), "time_step"), "edges": files["edgelist"].select(F.col("__row").alias("edge_id"), "txId1", "txId2")}
    faults = validate.table_rules(spark, config.parse(m["config"]), t, m["behavior"]["drift_schedule"]["realized"]).faults()
    found = {r["message"] for r in faults.select("message").distinct().collect()}
    assert set(TAMPERS) <= found, sorted(set(TAMPERS) - found)


@pytest.mark.parametrize(
    ("message", "change"),
    [
        ("registry digest", lambda m: m["behavior"]["behavioral_profiles"].update(registry_sha256="0")), ("seed", lambda m: m.update(seed=1)), ("drift schedule", lambda m: m["behavior"]["drift_schedule"]["configured"]["phases"].pop()),
        ("phase bounds", lambda m: m["behavior"]["drift_schedule"]["realized"][0].update(step_max=3)), ("chain registry", lambda m: m["behavior"]["chain_metadata"]["chains"].pop()), ("sanctions", lambda m: m["behavior"]["sanctions_anchor_map"].update(records=[1])),
        ("calibration", lambda m: m["behavior"]["calibration"].update(status="x")), ("contract version", lambda m: m["behavior"].update(contract_version="x")), ("not whole", lambda m: m["config"].pop("holdout")), ("invalid", lambda m: m["config"].update(n_txs=True)),
        ("section is missing", lambda m: m.pop("decoys")), ("decoys", lambda m: m.update(decoys=[1])), ("feature layout", lambda m: m["feature_semantics"].update(mode="x")), ("retrieval", lambda m: m["retrieval_specs"].update(default_k=9)), ("draws", lambda m: m["behavior"]["rng_contract"].update(generator="x")),
    ],
)
def test_manifest_sections(root, message, change):
    m = json.loads((root / "manifest.json").read_text())
    validate.manifest_rules(m)
    change(m)
    with pytest.raises(validate.Invalid, match=message):
        validate.manifest_rules(m)


def test_config_refuses():
    assert config.parse({"seed": 72, "n_txs": 10000}).quotas == config.QUOTAS
    for raw, message in [
        ({"features": {"mode": "cdf"}}, "semantic only"), ({"graph": {"mode": "legacy"}}, "behavior only"), ({"schemes": {}}, "unknown top-level"), ({"n_txs": 5}, "sum to n_txs"), ({"gnn": {"hidden": 3}}, "even"), ({"gnn": {"layers": 4}}, "layers"), ({"gnn": {"dropout": 1.0}}, "rates"), ({"n_txs": True}, "integer"), ({"gnn": {"backend": "x"}}, "backend"),
        ({"behavior": {"drift": {"phases": [dict(p) if k != 1 else p | {"step_min": 39} for k, p in enumerate(config.PHASES)]}}}, "contiguous"), ({"behavior": {"profile_quotas": {"mixer": {"entity_count": 0, "tx_quota": 1}}}}, "at least"),
    ]:
        with pytest.raises(ValueError, match=message):
            config.parse(raw)


def test_yaml_keys_are_unique(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 1\nseed: 2\n")
    with pytest.raises(ValueError, match="duplicate"):
        config.load(tmp_path / "c.yaml")


def test_registry():
    registry.check_registry()
    assert len(registry.ACTIONS) == 9 and len(registry.PROFILES) == 7 and len(registry.digest()) == 64
    with pytest.raises(ValueError, match="unknown"):
        registry.lookup("chain", "nowhere")


def test_registry_faults(monkeypatch):
    """Every rule over the registries, each broken once."""
    from dataclasses import replace

    assert registry.registry_faults() == []
    mixer = registry.PROFILES["mixer"]
    monkeypatch.setitem(registry.PROFILES, "mixer", replace(mixer, chain_weights=(("bitcoin", 0.0), ("mars", 1.0)), counterparty_profile_ids=("nobody",), action_ids=(*mixer.action_ids, "fly", "round_trip"), amount_policy="x"))
    found = registry.registry_faults()
    assert {rule for rule, _ in found} == {
        "actions that are not registered", "profiles that are not registered", "chains that are not registered", "amount policies that are not registered", "actions that do not list their profile",
        "counterparties of an action that its profile does not meet", "weights of chains that are not above zero"}
    assert ("actions that do not list their profile", ("mixer", "round_trip")) in found and ("weights of chains that are not above zero", ("mixer", "bitcoin")) in found
    with pytest.raises(ValueError, match="fly"):
        registry.check_registry()


def test_json_and_report(tmp_path):
    (tmp_path / "m.json").write_text('{"a": NaN}')
    with pytest.raises(ValueError, match="constant"):
        bundle.read_json(tmp_path / "m.json")
    bundle.write_report(tmp_path / "r" / "x.json", {"a": None})
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"a": None}
    with pytest.raises(ValueError, match="raw"):
        bundle.write_report(tmp_path / "raw" / "x.json", {}, tmp_path / "raw")


def test_protocol(spark, root, monkeypatch):
    from causeway.models import training
    from causeway.plans import protocol

    settings = training.Settings(hidden=4, epochs=2, patience=2)
    report = protocol.run(spark, [root], root, [0], k=10, settings=settings)
    assert report["status"] == "completed" and report["model_roster"] == ["rf", "sgc_proxy", "pyg_sage", "pyg_gat", "pyg_gin"] and report["unavailable_models"] == []
    for arm in report["per_seed"][0]["transfer_to_real"].values():
        assert [s["time_step"] for s in arm["test"]["per_timestep"]] == list(range(41, 50)) and [s["time_step"] for s in arm["validation"]["per_timestep"]] == list(range(31, 41))
    assert set(report["per_seed"][0]["edge_shuffle"]["full_models"]) == {"pyg_sage", "pyg_gat", "pyg_gin"} and report["per_seed"][0]["edge_shuffle"]["train"]["seed"] == protocol.shuffle_seed(0)
    assert report["protocol_gates"]["full_roster_executed"] and not report["protocol_gates"]["frozen_hyperparameters"] and report["acceptance"] == {"status": "diagnostic", "target": "primary_macro_test_f1 > 0.5", "target_met": None}
    assert report["split_contract"]["cross_partition_message_edges"] == 0 and report["aggregate"]["pyg_sage"]["n"] == 1

    def broken():
        raise RuntimeError("no")

    monkeypatch.setattr(protocol, "probe", broken)
    assert protocol.backend("auto")["resolved"] == "sgc_proxy" and not protocol.backend("sgc")["is_full_gnn"]
    with pytest.raises(protocol.Blocked, match="RuntimeError"):
        protocol.backend("full")


@pytest.mark.parametrize(("seeds", "tier", "code"), [([], "smoke", "EMPTY_SEED_ROSTER"), ([1, 1], "smoke", "DUPLICATE_SEED"), ([True], "smoke", "SEED_VALUE"), ([-1], "smoke", "SEED_VALUE"), ([0], "real", "N_GATE"), ([0], "x", "TIER_VALUE")])
def test_seed_plan(seeds, tier, code):
    from causeway.plans import protocol

    with pytest.raises(ValueError, match=code):
        protocol.seed_plan(seeds, tier)


def test_default_configuration_has_the_pinned_fingerprint():
    from causeway.plans import protocol

    assert protocol._digest(config.Config().as_dict()) == protocol.CONFIG_SHA256


def test_validate_real(spark, root, tmp_path):
    """The whole command on a small configuration, and the statuses of its faults."""
    import numpy as np

    from causeway import cli

    stats = tmp_path / "volume"
    stats.mkdir()
    np.save(stats / "volume.npy", np.full(49, 100))
    quotas = "".join(f"    {p}: {{entity_count: {e}, tx_quota: {t}}}\n" for p, (e, t) in QUOTAS.items())
    (tmp_path / "c.yaml").write_text(f"seed: 72\nn_txs: 1000\nstats_dir: {stats}\nbehavior:\n  profile_quotas:\n{quotas}gnn: {{hidden: 4, epochs: 1, patience: 1, k: 10}}\n")
    base = ["validate-real", "--config", str(tmp_path / "c.yaml"), "--raw-dir", str(root)]
    out = tmp_path / "r.json"
    assert cli.main([*base, "--out", str(out), "--seeds", "3", "--sage-only", "--backend", "full"]) == 0
    report = json.loads(out.read_text())
    assert report["status"] == "completed" and report["report_written"] and report["model_roster"] == ["rf", "sgc_proxy", "pyg_sage"] and set(report["synthetic_fingerprints"]) == {"3"} and report["config_sources"]["seeds"] == "cli"
    assert cli.main([*base, "--out", str(root / "r.json"), "--seeds", "3"]) == 4 and not (root / "r.json").exists()
    assert cli.main([*base, "--out", str(out), "--tier", "real"]) == 4 and json.loads(out.read_text())["error"]["code"] == "RAW_ACCEPTANCE_CONTRACT"
    assert cli.main([*base, "--out", str(out), "--seeds", "x"]) == 4
