"""Strict configuration of the generator."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from ..models.training import Settings
from .registry import CHAINS, PROFILES, check_registry

STEPS = 49
#: The default quotas (entities, transactions) and phases.
QUOTAS = {"ordinary_wallet": (120, 4000), "exchange_hub": (12, 1200), "miner_payout": (20, 800), "wallet_provider": (30, 1000), "individual": (180, 1800), "mixer": (8, 600), "wash_round_trip": (6, 600)}
PHASES = [
    {"phase_id": "stable", "step_min": 1, "step_max": 39, "illicit_keep_probability": 1.0, "novel_profile_ids": []},
    {"phase_id": "shutdown", "step_min": 40, "step_max": 44, "illicit_keep_probability": 0.0, "novel_profile_ids": []},
    {"phase_id": "novel", "step_min": 45, "step_max": 49, "illicit_keep_probability": 0.0, "novel_profile_ids": ["wash_round_trip"]},
]


class DriftError(ValueError):
    """A schedule or quota that can't be met."""


def _need(ok: bool, message: str, kind: type = ValueError) -> None:
    if not ok:
        raise kind(message)


def integer(value: Any, name: str, low: int | None = None) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool), f"{name} must be an integer")
    _need(low is None or value >= low, f"{name} must be at least {low}")
    return value


def number(value: Any, name: str) -> float:
    _need(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value), f"{name} must be a finite number")
    return float(value)


def flag(value: Any, name: str) -> bool:
    _need(isinstance(value, bool), f"{name} must be a boolean")
    return value


def fields(value: Any, name: str, allowed: set[str], exact: bool = False) -> dict:
    _need(isinstance(value, dict), f"{name} must be a mapping")
    _need(not set(value) - allowed, f"unknown {name} fields: {sorted(map(str, set(value) - allowed))}")
    _need(not exact or set(value) == allowed, f"{name} fields are invalid")
    return value


def check_phases(phases: Any, known: set[str] | None = None) -> list[dict]:
    """Phases that are unique, contiguous and cover every step."""
    _need(isinstance(phases, list) and bool(phases), "there is no drift phase", DriftError)
    start, seen = 1, set()
    for p in phases:
        _need(isinstance(p, dict) and set(p) == set(PHASES[0]), "drift phase fields do not match the contract", DriftError)
        low, high, keep, novel = p["step_min"], p["step_max"], p["illicit_keep_probability"], p["novel_profile_ids"]
        _need(isinstance(p["phase_id"], str) and p["phase_id"] and p["phase_id"] not in seen, "names of drift phases must be different strings", DriftError)
        _need(all(isinstance(x, int) and not isinstance(x, bool) for x in (low, high)), "bounds of a drift phase are no integers", DriftError)
        _need(low == start and low <= high <= STEPS, "drift phases must be contiguous and bounded", DriftError)
        _need(isinstance(keep, (int, float)) and not isinstance(keep, bool) and 0 <= keep <= 1, "a drift probability is outside of 0..1", DriftError)
        _need(isinstance(novel, list) and all(isinstance(x, str) for x in novel) and len(novel) == len(set(novel)), "novel profiles must be different strings", DriftError)
        _need(known is None or set(novel) <= known, "a novel profile has no quota", DriftError)
        seen.add(p["phase_id"])
        start = high + 1
    _need(start == STEPS + 1, "drift phases must be contiguous up to the last step", DriftError)
    return [dict(p) for p in phases]


@dataclass
class Config:
    seed: int = 72
    n_txs: int = 10_000
    stats_dir: str = "data/volume"
    out_dir: str = "data/synthetic/behavior_run"
    quotas: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(QUOTAS))
    chains: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(CHAINS, True))
    phases: list[dict] = field(default_factory=lambda: [dict(p) for p in PHASES])
    timestamp_scale: int = 1200
    per_1000_nodes: int = 2
    min_anchor_distance: int = 3
    k_hop_range: tuple[int, ...] = (1, 3)
    prefer_central_anchors: bool = True
    holdout: list[dict] = field(default_factory=list)
    k: int = 100
    seeds: tuple[int, ...] = tuple(range(10))
    backend: str = "auto"
    training: Settings = field(default_factory=Settings)
    threads: int = 1

    def check(self) -> Config:
        """What must hold before any draw."""
        check_registry()
        self.phases = check_phases(self.phases, set(self.quotas))
        _need(sum(t for _, t in self.quotas.values()) == self.n_txs, "profile quotas must add up: they sum to n_txs", DriftError)
        for p, (entities, txs) in self.quotas.items():
            _need(p in PROFILES, f"unknown behavior profile: {p}")
            _need(entities >= 0 and txs >= 0, f"a quota is under zero: {p}")
            _need((entities == 0) == (txs == 0), f"a profile has entities and transactions or neither: {p}")
        for p in self.phases:
            for x in p["novel_profile_ids"]:
                _need(PROFILES[x].negative_kind == "novel_illicit", f"only novel profiles may be listed as novel: {x}")
        _need(sum(self.chains.values()) >= 2, "bridges need two enabled chains")
        return self

    def as_dict(self) -> dict:
        """The echo of the configuration in a manifest; absolute paths are cut to their last part."""
        shown = lambda p: Path(p).name if Path(p).is_absolute() else str(p)
        return {
            "seed": self.seed, "n_txs": self.n_txs, "stats_dir": shown(self.stats_dir), "out_dir": shown(self.out_dir), "graph": {"mode": "behavior"}, "features": {"mode": "semantic"},
            "behavior": {
                "contract_version": "behavior.p0.v1", "profile_quotas": {p: {"entity_count": e, "tx_quota": t} for p, (e, t) in sorted(self.quotas.items())}, "chains": {c: {"enabled": on} for c, on in sorted(self.chains.items())}, "drift": {"phases": [dict(p) for p in self.phases]},
            },
            "edge_attributes": {"timestamp_scale": self.timestamp_scale},
            "anchors": {"per_1000_nodes": self.per_1000_nodes, "min_anchor_distance": self.min_anchor_distance, "k_hop_range": list(self.k_hop_range), "prefer_central_anchors": self.prefer_central_anchors},
            "holdout": {"entries": self.holdout}, "gnn": {"backend": self.backend, **asdict(self.training), "threads": self.threads, "k": self.k, "seeds": list(self.seeds)},
        }


def parse(raw: Any) -> Config:
    """A configuration from a mapping; unknown fields are refused at every level."""
    raw = fields({} if raw is None else raw, "top-level config", {"seed", "n_txs", "stats_dir", "out_dir", "graph", "features", "behavior", "edge_attributes", "anchors", "holdout", "gnn"})
    out = Config(seed=integer(raw.get("seed", 72), "seed"), n_txs=integer(raw.get("n_txs", 10_000), "n_txs", 1))
    for name in ("stats_dir", "out_dir"):
        value = raw.get(name, getattr(out, name))
        _need(isinstance(value, (str, Path)), f"{name} must be a path")
        setattr(out, name, str(value))
    for name, mode in (("graph", "behavior"), ("features", "semantic")):
        _need(fields(raw.get(name, {}), name, {"mode"}).get("mode", mode) == mode, f"{name}.mode may be {mode} only")
    behavior = fields(raw.get("behavior", {}), "behavior", {"contract_version", "profile_quotas", "chains", "drift"})
    _need(behavior.get("contract_version", "behavior.p0.v1") == "behavior.p0.v1", "behavior.contract_version must be behavior.p0.v1")
    if behavior.get("profile_quotas") is not None:
        quotas = fields(behavior["profile_quotas"], "behavior.profile_quotas", set(PROFILES))
        rows = {p: fields(q, f"behavior.profile_quotas.{p}", {"entity_count", "tx_quota"}, True) for p, q in quotas.items()}
        out.quotas = {p: (integer(q["entity_count"], f"{p}.entity_count", 1), integer(q["tx_quota"], f"{p}.tx_quota", 1)) for p, q in rows.items()}
    if behavior.get("chains") is not None:
        out.chains = {c: flag(fields(x, f"behavior.chains.{c}", {"enabled"}, True)["enabled"], c) for c, x in fields(behavior["chains"], "behavior.chains", set(CHAINS), True).items()}
        _need(any(out.chains.values()), "no chain is enabled")
    if behavior.get("drift") is not None:
        out.phases = check_phases(fields(behavior["drift"], "behavior.drift", {"phases"}, True)["phases"], set(PROFILES))
    _need(sum(t for _, t in out.quotas.values()) == out.n_txs, "profile quotas must add up: they sum to n_txs")
    out.timestamp_scale = integer(fields(raw.get("edge_attributes", {}), "edge_attributes", {"timestamp_scale"}).get("timestamp_scale", 1200), "edge_attributes.timestamp_scale", 0)
    anchors = fields(raw.get("anchors", {}), "anchors", {"per_1000_nodes", "min_anchor_distance", "k_hop_range", "prefer_central_anchors"})
    out.per_1000_nodes = integer(anchors.get("per_1000_nodes", 2), "anchors.per_1000_nodes", 0)
    out.min_anchor_distance = integer(anchors.get("min_anchor_distance", 3), "anchors.min_anchor_distance", 0)
    out.k_hop_range = tuple(integer(x, "anchors.k_hop_range", 0) for x in anchors.get("k_hop_range", [1, 3]))
    out.prefer_central_anchors = flag(anchors.get("prefer_central_anchors", True), "anchors.prefer_central_anchors")
    for e in fields(raw.get("holdout", {}), "holdout", {"entries"}).get("entries") or []:
        e = fields(e, "holdout entry", {"pattern", "step_min", "step_max", "train_excluded"}, True)
        _need(e["pattern"] in PROFILES, "holdout names no profile")
        _need(1 <= integer(e["step_min"], "step_min") <= integer(e["step_max"], "step_max") <= STEPS, "holdout steps are out of order or range")
        flag(e["train_excluded"], "train_excluded")
        out.holdout.append(dict(e))
    gnn = fields(raw.get("gnn", {}), "gnn", {"backend", "hidden", "layers", "dropout", "learning_rate", "weight_decay", "epochs", "patience", "threads", "k", "seeds"})
    for name in ("hidden", "epochs", "patience", "threads", "k"):
        integer(gnn.get(name, 2), f"gnn.{name}", 1)
    rates = {name: number(gnn.get(name, getattr(out.training, name)), f"gnn.{name}") for name in ("dropout", "learning_rate", "weight_decay")}
    out.training = Settings(**{name: gnn.get(name, getattr(out.training, name)) for name in ("hidden", "layers", "epochs", "patience")}, **rates)
    out.threads = gnn.get("threads", 1)
    t = out.training
    _need(integer(t.layers, "gnn.layers") in (2, 3), "gnn.layers takes two or three")
    _need(t.hidden % 2 == 0, "gnn.hidden is split between two heads and must be even")
    _need(0 <= t.dropout < 1 and t.learning_rate > 0 and t.weight_decay >= 0, "gnn rates are out of their range")
    out.k, out.backend = gnn.get("k", 100), gnn.get("backend", "auto")
    _need(out.backend in ("auto", "full", "sgc"), "gnn.backend must be auto, full or sgc")
    seeds = gnn.get("seeds", list(range(10)))
    _need(isinstance(seeds, list) and bool(seeds) and len(set(map(str, seeds))) == len(seeds), "gnn.seeds must hold different numbers")
    out.seeds = tuple(integer(s, "gnn.seeds") for s in seeds)
    return out


def load(path: str | Path) -> Config:
    """A configuration from YAML that names no key twice."""
    import yaml

    class Unique(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            _need(key not in out, f"duplicate key: {key}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return parse(yaml.load(Path(path).read_text(encoding="utf-8"), Loader=Unique))
