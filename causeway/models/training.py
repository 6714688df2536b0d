"""Training of graph networks by steps over the whole graph, summed over packs of its components.

Messages never leave a component, so the loss and its slopes are sums over components. These are dealt to packs of about
PACK_NODES nodes, one row each in the shared folder; every step sums the slopes of all packs, task by task and all tasks at
once, and the driver holds the weights alone. A component must fit in a task's memory. Dropout is drawn by seed, step and
pack, so a lost task repeats it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, graph
from ..storage import stored
from . import networks

PACK_NODES = 6_000
#: Packs that a file of theirs holds, unless cores would be idle, and sums of a step that one task or the driver adds up.
FILE_PACKS, MOST_SUMS = 16, 64


@dataclass(frozen=True)
class Settings:
    """Sizes and rates of training; the defaults are those of the protocol."""

    hidden: int = 64
    layers: int = 2
    dropout: float = 0.25
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    epochs: int = 300
    patience: int = 30


def packed(rows: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """(pack, ids, x, y, fit, judge, sources, targets): whole components by pack, as bytes. rows: (tx_id, columns, y, fit, judge); edges: (txId1, txId2)."""
    parts = max(1, -(-rows.count() // PACK_NODES))
    found = graph.components(edges, "txId1", "txId2").withColumnRenamed("node", "tx_id")
    pack = F.pmod(F.xxhash64(F.coalesce("component", "tx_id")), F.lit(parts)).cast("int").alias("pack")
    nodes = stored(rows.join(found, "tx_id", "left").select("tx_id", *[F.col(c).cast("double").alias(c) for c in columns], F.col("y").cast("double").alias("y"), "fit", "judge", pack))
    links = stored(edges.join(nodes.select(F.col("tx_id").alias("txId1"), "pack"), "txId1").select("pack", "txId1", "txId2"))

    def build(mine: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("tx_id")
        ids = mine["tx_id"].to_numpy(np.int64)
        between = between.sort_values(["txId1", "txId2"])
        a, b = (np.searchsorted(ids, between[c].to_numpy(np.int64)) for c in ("txId1", "txId2"))
        arrays = {"ids": ids, "x": mine[columns].to_numpy(np.float64), "y": mine["y"].fillna(0).to_numpy(np.float64), "fit": mine["fit"].to_numpy(bool), "judge": mine["judge"].to_numpy(bool), "sources": a.astype(np.int64), "targets": b.astype(np.int64)}
        return pd.DataFrame({"pack": [int(mine["pack"].iloc[0])], **{k: [v.tobytes()] for k, v in arrays.items()}})

    schema = "pack int, ids binary, x binary, y binary, fit binary, judge binary, sources binary, targets binary"
    files = min(parts, max(-(-parts // FILE_PACKS), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    return stored(nodes.groupBy("pack").cogroup(links.groupBy("pack")).applyInPandas(build, schema).repartition(files))


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    kinds = {"ids": np.int64, "x": np.float64, "y": np.float64, "fit": bool, "judge": bool, "sources": np.int64, "targets": np.int64}
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            out = {k: np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in kinds.items()}  # where they are, not copied
            out["x"] = out["x"].reshape(-1, width)
            yield pack, out


@dataclass
class GraphModel:
    """Weights of a trained network with the means and scales of its columns."""

    kind: str
    columns: list[str]
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    def scores(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """(tx_id, score) of every row of a graph: (tx_id, columns)."""
        no = F.lit(False)
        packs = packed(rows.withColumn("y", F.lit(None).cast("double")).withColumn("fit", no).withColumn("judge", no), edges, self.columns)
        kind, width, weights, mean, scale = self.kind, len(self.columns), self.weights, self.mean, self.scale

        def run(batches):
            for _, a in _arrays(batches, width):
                z = networks.logits(kind, {k: networks.Value(v) for k, v in weights.items()}, (a["x"] - mean) / scale, a["sources"], a["targets"])
                yield pa.RecordBatch.from_arrays([pa.array(a["ids"]), pa.array(networks.sigmoid(z.data[:, 0]))], ["tx_id", "score"])

        return packs.mapInArrow(run, "tx_id bigint, score double")


def _f1(tp: float, fp: float, fn: float) -> float:
    """0 where it is undefined."""
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def _summed(rows: DataFrame, tasks: int) -> np.ndarray:
    """The sum of arrays, one row from each of so many tasks. Each is as long as the weights, so more than MOST_SUMS are first summed in tasks."""

    def run(batches):
        found = sorted(x for batch in batches for x in batch.column("sums").to_pylist())  # they come in any order
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(np.frombuffer, found)).tobytes()], pa.binary())], ["sums"])

    while tasks > MOST_SUMS:
        tasks = -(-tasks // MOST_SUMS)
        rows = rows.repartition(tasks).mapInArrow(run, "sums binary")
    return sum(np.frombuffer(r["sums"]) for r in rows.collect())


def fit(rows: DataFrame, edges: DataFrame, columns: list[str], kind: str, seed: int, settings: Settings = Settings()) -> GraphModel:
    """A network fitted on the rows with `fit`, stopped by the f1 of those with `judge`; the best weights seen are kept.

    rows: (tx_id, columns, y, fit, judge). One job a step gives the slopes at the weights of now and the f1 that they reach.
    """
    for part, code in (("fit", "TRAIN_CLASSES"), ("judge", "VALIDATION_SINGLE_CLASS")):
        if rows.where(part).agg(F.count_distinct("y")).first()[0] != 2:
            raise ValueError(code)
    scaler = evaluation.clamped_scaler(rows.where("fit"), columns).first()
    mean, scale = (np.array([scaler[f"{k}_{c}"] for c in columns]) for k in ("mean", "scale"))
    packs, width = packed(rows, edges, columns), len(columns)
    n_fit, tasks = rows.where("fit").count(), packs.rdd.getNumPartitions()
    weights = networks.parameters(kind, width, settings.hidden, settings.layers, seed)
    names = list(weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    best, best_score, stale, history = weights, -1.0, 0, []
    for step in range(settings.epochs + 1):
        now = weights

        def run(batches, now=now, step=step):
            sums = np.zeros(4 + sum(v.size for v in now.values()))
            for pack, a in _arrays(batches, width):
                x = (a["x"] - mean) / scale
                z = networks.logits(kind, {k: networks.Value(v) for k, v in now.items()}, x, a["sources"], a["targets"], wanted=a["judge"]).data[:, 0]
                yes, said = a["y"][a["judge"]] == 1, z >= 0
                counts = [float(m.sum()) for m in (yes & said, ~yes & said, yes & ~said)]
                draw = np.random.default_rng([seed, step, pack])
                loss, slopes = networks.loss_and_slopes(kind, now, x, a["sources"], a["targets"], a["y"], a["fit"], settings.dropout, draw)
                sums += np.concatenate([[loss], counts, *[slopes[k].ravel() for k in names]])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        sums = _summed(packs.mapInArrow(run, "sums binary"), tasks)
        score = _f1(*sums[1:4])
        if step:  # the weights that the step before led to
            history.append((sums[0] / n_fit, score))
            if score > best_score:
                best, best_score, stale = now, score, 0
            else:
                stale += 1
                if stale >= settings.patience:
                    break
        at, moved = 4, {}
        for k in names:  # AdamW
            g = sums[at : at + now[k].size].reshape(now[k].shape) / n_fit
            at += now[k].size
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            direction = first[k] / (1 - 0.9 ** (step + 1)) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
            moved[k] = now[k] * (1 - settings.learning_rate * settings.weight_decay) - settings.learning_rate * direction
        weights = moved
    return GraphModel(kind, columns, best, mean, scale, history)


def saved(model: GraphModel) -> str:
    """A model as JSON."""
    return json.dumps({"kind": model.kind, "columns": model.columns, "mean": model.mean.tolist(), "scale": model.scale.tolist(), "weights": {k: v.tolist() for k, v in model.weights.items()}})


def restored(text: str) -> GraphModel:
    said = json.loads(text)
    return GraphModel(said["kind"], said["columns"], {k: np.array(v) for k, v in said["weights"].items()}, np.array(said["mean"]), np.array(said["scale"]))
