"""Graph networks against differences of their losses and plain loops, and training over packs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.models import networks, training
from causeway.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def small(seed=0, n=9, width=3):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, n, 14), r.integers(0, n, 14)
    keep = a != b
    return r.standard_normal((n, width)), a[keep], b[keep], (r.random(n) < 0.5).astype(float), r.random(n) < 0.8


@pytest.mark.parametrize("kind", networks.KINDS)
@pytest.mark.parametrize("layers", [2, 3])
def test_slopes_are_those_of_the_loss(kind, layers):
    x, a, b, y, fit = small()
    w = networks.parameters(kind, 3, 4, layers, 1)
    _, slopes = networks.loss_and_slopes(kind, w, x, a, b, y, fit, 0.0, None)
    r = np.random.default_rng(2)
    for name, v in w.items():
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in v.shape)
            sides = []
            for step in (1e-6, -1e-6):
                moved = {k: u.copy() for k, u in w.items()}
                moved[name][at] += step
                sides.append(networks.loss_and_slopes(kind, moved, x, a, b, y, fit, 0.0, None)[0])
            assert abs((sides[0] - sides[1]) / 2e-6 - slopes[name][at]) < 1e-5, (name, at)


def test_sage_by_loops():
    x, a, b, _, _ = small(3)
    w = networks.parameters("sage", 3, 4, 1, 5)
    out = networks.logits("sage", {k: networks.Value(v) for k, v in w.items()}, x, a, b).data[:, 0]
    for i in range(len(x)):
        parts = []
        for side, of in (("out", [s for s, t in zip(a, b) if t == i]), ("in", [t for s, t in zip(a, b) if s == i])):
            mean = np.mean([x[j] for j in of], axis=0) if of else np.zeros(3)
            parts.append(np.maximum(mean @ w[f"0.{side}.near.w"] + w[f"0.{side}.near.b"][0] + x[i] @ w[f"0.{side}.self.w"], 0))
        assert abs(np.concatenate(parts) @ w["head.w"][:, 0] + w["head.b"][0, 0] - out[i]) < 1e-9


def test_attention_and_sums_by_loops():
    x, a, b, _, _ = small(4)
    w = networks.parameters("gat", 3, 4, 1, 6)
    out = networks.logits("gat", {k: networks.Value(v) for k, v in w.items()}, x, a, b).data[:, 0]
    h = (x @ w["0.map.w"]).reshape(-1, 2, 2)
    for i in range(len(x)):
        of = [s for s, t in zip(a, b) if t == i] + [i]
        seen = []
        for head in range(2):
            e = np.array([h[j, head] @ w["0.from"][0, head] + h[i, head] @ w["0.to"][0, head] for j in of])
            e = np.where(e > 0, e, 0.2 * e)
            share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            seen.append(sum(s * h[j, head] for s, j in zip(share, of)))
        assert abs(np.maximum(np.concatenate(seen) + w["0.offset"][0], 0) @ w["head.w"][:, 0] + w["head.b"][0, 0] - out[i]) < 1e-9
    w = networks.parameters("gin", 3, 4, 1, 7)
    w["0.eps"][:] = 0.3
    out = networks.logits("gin", {k: networks.Value(v) for k, v in w.items()}, x, a, b).data[:, 0]
    for i in range(len(x)):
        z = 1.3 * x[i] + sum((x[s] for s, t in zip(a, b) if t == i), np.zeros(3))
        z = np.maximum(np.maximum(z @ w["0.first.w"] + w["0.first.b"][0], 0) @ w["0.second.w"] + w["0.second.b"][0], 0)
        assert abs(z @ w["head.w"][:, 0] + w["head.b"][0, 0] - out[i]) < 1e-9


def test_refusals():
    with pytest.raises(ValueError, match="even"):
        networks.parameters("gat", 3, 5, 2, 0)
    with pytest.raises(ValueError, match="unknown"):
        networks.parameters("mlp", 3, 4, 2, 0)


@pytest.fixture(scope="module")
def graph(spark):
    """Pairs in which the label of one end is the sign of the other end's column."""
    r = np.random.default_rng(8)
    rows, edges = [], []
    for k in range(150):
        u, v = float(r.standard_normal()), float(r.standard_normal())
        part = ["fit", "fit", "judge"][k % 3]
        rows += [(2 * k, u, v * 0, int(v > 0), part == "fit", part == "judge"), (2 * k + 1, v, 0.0, None, False, False)]
        edges.append((2 * k + 1, 2 * k))
    return spark.createDataFrame(rows, "tx_id bigint, c1 double, c2 double, y int, fit boolean, judge boolean"), spark.createDataFrame(edges, "txId1 bigint, txId2 bigint")


@pytest.mark.parametrize("kind", networks.KINDS)
def test_training_learns_from_neighbours(spark, graph, kind):
    rows, edges = graph
    model = training.fit(rows, edges, ["c1", "c2"], kind, 0, training.Settings(hidden=8, learning_rate=0.05, epochs=25, patience=25, dropout=0.0))
    assert max(f for _, f in model.history) > 0.85 and model.history[-1][0] < model.history[0][0]
    scores = {r["tx_id"]: r["score"] for r in model.scores(rows.select("tx_id", "c1", "c2"), edges).collect()}
    assert len(scores) == 300 and all(0 <= s <= 1 for s in scores.values())
    again = training.restored(training.saved(model))
    assert {r["tx_id"]: r["score"] for r in again.scores(rows.select("tx_id", "c1", "c2"), edges).collect()} == scores


def test_packs_give_the_steps_of_one_whole_graph(graph, monkeypatch):
    rows, edges = graph
    settings = training.Settings(hidden=4, learning_rate=0.05, epochs=4, patience=9, dropout=0.0)
    whole = training.fit(rows, edges, ["c1", "c2"], "sage", 3, settings)
    monkeypatch.setattr(training, "PACK_NODES", 40)
    parts = training.fit(rows, edges, ["c1", "c2"], "sage", 3, settings)
    assert np.allclose(whole.history, parts.history) and training.packed(rows, edges, ["c1", "c2"]).count() > 4


def test_training_needs_both_classes(graph):
    rows, edges = graph
    for part, code in (("fit", "TRAIN_CLASSES"), ("judge", "VALIDATION_SINGLE_CLASS")):
        with pytest.raises(ValueError, match=code):
            training.fit(rows.where(~F.col(part) | (F.col("y") == 1)), edges, ["c1", "c2"], "gin", 0, training.Settings(epochs=1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_network_scores_trains_as_the_protocol(spark, monkeypatch):
    """Sizes and rates of the protocol, and steps until its patience ends or all are done."""
    models, fit = [], training.fit
    monkeypatch.setattr(training, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    out = QUERIES["network_scores"](spark, SF)
    (model,), want = models, training.Settings()
    assert (want.hidden, want.layers, want.epochs, want.patience, want.dropout) == (64, 2, 300, 30, 0.25)
    fresh = networks.parameters("sage", len(model.columns), want.hidden, want.layers, 0)
    assert {k: v.shape for k, v in model.weights.items()} == {k: v.shape for k, v in fresh.items()}
    f1 = [f for _, f in model.history]
    assert len(f1) == min(want.epochs, f1.index(max(f1)) + 1 + want.patience)
    assert out.count() == 1000 and out.select("tx_id").distinct().count() == 1000


@pytest.mark.parametrize("kind", networks.KINDS)
@pytest.mark.parametrize("layers", [1, 2, 3])
def test_wanted_logits_are_those_of_the_whole(kind, layers):
    x, a, b, _, _ = small(9, n=60)
    w = {k: networks.Value(v) for k, v in networks.parameters(kind, 3, 4, layers, 1).items()}
    whole = networks.logits(kind, w, x, a, b).data
    for wanted in (np.arange(60) % 7 == 0, np.arange(60) < 1, np.zeros(60, bool), np.ones(60, bool)):
        assert np.allclose(networks.logits(kind, w, x, a, b, wanted=wanted).data, whole[wanted], atol=1e-12)


def test_sums_of_many_tasks_are_added_in_tasks(graph, monkeypatch):
    rows, edges = graph
    settings = training.Settings(hidden=4, learning_rate=0.05, epochs=3, patience=9, dropout=0.5)
    monkeypatch.setattr(training, "PACK_NODES", 40)
    once = training.fit(rows, edges, ["c1", "c2"], "sage", 3, settings)
    monkeypatch.setattr(training, "MOST_SUMS", 2)
    added, collect = [], training._summed
    monkeypatch.setattr(training, "_summed", lambda rows, tasks: added.append(tasks) or collect(rows, tasks))
    twice = training.fit(rows, edges, ["c1", "c2"], "sage", 3, settings)
    assert min(added) > 2 and np.allclose(once.history, twice.history)
