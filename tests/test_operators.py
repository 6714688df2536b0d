"""Operators on hand-made graphs and vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import asof, checks, evaluation, features, forest, schedule


@pytest.fixture(scope="module")
def hand(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)], "tx_id bigint, time_step int")
    edges = spark.createDataFrame([(0, 2), (2, 3), (2, 4), (1, 5), (1, 5)], "txId1 bigint, txId2 bigint")
    return nodes, edges


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_structural(hand):
    out = {r["tx_id"]: r for r in features.structural(*hand).collect()}
    assert [out[i]["in_degree"] for i in range(6)] == [0, 0, 1, 1, 1, 2]
    assert [out[i]["out_degree"] for i in range(6)] == [1, 2, 2, 0, 0, 0]
    assert out[5]["in_unique_neighbors"] == out[1]["out_unique_neighbors"] == 1


def test_forest(hand):
    nodes, edges = hand
    trees = forest.Forest(nodes, edges.distinct())
    assert rows(trees.instances(), "node", "instance_id") == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    anchors = trees.anchors()
    assert rows(anchors, "root", "anchor", "max_distance") == [(0, 2, 1), (1, 1, 1)]
    assert rows(trees.articulation_points(), "node") == [(2,)]
    assert rows(trees.shells(anchors, 2), "root", "hop", "nodes") == [(0, 1, [0, 3, 4]), (1, 1, [5])]


def test_forest_distances_by_brute_force(spark):
    r, n = random.Random(1), 60
    parent = {i: r.randrange(i) for i in range(1, n) if r.random() < 0.9}
    nodes = spark.createDataFrame([(i,) for i in range(n)], "tx_id bigint")
    edges = spark.createDataFrame([(p, c) for c, p in parent.items()], "txId1 bigint, txId2 bigint")
    near = {i: set() for i in range(n)}
    for c, p in parent.items():
        near[c].add(p)
        near[p].add(c)

    def far(i):
        seen, now, d = {i}, {i}, 0
        while now := {y for x in now for y in near[x]} - seen:
            seen |= now
            d += 1
        return d

    assert rows(forest.Forest(nodes, edges).eccentricities(), "node", "ecc") == [(i, far(i)) for i in range(n)]


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_asof_over_spans(spark, span):
    r = random.Random(span)
    writes = [(r.choice("abc"), t) for t in range(0, 80) if r.random() < 0.5] + [(None, 3)]
    probes = [(r.choice("abcd"), t) for t in range(80)] + [(None, 5)]
    out = asof.last_before(spark.createDataFrame(probes, "k string, t bigint"), spark.createDataFrame(writes, "k string, t bigint"), "k", "t", span)
    got = {(x["k"], x["t"]): x["last"] for x in out.collect()}
    assert got == {(k, t): max((w for j, w in writes if j == k and k is not None and w < t), default=None) for k, t in probes}


def test_slots(spark):
    flat = spark.range(1, 50).select(F.col("id").alias("step"), F.lit(100).alias("weight"))
    counts = dict(rows(schedule.slots(flat, 1000).groupBy("step").count(), "step", "count"))
    assert [counts[s] for s in range(1, 50)] == [21] * 20 + [20] * 29
    assert dict(rows(schedule.slots(flat.withColumn("weight", F.lit(0)), 49).groupBy("step").count(), "step", "count")) == dict.fromkeys(range(1, 50), 1)
    assert schedule.slots(flat, 0).count() == 0


def test_weighted_pick_keeps_shares(spark):
    out = schedule.weighted_pick(spark.range(4000), [("a", 0.4), ("b", 0.3), ("c", 0.3)], schedule.uniform(F.lit(1), F.col("id")), "x")
    counts = dict(rows(out.groupBy("x").count(), "x", "count"))
    assert abs(counts["a"] - 1600) < 120 and abs(counts["b"] - 1200) < 120


NODES = list(zip(range(12), [1, 2, 30, 31, 40, 41, 42, 49, 45, 46, 47, 48], "1 2 unknown 1 2 1 2 1 2 1 2 1".split()))


def test_split_and_filter(spark):
    nodes = spark.createDataFrame(NODES, "tx_id bigint, time_step int, class string")
    edges = spark.createDataFrame([(0, 1), (0, 3), (3, 5), (4, 4)], "txId1 bigint, txId2 bigint")
    assert rows(nodes.groupBy(evaluation.part(F.col("time_step")).alias("p")).count(), "p", "count") == [("test", 7), ("train", 3), ("validation", 2)]
    assert rows(evaluation.partition_edges(edges, nodes), "part", "txId1", "txId2") == [("train", 0, 1)]
    r = evaluation.filter_report(edges, nodes).first()
    assert (r["input"], r["self_loops"], r["cross_partition"], r["retained"]) == (4, 1, 2, 1)
    assert nodes.where(evaluation.label(F.col("class")).isNotNull()).count() == 11
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(50,)], "s int").select(evaluation.part(F.col("s"))).collect()


def test_metric_fields_and_refusals(spark):
    rows_ = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.7), (3, 1, 0.2), (4, None, 0.8), (5, 0, 0.1)], "tx_id int, y int, score double")
    r = evaluation.confusion(rows_, 0.5, [], 2).first().asDict()
    assert (r["n"], r["n_positive"], r["n_negative"], r["positive_rate"], r["threshold"], r["k"], r["k_effective"], r["hits"]) == (4, 2, 2, 0.5, 0.5, 2, 2, 1)
    for threshold in (-0.1, 1.1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            evaluation.confusion(rows_, threshold, [])
    for k in (0, -1, True, 2.0):
        with pytest.raises(ValueError):
            evaluation.confusion(rows_, 0.5, [], k)
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="scores must be finite"):
            evaluation.confusion(rows_.union(spark.createDataFrame([(6, 1, bad)], rows_.schema)), 0.5, []).collect()
    empty = evaluation.confusion(rows_.limit(0), 0.5, []).first()
    assert (empty["n"], empty["n_positive"], empty["positive_rate"], empty["f1"]) == (0, 0, None, None)


def test_metrics(spark):
    three = spark.createDataFrame([(1, 1, 0.9, 1), (0, 2, 0.2, 1), (1, 3, 0.8, 1)], "y int, tx_id bigint, score double, time_step int")
    r = evaluation.confusion(three, 0.5, [], 2).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["f1"], r["precision_at_k"], r["recall_at_k"]) == (2, 0, 1, 0, 1.0, 1.0, 1.0)
    data = [({"1": 1, "2": 0}[c], i, 0.1 + 0.8 * i / 11, s) for i, s, c in NODES if c != "unknown"]
    steps = evaluation.per_step(spark.createDataFrame(data, "y int, tx_id bigint, score double, time_step int").where("time_step > 40"), 0.5, 2)
    assert [r["time_step"] for r in steps.orderBy("time_step").collect()] == list(range(41, 50))
    m = evaluation.macro(steps, ["f1", "precision_at_k", "recall_at_k"]).first()
    assert (m["steps_f1"], m["steps_precision_at_k"], m["steps_recall_at_k"], m["macro_f1"]) == (4, 7, 4, None)
    assert evaluation.micro(steps).first()["tp"] == 3  # 46, 48 and 49 score over the bar


def test_threshold_takes_the_lowest_of_ties(spark):
    data = [(1, 0.57), (1, 0.9), (0, 0.3), (0, 0.1)]
    r = evaluation.best_threshold(spark.createDataFrame(data, "y int, score double")).first()
    assert (r["i"], r["f1"]) == (31, 1.0)


def test_effects(spark):
    r = evaluation.paired_effect(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "delta double")).first()
    assert r["cohen_dz"] == pytest.approx(2.0) and r["t"] == pytest.approx(2 * 3**0.5)
    assert r["p"] == pytest.approx(0.0742, abs=1e-4)
    assert evaluation.paired_effect(spark.createDataFrame([(1.0,), (1.0,)], "delta double")).first()["p"] is None
    # against the closed form of even degrees of freedom
    for t, df in ((0.0, 2), (1.5, 4), (-2.5, 10), (6.0, 48), (40.0, 6), (1.0, 20_000)):
        x = math.atan(abs(t) / math.sqrt(df))
        term = total = 1.0
        for j in range(1, df // 2):
            term *= (2 * j - 1) / (2 * j) * math.cos(x) ** 2
            total += term
        got = spark.range(1).select(evaluation.two_sided_p(F.lit(t), F.lit(float(df)))).first()[0]
        assert got == pytest.approx(1 - math.sin(x) * total, abs=1e-9)


def test_checks(spark, hand):
    nodes, edges = hand
    assert checks.orphans(edges.union(spark.createDataFrame([(0, 99)], edges.schema)), nodes).count() == 1
    assert rows(checks.duplicates(edges, ["txId1", "txId2"]), "txId1", "txId2", "n") == [(1, 5, 2)]
    assert checks.contiguity(nodes, "tx_id").first()["ok"] and not checks.contiguity(nodes.where("tx_id <> 2"), "tx_id").first()["ok"]
    assert checks.causality_violations(spark.createDataFrame([(5, 0), (0, 5)], edges.schema), nodes).count() == 1


@pytest.mark.parametrize("reach", [3, 60])
def test_distances_and_shells_of_random_forests(spark, reach):
    """Long and bushy trees, against layers counted one by one; few steps are walked, many are found by distances."""
    r, n = random.Random(reach), 80
    parent = {i: r.randrange(max(i - reach, 0), i) for i in range(1, n) if r.random() < 0.97}
    nodes = spark.createDataFrame([(i,) for i in range(n)], "tx_id bigint")
    trees = forest.Forest(nodes, spark.createDataFrame([(p, c) for c, p in parent.items()], "txId1 bigint, txId2 bigint"))
    near, root = {i: set() for i in range(n)}, {}
    for i in range(n):
        root[i] = root[parent[i]] if i in parent else i
        if i in parent:
            near[i].add(parent[i])
            near[parent[i]].add(i)

    def layers(i):
        seen, now, out = {i}, {i}, []
        while now:
            out.append(sorted(now))
            now = {y for x in now for y in near[x]} - seen
            seen |= now
        return out

    assert rows(trees.eccentricities(), "node", "root", "ecc") == [(i, root[i], len(layers(i)) - 1) for i in range(n)]
    targets = {t: r.choice([i for i in range(n) if root[i] == t]) for t in sorted(set(root.values())) if t % 2 == 0}  # of some trees
    want = sorted((x, t, d) for t, i in targets.items() for d, layer in enumerate(layers(i)) for x in layer)
    assert rows(trees.distances(spark.createDataFrame(list(targets.items()), "root bigint, target bigint")), "node", "root", "d") == want
    anchors = spark.createDataFrame([(t, i, 1 + t % 5) for t, i in targets.items()], "root bigint, anchor bigint, max_distance bigint")
    for hops in (2, 1 << 20):
        want = sorted((t, d, layer) for t, i in targets.items() for d, layer in enumerate(layers(i)) if 1 <= d <= min(hops, 1 + t % 5))
        assert rows(trees.shells(anchors, hops), "root", "hop", "nodes") == want


def test_anchors_and_shells_take_few_rounds(spark, monkeypatch):
    """Every table that is stored costs jobs, however small it is: one search for where ways meet is enough for anchors, and a step for a shell."""
    seen = []
    whole, told = forest.stored, forest.stored_told
    monkeypatch.setattr(forest, "stored", lambda df: (seen.append(1), whole(df))[1])
    monkeypatch.setattr(forest, "stored_told", lambda df, **x: (seen.append(1), told(df, **x))[1])
    nodes = spark.range(200).select(F.col("id").alias("tx_id"))
    trees = forest.Forest(nodes, nodes.where("tx_id % 100 > 0").select((F.col("tx_id") - 1).alias("txId1"), F.col("tx_id").alias("txId2")))
    seen.clear()
    anchors = whole(trees.anchors())
    assert rows(trees.shells(anchors, 1), "root", "hop", "nodes") == [(0, 1, [48, 50]), (100, 1, [148, 150])]
    assert len(seen) < 8
