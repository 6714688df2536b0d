"""Numbers, overlaps and comparisons of tables of which no task may see a large part."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway import storage
from causeway.operators import checks, evaluation, features, forest, intervals
from causeway.operators.numbering import numbered


def test_numbers_of_sparse_ids(spark):
    r = random.Random(1)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, 1, 2]
    out = numbered(spark.createDataFrame([(x,) for x in ids], "x bigint").repartition(7), ["x"], "n")
    assert sorted(map(tuple, out.collect())) == list(zip(sorted(ids), range(len(ids))))


def test_numbers_within_groups(spark):
    """A group with most rows, groups of one, a null group and nulls in the order."""
    rows = [("hot", i) for i in range(300)] + [(f"g{i}", 5) for i in range(40)] + [(None, 2), (None, None), (None, 1)]
    out = {}
    for g, x, n in numbered(spark.createDataFrame(rows, "g string, x int").repartition(9), ["x"], "n", ["g"]).collect():
        out.setdefault(g, []).append((n, x))
    assert sorted(out["hot"]) == [(i, i) for i in range(300)] and sorted(out[None], key=lambda t: t[0]) == [(0, None), (1, 1), (2, 2)]
    assert all(out[f"g{i}"] == [(0, 5)] for i in range(40))
    assert numbered(spark.createDataFrame([], "g string, x int"), ["x"], "n", ["g"]).count() == 0


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_overlaps(spark, buckets):
    """Points, long and empty intervals, ties of starts, nulls, a hot key."""
    r = random.Random(buckets)

    def side(n):
        out = []
        for i in range(n):
            low = r.randrange(200)
            out.append((i, r.choice(["hot", "hot", "a", None]), low, low + r.choice([0, 0, 3, 10, 400, -1])))
        return out + [(n, "a", None, 5), (n + 1, "a", 5, None)]

    a, b = side(150), side(120)
    schema = "id int, key string, low int, high int"
    met = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"], buckets).select("l.id", "r.id").collect()
    sound = lambda rows: [x for x in rows if None not in x and x[2] <= x[3]]
    want = sorted((x[0], y[0]) for x in sound(a) for y in sound(b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, met)) == want and len(want) > 100
    assert intervals.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ["key"]).count() == 0


def test_first_window_of_a_long_list(spark):
    r = random.Random(6)
    inst = [(i, r.choice("abc"), s, s + r.randrange(30)) for i in range(300) for s in [r.randrange(1000)]]
    wins = [(k, r.choice("ab"), s, s + r.randrange(4)) for k in range(400) for s in [r.randrange(1000)]]
    out = forest.held_out_instances(spark.createDataFrame(inst, "instance_id int, pattern string, step_min int, step_max int"), spark.createDataFrame(wins, "ordinal int, pattern string, low int, high int"))
    assert sorted(map(tuple, out.collect())) == [(i, min((k for k, q, lo, hi in wins if q == p and s <= hi and e >= lo), default=None)) for i, p, s, e in inst]


def test_equal_tables_leave_nothing_to_compare(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else i) for i in range(1000)] + [(3, "v3", None)]
    cols = ["id", "v", "x"]
    a, b = (spark.createDataFrame(x, "id int, v string, x int") for x in (rows, rows[::-1]))
    assert [x.count() for x in checks.differing(a, b, cols, ["id"])] == [0, 0]
    changed = [*rows[:10], (10, "other", 10), *rows[11:500], *rows[501:], (7, "v0", None)]  # one changed, one lost, one doubled
    c = spark.createDataFrame(changed, "id int, v string, x int")
    left, right = checks.differing(a, c, cols, ["id"])
    assert left.count() < 10 and right.count() < 10
    assert sorted(map(tuple, checks.unequal(a, c, cols).collect()), key=str) == sorted([(10, "v3", 10, 1, 0), (10, "other", 10, 0, 1), (500, "v3", 500, 1, 0), (7, "v0", None, 1, 2)], key=str)
    swapped = spark.createDataFrame([(1, None, "x")], "id int, v string, x string"), spark.createDataFrame([(1, "x", None)], "id int, v string, x string")
    assert checks.unequal(*swapped, cols).count() == 2  # a null is not a null elsewhere
    assert checks.unequal(a.limit(0), a, cols).count() == 1000 and checks.unequal(a.limit(0), a.limit(0), cols).count() == 0


def test_joins_of_forests_are_not_broadcast(spark, monkeypatch):
    """Tables with a row per node compress so well that Spark takes them for small ones; no join may broadcast them, and no round may hold the ones before twice."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.stored(df)

    monkeypatch.setattr(forest, "stored", noted)
    monkeypatch.setattr(forest, "stored_told", lambda df, **told: (out := noted(df), out.agg(*[c.alias(n) for n, c in told.items()]).first().asDict()))
    monkeypatch.setattr(forest, "FEW", 0)
    nodes = spark.range(200).select(F.col("id").alias("tx_id"))
    trees = forest.Forest(nodes, nodes.where("tx_id % 100 > 0").select((F.col("tx_id") - 1).alias("txId1"), F.col("tx_id").alias("txId2")))  # two chains
    anchors = storage.stored(trees.anchors())
    assert sorted(map(tuple, anchors.collect())) == [(0, 49, 50), (100, 149, 50)]
    assert sorted(map(tuple, noted(trees.shells(anchors, 1)).collect())) == [(0, 1, [48, 50]), (100, 1, [148, 150])]
    assert sum(p.count("MergeJoin") for p in plans) > 20 and not any("BroadcastHashJoin" in p for p in plans)
    assert max(p.count("MergeJoin") for p in plans) < 10


def test_joins_of_features_are_not_broadcast(spark):
    """Nor do the joins of the views and of the propagated columns, with a row per node or edge on both sides."""
    nodes = storage.stored(spark.range(60).select(F.col("id").alias("tx_id"), (F.col("id") % 49 + 1).cast("int").alias("time_step"), (F.col("id") / 2).alias("x")))
    edges = storage.stored(nodes.where("tx_id > 0").select((F.col("tx_id") - 1).alias("txId1"), F.col("tx_id").alias("txId2")))
    out = features.propagated(nodes, edges, ["x"])
    assert {r["tx_id"]: (r["x_1"], r["x_2"]) for r in out.collect()} == {i: ((i + 1) / 2 if i < 59 else 0, (i + 2) / 2 if i < 58 else 0) for i in range(60)}
    for df in (out, features.structural(nodes, edges), evaluation.partition_edges(edges, nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MergeJoin") >= 2 and "BroadcastHashJoin" not in plan


def test_long_rows_come_to_python_a_few_at_a_time(spark):
    """However many packs a task reads, it does not hold them together."""
    rows = storage.stored(spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 2_000_000).cast("binary").alias("data")))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    sizes = [r["n"] for r in rows.coalesce(1).mapInArrow(run, "n bigint").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 8
