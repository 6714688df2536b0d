"""Registered queries of the graph operators and the DuckDB SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, checks, evaluation, features, forest, schedule
from ..operators.numbering import numbered
from ..sources import ledger
from ..storage import shuffled, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NODES = """tx_nodes AS (SELECT event_id AS tx_id, CAST(least(49, ((epoch_us(ts) - 1704067200000000) * 49) // 2592000000000 + 1) AS INTEGER) AS time_step, user_id AS actor,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS recv, user_id % 3 AS chain, CASE WHEN event_type = 'error' THEN '1' WHEN event_type IN ('purchase', 'view') THEN '2' ELSE 'unknown' END AS class,
  CAST(round(value * 100) AS BIGINT) AS amount_minor, ((event_id * 7919) % 1000) / 1000.0 AS score FROM events)"""
_EDGES = f"{_NODES}, tx_edges AS (SELECT s.tx_id AS txId1, a.tx_id AS txId2 FROM tx_nodes a ASOF JOIN tx_nodes s ON s.recv = a.actor AND a.tx_id > s.tx_id)"
_ATTRS = f"{_EDGES}, attrs AS (SELECT e.txId1, e.txId2, round(v.amount_minor / 100.0, 2) AS amount, 1200 * (greatest(u.time_step, v.time_step) - 1) AS timestamp, u.time_step AS s1, v.time_step AS s2, u.chain AS c1, v.chain AS c2 FROM tx_edges e JOIN tx_nodes u ON u.tx_id = e.txId1 JOIN tx_nodes v ON v.tx_id = e.txId2)"
_ROOTS = f"{_EDGES}, walk AS (SELECT tx_id AS node, tx_id AS root, 0 AS depth FROM tx_nodes WHERE tx_id NOT IN (SELECT txId2 FROM tx_edges) UNION ALL SELECT e.txId2, w.root, w.depth + 1 FROM walk w JOIN tx_edges e ON e.txId1 = w.node)"
_INST = f"{_ROOTS}, numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS instance_id FROM (SELECT DISTINCT root FROM walk)), inst AS (SELECT w.node, w.root, w.depth, n.instance_id FROM walk w JOIN numbers n ON n.root = w.root)"
_DIST = f"{_INST}, und AS (SELECT txId1 AS a, txId2 AS b FROM tx_edges UNION SELECT txId2, txId1 FROM tx_edges), dist AS (SELECT node AS src, node, CAST(-1 AS BIGINT) AS prev, 0 AS d FROM inst UNION ALL SELECT x.src, u.b, x.node, x.d + 1 FROM dist x JOIN und u ON u.a = x.node WHERE u.b <> x.prev)"
_ECC = f"{_DIST}, ecc AS (SELECT i.instance_id, i.root, d.src AS node, max(d.d) AS ecc FROM dist d JOIN inst i ON i.node = d.src GROUP BY ALL), anchors AS (SELECT instance_id, root, min_by(node, ecc::BIGINT * 1000000000 + node) AS anchor, min(ecc) AS max_distance FROM ecc GROUP BY ALL)"
_LABELED = f"{_NODES}, labeled AS (SELECT *, CASE class WHEN '1' THEN 1 WHEN '2' THEN 0 END AS y FROM tx_nodes WHERE class <> 'unknown')"
_STEPS = f"""{_LABELED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY time_step ORDER BY score DESC, tx_id) AS r, count(*) OVER (PARTITION BY time_step) AS c FROM labeled WHERE time_step BETWEEN 41 AND 49),
stats AS (SELECT time_step, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) AS n,
  count(*) FILTER (WHERE y = 1 AND r <= 10) AS hits, least(10, any_value(c)) AS k_effective FROM ranked GROUP BY time_step),
steps AS (SELECT CAST(t.s AS INTEGER) AS time_step, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn, coalesce(n, 0) AS n, hits, k_effective,
  CASE WHEN tp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1, hits / k_effective::DOUBLE AS precision_at_k, CASE WHEN tp + fn > 0 THEN hits::DOUBLE / (tp + fn) END AS recall_at_k FROM range(41, 50) t(s) LEFT JOIN stats ON stats.time_step = t.s)"""

#: Test schedule: phases of the drift and profiles of the registry that the queries use.
PHASES = [
    {"phase_id": "stable", "step_min": 1, "step_max": 39, "illicit_keep_probability": 1.0, "novel_profile_ids": []},
    {"phase_id": "shutdown", "step_min": 40, "step_max": 44, "illicit_keep_probability": 0.0, "novel_profile_ids": []},
    {"phase_id": "novel", "step_min": 45, "step_max": 49, "illicit_keep_probability": 0.0, "novel_profile_ids": ["wash_round_trip"]},
]
_PHASE_CASE = "CASE WHEN time_step <= 39 THEN 'stable' WHEN time_step <= 44 THEN 'shutdown' ELSE 'novel' END"

def _nest(keys) -> str:
    text = " || ':' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def query(sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH RECURSIVE " if recursive else "WITH ") + sql
        return f

    return add


def _nodes(spark, d):
    return ledger.tx_nodes(ledger.table(spark, d, "events"))


def _graph(spark, d):
    nodes = _nodes(spark, d)
    return nodes, asof.causal_edges(nodes)


def _attributed(spark, d):
    nodes = _nodes(spark, d)
    return nodes, asof.attributed_edges(nodes)


def _forest(spark, d):
    nodes, edges = _graph(spark, d)
    edges = stored(edges)
    return nodes, edges, forest.Forest(nodes, edges)


def _labeled(spark, d):
    return _nodes(spark, d).withColumn("y", evaluation.label(F.col("class"))).where("y is not null")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _round_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(f"{_NODES} SELECT tx_id, time_step, actor, recv, chain, class, amount_minor, round(score, 6) AS score FROM tx_nodes")
def tx_nodes(spark, d):
    return _rounded(_nodes(spark, d))


@query(f"{_EDGES} SELECT txId1, txId2 FROM tx_edges")
def asof_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"""{_NODES}, first AS (SELECT recv AS entity, min(tx_id) AS f FROM tx_nodes GROUP BY recv),
own AS (SELECT n.* FROM tx_nodes n LEFT JOIN first ON entity = actor WHERE f IS NULL OR f >= tx_id)
SELECT o.tx_id, min(c.entity) AS source FROM own o LEFT JOIN first c ON c.entity % 3 = o.recv % 3 AND c.f < o.tx_id AND c.entity <> o.actor AND c.entity <> o.recv GROUP BY o.tx_id""")
def fallback_source(spark, d):
    return asof.fallback_sources(_nodes(spark, d))


@query(f"{_ATTRS} SELECT txId1, txId2, amount, CAST(timestamp AS BIGINT) AS timestamp FROM attrs")
def edge_attributes(spark, d):
    return _attributed(spark, d)[1].select("txId1", "txId2", "amount", "timestamp")


_SIDES = ", ".join(
    f"{s} AS (SELECT {e} AS tx_id, count(*) AS n, sum(amount) AS s, min(amount) AS lo, max(amount) AS hi, avg(amount) AS m, stddev_samp(amount) AS sd, min(s2 - s1) AS a0, avg(s2 - s1) AS a1, max(s2 - s1) AS a2, avg(timestamp) AS w, count(*) FILTER (WHERE c1 <> c2) AS x FROM attrs GROUP BY 1)"
    for s, e in (("ins", "txId2"), ("outs", "txId1"))
)
_L = lambda x: f"ln(1 + greatest(coalesce({x}, 0), 0))"
_Z = lambda x: f"coalesce({x}, 0)::DOUBLE"
_BASE_SQL = [
    _Z("i.n"), _Z("o.n"), _L("o.s"), _L("i.s"), f"{_Z('i.s')} - {_Z('o.s')}", f"{_L('i.s')} - {_L('o.s')}", _L("i.hi"), _L("i.m"), _L("o.hi"), _L("o.m"), _L("i.lo"), _Z("i.a0"), _Z("i.a1"), _Z("i.a2"), _Z("o.a1"),
    _Z("i.m"), _Z("o.m"), _L("i.sd"), _L("o.sd"), f"{_Z('i.w')} / 3600", f"{_Z('o.w')} / 3600", "(i.n IS NOT NULL)::INT::DOUBLE", "(o.n IS NOT NULL)::INT::DOUBLE", "t.time_step / 49.0::DOUBLE",
]
_SEM = f"{_ATTRS}, {_SIDES}, sem AS (SELECT t.tx_id, " + ", ".join(f"{x} AS {n}" for x, n in zip(_BASE_SQL, features.BASE)) + ", " + ", ".join(f"(t.chain = {k})::INT::DOUBLE AS {features.CHAIN[k]}" for k in range(3)) + f", {_Z('i.x')} AS cross_chain_in, {_Z('o.x')} AS cross_chain_out FROM tx_nodes t LEFT JOIN ins i ON i.tx_id = t.tx_id LEFT JOIN outs o ON o.tx_id = t.tx_id)"


@query(f"{_SEM} SELECT tx_id, {_round_sql(features.BASE)} FROM sem")
def semantic_core(spark, d):
    return _rounded(features.semantic(*_attributed(spark, d), chains=False))


@query(f"{_SEM} SELECT tx_id, {_round_sql(features.CHAIN)} FROM sem")
def semantic_chain(spark, d):
    return _rounded(features.semantic(*_attributed(spark, d)).select("tx_id", *features.CHAIN))


def _product_sql(k: int) -> str:
    a, b, c = (features.BASE[i] for i in (k % 24, k // 24 % 24, k // 576 % 24))
    return f"round(ln(1 + abs({a}) + 1e-9) * ln(1 + abs({b}) + 1e-9) * (1 + 0.01 * abs({c})), 5) AS d{k}"


@query(f"{_SEM} SELECT tx_id, {', '.join(map(_product_sql, range(features.DERIVED)))} FROM sem")
def semantic_derived(spark, d):
    out = features.derived(features.semantic(*_attributed(spark, d), chains=False))
    return out.select("tx_id", *(F.round(F.col("derived")[k], 5).alias(f"d{k}") for k in range(features.DERIVED)))


def _structural_sql(nodes: str, edges: str) -> str:
    return f"""pairs AS (SELECT txId1, txId2, count(*) AS n FROM {edges} GROUP BY ALL), si AS (SELECT txId2 AS id, sum(n) AS n, count(*) AS u FROM pairs GROUP BY 1), so AS (SELECT txId1 AS id, sum(n) AS n, count(*) AS u FROM pairs GROUP BY 1)
SELECT t.tx_id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, coalesce(i.u, 0) AS in_unique_neighbors, coalesce(o.u, 0) AS out_unique_neighbors,
  (i.n IS NOT NULL)::INT AS has_incoming, (o.n IS NOT NULL)::INT AS has_outgoing, round(t.time_step / 49.0::DOUBLE, 6) AS step_norm FROM {nodes} t LEFT JOIN si i ON i.id = t.tx_id LEFT JOIN so o ON o.id = t.tx_id"""


@query(f"{_EDGES}, {_structural_sql('tx_nodes', 'tx_edges')}")
def structural_7(spark, d):
    return _rounded(features.structural(*_graph(spark, d)))


_MULTI = """multi AS (SELECT o_custkey AS txId1, 1000000 + l_suppkey AS txId2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
mnodes AS (SELECT c_custkey AS tx_id, c_nationkey + 1 AS time_step FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_nationkey + 1 FROM supplier)"""


@query(f"{_MULTI}, {_structural_sql('mnodes', 'multi')}")
def structural_7_parallel(spark, d):
    edges = ledger.tx_multi(ledger.table(spark, d, "orders"), ledger.table(spark, d, "lineitem"))
    c, s = ledger.table(spark, d, "customer"), ledger.table(spark, d, "supplier")
    nodes = c.select(F.col("c_custkey").alias("tx_id"), (F.col("c_nationkey") + 1).alias("time_step")).union(s.select(F.col("s_suppkey") + 1000000, F.col("s_nationkey") + 1))
    return _rounded(features.structural(nodes, edges))


_SLOTS = f"""{_NODES}, volume AS (SELECT time_step AS step, count(*) AS weight FROM tx_nodes GROUP BY 1), shares AS (SELECT step, weight * 1000 / (sum(weight) OVER ())::DOUBLE AS share FROM volume),
floors AS (SELECT step, floor(share)::BIGINT AS base, share - floor(share) AS rest, 1000 - (sum(floor(share)) OVER ())::BIGINT AS more FROM shares), counts AS (SELECT step, base + (row_number() OVER (ORDER BY rest DESC, step) <= more)::INT AS c FROM floors),
slots AS (SELECT row_number() OVER (ORDER BY step) - 1 AS slot, step FROM (SELECT step, unnest(range(c)) FROM counts))"""


@query(f"{_SLOTS} SELECT slot, step FROM slots")
def slot_allocation(spark, d):
    return schedule.slots(_nodes(spark, d).groupBy(F.col("time_step").alias("step")).agg(F.count(F.lit(1)).alias("weight")), 1000)


@query(f"{_NODES} SELECT tx_id, {_PHASE_CASE} AS phase_id, CASE WHEN time_step <= 39 THEN 1.0 ELSE 0.0 END::DOUBLE AS keep_probability FROM tx_nodes")
def phase_join(spark, d):
    return schedule.with_phase(_nodes(spark, d).select("tx_id", F.col("time_step").alias("step")), PHASES).select("tx_id", "phase_id", "keep_probability")


_PROFILES_SQL = "profiles AS (SELECT * FROM (VALUES ('ordinary_wallet', 'licit', 'ordinary'), ('mixer', 'illicit', 'illicit'), ('wash_round_trip', 'illicit', 'novel_illicit')) v(profile_id, class_policy, negative_kind))"


@query(f"{_SLOTS}, {_PROFILES_SQL} SELECT slot, step, profile_id, CASE WHEN negative_kind = 'novel_illicit' THEN step >= 45 WHEN class_policy = 'illicit' THEN step <= 39 ELSE true END AS eligible FROM slots, profiles")
def eligibility(spark, d):
    profiles = spark.createDataFrame([("ordinary_wallet", "licit", "ordinary"), ("mixer", "illicit", "illicit"), ("wash_round_trip", "illicit", "novel_illicit")], "profile_id string, class_policy string, negative_kind string")
    return schedule.eligible(schedule.with_phase(slot_allocation(spark, d), PHASES), profiles).select("slot", "step", "profile_id", "eligible")


@query(f"{_NODES}, drawn AS (SELECT tx_id, time_step, row_number() OVER (PARTITION BY time_step ORDER BY {_nest(['72', 'tx_id'])}, tx_id) AS r FROM tx_nodes) SELECT tx_id, time_step FROM drawn WHERE r <= 20")
def quota_sample(spark, d):
    return schedule.quota_sample(_nodes(spark, d).select("tx_id", "time_step"), "time_step", "tx_id", 20, 72)


@query(f"{_NODES}, drawn AS (SELECT tx_id, {_nest(['7', 'tx_id'])} AS u FROM tx_nodes) SELECT tx_id, CASE WHEN u <= 0.4 THEN 'bitcoin' WHEN u <= 0.7 THEN 'ethereum' ELSE 'tron' END AS chain_key FROM drawn")
def weighted_pick(spark, d):
    return schedule.weighted_pick(_nodes(spark, d).select("tx_id"), [("bitcoin", 0.4), ("ethereum", 0.3), ("tron", 0.3)], schedule.uniform(F.lit(7), F.col("tx_id")), "chain_key")


@query(f"{_INST} SELECT node AS tx_id, root, depth::BIGINT AS depth, instance_id FROM inst", True)
def components(spark, d):
    return _forest(spark, d)[2].instances().select(F.col("node").alias("tx_id"), "root", "depth", "instance_id")


_ROLL = f"{_INST}, members AS (SELECT i.instance_id, n.* FROM inst i JOIN tx_nodes n ON n.tx_id = i.node)"


def _members(spark, d):
    nodes, _, trees = _forest(spark, d)
    return trees.instances().select(F.col("node").alias("tx_id"), "instance_id").join(shuffled(nodes), "tx_id")


@query(f"""{_ROLL} SELECT instance_id, count(*) AS n_nodes, count(*) - 1 AS n_edges, min(time_step) AS step_min, max(time_step) AS step_max, min_by(class, tx_id) AS pattern, array_to_string(list_sort(list(DISTINCT class)), ',') AS classes,
sum(amount_minor)::BIGINT AS amount_minor FROM members GROUP BY instance_id""", True)
def instance_rollup(spark, d):
    return _members(spark, d).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.count(F.lit(1)) - 1).alias("n_edges"), F.min("time_step").alias("step_min"), F.max("time_step").alias("step_max"), F.min_by("class", "tx_id").alias("pattern"),
        F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"), F.sum("amount_minor").alias("amount_minor"))


@query(f"{_ROLL}, firsts AS (SELECT instance_id, chain, min(tx_id) AS f FROM members GROUP BY ALL) SELECT instance_id, string_agg(chain::VARCHAR, '>' ORDER BY f) AS chain_path FROM firsts GROUP BY instance_id", True)
def chain_path(spark, d):
    firsts = _members(spark, d).groupBy("instance_id", "chain").agg(F.min("tx_id").alias("f"))
    return firsts.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "chain"))), lambda x: x["chain"].cast("string")), ">").alias("chain_path"))


@query(f"{_NODES}, roles AS (SELECT actor AS entity, time_step FROM tx_nodes UNION ALL SELECT recv, time_step FROM tx_nodes) SELECT entity, min(time_step) AS first_step, max(time_step) AS last_step FROM roles GROUP BY entity")
def entity_bounds(spark, d):
    nodes = _nodes(spark, d)
    return nodes.select(F.explode(F.array("actor", "recv")).alias("entity"), "time_step").groupBy("entity").agg(F.min("time_step").alias("first_step"), F.max("time_step").alias("last_step"))


@query(f"{_EDGES} SELECT row_number() OVER (ORDER BY txId2) - 1 AS edge_id, txId1, txId2 FROM tx_edges")
def edge_ids(spark, d):
    return numbered(_graph(spark, d)[1], ["txId2"], "edge_id").select("edge_id", "txId1", "txId2")


@query(f"{_ECC} SELECT node AS tx_id, ecc::BIGINT AS ecc FROM ecc", True)
def anchor_eccentricity(spark, d):
    return _forest(spark, d)[2].eccentricities().select(F.col("node").alias("tx_id"), "ecc")


@query(f"{_ECC} SELECT instance_id, anchor, max_distance::BIGINT AS max_distance FROM anchors", True)
def central_anchor(spark, d):
    trees = _forest(spark, d)[2]
    return shuffled(trees.anchors()).join(trees.instances().where("node = root").select("root", "instance_id"), "root").select("instance_id", "anchor", "max_distance")


@query(f"{_EDGES}, ends AS (SELECT txId1 AS n, txId2 AS o FROM tx_edges UNION SELECT txId2, txId1 FROM tx_edges) SELECT n AS tx_id FROM ends GROUP BY n HAVING count(*) >= 2")
def articulation_points(spark, d):
    return _forest(spark, d)[2].articulation_points().select(F.col("node").alias("tx_id"))


@query(f"{_ECC} SELECT a.instance_id, d.d::BIGINT AS hop, string_agg(d.node::VARCHAR, ',' ORDER BY d.node) AS nodes FROM anchors a JOIN dist d ON d.src = a.anchor WHERE d.d BETWEEN 1 AND least(2, a.max_distance) GROUP BY ALL", True)
def khop_shells(spark, d):
    trees = _forest(spark, d)[2]
    ids = trees.instances().where("node = root").select("root", "instance_id")
    return shuffled(trees.shells(stored(trees.anchors()), 2)).join(ids, "root").select("instance_id", "hop", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query(f"{_ECC} SELECT instance_id, anchor FROM anchors ORDER BY instance_id LIMIT greatest(5 * (SELECT count(*) FROM tx_nodes) // 1000, 1)", True)
def anchor_selection(spark, d):
    return forest.selected_anchors(central_anchor(spark, d).select("instance_id", "anchor"), ledger.table(spark, d, "events").count(), 5)


@query(f"""{_ROLL}, r AS (SELECT instance_id, min_by(class, tx_id) AS pattern, min(time_step) AS a, max(time_step) AS b FROM members GROUP BY 1), w AS (SELECT * FROM (VALUES (0, '1', 40, 44), (1, '2', 1, 3), (2, '1', 44, 49)) v(ordinal, pattern, low, high))
SELECT r.instance_id, min(w.ordinal) AS "window" FROM r LEFT JOIN w ON w.pattern = r.pattern AND r.a <= w.high AND r.b >= w.low GROUP BY 1""", True)
def holdout_overlap(spark, d):
    windows = spark.createDataFrame([(0, "1", 40, 44), (1, "2", 1, 3), (2, "1", 44, 49)], "ordinal int, pattern string, low int, high int")
    return forest.held_out_instances(instance_rollup(spark, d), windows)


_PARTS = f"{_EDGES}, ends AS (SELECT tx_id, CASE WHEN time_step <= 30 THEN 'train' WHEN time_step <= 40 THEN 'validation' ELSE 'test' END AS p FROM tx_nodes), pe AS (SELECT e.*, u.p AS p1, v.p AS p2 FROM tx_edges e JOIN ends u ON u.tx_id = txId1 JOIN ends v ON v.tx_id = txId2)"


@query(f"{_PARTS} SELECT p1 AS part, txId1, txId2 FROM pe WHERE p1 = p2 AND txId1 <> txId2")
def partition_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return evaluation.partition_edges(edges, nodes)


@query(f"""{_PARTS} SELECT count(*) AS input, count(*) FILTER (WHERE txId1 = txId2) AS self_loops, count(*) FILTER (WHERE p1 <> p2) AS cross_partition, count(*) FILTER (WHERE p1 = p2 AND txId1 <> txId2) AS retained,
count(*) FILTER (WHERE p1 = p2 AND p1 = 'train') AS retained_train, count(*) FILTER (WHERE p1 = p2 AND p1 = 'validation') AS retained_validation, count(*) FILTER (WHERE p1 = p2 AND p1 = 'test') AS retained_test FROM pe""")
def filter_report(spark, d):
    nodes, edges = _graph(spark, d)
    return evaluation.filter_report(edges, nodes)


@query(f"{_NODES} SELECT tx_id, CASE WHEN time_step <= 30 THEN 'train' WHEN time_step <= 40 THEN 'validation' ELSE 'test' END AS part, CASE class WHEN '1' THEN 1 WHEN '2' THEN 0 END AS y, class <> 'unknown' AS labeled FROM tx_nodes")
def label_mask(spark, d):
    return _nodes(spark, d).select("tx_id", evaluation.part(F.col("time_step")).alias("part"), evaluation.label(F.col("class")).alias("y"), evaluation.label(F.col("class")).isNotNull().alias("labeled"))


def _per_step(spark, d):
    return evaluation.per_step(_labeled(spark, d).where("time_step >= 41"), 0.5, 10)


@query(f"{_STEPS} SELECT time_step, tp, fp, tn, fn, n, tp + fn AS n_positive, fp + tn AS n_negative, CASE WHEN n > 0 THEN round((tp + fn) / n, 6) END AS positive_rate, CASE WHEN n > 0 THEN 0.5::DOUBLE END AS threshold, CASE WHEN n > 0 THEN 10 END AS k, hits, k_effective, {_round_sql(['f1', 'precision_at_k', 'recall_at_k'])} FROM steps")
def confusion_per_step(spark, d):
    return _rounded(_per_step(spark, d).drop("precision", "recall").withColumn("k_effective", F.col("k_effective").cast("bigint")))


@query(f"{_STEPS} SELECT time_step, r::INTEGER AS rank, tx_id, score::DOUBLE AS score, y FROM ranked WHERE r <= 10")
def topk_per_step(spark, d):
    return evaluation.top_k(_labeled(spark, d).where("time_step >= 41"), 10, ["time_step"])


_MACRO = ["f1", "precision_at_k", "recall_at_k"]


@query(f"{_STEPS} SELECT " + ", ".join(f"round(CASE WHEN count({c}) = count(*) THEN avg({c}) END, 6) AS macro_{c}, count({c}) AS steps_{c}" for c in _MACRO) + " FROM steps")
def macro_metrics(spark, d):
    return _rounded(evaluation.macro(_per_step(spark, d), _MACRO))


@query(f"""{_STEPS} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(sum(hits) / sum(k_effective)::DOUBLE, 6) AS micro_precision_at_k,
round(sum(hits) / (sum(tp) + sum(fn))::DOUBLE, 6) AS micro_recall_at_k FROM steps WHERE n > 0""")
def micro_metrics(spark, d):
    return _rounded(evaluation.micro(_per_step(spark, d)))


_SWEEP = f"""{_LABELED}, cuts AS (SELECT i::INTEGER AS i, i * 0.01::DOUBLE AS threshold FROM range(0, 101) t(i)),
sweep AS (SELECT i, threshold, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE y = 1 AND score::DOUBLE >= threshold) / (count(*) FILTER (WHERE score::DOUBLE >= threshold) + count(*) FILTER (WHERE y = 1)), 0) AS f1 FROM cuts, (SELECT * FROM labeled WHERE time_step BETWEEN 31 AND 40) GROUP BY ALL)"""


@query(f"{_SWEEP} SELECT i, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM sweep")
def threshold_sweep(spark, d):
    return _rounded(evaluation.threshold_sweep(_labeled(spark, d).where("time_step between 31 and 40")))


@query(f"{_SWEEP} SELECT i, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM sweep ORDER BY f1 DESC, i LIMIT 1")
def best_threshold(spark, d):
    return _rounded(evaluation.best_threshold(_labeled(spark, d).where("time_step between 31 and 40")))


_SCALED = ["amount_minor", "time_step", "score"]


@query(f"{_NODES} SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale_{c}" for c in _SCALED) + " FROM tx_nodes WHERE time_step <= 30")
def scaler_fit(spark, d):
    return _rounded(evaluation.scaler(_nodes(spark, d).where("time_step <= 30"), _SCALED))


@query(f"{_NODES}, fit AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED) + " FROM tx_nodes WHERE time_step <= 30) SELECT tx_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED) + " FROM tx_nodes, fit")
def scaled_features(spark, d):
    nodes = _nodes(spark, d).select("tx_id", *_SCALED)
    return _rounded(evaluation.scaled(nodes, evaluation.scaler(_nodes(spark, d).where("time_step <= 30"), _SCALED), _SCALED))


def _p_sql(t: str, df: str) -> str:
    """One minus twice the area of Student's density from 0 to |t|, by Simpson's rule."""
    return f"""(SELECT 1 - 2 * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2)) * any_value(t) / 12000
FROM (SELECT abs({t}) AS t, ({df})::DOUBLE AS df, i FROM range(0, 4001) r(i)))"""


@query(f"{_NODES}, deltas AS (SELECT time_step, avg(score) - 0.5 AS delta FROM tx_nodes GROUP BY 1) SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t, round(avg(delta) / stddev_samp(delta), 6) AS cohen_dz, round({_p_sql('(SELECT avg(delta) / (stddev_samp(delta) / sqrt(count(*))) FROM deltas)', '(SELECT count(*) - 1 FROM deltas)')}, 6) AS p FROM deltas")
def paired_effect(spark, d):
    return _rounded(evaluation.paired_effect(_nodes(spark, d).groupBy("time_step").agg((F.avg("score") - 0.5).alias("delta"))))


@query(f"""{_NODES}, s AS (SELECT count(*) FILTER (WHERE class = '1') AS na, count(*) FILTER (WHERE class = '2') AS nb, avg(amount_minor) FILTER (WHERE class = '1') AS ma, avg(amount_minor) FILTER (WHERE class = '2') AS mb,
var_samp(amount_minor) FILTER (WHERE class = '1') AS va, var_samp(amount_minor) FILTER (WHERE class = '2') AS vb FROM tx_nodes)
SELECT na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d,
round({_p_sql('(SELECT (ma - mb) / sqrt(va / na + vb / nb) FROM s)', '(SELECT pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) FROM s)')}, 6) AS p FROM s""")
def welch(spark, d):
    out = evaluation.welch(_nodes(spark, d), "class", "amount_minor", "1", "2")
    return _rounded(out).withColumn("df", F.round("df", 4))


@query("ids AS (SELECT event_id AS id FROM events WHERE event_id % 7 <> 0), e AS (SELECT event_id AS txId1, event_id + 1 AS txId2 FROM events) SELECT txId1, txId2 FROM e WHERE txId1 NOT IN (SELECT id FROM ids) OR txId2 NOT IN (SELECT id FROM ids)")
def orphans(spark, d):
    events = ledger.table(spark, d, "events")
    edges = events.select(F.col("event_id").alias("txId1"), (F.col("event_id") + 1).alias("txId2"))
    return checks.orphans(edges, events.where("event_id % 7 <> 0").select(F.col("event_id").alias("tx_id")))


@query(f"{_MULTI} SELECT txId1, txId2, count(*) AS n FROM multi GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return checks.duplicates(ledger.tx_multi(ledger.table(spark, d, "orders"), ledger.table(spark, d, "lineitem")), ["txId1", "txId2"])


@query("s AS (SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n, min(event_id) AS least, max(event_id) AS greatest FROM events) SELECT *, n = distinct_n AND least = 0 AND greatest = n - 1 AS ok FROM s")
def contiguity(spark, d):
    return checks.contiguity(ledger.table(spark, d, "events"), "event_id")


@query(f"{_NODES}, e AS (SELECT txId1, txId2 FROM (SELECT tx_id AS txId1, (tx_id * 31 + 7) % (SELECT count(*) FROM tx_nodes) AS txId2 FROM tx_nodes)) SELECT e.txId1, e.txId2, u.time_step AS s1, v.time_step AS s2 FROM e JOIN tx_nodes u ON u.tx_id = txId1 JOIN tx_nodes v ON v.tx_id = txId2 WHERE txId1 >= txId2 OR u.time_step > v.time_step")
def causality_violations(spark, d):
    nodes = _nodes(spark, d)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    edges = nodes.select("tx_id").crossJoin(F.broadcast(n)).select(F.col("tx_id").alias("txId1"), ((F.col("tx_id") * 31 + 7) % F.col("n")).alias("txId2"))  # one row
    return checks.causality_violations(edges, nodes)


@query(f"""{_NODES}, p AS (SELECT {_PHASE_CASE} AS phase_id, class FROM tx_nodes), keys AS (SELECT * FROM (VALUES ('stable'), ('shutdown'), ('novel')) a(phase_id), (VALUES ('1'), ('2'), ('unknown'), ('other')) b(class))
SELECT k.phase_id, k.class, count(p.class) AS n FROM keys k LEFT JOIN p ON p.phase_id = k.phase_id AND p.class = k.class GROUP BY ALL""")
def drift_realized(spark, d):
    keys = spark.createDataFrame([(p["phase_id"], c) for p in PHASES for c in ("1", "2", "unknown", "other")], "phase_id string, class string")
    got = schedule.with_phase(_nodes(spark, d).select("class", F.col("time_step").alias("step")), PHASES).groupBy("phase_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(got, ["phase_id", "class"], "left").fillna(0)


@query(f"{_NODES}, c AS (SELECT *, CASE chain WHEN 0 THEN 'bip122:000000000019d6689c085ae165831e93' WHEN 1 THEN 'eip155:1' ELSE 'eip155:728126428' END AS chain_id FROM tx_nodes) SELECT tx_id, CASE WHEN chain_id = 'eip155:1' THEN '0x' ELSE '' END || sha256('72:behavior:tx:' || tx_id || ':' || chain_id) AS native_tx_id FROM c")
def native_ids(spark, d):
    from ..simulation.registry import CHAINS, native_tx_id

    chain = F.when(F.col("chain") == 0, CHAINS["bitcoin"]["chain_id"]).when(F.col("chain") == 1, CHAINS["ethereum"]["chain_id"]).otherwise(CHAINS["tron"]["chain_id"])
    return _nodes(spark, d).select("tx_id", native_tx_id(72, F.col("tx_id"), chain).alias("native_tx_id"))


@query(f"{_NODES}, a AS (SELECT DISTINCT actor AS entity FROM tx_nodes), r AS (SELECT DISTINCT recv AS entity FROM tx_nodes) SELECT entity, 'left' AS side FROM a WHERE entity NOT IN (SELECT entity FROM r) UNION ALL SELECT entity, 'right' FROM r WHERE entity NOT IN (SELECT entity FROM a)")
def coverage_diff(spark, d):
    nodes = _nodes(spark, d)
    return checks.coverage_diff(nodes.select(F.col("actor").alias("entity")), nodes.select(F.col("recv").alias("entity")), "entity")


@query(f"{_EDGES}, numbered AS (SELECT row_number() OVER (ORDER BY txId2) - 1 AS edge_id, txId2 FROM tx_edges) SELECT n.tx_id AS event_id, m.edge_id, n.chain AS source_chain, n.recv % 3 AS target_chain FROM tx_nodes n LEFT JOIN numbered m ON m.txId2 = n.tx_id WHERE n.chain <> n.recv % 3")
def bridge_records(spark, d):
    nodes, edges = _graph(spark, d)
    ids = numbered(edges, ["txId2"], "edge_id").select("edge_id", F.col("txId2").alias("tx_id"))
    return nodes.where("chain <> recv % 3").join(ids, "tx_id", "left").select(F.col("tx_id").alias("event_id"), "edge_id", F.col("chain").alias("source_chain"), (F.col("recv") % 3).alias("target_chain"))


_PROP = f"{_EDGES}, x0 AS (SELECT tx_id, amount_minor::DOUBLE AS a, score::DOUBLE AS s FROM tx_nodes), x1 AS (SELECT t.tx_id, coalesce(avg(x.a), 0) AS a, coalesce(avg(x.s), 0) AS s FROM tx_nodes t LEFT JOIN tx_edges e ON e.txId1 = t.tx_id LEFT JOIN x0 x ON x.tx_id = e.txId2 GROUP BY 1), x2 AS (SELECT t.tx_id, coalesce(avg(x.a), 0) AS a, coalesce(avg(x.s), 0) AS s FROM tx_nodes t LEFT JOIN tx_edges e ON e.txId1 = t.tx_id LEFT JOIN x1 x ON x.tx_id = e.txId2 GROUP BY 1)"


@query(f"{_PROP} SELECT x0.tx_id, round(x0.a, 6) AS a, round(x0.s, 6) AS s, round(x1.a, 6) AS a_1, round(x1.s, 6) AS s_1, round(x2.a, 6) AS a_2, round(x2.s, 6) AS s_2 FROM x0 JOIN x1 ON x1.tx_id = x0.tx_id JOIN x2 ON x2.tx_id = x0.tx_id")
def sgc_propagate(spark, d):
    nodes, edges = _graph(spark, d)
    x = nodes.select("tx_id", F.col("amount_minor").cast("double").alias("a"), F.col("score").cast("double").alias("s"))
    return _rounded(features.propagated(x, stored(edges), ["a", "s"]))


# Models, sequential methods and generated tables: no SQL can express them.
def _fitted(spark, d, kind: str):
    """(rows, columns, model): an arm fitted on the train part of the event graph."""
    from . import protocol

    nodes, edges = _graph(spark, d)
    rows, parted = protocol.views(nodes.select("tx_id", "time_step", "class"), stored(edges))
    rows = evaluation.scaled(rows, evaluation.scaler(rows.where("part = 'train'"), protocol.FEATURES), protocol.FEATURES)
    columns = protocol.FEATURES
    if kind == "sgc":
        rows, columns = protocol._propagated(rows, parted)
    return rows, columns, protocol.fit(kind, rows.where("part = 'train'"), columns, 0)


def _model_scores(spark, d, kind: str):
    from . import protocol

    rows, columns, model = _fitted(spark, d, kind)
    return protocol.scores(model, rows, columns)


@query()
def rf_scores(spark, d):
    return _model_scores(spark, d, "rf")


@query()
def sgc_scores(spark, d):
    return _model_scores(spark, d, "sgc")


from . import contract_queries, ledger_queries  # noqa: E402, F401  register their queries
