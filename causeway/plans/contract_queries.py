"""Registered queries of files, contracts, graphs of any shape, views and training helpers, with their SQL."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import networks, training
from ..operators import biconnected, evaluation, graph, shuffle
from ..simulation import bundle, validate
from ..sources import json_ranges, raw, single_file
from ..sources.rows import with_rows
from ..sources.single_file import write_csv
from ..storage import shared_folder, stored
from . import ledger_queries, protocol
from . import queries as base
from .queries import query

_SEEDS = {"train": 0, "validation": 1, "test": 3}


def _lines(folder, name: str, df: DataFrame, order: str, header: bool = True):
    path = folder / name
    write_csv(df, path, [order], header)
    return path


@query(f"{base._NODES} SELECT s::INTEGER AS step, count(tx_id) AS weight FROM range(1, 50) r(s) LEFT JOIN tx_nodes ON time_step = s GROUP BY s")
def volume_scan(spark, d):
    """A volume profile of 49 whole numbers, written and read as a NumPy file."""
    folder, counts = shared_folder(spark), np.zeros(49, np.int64)
    for r in base._nodes(spark, d).groupBy("time_step").count().collect():  # 49 steps
        counts[r["time_step"] - 1] = r["count"]
    np.save(folder / "volume.npy", counts)
    return bundle.volume(spark, folder)


@query(f"{base._EDGES} SELECT row_number() OVER (ORDER BY txId2) - 1 AS row, txId1, txId2 FROM tx_edges")
def edge_file_scan(spark, d):
    """Edges written as one CSV file in order and read in parts, with their row numbers."""
    folder = shared_folder(spark)
    _lines(folder, bundle.FILES["edgelist"], base._graph(spark, d)[1].select("txId1", "txId2"), "txId2")
    return bundle.read_table(spark, folder, "edgelist").withColumnRenamed("__row", "row")


@query(f"{base._ATTRS} SELECT row_number() OVER (ORDER BY txId2) - 1 AS row, txId1, txId2, amount, timestamp::BIGINT AS timestamp FROM attrs")
def attribute_file_scan(spark, d):
    """Edge attributes, likewise."""
    folder = shared_folder(spark)
    _lines(folder, bundle.FILES["edge_attributes"], base.edge_attributes(spark, d), "txId2")
    return bundle.read_table(spark, folder, "edge_attributes").withColumnRenamed("__row", "row")


def _raw_folder(spark, d):
    """The event graph as a raw directory, 165 columns of which follow from the ids."""
    folder, (nodes, edges) = shared_folder(spark), base._graph(spark, d)
    edges = stored(edges)  # else found twice, as the sort samples them first
    columns = [F.col("tx_id"), F.col("time_step"), *[(F.col("tx_id") * k % 1000 / 8).alias(f"feat_{k}") for k in range(2, bundle.FEATURES + 2)]]
    single_file.write_pieces(folder / raw.RAW["features"], [single_file.number_rows(nodes.select("tx_id", "time_step"), ["tx_id"], columns)])
    _lines(folder, raw.RAW["classes"], nodes.select(F.col("tx_id").alias("txId"), "class"), "txId")
    _lines(folder, raw.RAW["edgelist"], edges.select("txId1", "txId2"), "txId2")
    return folder


@query(f"{base._NODES} SELECT tx_id, time_step, class FROM tx_nodes")
def raw_scan(spark, d):
    """A raw directory of 167 columns, read strictly and checked against every rule."""
    return protocol.load_graph(spark, _raw_folder(spark, d))[0]


@query(f"{base._NODES} SELECT tx_id, time_step FROM tx_nodes")
def raw_scan_pruned(spark, d):
    """The same without its 165 values, which are neither parsed nor checked."""
    return raw.read(spark, _raw_folder(spark, d), check_values=False)["features"].select(F.col("txId").alias("tx_id"), "time_step")


@query(f"{base._NODES} SELECT tx_id, time_step, list_sum([(tx_id * k) % 1000 / 8 FOR k IN range(2, {bundle.FEATURES + 2})]) AS total, (tx_id * {bundle.FEATURES + 1}) % 1000 / 8 AS last FROM tx_nodes")
def raw_values(spark, d):
    """The 165 values of every row of a raw directory, summed, and the last one."""
    rows = raw.read(spark, _raw_folder(spark, d), with_values=True)["features"]
    return rows.select(F.col("txId").alias("tx_id"), "time_step", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("features", -1).alias("last"))


_TEXTS = "CASE event_id % 9 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '-4' WHEN 2 THEN '1.0' WHEN 3 THEN 'x' || event_id WHEN 4 THEN '9223372036854775808' WHEN 5 THEN '9223372036854775807' WHEN 6 THEN '' WHEN 7 THEN '007' ELSE NULL END"


@query(f"texts AS (SELECT event_id, {_TEXTS} AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(v, '[0-9]+') THEN TRY_CAST(v AS BIGINT) END AS value FROM texts")
def integer_coercion(spark, d):
    """Texts that are whole numbers from 0 to the greatest bigint; others are null, which is a fault of their column."""
    e = base.ledger.table(spark, d, "events").select("event_id", F.expr("case event_id % 9 when 0 then cast(event_id as string) when 1 then '-4' when 2 then '1.0' when 3 then 'x' || event_id when 4 then '9223372036854775808' when 5 then '9223372036854775807' when 6 then '' when 7 then '007' end").alias("v"))
    return e.select("event_id", raw.integer(F.col("v")).alias("value"))


@query(f"texts AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN 'abc' WHEN 4 THEN '-1.5e3' ELSE '1e999' END AS v FROM events) SELECT event_id, coalesce(isfinite(TRY_CAST(v AS DOUBLE)), false) AS ok FROM texts")
def finite_values(spark, d):
    """Which texts are finite numbers."""
    e = base.ledger.table(spark, d, "events").select("event_id", F.expr("case event_id % 6 when 0 then cast(value as string) when 1 then 'nan' when 2 then 'inf' when 3 then 'abc' when 4 then '-1.5e3' else '1e999' end").alias("v"))
    return e.select("event_id", raw.finite(F.col("v")).alias("ok"))


@query(f"""{base._EDGES}, f AS (SELECT tx_id AS row, CASE WHEN tx_id % 500 = 7 THEN tx_id - 1 ELSE tx_id END AS txId, CASE WHEN tx_id % 300 = 5 THEN 50 ELSE time_step END AS time_step FROM tx_nodes),
c AS (SELECT tx_id AS row, tx_id AS txId, CASE WHEN tx_id % 400 = 9 THEN '3' ELSE class END AS class FROM tx_nodes),
e AS (SELECT txId1, CASE WHEN txId2 % 250 = 3 THEN txId1 WHEN txId2 % 250 = 4 THEN -1 WHEN txId2 % 250 = 5 THEN txId2 + 1000000000 ELSE txId2 END AS txId2 FROM tx_edges UNION ALL SELECT txId1, txId2 FROM tx_edges WHERE txId2 % 350 = 1 AND txId2 % 250 NOT IN (3, 4, 5))
SELECT 'RAW_ID_DUPLICATE' AS code, (SELECT count(*) FROM (SELECT txId FROM f GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'RAW_ID_ORDER', (SELECT count(*) FROM f JOIN c USING (row) WHERE f.txId <> c.txId)
UNION ALL SELECT 'RAW_ORPHAN_EDGE', (SELECT count(*) FROM (SELECT DISTINCT txId1, txId2 FROM e WHERE txId1 NOT IN (SELECT txId FROM f) OR txId2 NOT IN (SELECT txId FROM f))) UNION ALL SELECT 'RAW_CLASS_VALUE', (SELECT count(*) FROM c WHERE class = '3')
UNION ALL SELECT 'RAW_ID_SEQUENCE', (SELECT count(*) FROM f WHERE txId <> row) UNION ALL SELECT 'RAW_EDGE_RANGE', (SELECT count(*) FROM e WHERE greatest(txId1, txId2) >= (SELECT count(*) FROM f))
UNION ALL SELECT 'RAW_TIME_STEP', (SELECT count(*) FROM f WHERE time_step = 50) UNION ALL SELECT 'RAW_SELF_LOOP', (SELECT count(*) FROM e WHERE txId1 = txId2) UNION ALL SELECT 'RAW_DUPLICATE_EDGE', (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY txId1, txId2 HAVING count(*) > 1))""")
def raw_faults(spark, d):
    """The rows at fault by code, of tables that break every rule of a raw directory."""
    nodes, edges = base._graph(spark, d)
    edges, i = stored(edges), F.col("tx_id")
    f = nodes.select(i.alias("row"), F.when(i % 500 == 7, i - 1).otherwise(i).alias("txId"), F.when(i % 300 == 5, 50).otherwise(F.col("time_step")).alias("time_step"))
    c = nodes.select(i.alias("row"), i.alias("txId"), F.when(i % 400 == 9, "3").otherwise(F.col("class")).alias("class"))
    v = F.col("txId2")
    moved = edges.select("txId1", F.when(v % 250 == 3, F.col("txId1")).when(v % 250 == 4, -1).when(v % 250 == 5, v + 1_000_000_000).otherwise(v).alias("txId2"))
    again = edges.where((v % 350 == 1) & ~(v % 250).isin(3, 4, 5)).select("txId1", "txId2")
    out = None
    for code, rows in raw.contract_faults({"features": f, "classes": c, "edgelist": moved.union(again)}, True):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")
        out = one if out is None else out.union(one)
    return out.groupBy("code").agg(F.sum("n").alias("n"))


@query(f"{base._EDGES} SELECT 'edgelist' AS name, sha256('txId1,txId2' || chr(10) || string_agg(txId1 || ',' || txId2 || chr(10), '' ORDER BY txId2)) AS sha256 FROM tx_edges")
def file_digest(spark, d):
    """SHA-256 of a CSV file that the sink wrote."""
    path = _lines(shared_folder(spark), "edges.csv", base._graph(spark, d)[1].select("txId1", "txId2"), "txId2")
    return spark.createDataFrame([("edgelist", bundle.sha256(path))], "name string, sha256 string")


_PARTED = f"{base._PARTS}, parted AS (SELECT p1 AS part, txId1, txId2 FROM pe WHERE p1 = p2 AND txId1 <> txId2)"


@query(f"{_PARTED} SELECT part, sha256('txId1,txId2' || chr(10) || string_agg(txId1 || ',' || txId2 || chr(10), '' ORDER BY txId1, txId2)) AS sha256 FROM parted GROUP BY part")
def edge_table_digest(spark, d):
    """The digest of each partition's edges as CSV text."""
    return shuffle.edge_digest(base.partition_edges(spark, d))


#: Rounds that the SQL of the shuffle plays; the parts of the event graph have used up their budgets before.
_ROUNDS = 9


def _shuffle_sql() -> str:
    """The rounds of the edge shuffle one by one: dealing, proposals, clashes, swaps and what is left of the budgets."""
    seeds = "CASE part " + " ".join(f"WHEN '{p}' THEN {s}" for p, s in _SEEDS.items()) + " END"
    out = [f"{_PARTED}, s0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY txId1, txId2) - 1 AS edge, txId1 AS u, txId2 AS v, txId2 AS was FROM parted)",
           f"b0 AS MATERIALIZED (SELECT part, {seeds} AS seed, count(*) AS n, 0::BIGINT AS tries, 0::BIGINT AS swaps FROM parted GROUP BY part)"]
    own = lambda u, v: f"(u1 = {u} AND v1 = {v})::INT + (u2 = {u} AND v2 = {v})::INT"
    for r in range(_ROUNDS):
        out += [
            f"g{r} AS MATERIALIZED (SELECT s.*, n, tries, swaps, md5(seed || ':{r}:' || edge) AS draw FROM s{r} s JOIN b{r} USING (part) WHERE n > 1 AND swaps < n AND tries < 20 * n)",
            f"d{r} AS (SELECT *, ('0x' || draw[1:12])::BIGINT % greatest(n // 2, 1) AS bucket FROM g{r})", f"i{r} AS (SELECT *, row_number() OVER (PARTITION BY part, bucket ORDER BY draw, edge) - 1 AS i FROM d{r})",
            f"""p{r} AS MATERIALIZED (SELECT a.part, a.edge AS pair, b.edge AS other, a.draw, a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2, a.n - a.swaps AS room FROM i{r} a JOIN i{r} b ON a.part = b.part AND a.bucket = b.bucket AND a.i % 2 = 0 AND b.i = a.i + 1
  QUALIFY row_number() OVER (PARTITION BY a.part ORDER BY a.draw, a.edge) <= 20 * a.n - a.tries)""",
            f"o{r} AS MATERIALIZED (SELECT * FROM p{r} WHERE u1 <> v2 AND u2 <> v1 AND NOT (u1 = u2 AND v1 = v2))", f"w{r} AS (SELECT part, pair, u1 AS u, v2 AS v, {own('u1', 'v2')} AS mine FROM o{r} UNION ALL SELECT part, pair, u2, v1, {own('u2', 'v1')} FROM o{r})",
            f"c{r} AS (SELECT part, u, v, count(*) AS wishes FROM w{r} GROUP BY ALL), h{r} AS (SELECT part, u, v, count(*) AS there FROM g{r} GROUP BY ALL)",
            f"f{r} AS (SELECT w.part, w.pair FROM w{r} w JOIN c{r} c USING (part, u, v) LEFT JOIN h{r} h USING (part, u, v) WHERE wishes = 1 AND coalesce(there, 0) = mine GROUP BY ALL HAVING count(*) = 2)",
            f"t{r} AS MATERIALIZED (SELECT o.* FROM o{r} o JOIN f{r} USING (part, pair) QUALIFY row_number() OVER (PARTITION BY part ORDER BY draw, pair) <= room)",
            f"m{r} AS (SELECT part, pair AS edge, v2 AS new FROM t{r} UNION ALL SELECT part, other, v1 FROM t{r})", f"s{r + 1} AS MATERIALIZED (SELECT s.part, s.edge, s.u, coalesce(m.new, s.v) AS v, s.was FROM s{r} s LEFT JOIN m{r} m USING (part, edge))",
            f"b{r + 1} AS MATERIALIZED (SELECT part, seed, n, tries + (SELECT count(*) FROM p{r} x WHERE x.part = b.part) AS tries, swaps + (SELECT count(*) FROM t{r} x WHERE x.part = b.part) AS swaps FROM b{r} b)"]
    return ", ".join(out)


@query(f"{_shuffle_sql()} SELECT part, u AS txId1, v AS txId2 FROM s{_ROUNDS}")
def edge_shuffle(spark, d):
    """The edges of each part with shuffled targets, edge by edge as the rounds give them."""
    return shuffle.shuffled(base.partition_edges(spark, d), _SEEDS)[0]


@query(f"{_PARTED}, o AS (SELECT part, txId1 AS tx_id, count(*) AS n_out FROM parted GROUP BY ALL), i AS (SELECT part, txId2 AS tx_id, count(*) AS n_in FROM parted GROUP BY ALL) SELECT coalesce(o.part, i.part) AS part, coalesce(o.tx_id, i.tx_id) AS tx_id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i ON o.part = i.part AND o.tx_id = i.tx_id")
def edge_shuffle_degrees(spark, d):
    """Degrees in the shuffled graph, which must be those of the graph it came from."""
    moved, _ = shuffle.shuffled(base.partition_edges(spark, d), _SEEDS)
    return moved.select("part", F.explode(F.array(F.struct(F.col("txId1").alias("tx_id"), F.lit(1).alias("o")), F.struct(F.col("txId2").alias("tx_id"), F.lit(0).alias("o")))).alias("x")).groupBy("part", "x.tx_id").agg(F.sum("x.o").alias("n_out"), (F.count(F.lit(1)) - F.sum("x.o")).alias("n_in"))


@query(f"""{_shuffle_sql()}, k AS (SELECT part, count(*) FILTER (WHERE v <> was) AS changed, count(*) FILTER (WHERE u = v) AS loops, count(*) - count(DISTINCT (u, v)) AS doubled FROM s{_ROUNDS} GROUP BY part)
SELECT part, b.tries AS attempts, b.swaps, round(k.changed / b.n, 6) AS changed_fraction, CASE WHEN k.changed > 0 THEN 'ok' ELSE 'not_testable' END AS status, k.loops, k.doubled FROM b{_ROUNDS} b JOIN k USING (part)""")
def edge_shuffle_report(spark, d):
    """What each part's shuffle did, and how many loops and double edges there are after it."""
    moved, told = shuffle.shuffled(base.partition_edges(spark, d), _SEEDS)
    after = moved.groupBy("part").agg(F.sum((F.col("txId1") == F.col("txId2")).cast("bigint")).alias("loops"), (F.count(F.lit(1)) - F.count_distinct("txId1", "txId2")).alias("doubled"))
    return told.join(after, "part").select("part", "attempts", "swaps", F.round("changed_fraction", 6).alias("changed_fraction"), "status", "loops", "doubled")


# graphs with cycles: siblings are linked too
_RING = f"{base._EDGES}, ring AS (SELECT txId1, txId2 FROM tx_edges UNION SELECT txId2, lead(txId2) OVER (PARTITION BY txId1 ORDER BY txId2) FROM tx_edges QUALIFY lead(txId2) OVER (PARTITION BY txId1 ORDER BY txId2) IS NOT NULL), und AS (SELECT txId1 AS a, txId2 AS b FROM ring UNION SELECT txId2, txId1 FROM ring)"


def _ring(spark, d) -> DataFrame:
    from pyspark.sql import Window

    edges = base._graph(spark, d)[1]
    follows = F.lead("txId2").over(Window.partitionBy("txId1").orderBy("txId2"))
    return stored(edges.union(edges.select("txId2", follows.alias("b")).where("b is not null")))


@query(f"{_RING}, walk AS (SELECT a AS src, a AS node FROM und UNION SELECT w.src, u.b FROM walk w JOIN und u ON u.a = w.node) SELECT src AS node, min(node) AS component FROM walk GROUP BY src", True)
def graph_components(spark, d):
    """Components of a graph with cycles."""
    return graph.components(_ring(spark, d), "txId1", "txId2")


@query(f"{_RING}, walk AS (SELECT DISTINCT a AS source, a AS node, 0 AS d FROM und WHERE a % 7 = 0 UNION SELECT w.source, u.b, w.d + 1 FROM walk w JOIN und u ON u.a = w.node WHERE w.d < 4) SELECT source, node, min(d)::INTEGER AS d FROM walk GROUP BY ALL", True)
def bfs_layers(spark, d):
    """Breadth-first distances of up to four steps from every seventh node."""
    ring = _ring(spark, d)
    return graph.layers(ring, graph.neighbours(ring).where("node % 7 = 0").select(F.col("node").alias("source")), 4)


@query(f"""{_RING}, comp AS (SELECT src AS node, min(node) AS component FROM (WITH RECURSIVE w AS (SELECT a AS src, a AS node FROM und UNION SELECT w.src, u.b FROM w JOIN und u ON u.a = w.node) SELECT * FROM w) GROUP BY src), big AS (SELECT component, count(*) AS size FROM comp GROUP BY 1),
start AS (SELECT u.a AS gone, min(u.b) AS node FROM und u GROUP BY 1), reach AS (SELECT gone, node FROM start UNION SELECT r.gone, u.b FROM reach r JOIN und u ON u.a = r.node WHERE u.b <> r.gone)
SELECT c.component, r.gone AS node FROM (SELECT gone, count(*) AS n FROM reach GROUP BY 1) r JOIN comp c ON c.node = r.gone JOIN big b USING (component) WHERE r.n < b.size - 1""", True)
def graph_articulation_points(spark, d):
    """Nodes without which a component with cycles falls apart."""
    return biconnected.articulation_points(_ring(spark, d))


_ALL_PAIRS = f"{_RING}, walk(src, node, d) USING KEY (src, node) AS (SELECT DISTINCT a, a, 0 FROM und UNION SELECT w.src, u.b, w.d + 1 FROM walk w JOIN und u ON u.a = w.node LEFT JOIN recurring.walk r ON r.src = w.src AND r.node = u.b WHERE r.d IS NULL), ecc AS (SELECT src AS node, min(node) AS component, max(d) AS ecc FROM walk GROUP BY src), centre AS (SELECT component, min(node) AS anchor, min(ecc) AS max_distance FROM ecc e WHERE ecc = (SELECT min(ecc) FROM ecc i WHERE i.component = e.component) GROUP BY component)"


@query(f"{_ALL_PAIRS} SELECT node, component, ecc FROM ecc", True)
def graph_eccentricities(spark, d):
    """The distance of every node of a graph with cycles to the farthest node of its component."""
    return graph.eccentricities(_ring(spark, d))


@query(f"{_ALL_PAIRS} SELECT component, anchor, max_distance FROM centre", True)
def graph_centres(spark, d):
    """The central anchor of every component with cycles, and its eccentricity."""
    return graph.centres(_ring(spark, d))


@query(f"{_ALL_PAIRS} SELECT w.src AS anchor, w.d AS hop, string_agg(w.node::VARCHAR, ',' ORDER BY w.node) AS nodes FROM walk w JOIN centre c ON c.anchor = w.src WHERE w.d BETWEEN 1 AND least(3, c.max_distance) GROUP BY ALL", True)
def graph_khop_shells(spark, d):
    """The nodes around each central anchor by distance, in a graph with cycles."""
    ring = _ring(spark, d)
    found = graph.shells(ring, stored(graph.centres(ring).select("anchor", "max_distance")), 3)
    return found.select("anchor", "hop", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


_FAR = f"{_RING}, walk AS (SELECT DISTINCT a AS source, a AS node, 0 AS d FROM und WHERE a % 5 = 0 UNION SELECT w.source, u.b, w.d + 1 FROM walk w JOIN und u ON u.a = w.node WHERE w.d < 2), close AS (SELECT DISTINCT source AS a, node AS b FROM walk WHERE d > 0 AND source <> node AND node % 5 = 0)"


@query(f"{_FAR} SELECT a, b FROM close", True)
def anchors_too_close(spark, d):
    """Pairs of anchors less than three steps apart."""
    ring = _ring(spark, d)
    return graph.too_close(graph.neighbours(ring).where("node % 5 = 0").select(F.col("node").alias("anchor")).distinct(), ring, 3)


@query(f"{_FAR}, list AS (SELECT a, list(b) AS bs FROM close GROUP BY 1), anchors AS (SELECT anchor, row_number() OVER (ORDER BY anchor) AS i, coalesce(bs, []) AS bs FROM (SELECT DISTINCT a AS anchor FROM und WHERE a % 5 = 0) LEFT JOIN list ON a = anchor),"
       " kept AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS k UNION ALL SELECT n.i, CASE WHEN list_has_any(k, n.bs) THEN k ELSE list_append(k, n.anchor) END FROM kept JOIN anchors n ON n.i = kept.i + 1) SELECT unnest(k) AS anchor FROM kept WHERE i = (SELECT max(i) FROM kept)", True)  # fmt: skip
def spaced_anchors(spark, d):
    """Anchors in order, each at least three steps from all kept before."""
    ring = _ring(spark, d)
    anchors = graph.neighbours(ring).where("node % 5 = 0").select(F.col("node").alias("anchor"), F.col("node").alias("ordinal")).distinct()
    return graph.spaced(anchors, ring, 3).select("anchor")


# views and training
_VIEWS = f"{_PARTED}, {base._structural_sql('tx_nodes', 'parted').replace('SELECT t.tx_id', ', views AS (SELECT t.tx_id', 1)}), kinds AS (SELECT tx_id, CASE WHEN time_step <= 30 THEN 'train' WHEN time_step <= 40 THEN 'validation' ELSE 'test' END AS part, CASE class WHEN '1' THEN 1 WHEN '2' THEN 0 END AS y FROM tx_nodes)"


@query(f"{_VIEWS} SELECT v.*, k.part, k.y FROM views v JOIN kinds k USING (tx_id)")
def partition_views(spark, d):
    """The structural seven of each partition's own edges, with part and label."""
    nodes, edges = base._graph(spark, d)
    rows, _ = protocol.views(nodes.select("tx_id", "time_step", "class"), edges)
    counts = [F.col(c).cast("bigint").alias(c) for c in protocol.FEATURES[:4]] + [F.col(c).cast("int").alias(c) for c in protocol.FEATURES[4:6]]
    return rows.select("tx_id", *counts, F.round("step_norm", 6).alias("step_norm"), "part", "y")


@query(f"{_VIEWS} SELECT k.tx_id, k.part, k.y, k.y IS NOT NULL AND k.part = 'train' AS fit, k.y IS NOT NULL AND k.part = 'validation' AS judge FROM kinds k WHERE k.part <> 'test'")
def stacked_views(spark, d):
    """Train and validation as one graph with the masks to fit on and to stop by."""
    rows = base.label_mask(spark, d).drop("labeled")
    return evaluation.stacked(rows.where("part = 'train'"), rows.where("part = 'validation'"))


@query(f"{base._LABELED}, n AS (SELECT count(*) AS a, sum(y) AS p FROM labeled WHERE time_step <= 30) SELECT tx_id, round(a / (2.0 * CASE WHEN y = 1 THEN p ELSE a - p END), 6) AS weight FROM labeled, n WHERE time_step <= 30")
def balanced_weights(spark, d):
    """Weights by which both classes of the train part count alike."""
    return base._rounded(evaluation.balanced(base._labeled(spark, d).where("time_step <= 30")).select("tx_id", "weight"))


@query(f"{base._NODES} SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(greatest(stddev_samp({c}), 1e-6), 6) AS scale_{c}" for c in base._SCALED) + ", 0.5::DOUBLE AS mean_flat, 1e-6::DOUBLE AS scale_flat FROM tx_nodes WHERE time_step <= 30")
def clamped_scaler_fit(spark, d):
    """Means and sample deviations, which are never under a bound."""
    out = evaluation.clamped_scaler(base._nodes(spark, d).where("time_step <= 30").withColumn("flat", F.lit(0.5)), [*base._SCALED, "flat"])
    return base._rounded(out)


@query(f"{base._LABELED}, s AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn FROM labeled) SELECT round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, 0.0::DOUBLE AS f1_of_none FROM s")
def training_f1(spark, d):
    """f1 as training compares it: 0 where it is undefined."""
    rows = base._labeled(spark, d)
    return base._rounded(evaluation.binary_f1(rows).crossJoin(evaluation.binary_f1(rows.limit(0)).withColumnRenamed("f1", "f1_of_none")))


@query(f"{base._LABELED}, t(s) AS (SELECT * FROM range(31, 41)) SELECT s::INTEGER AS time_step, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn FROM t LEFT JOIN labeled ON time_step = s GROUP BY s")
def view_steps(spark, d):
    """Counts by step over the part that a view's steps lie in."""
    return evaluation.view_metrics(base._labeled(spark, d).where("time_step between 33 and 39").union(base._labeled(spark, d).where("time_step in (31, 32, 40)")), 0.5, 10).select("time_step", "tp", "fp", "tn", "fn")


@query(f"""{base._LABELED}, s AS (SELECT tx_id % 4 AS seed, tx_id % 3 AS arm, avg(score) AS v, count(DISTINCT time_step) AS steps FROM labeled GROUP BY ALL), n AS (SELECT arm, CASE WHEN arm = 2 AND seed = 1 THEN NULL ELSE v END AS v, steps FROM s)
SELECT arm::BIGINT AS arm, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS v_mean, min(steps) AS steps_min FROM n GROUP BY arm""")
def seed_means(spark, d):
    """Means over seeds by arm, null if one seed's value is, and the least coverage."""
    s = base._labeled(spark, d).groupBy((F.col("tx_id") % 4).alias("seed"), (F.col("tx_id") % 3).alias("arm")).agg(F.avg("score").alias("v"), F.count_distinct("time_step").alias("steps"))
    return base._rounded(evaluation.over_seeds(s.withColumn("v", F.when(~((F.col("arm") == 2) & (F.col("seed") == 1)), F.col("v"))), "arm", ["v"], "steps"))


@query(f"""{ledger_queries._EVENTS}, e AS (SELECT profile_id, count(*) AS n FROM people GROUP BY 1), t AS (SELECT profile_id, count(*) AS n FROM events_made GROUP BY 1) SELECT e.profile_id, e.n AS entity_count, t.n AS tx_count, true AS met FROM e JOIN t USING (profile_id)""")
def quota_counts(spark, d):
    """Entities and transactions of each profile against its quota."""
    made = ledger_queries.made(spark, d)
    e, t = made.entities.groupBy("profile_id").agg(F.count(F.lit(1)).alias("entity_count")), made.events.groupBy("profile_id").agg(F.count(F.lit(1)).alias("tx_count"))
    want = spark.createDataFrame([(p, n, x) for p, (n, x) in made.config.quotas.items()], "profile_id string, n bigint, x bigint")
    return e.join(t, "profile_id", "full").join(want, "profile_id", "full").select("profile_id", "entity_count", "tx_count", (F.col("entity_count").eqNullSafe(F.col("n")) & F.col("tx_count").eqNullSafe(F.col("x"))).alias("met"))


@query(f"""{ledger_queries._TREES}, n AS (SELECT count(*) AS n FROM events_made), i AS (SELECT count(DISTINCT instance_id) AS i FROM member), e AS (SELECT count(*) AS e FROM edges_made), b AS (SELECT count(*) AS b FROM events_made WHERE bridge_id IS NOT NULL), p AS (SELECT count(*) AS p FROM people)
SELECT * FROM (SELECT 'ground_truth' AS section, n AS records FROM n UNION ALL SELECT 'instance_ground_truth', i FROM i UNION ALL SELECT 'edge_attribute_ground_truth', e FROM e UNION ALL SELECT 'anchors', least(i, 20) FROM i UNION ALL SELECT 'profile_nodes', n FROM n UNION ALL SELECT 'entities', p FROM p
UNION ALL SELECT 'events', n FROM n UNION ALL SELECT 'instances', i FROM i UNION ALL SELECT 'realized', 3 UNION ALL SELECT 'node_records', n FROM n UNION ALL SELECT 'edge_records', e FROM e UNION ALL SELECT 'bridge_records', b FROM b UNION ALL SELECT 'hashes_that_match', 4)""", True)
def manifest_sections(spark, d):
    """A bundle written whole and its manifest read again: records by section, and files whose digests agree."""
    folder = shared_folder(spark)
    bundle.write(ledger_queries.made(spark, d), folder)
    m, t = validate.sections(spark, folder / "manifest.json")
    shown = {"truth": "ground_truth", "instance_truth": "instance_ground_truth", "edge_truth": "edge_attribute_ground_truth"}
    counted = [x.select(F.lit(shown.get(name, name)).alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("records")) for name, x in t.items()]
    rows = [("realized", len(m["behavior"]["drift_schedule"]["realized"])), ("hashes_that_match", sum(m["sha256"][k] == bundle.sha256(folder / f) for k, f in bundle.FILES.items()))]
    return reduce(DataFrame.union, [*counted, spark.createDataFrame(rows, "section string, records bigint")])


@query(f"{ledger_queries._EVENTS} SELECT event_id, step, profile_id, action_id, actor AS actor_entity_id, counterparty::VARCHAR AS counterparties, amount_minor, chain_id, bridge_id FROM events_made")
def manifest_events(spark, d):
    """The records of one section, as tasks write them into the manifest and read them again by ranges."""
    folder = shared_folder(spark)
    events = bundle.Rows(ledger_queries.made(spark, d).events, "event_id")
    single_file.write_pieces(folder / "events.json", bundle.pieces({"seed": 72, "behavior": {"events": events, "note": "[]"}}))
    document = json_ranges.Document(spark, folder / "events.json", 1 << 20)
    at, schema = validate._SECTIONS["events"]
    _, places = document.read({at})
    found = document.records(places, {at: set(validate.fields(schema))}).where("fault is null")
    rows = found.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.select("event_id", "step", "profile_id", "action_id", "actor_entity_id", F.array_join(F.transform("counterparty_entity_ids", lambda x: x.cast("string")), ",").alias("counterparties"), "amount_minor", "chain_id", "bridge_id")


@query("shown AS (SELECT * FROM (VALUES ('a', '[1, null, 0.5]'), ('n', '12'), ('nested', '{\"x\": \"é\"}')) v(key, value)) SELECT * FROM shown")
def report_roundtrip(spark, d):
    """A report replaced in one step and read strictly."""
    path = shared_folder(spark) / "deep" / "report.json"
    for said in ({"old": 1}, {"a": [1, None, 0.5], "n": 12, "nested": {"x": "é"}}):
        bundle.write_report(path, said)
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in bundle.read_json(path).items()], "key string, value string")


@query(f"{base._NODES} SELECT tx_id, time_step, tx_id AS row FROM tx_nodes")
def dense_rows(spark, d):
    """Rows of one file, numbered as they stand in it, in however many parts it is read."""
    path = _lines(shared_folder(spark), "nodes.csv", base._nodes(spark, d).select("tx_id", "time_step"), "tx_id", header=False)
    file = spark.read.schema("tx_id bigint, time_step int").csv(str(path))
    return with_rows(file, "row")


@query(f"{base._PROP}, s AS (SELECT 0) SELECT 0.0::DOUBLE AS steepest FROM s")
def sgc_optimality(spark, d):
    """The steepest slope of the linear model's penalized loss at the weights found, to three places: none."""
    rows, columns, model = base._fitted(spark, d, "sgc")
    labeled = evaluation.balanced(rows.where("part = 'train'"))
    w, b = model.coefficients.toArray(), float(model.intercept)
    z = sum((F.col(c) * float(x) for c, x in zip(columns, w)), F.lit(b))
    miss = F.col("weight") * (1 / (1 + F.exp(-z)) - F.col("y"))
    slopes = labeled.agg(*(F.sum(miss * F.col(c)).alias(c) for c in columns), F.sum(miss).alias("__b"), F.sum("weight").alias("__n")).first()
    steepest = max(abs((slopes[c] + float(x)) / slopes["__n"]) for c, x in zip([*columns, "__b"], [*w, 0.0]))
    return spark.createDataFrame([(round(steepest, 3) + 0.0,)], "steepest double")


_TAMPERED = [
    ("ground truth: class does not match", "SELECT event_id FROM events_made WHERE event_id % 1009 = 3"), ("ground truth do not cover their source", "SELECT event_id FROM events_made WHERE event_id % 1511 = 7"),
    ("edge ground truth: amount does not match", "SELECT edge_id FROM edges_made WHERE edge_id % 1201 = 2"), ("chain node records: native_id_is_synthetic does not match", "SELECT event_id FROM events_made WHERE event_id % 1301 = 1"),
    ("bridge records occur twice", "SELECT event_id FROM events_made WHERE bridge_id IS NOT NULL AND event_id % 101 = 6"), ("instances: chain_path does not match", "SELECT 0"), ("native entity ID does not match", "SELECT entity_id FROM people WHERE entity_id % 90 = 4"),
    # records of nodes are derived from the entities as told, so those of changed ones differ
    ("chain node records: native_entity_id does not match", "SELECT event_id FROM (SELECT e.event_id, min(r.entity) AS first FROM events_made e JOIN roles r USING (event_id) JOIN people p ON p.entity_id = r.entity AND p.chain_id = e.chain_id GROUP BY 1) WHERE first % 90 = 4"),
]


@query(f"{ledger_queries._EVENTS} " + " UNION ALL ".join(f"SELECT '{m}' AS message, x.* FROM ({q}) x(row)" for m, q in _TAMPERED))
def validator_faults(spark, d):
    """Every fault that the validator finds in sections with some records changed, dropped or repeated: those and no others."""
    made = ledger_queries.made(spark, d)
    m = bundle.manifest(made, stored(bundle.attributes(made)), {})
    t = {name: validate._at(m, path).table for name, (path, _) in validate._SECTIONS.items()}
    t["truth"] = t["truth"].where("txId % 1511 <> 7").withColumn("class", F.when(F.col("txId") % 1009 == 3, "unknown").otherwise(F.col("class")))
    t["edge_truth"] = t["edge_truth"].withColumn("amount", F.col("amount") + (F.col("edge_id") % 1201 == 2).cast("int"))
    t["node_records"] = t["node_records"].withColumn("native_id_is_synthetic", F.col("txId") % 1301 != 1)
    t["bridge_records"] = t["bridge_records"].union(t["bridge_records"].where("event_id % 101 = 6"))
    t["instances"] = t["instances"].withColumn("chain_path", F.when(F.col("instance_id") != 0, F.col("chain_path")).otherwise(F.expr("cast(array() as array<string>)")))
    t["entities"] = t["entities"].withColumn("native_entity_id", F.when(F.col("entity_id") % 90 == 4, F.concat(F.lit("synthetic-"), F.col("entity_id").cast("string"))).otherwise(F.col("native_entity_id")))
    t |= {name: stored(t[name]) for name in validate._SECTIONS}
    t |= {"nodes": made.nodes.select("tx_id", "time_step"), "edges": made.edges.select("edge_id", "txId1", "txId2")}
    return validate.table_rules(spark, made.config, t, m["behavior"]["drift_schedule"]["realized"]).faults().select("message", "row")


# networks with fixed weights, written out as sums
def _sum(columns: list[str], weights, column: int) -> str:
    return " + ".join(f"{c} * ({float(w)!r}::DOUBLE)" for c, w in zip(columns, weights[:, column]))


_NET = ["x0", "x1"]
_HIDDEN = 4


def _weights(kind: str) -> dict:
    return networks.parameters(kind, len(_NET), _HIDDEN, 1, 11)


_GRAPH = f"{_PARTED}, x AS (SELECT tx_id, score::DOUBLE AS x0, time_step / 49.0::DOUBLE AS x1 FROM tx_nodes)"


def _head(w: dict, hidden: list[str]) -> str:
    return f"round(1 / (1 + exp(-({_sum(hidden, w['head.w'], 0)} + ({float(w['head.b'][0, 0])!r}::DOUBLE)))), 6) AS score"


def _sage_sql() -> str:
    w, parts = _weights("sage"), []
    for side in ("out", "in"):
        near = [f"coalesce({side}_{c}, 0)" for c in _NET]
        parts += [f"greatest({_sum(near, w[f'0.{side}.near.w'], h)} + ({float(w[f'0.{side}.near.b'][0, h])!r}::DOUBLE) + {_sum(_NET, w[f'0.{side}.self.w'], h)}, 0) AS h{side}{h}" for h in range(_HIDDEN)]
    means = lambda side, at, of: f"{side}_m AS (SELECT e.{at} AS tx_id, avg(x0) AS {side}_x0, avg(x1) AS {side}_x1 FROM parted e JOIN x ON x.tx_id = e.{of} GROUP BY 1)"
    hidden = [f"h{side}{h}" for side in ("out", "in") for h in range(_HIDDEN)]
    return f"{_GRAPH}, {means('out', 'txId2', 'txId1')}, {means('in', 'txId1', 'txId2')}, h AS (SELECT tx_id, {', '.join(parts)} FROM x LEFT JOIN out_m USING (tx_id) LEFT JOIN in_m USING (tx_id)) SELECT tx_id, {_head(w, hidden)} FROM h"


def _gin_sql() -> str:
    w = _weights("gin")
    own = [f"({c} + coalesce(s_{c}, 0))" for c in _NET]
    first = [f"greatest({_sum(own, w['0.first.w'], h)} + ({float(w['0.first.b'][0, h])!r}::DOUBLE), 0) AS f{h}" for h in range(_HIDDEN)]
    second = [f"greatest({_sum([f'f{k}' for k in range(_HIDDEN)], w['0.second.w'], h)} + ({float(w['0.second.b'][0, h])!r}::DOUBLE), 0) AS h{h}" for h in range(_HIDDEN)]
    sums = "s AS (SELECT e.txId2 AS tx_id, sum(x0) AS s_x0, sum(x1) AS s_x1 FROM parted e JOIN x ON x.tx_id = e.txId1 GROUP BY 1)"
    return f"{_GRAPH}, {sums}, f AS (SELECT tx_id, {', '.join(first)} FROM x LEFT JOIN s USING (tx_id)), h AS (SELECT tx_id, {', '.join(second)} FROM f) SELECT tx_id, {_head(w, [f'h{h}' for h in range(_HIDDEN)])} FROM h"


def _gat_sql() -> str:
    w, each = _weights("gat"), _HIDDEN // networks.HEADS
    mapped = ", ".join(f"{_sum(_NET, w['0.map.w'], h)} AS m{h}" for h in range(_HIDDEN))
    ends = "reached AS (SELECT txId1 AS s, txId2 AS t FROM parted UNION ALL SELECT tx_id, tx_id FROM x)"
    scores, shares, seen, hidden = [], [], [], []
    for head in range(networks.HEADS):
        own = range(head * each, (head + 1) * each)
        raw_ = " + ".join(f"a.m{h} * ({float(w['0.from'][0, head, k])!r}::DOUBLE) + b.m{h} * ({float(w['0.to'][0, head, k])!r}::DOUBLE)" for k, h in enumerate(own))
        scores.append(f"exp(CASE WHEN {raw_} > 0 THEN {raw_} ELSE 0.2 * ({raw_}) END) AS e{head}")
        seen += [f"sum(e{head} * m{h}) / sum(e{head}) AS g{h}" for h in own]
        hidden += [f"greatest(g{h} + ({float(w['0.offset'][0, h])!r}::DOUBLE), 0) AS h{h}" for h in own]
    return (
        f"{_GRAPH}, m AS (SELECT tx_id, {mapped} FROM x), {ends}, e AS (SELECT b.tx_id, {', '.join(f'a.m{h}' for h in range(_HIDDEN))}, {', '.join(scores)} FROM reached JOIN m a ON a.tx_id = s JOIN m b ON b.tx_id = t),"
        f" g AS (SELECT tx_id, {', '.join(seen)} FROM e GROUP BY 1), h AS (SELECT tx_id, {', '.join(hidden)} FROM g) SELECT tx_id, {_head(w, [f'h{h}' for h in range(_HIDDEN)])} FROM h"
    )


def _forward(spark, d, kind: str) -> DataFrame:
    x = base._nodes(spark, d).select("tx_id", F.col("score").cast("double").alias("x0"), (F.col("time_step") / 49).alias("x1"))
    model = training.GraphModel(kind, _NET, _weights(kind), np.zeros(2), np.ones(2))
    return base._rounded(model.scores(x, stored(base.partition_edges(spark, d).select("txId1", "txId2"))))


@query(_sage_sql())
def sage_forward(spark, d):
    """Scores of a layer of means in both directions, with fixed weights."""
    return _forward(spark, d, "sage")


@query(_gat_sql())
def gat_forward(spark, d):
    """Scores of a layer of two heads of attention, with fixed weights."""
    return _forward(spark, d, "gat")


@query(_gin_sql())
def gin_forward(spark, d):
    """Scores of a layer of sums through a small network, with fixed weights."""
    return _forward(spark, d, "gin")


@query()
def network_scores(spark, d):
    """A sage network trained on train and stopped by validation, over all parts, with the sizes and rates of the protocol."""
    nodes, edges = base._graph(spark, d)
    rows, parted = protocol.views(nodes.select("tx_id", "time_step", "class"), stored(edges))
    both = evaluation.stacked(rows.where("part = 'train'"), rows.where("part = 'validation'"))
    model = training.fit(both, parted.where("part <> 'test'").select("txId1", "txId2"), protocol.FEATURES, "sage", 0)
    return model.scores(rows.select("tx_id", *protocol.FEATURES), parted.select("txId1", "txId2"))
