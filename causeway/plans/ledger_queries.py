"""Registered queries of the generator and of the sections of its manifest, with SQL that replays every draw.

The ledger has the default quotas; its volume by step is that of the event table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..simulation import bundle, generate, registry
from ..simulation.config import PHASES, QUOTAS, Config
from ..simulation.registry import ACTIONS, AMOUNTS, CHAINS, PROFILES
from ..sources import ledger as source
from ..storage import still_there
from . import queries as base
from .queries import query

SEED, TXS = 72, 10_000
_made: dict[tuple[str, str], generate.Ledger] = {}


def made(spark: SparkSession, d: str) -> generate.Ledger:
    """The ledger over the volume of the events in d; its tables are stored once for a session, and again if they were deleted."""
    key = spark.sparkContext.applicationId, d
    if key not in _made or not all(still_there(x) for x in vars(_made[key]).values() if isinstance(x, DataFrame)):
        volume = source.tx_nodes(source.table(spark, d, "events")).groupBy(F.col("time_step").alias("step")).agg(F.count(F.lit(1)).alias("weight"))
        every = spark.range(1, 50).select(F.col("id").cast("int").alias("step")).join(volume, "step", "left").fillna(0)
        _made[key] = generate.generate(spark, Config(seed=SEED, n_txs=TXS), every)
    return _made[key]


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "'" + x + "'" if isinstance(x, str) else "true" if x is True else "false" if x is False else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names}))"


def _u(stream: int, *keys: str) -> str:
    return base._nest([str(SEED), str(stream), *keys])


_ORDER = sorted(QUOTAS)
_NAMES = sorted(PROFILES)
_FIRST = {p: sum(QUOTAS[q][0] for q in _ORDER[:k]) for k, p in enumerate(_ORDER)}
_TURNS = sorted(QUOTAS, key=lambda p: (PROFILES[p].negative_kind != "novel_illicit", p))


def _chain_case(p: str) -> str:
    weights = [(CHAINS[c]["chain_id"], w) for c, w in PROFILES[p].chain_weights]
    total, running, out = sum(w for _, w in weights), 0.0, "CASE"
    for chain, w in weights:
        running += w
        out += f" WHEN u * {total!r}::DOUBLE <= {running!r}::DOUBLE THEN '{chain}'"
    return out + f" ELSE '{weights[-1][0]}' END"


_PEOPLE = "drawn_people AS (" + " UNION ALL ".join(
    f"SELECT i AS entity_id, '{p}' AS profile_id, {_chain_case(p)} AS chain_id FROM (SELECT i, {_u(generate.POPULATION, 'i')} AS u FROM range({_FIRST[p]}, {_FIRST[p] + QUOTAS[p][0]}) t(i))" for p in _ORDER
) + "), people AS (SELECT *, row_number() OVER (PARTITION BY profile_id, chain_id ORDER BY entity_id) - 1 AS ordinal FROM drawn_people)"

_VOLUME = f"""{base._NODES}, volume AS (SELECT s::INTEGER AS step, coalesce(w, 0) AS weight FROM range(1, 50) r(s) LEFT JOIN (SELECT time_step, count(*) AS w FROM tx_nodes GROUP BY 1) ON time_step = s),
shares AS (SELECT step, weight * {TXS} / (sum(weight) OVER ())::DOUBLE AS share FROM volume), floors AS (SELECT step, floor(share)::BIGINT AS base, share - floor(share) AS rest, {TXS} - (sum(floor(share)) OVER ())::BIGINT AS more FROM shares),
counts AS (SELECT step, base + (row_number() OVER (ORDER BY rest DESC, step) <= more)::INT AS c FROM floors), slots AS (SELECT row_number() OVER (ORDER BY step) - 1 AS slot, step FROM (SELECT step, unnest(range(c)) FROM counts))"""


def _assigned() -> str:
    parts, left = [], "slots"
    for p in _TURNS:
        number, profile = _NAMES.index(p), PROFILES[p]
        novel = profile.negative_kind == "novel_illicit"
        if novel:
            ok = " OR ".join(f"step BETWEEN {x['step_min']} AND {x['step_max']}" for x in PHASES if p in x["novel_profile_ids"]) or "false"
        elif profile.class_policy == "illicit":
            keep = "CASE " + " ".join(f"WHEN step <= {x['step_max']} THEN {float(x['illicit_keep_probability'])!r}" for x in PHASES) + " END"
            ok = f"{_u(generate.DRIFT, str(number), 'slot')} < {keep}"
        else:
            ok = "true"
        key = f"floor({_u(generate.SCHEDULE, str(number), 'slot')} * 1073741824)::BIGINT * 4294967296 + slot"
        parts.append(f"by_{p} AS (SELECT slot, step, '{p}' AS profile_id FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS r FROM {left} WHERE {ok}) WHERE r <= {QUOTAS[p][1]})")
        parts.append(f"without_{p} AS (SELECT * FROM {left} WHERE slot NOT IN (SELECT slot FROM by_{p}))")
        left = f"without_{p}"
    return ", ".join(parts) + ", assigned AS (" + " UNION ALL ".join(f"SELECT * FROM by_{p}" for p in _TURNS) + ")"


_SCHEDULE = f"{_VOLUME}, {_assigned()}"

_RULES = ", ".join([
    "profiles AS " + _values([(p, len(x.action_ids), _FIRST[p], QUOTAS[p][0], x.activity_weight, x.entity_type, x.class_policy, x.amount_policy) for p, x in PROFILES.items()], "profile_id, n_actions, first_id, n_entities, weight, entity_type, class_policy, amount_policy"),
    "acts AS " + _values([(p, k, a) for p, x in PROFILES.items() for k, a in enumerate(x.action_ids)], "profile_id, k, action_id"),
    "allowed AS " + _values([(a.action_id, k, q) for a in ACTIONS.values() for k, q in enumerate(a.counterparty_profiles)], "action_id, k, q"),
    "actions AS " + _values([(a.action_id, *AMOUNTS[a.amount_policy], a.action_id in ("hub_in", "mix_in"), a.target_class, a.edge_kind, a.amount_policy, a.channel) for a in ACTIONS.values()], "action_id, low, high, inward, target_class, edge_kind, amount_policy, channel"),
    "chains AS " + _values([(k, c["chain_id"], name) for k, (name, c) in enumerate(CHAINS.items())], "ck, chain_id, chain_key"),
    "sizes AS (SELECT profile_id, chain_id, ck, count(*) AS n FROM people JOIN chains USING (chain_id) GROUP BY ALL)",
    # where a counterparty may come from: the groups of profile and chain, in order, with their running weight
    "asked AS (SELECT a.action_id, s.profile_id, s.chain_id AS here, x.crossing FROM (SELECT DISTINCT action_id FROM allowed) a, sizes s, (VALUES (true), (false)) x(crossing))",
    "options AS (SELECT k.*, l.k AS lk, s.profile_id AS q, s.chain_id AS c, s.ck, s.n - (s.profile_id = k.profile_id AND s.chain_id = k.here)::INT AS n, p.weight AS w, s.profile_id = k.profile_id AND s.chain_id = k.here AS own, (s.chain_id <> k.here) = k.crossing AS same"
    " FROM asked k JOIN allowed l USING (action_id) JOIN sizes s ON s.profile_id = l.q JOIN profiles p ON p.profile_id = l.q)",
    "usable AS (SELECT * FROM (SELECT *, bool_or(same) OVER (PARTITION BY action_id, profile_id, here, crossing) AS any_same FROM options WHERE n > 0) WHERE same OR NOT (crossing OR any_same))",
    "groups AS (SELECT *, sum(n * w) OVER (PARTITION BY action_id, profile_id, here, crossing ORDER BY lk, ck ROWS UNBOUNDED PRECEDING) AS upto, sum(n * w) OVER (PARTITION BY action_id, profile_id, here, crossing) AS total FROM usable)",
])


def _picked(rows: str, name: str, stream: int, crossing: str) -> str:
    """CTE `name`: rows (slot, step, profile_id, action_id, actor, here, own_ordinal) with the counterparty's q, c and ordinal."""
    return f"""{name}_drawn AS (SELECT r.*, {_u(stream, 'slot')} AS u, {crossing} AS crossing FROM {rows} r),
{name} AS (SELECT * EXCLUDE (r), CASE WHEN own AND least(floor((u * total - (upto - n * w)) / w), n - 1) >= own_ordinal THEN least(floor((u * total - (upto - n * w)) / w), n - 1) + 1 ELSE least(floor((u * total - (upto - n * w)) / w), n - 1) END::BIGINT AS cp_ordinal
  FROM (SELECT d.slot, d.step, d.profile_id, d.action_id, d.actor, d.here, d.own_ordinal, d.u, g.q, g.c, g.n, g.w, g.own, g.upto, g.total, row_number() OVER (PARTITION BY d.slot ORDER BY g.lk, g.ck) AS r
    FROM {name}_drawn d JOIN groups g ON g.action_id = d.action_id AND g.profile_id = d.profile_id AND g.here = d.here AND g.crossing = d.crossing AND d.u * g.total < g.upto) WHERE r = 1)"""


_TARGETS = f"""{_SCHEDULE}, {_PEOPLE}, {_RULES},
started AS (SELECT s.slot, s.step, s.profile_id, floor({_u(generate.ACTION, 'slot')} * n_actions)::INT AS k, first_id + floor({_u(generate.ACTOR, 'slot')} * n_entities)::BIGINT AS actor FROM assigned s JOIN profiles p USING (profile_id)),
acting AS (SELECT s.slot, s.step, s.profile_id, a.action_id, s.actor, e.chain_id AS here, e.ordinal AS own_ordinal FROM started s JOIN acts a ON a.profile_id = s.profile_id AND a.k = s.k JOIN people e ON e.entity_id = s.actor),
{_picked('acting', 'once', generate.COUNTERPARTY, "action_id = 'bridge_link'")},
leaving AS (SELECT slot, step, profile_id, 'bridge_link' AS action_id, actor, here, own_ordinal FROM once WHERE action_id <> 'bridge_link' AND c <> here),
{_picked('leaving', 'twice', generate.BRIDGE, 'true')},
met AS (SELECT * FROM once WHERE action_id = 'bridge_link' OR c = here UNION ALL SELECT * FROM twice),
drawn AS (SELECT m.slot AS event_id, m.step, m.profile_id, m.action_id, m.actor, m.here, e.entity_id AS counterparty, CASE WHEN a.inward THEN m.actor ELSE e.entity_id END AS target, CASE WHEN a.inward THEN e.entity_id ELSE m.actor END AS preferred,
  CASE WHEN a.inward THEN m.here ELSE m.c END AS chain_id, (a.low + floor({_u(generate.AMOUNT, 'm.slot')} * (a.high - a.low + 1)))::BIGINT AS amount_minor
  FROM met m JOIN actions a ON a.action_id = m.action_id JOIN people e ON e.profile_id = m.q AND e.chain_id = m.c AND e.ordinal = m.cp_ordinal)"""

_EVENTS = f"""{_TARGETS}, writes AS (SELECT target AS entity, event_id FROM drawn),
direct AS (SELECT d.*, w.event_id AS tx1 FROM drawn d ASOF LEFT JOIN writes w ON w.entity = d.preferred AND d.event_id > w.event_id),
received AS (SELECT w.entity, min(w.event_id) AS since, e.profile_id AS p, e.chain_id AS c FROM writes w JOIN people e ON e.entity_id = w.entity GROUP BY ALL),
other AS (SELECT d.event_id, min(r.entity) AS entity FROM direct d JOIN allowed l ON l.action_id = d.action_id JOIN received r ON r.p = l.q AND r.since < d.event_id AND r.entity <> d.actor AND r.entity <> d.target AND (r.c <> d.chain_id) = (d.action_id = 'bridge_link')
  WHERE d.tx1 IS NULL GROUP BY 1),
second AS (SELECT o.event_id, o.entity, w.event_id AS tx2 FROM other o ASOF LEFT JOIN writes w ON w.entity = o.entity AND o.event_id > w.event_id),
events_made AS (SELECT d.*, CASE WHEN d.tx1 IS NOT NULL THEN d.preferred ELSE s.entity END AS source_entity, coalesce(d.tx1, s.tx2) AS source_tx, CASE WHEN d.action_id = 'bridge_link' THEN d.here || '->' || d.chain_id END AS bridge_id FROM direct d LEFT JOIN second s USING (event_id)),
roles AS (SELECT DISTINCT event_id, step, unnest([actor, target, counterparty, source_entity]) AS entity FROM events_made),
edges_made AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS edge_id, source_tx AS txId1, event_id AS txId2, e.*, a.edge_kind AS kind, a.target_class AS cls FROM events_made e JOIN actions a USING (action_id) WHERE source_tx IS NOT NULL)"""

_TREES = f"""{_EVENTS}, walk AS (SELECT event_id AS node, event_id AS root FROM events_made WHERE source_tx IS NULL UNION ALL SELECT e.txId2, w.root FROM walk w JOIN edges_made e ON e.txId1 = w.node),
numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS instance_id FROM (SELECT DISTINCT root FROM walk)), member AS (SELECT w.node AS event_id, n.instance_id FROM walk w JOIN numbers n USING (root))"""

_NATIVE_ENTITY = f"'synthetic-' || substr(sha256('{SEED}:behavior:entity:' || entity_id || ':' || chain_id), 1, 32)"


def _native_tx(tx: str, chain: str) -> str:
    return f"CASE WHEN {chain} = 'eip155:1' THEN '0x' ELSE '' END || sha256('{SEED}:behavior:tx:' || {tx} || ':' || {chain})"


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(f"""{_EVENTS} SELECT e.entity_id, e.profile_id, p.entity_type, e.chain_id, {_NATIVE_ENTITY} AS native_entity_id, min(r.step) AS first_step, max(r.step) AS last_step
FROM people e JOIN profiles p USING (profile_id) LEFT JOIN roles r ON r.entity = e.entity_id GROUP BY ALL""")
def generated_entities(spark, d) -> DataFrame:
    """Numbered by profile, on chains drawn by weight, with the steps of their first and last part in an event."""
    return made(spark, d).entities.drop("profile_version")


@query(f"{_SCHEDULE} SELECT slot AS event_id, step, profile_id FROM assigned")
def generated_schedule(spark, d) -> DataFrame:
    """Quotas filled from eligible slots, novel profiles first."""
    return made(spark, d).events.select("event_id", "step", "profile_id")


@query(f"{_EVENTS} SELECT event_id, step, profile_id, action_id, actor AS actor_entity_id, counterparty::VARCHAR AS counterparties, target AS target_entity_id, chain_id, amount_minor, bridge_id, source_tx, source_entity FROM events_made")
def generated_events(spark, d) -> DataFrame:
    """Actors, counterparties by weight, direction, bridges drawn again, amounts and sources."""
    one = lambda c: F.get(c, F.lit(0))
    return made(spark, d).events.select("event_id", "step", "profile_id", "action_id", "actor_entity_id", _joined("counterparty_entity_ids").alias("counterparties"), "target_entity_id", "chain_id", "amount_minor", "bridge_id", one("source_tx_ids").alias("source_tx"), one("source_entity_ids").alias("source_entity"))


@query(f"""{_TREES} SELECT e.event_id AS tx_id, e.step AS time_step, a.target_class AS cls, e.action_id AS role, e.profile_id AS scheme, e.chain_id, m.instance_id, x.entity_ids FROM events_made e JOIN actions a USING (action_id) JOIN member m USING (event_id)
JOIN (SELECT event_id, string_agg(entity::VARCHAR, ',' ORDER BY entity) AS entity_ids FROM roles WHERE entity IS NOT NULL GROUP BY 1) x USING (event_id)""", True)
def generated_nodes(spark, d) -> DataFrame:
    """The ground truth of every transaction: class, role, scheme, instance and participants in order."""
    return made(spark, d).nodes.select("tx_id", "time_step", "cls", "role", "scheme", "chain_id", "instance_id", _joined("entity_ids").alias("entity_ids"))


@query(f"""{_TREES}, placed AS (SELECT e.*, round(e.amount_minor / 100.0, 2) AS amount, 1200 * (greatest(u.step, e.step) - 1) AS at FROM edges_made e JOIN events_made u ON u.event_id = e.txId1),
firsts AS (SELECT m.instance_id, min_by(e.profile_id, e.event_id) AS pattern FROM member m JOIN events_made e USING (event_id) GROUP BY 1)
SELECT p.edge_id, p.txId1, p.txId2, p.kind AS edge_kind, p.action_id AS role, p.amount::DOUBLE AS amount, p.at::BIGINT AS timestamp, p.event_id, p.chain_id, m.instance_id, f.pattern AS pattern_type, p.bridge_id FROM placed p JOIN member m USING (event_id) JOIN firsts f USING (instance_id)""", True)
def generated_edges(spark, d) -> DataFrame:
    """The ground truth of every edge with its file's amount and time."""
    made_ = made(spark, d)
    nodes, first = made_.nodes.select(F.col("tx_id").alias("txId2"), "instance_id"), made_.instances.select("instance_id", F.col("profile_id").alias("pattern_type"))
    joined = made_.edges.drop("amount_minor", "timestamp").join(bundle.attributes(made_).select("edge_id", "amount", "timestamp"), "edge_id").join(nodes, "txId2").join(first, "instance_id")
    return joined.select("edge_id", "txId1", "txId2", F.col("kind").alias("edge_kind"), "role", "amount", "timestamp", "event_id", "chain_id", "instance_id", "pattern_type", "bridge_id")


@query(f"""{_TREES}, inside AS (SELECT m.instance_id, e.* FROM member m JOIN events_made e USING (event_id)), firsts AS (SELECT instance_id, chain_id, min(event_id) AS f FROM inside GROUP BY ALL),
paths AS (SELECT instance_id, string_agg(chain_id, ',' ORDER BY f) AS chain_path FROM firsts GROUP BY 1), persons AS (SELECT m.instance_id, r.entity FROM member m JOIN roles r USING (event_id) WHERE r.entity IS NOT NULL GROUP BY ALL),
own AS (SELECT m.instance_id, string_agg(e.edge_id::VARCHAR, ',' ORDER BY e.edge_id) AS edge_ids FROM edges_made e JOIN member m USING (event_id) GROUP BY 1)
SELECT i.instance_id, min_by(i.profile_id, i.event_id) AS profile_id, string_agg(i.event_id::VARCHAR, ',' ORDER BY i.event_id) AS event_ids, array_to_string(list_sort(list(DISTINCT i.profile_id)), ',') AS profile_ids, min(i.step) AS step_min, max(i.step) AS step_max,
  any_value(p.chain_path) AS chain_path, (SELECT string_agg(x.entity::VARCHAR, ',' ORDER BY x.entity) FROM persons x WHERE x.instance_id = i.instance_id) AS entity_ids, coalesce(any_value(o.edge_ids), '') AS edge_ids
FROM inside i JOIN paths p USING (instance_id) LEFT JOIN own o USING (instance_id) GROUP BY i.instance_id""", True)
def generated_instances(spark, d) -> DataFrame:
    """Components with their members, steps, profiles and chains in order of first use."""
    rows = made(spark, d).instances
    window = [F.col("temporal_window")[k].alias(n) for k, n in enumerate(("step_min", "step_max"))]
    return rows.select("instance_id", "profile_id", _joined("event_ids").alias("event_ids"), _joined("profile_ids").alias("profile_ids"), *window, _joined("chain_path").alias("chain_path"), _joined("entity_ids").alias("entity_ids"), _joined("edge_ids").alias("edge_ids"))


@query(f"""{_EVENTS}, here_first AS (SELECT e.event_id, min(r.entity) AS entity_id FROM events_made e JOIN roles r USING (event_id) JOIN people p ON p.entity_id = r.entity AND p.chain_id = e.chain_id GROUP BY 1)
SELECT e.event_id AS tx_id, e.chain_id, c.chain_key, {_native_tx('e.event_id', 'e.chain_id')} AS native_tx_id, (SELECT {_NATIVE_ENTITY.replace('entity_id', 'x.entity_id').replace('chain_id', 'x.chain_id')} FROM people x WHERE x.entity_id = f.entity_id) AS native_entity_id
FROM events_made e JOIN chains c USING (chain_id) LEFT JOIN here_first f USING (event_id)""")
def chain_node_records(spark, d) -> DataFrame:
    """Native ids of every transaction, and of its first participant on its chain."""
    return bundle.node_records(made(spark, d)).select(F.col("tx_id"), "chain_id", "chain_key", "native_tx_id", "native_entity_id")


@query(f"""{_EVENTS} SELECT e.edge_id, e.event_id, e.txId1, e.txId2, u.chain_id AS source_chain_id, e.chain_id AS target_chain_id, e.kind, e.action_id AS role, e.amount_minor / 100.0::DOUBLE AS csv_amount, e.step::BIGINT AS timestamp, NULL::BIGINT AS native_amount_minor, e.bridge_id
FROM edges_made e JOIN events_made u ON u.event_id = e.txId1""")
def chain_edge_records(spark, d) -> DataFrame:
    """Edges with the chains of both ends; amounts aren't rounded and times are steps."""
    return bundle.edge_records(made(spark, d)).withColumn("timestamp", F.col("timestamp").cast("bigint"))


@query(f"""{_EVENTS} SELECT e.bridge_id, e.event_id, g.edge_id, e.here AS source_chain_id, e.chain_id AS target_chain_id FROM events_made e LEFT JOIN edges_made g USING (event_id) WHERE e.bridge_id IS NOT NULL""")
def chain_bridge_records(spark, d) -> DataFrame:
    """Every bridge event, with its edge if it has a source."""
    return bundle.bridge_records(made(spark, d))


@query(f"""{_EVENTS} SELECT e.event_id AS tx_id, e.profile_id, p.entity_type, p.class_policy, a.amount_policy AS amount_policy_id, p.amount_policy AS profile_amount_policy_id, a.channel FROM events_made e JOIN profiles p USING (profile_id) JOIN actions a USING (action_id)""")
def profile_nodes(spark, d) -> DataFrame:
    """What the registries say of every transaction's profile and action."""
    n = made(spark, d).nodes
    pick = lambda table, key, field: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, getattr(v, field))])[F.col(key)]
    return n.select("tx_id", F.col("scheme").alias("profile_id"), pick(PROFILES, "scheme", "entity_type").alias("entity_type"), pick(PROFILES, "scheme", "class_policy").alias("class_policy"), pick(ACTIONS, "role", "amount_policy").alias("amount_policy_id"),
        pick(PROFILES, "scheme", "amount_policy").alias("profile_amount_policy_id"), pick(ACTIONS, "role", "channel").alias("channel"))


_PHASE_OF = "CASE " + " ".join(f"WHEN step <= {p['step_max']} THEN '{p['phase_id']}'" for p in PHASES) + " END"


@query(f"""{_EVENTS}, phased AS (SELECT {_PHASE_OF} AS phase_id, a.target_class AS cls, e.profile_id, e.chain_id FROM events_made e JOIN actions a USING (action_id)),
keys AS (SELECT 'class' AS kind, v FROM (VALUES ('illicit'), ('licit'), ('unknown')) t(v) UNION ALL SELECT 'profile', profile_id FROM profiles UNION ALL SELECT 'chain', chain_id FROM chains),
seen AS (SELECT phase_id, 'class' AS kind, cls AS v FROM phased UNION ALL SELECT phase_id, 'profile', profile_id FROM phased UNION ALL SELECT phase_id, 'chain', chain_id FROM phased)
SELECT p.phase_id, k.kind, k.v, count(s.v) AS n FROM {_values([(p['phase_id'],) for p in PHASES], 'phase_id')} p CROSS JOIN keys k LEFT JOIN seen s ON s.phase_id = p.phase_id AND s.kind = k.kind AND s.v = k.v GROUP BY ALL""")
def drift_histograms(spark, d) -> DataFrame:
    """Nodes of each phase by class, profile and chain, zeros too."""
    return bundle.drift_counts(made(spark, d))


@query("shown AS " + _values([("chain", k, c["chain_id"]) for k, c in CHAINS.items()] + [("profile", k, p.entity_type) for k, p in PROFILES.items()] + [("action", k, a.edge_kind) for k, a in ACTIONS.items()] + [("digest", "", registry.digest())], "kind, key, value") + " SELECT * FROM shown")
def registries(spark, d) -> DataFrame:
    """The registries as tables, through their lookups."""
    rows = [("chain", k, registry.lookup("chain", k)["chain_id"]) for k in CHAINS] + [("profile", k, registry.lookup("profile", k).entity_type) for k in PROFILES] + [("action", k, registry.lookup("action", k).edge_kind) for k in ACTIONS]
    return spark.createDataFrame([*rows, ("digest", "", registry.digest())], "kind string, key string, value string")
