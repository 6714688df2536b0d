"""Embedding near-duplicates through a navigable small-world graph per shard.

Vectors that are equal bit for bit are one node with a multiplicity. The nodes of a label are hashed into shards of about
SHARD nodes; each shard gets a hierarchical navigable small-world graph, built layer by layer from the top: batches of nodes
are inserted by a search of what is built so far and linked to diverse neighbours among those found. Every vector then
queries every shard of its label: greedy descent through the upper layers, then a beam over the lowest. Each pair of a query
block and a graph is audited with real queries and with noisy copies of the graph's own nodes, against brute force; while
recall is under RECALL the beam is doubled. A query whose beam is full of links, as in a crowd of near copies, is answered
exactly for that shard; such probes do not count in the audit. If no beam up to WIDEST passes, or too few probes are left to
tell, the whole query block is answered exactly. All links are verified by cosine in double precision.

Building is in proportion to the vectors; asking is not: a label of S shards has S * S pairs of a block and a graph. A pair
is a key of its own, so these are spread over tasks, each of which holds one graph and QUERY_BLOCKS blocks at a time.

A task returns the number of links of each of its queries and a spanning forest of its links, not the pairs; components
are joined up from the forests. The column `recall` is what the audits of a label found, of all that they looked for with
the beams that were used; 1 where all was exact.

Cases: vectors that are null, zero, or hold a null or a value that is not finite, and vectors without a label, link with
nothing; each is its own component and its recall is null. Vectors of different lengths never link. Repeated rows of one id
count as different vectors with that id. A row without an id gets its links but is never a component id. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

COSINE, SHARD, NEIGHBOURS, BEAM, WIDEST, RECALL, AUDIT, QUERY_BLOCKS = 0.93, 4096, 16, 48, 384, 0.98, 48, 4
#: Beam of the search for the neighbours of a new node.
INSERT_BEAM = 64
#: Single-precision cosines this far under the bar are still verified.
_SLACK = 1e-4
_STEP = 4


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x = x
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        """Neighbour lists by layer, lowest first, padded with -1; nodes are in order of falling level, so a layer is a prefix."""
        n, draw = len(self.x), np.random.default_rng(7)
        level = np.sort(np.floor(-np.log(1 - draw.random(n)) / np.log(NEIGHBOURS)).astype(int))[::-1]
        sizes = [int((level >= k).sum()) for k in range(level[0] + 1)]
        layers: list[np.ndarray] = []
        for k in range(len(sizes) - 1, -1, -1):
            if k == 0 or sizes[k] > 1:
                layers.insert(0, self._layer(sizes[k], 2 * NEIGHBOURS if k == 0 else NEIGHBOURS, layers))
        return layers

    def _layer(self, n: int, width: int, above: list[np.ndarray]) -> np.ndarray:
        """The layer of the first n nodes: new ones are sought from where the layers above lead, in the part that is there."""
        lists = np.full((n, width), -1, np.int32)
        done = min(n, width // 2 + 1)
        for i in range(done):
            others = [j for j in range(done) if j != i]
            lists[i, : len(others)] = others
        while done < n:
            batch = np.arange(done, min(n, 2 * done, done + 512))
            q = self.x[batch]
            at, _ = self._descend(q, above)
            at = np.where(at < done, at, 0)
            candidates, _, _ = self._beam(q, at, lists[:done], min(INSERT_BEAM, done))
            chosen = self._diverse(batch, candidates.astype(np.int32), NEIGHBOURS)
            lists[batch, : chosen.shape[1]] = chosen
            self._back(lists, batch, chosen)
            done = int(batch[-1]) + 1
        return lists

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
        """For each node the nearest candidates that are nearer to it than to any chosen one, then half the places for the rest by nearness."""
        x, valid = self.x[candidates], candidates >= 0
        near = np.where(valid, np.einsum("nd,nkd->nk", self.x[nodes], x), -2)
        order = np.argsort(-near, axis=1, kind="stable")
        candidates, near, x = (np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(x, order[:, :, None], 1))
        between = np.einsum("nkd,njd->nkj", x, x)
        chosen, count = np.zeros(near.shape, bool), np.zeros(len(nodes), int)
        for j in range(near.shape[1]):
            worst = np.where(chosen[:, :j], between[:, j, :j], -3).max(axis=1, initial=-3)
            take = (near[:, j] > -2) & (count < keep) & (near[:, j] > worst)
            chosen[:, j] = take
            count += take
        spare = np.cumsum(~chosen, axis=1)
        rank = np.where(chosen, 0, 1) * 1000 + np.where(chosen, np.arange(near.shape[1]), spare) + np.where(near > -2, 0, 10_000)
        first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        limit = np.maximum(count, keep // 2)[:, None]
        out = np.take_along_axis(candidates, first, 1)
        return np.where((np.arange(first.shape[1])[None, :] < limit) & (np.take_along_axis(near, first, 1) > -2), out, -1)

    def _back(self, lists: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen neighbours back to the new nodes; lists that overflow are thinned."""
        rows, columns = np.nonzero(chosen >= 0)
        to, new = chosen[rows, columns], batch[rows]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[to], self.x[new]), to))
        to, new = to[order], new[order]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        counts = np.diff(np.append(heads, len(to)))
        width = lists.shape[1]
        for at, node, count in zip(heads.tolist(), to[heads].tolist(), counts.tolist()):
            used = int((lists[node] >= 0).sum())
            room = min(width - used, count)
            lists[node, used : used + room] = new[at : at + room]
            if room < count:
                more = np.concatenate([lists[node], new[at + room : at + min(count, room + width)]])[None, :]
                kept = self._diverse(np.array([node]), more.astype(np.int32), width)
                lists[node] = -1
                lists[node, : kept.shape[1]] = kept[0]

    def _descend(self, q: np.ndarray, above: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(node, similarity): where greedy steps through the layers, lowest first in the list, end for each query."""
        at = np.zeros(len(q), np.int64)
        best = q @ self.x[0]
        for lists in above[::-1]:
            moving = np.arange(len(q))
            while len(moving):
                near = lists[at[moving]]
                sims = np.where(near >= 0, np.einsum("nd,nkd->nk", q[moving], self.x[near]), -2)
                k = sims.argmax(axis=1)
                top = sims[np.arange(len(moving)), k]
                better = top > best[moving]
                moving, k, top = moving[better], k[better], top[better]
                at[moving], best[moving] = near[better, k], top
        return at, best

    def _beam(self, q: np.ndarray, at: np.ndarray, lists: np.ndarray, beam: int, bar: float = 9.0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(nodes, similarities) of the best nodes of each query, padded with -1, and (query, node) of all that were met at or over the bar."""
        m, n = len(q), len(lists)
        best = np.einsum("nd,nd->n", q, self.x[at])
        ids, sims, fresh = np.full((m, beam), -1, np.int64), np.full((m, beam), -2.0, np.float32), np.zeros((m, beam), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = at, best, True
        seen = np.zeros((m, n), bool)
        seen[np.arange(m), at] = True
        hits = [(np.flatnonzero(best >= bar), at[best >= bar])]
        active = np.arange(m)
        while len(active):
            open_ = np.where(fresh[active], sims[active], -3)
            step = min(_STEP, beam)
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(active), 1))
            good = np.take_along_axis(open_, pick, 1) > -2
            fresh[active[:, None], pick] = False
            near = np.where(good[:, :, None], lists[ids[active[:, None], pick]], -1).reshape(len(active), -1)
            row = np.broadcast_to(active[:, None], near.shape)
            ok = near >= 0
            ok[ok] = ~seen[row[ok], near[ok]]
            r, c = np.nonzero(ok)
            node = near[r, c]
            # a node may be met twice in one step
            code = np.unique(active[r] * n + node)
            query, node = code // n, code % n
            seen[query, node] = True
            value = np.einsum("nd,nd->n", q[query], self.x[node])
            over = value >= bar
            hits.append((query[over], node[over]))
            counts = np.bincount(query, minlength=m)[active]
            most = int(counts.max(initial=0))
            if most:
                starts = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=m))])
                place = np.arange(len(query)) - starts[query]
                more_ids, more = np.full((m, most), -1, np.int64), np.full((m, most), -2.0, np.float32)
                more_ids[query, place], more[query, place] = node, value
                all_ids = np.concatenate([ids[active], more_ids[active]], 1)
                all_sims = np.concatenate([sims[active], more[active]], 1)
                all_fresh = np.concatenate([fresh[active], more[active] > -2], 1)
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                ids[active], sims[active], fresh[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_fresh))
            active = active[fresh[active].any(axis=1)]
        query, node = (np.concatenate(x) for x in zip(*hits))
        return ids, sims, (query, node)

    def search(self, q: np.ndarray, beam: int, bar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) of nodes at or over the bar, and which queries' beams were full of them."""
        n = len(self.x)
        at, _ = self._descend(q, self.layers[1:])
        _, sims, (query, node) = self._beam(q, at, self.layers[0], min(beam, n), bar)
        return query, node, (sims >= bar).all(axis=1) & (beam < n)


def search_audited(graph: Graph, q: np.ndarray, exact: np.ndarray, exact_graph: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query, node) of all links of the queries to the graph's nodes, and how many links the last audit found and looked for.

    exact and exact_graph: the same vectors in double precision.
    """
    n, draw = len(graph.x), np.random.default_rng(11)
    bar = COSINE - _SLACK
    probes = graph.x[:: max(1, n // AUDIT)][:AUDIT]
    noise = draw.standard_normal(probes.shape)
    noise -= (noise * probes).sum(1, keepdims=True) * probes
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    probes = np.concatenate([(0.955 * probes + np.sqrt(1 - 0.955**2) * noise).astype(np.float32), q[:: max(1, len(q) // AUDIT)][:AUDIT]])
    truth = probes @ graph.x.T >= bar
    beam, passed, audit = BEAM, False, (0, 0)
    while beam <= WIDEST and beam < n:
        a, b, full = graph.search(probes, beam, bar)
        got = np.zeros(truth.shape, bool)
        got[a, b] = True
        audited = ~full & truth.any(axis=1)  # full ones are answered exactly below
        want, have = truth[audited].sum(axis=1), (got & truth)[audited].sum(axis=1)
        passed = len(want) >= AUDIT // 4 and have.sum() >= RECALL * want.sum() and (have / want).mean() >= RECALL
        if passed:
            audit = int(have.sum()), int(want.sum())
            break
        beam *= 2
    found = []
    for k in range(0, len(q), 512):
        part = q[k : k + 512]
        if passed:
            a, b, full = graph.search(part, beam, bar)
            keep = ~full[a]
            found.append((a[keep] + k, b[keep]))
        else:
            full = np.ones(len(part), bool)
        rest = np.flatnonzero(full) + k
        if len(rest):
            a, b = np.nonzero(q[rest] @ graph.x.T >= bar)
            found.append((rest[a], b))
    a, b = (np.concatenate(x) for x in zip(*found))
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        part = slice(k, k + (1 << 16))
        keep[part] = np.einsum("nd,nd->n", exact[a[part]], exact_graph[b[part]]) >= COSINE
    return a[keep], b[keep], *audit


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stored_as(frame: pd.DataFrame) -> np.ndarray:
    """The vectors as they came: in single precision where that is their type."""
    raw = np.stack(frame["v"].to_numpy())
    return raw.astype(np.float32) if frame["single"].iloc[0] else raw.astype(np.float64)


def _vectors(raw: bytes, dim: int, single: bool) -> np.ndarray:
    return _unit(np.frombuffer(raw, np.float32 if single else np.float64).reshape(-1, dim))


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node").sample(frac=1, random_state=3)
    raw = _stored_as(frame)
    graph = Graph(_unit(raw).astype(np.float32))
    head = frame.iloc[0]
    return pd.DataFrame({
        "label": [head["label"]], "dim": [head["dim"]], "shard": [head["shard"]], "nodes": [frame["node"].to_numpy(np.int64).tobytes()], "sizes": [frame["n"].to_numpy(np.int64).tobytes()],
        "vectors": [raw.tobytes()], "single": [head["single"]], "layers": [[x.tobytes() for x in graph.layers]], "counts": [[len(x) for x in graph.layers]]})


def _query(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links, forests and audits of every block of every bundle against the graph in its row."""
    for frame in frames:
        for row in frame.itertuples():
            exact = _vectors(row.vectors, row.dim, row.single)
            graph = Graph(exact.astype(np.float32), [np.frombuffer(x, np.int32).reshape(n, -1) for x, n in zip(row.layers, row.counts)])
            nodes, sizes = (np.frombuffer(x, np.int64) for x in (row.nodes, row.sizes))
            for block in row.blocks:
                queries, mine = np.frombuffer(block["nodes"], np.int64), _vectors(block["vectors"], row.dim, row.single)
                a, b, found, wanted = search_audited(graph, mine.astype(np.float32), mine, exact)
                other = queries[a] != nodes[b]
                a, b = a[other], b[other]
                code = np.unique(a * len(nodes) + b)
                a, b = code // len(nodes), code % len(nodes)
                links = np.bincount(a, weights=sizes[b], minlength=len(queries)).astype(np.int64)
                has = np.flatnonzero(links)
                child, root = forest(queries[a], nodes[b])
                for out in ({"node": queries[has], "links": links[has]}, {"node": child, "root": root}, {"label": [row.label], "dim": [row.dim], "found": [found], "wanted": [wanted]}):
                    out = {c: pd.array(x, "Int64") if c != "label" else x for c, x in out.items()}
                    yield pd.DataFrame(out).reindex(columns=["label", "dim", "node", "links", "root", "found", "wanted"])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall of its label, of every row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    key = ["label", "h", "g"]
    whole = stored(rows.where("usable").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    nodes = whole.select("label", F.xxhash64(*key).alias("node"), "least", "n", "v", F.size("v").alias("dim"))
    counts = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sharded = nodes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "node"), F.col("shards")).cast("int"))
    kind, shard = rows.schema["label"].dataType.simpleString(), ["label", "dim", "shard"]
    schema = f"label {kind}, dim int, shard int, nodes binary, sizes binary, vectors binary, single boolean, layers array<binary>, counts array<int>"
    graphs = stored(sharded.select(*shard, "node", "n", "v", F.lit(single).alias("single")).repartition(parts, *shard).groupBy(*shard).applyInPandas(_build, schema))
    bundle = F.floor(F.col("shard") / QUERY_BLOCKS).cast("int").alias("bundle")
    blocks = graphs.groupBy("label", "dim", bundle).agg(F.collect_list(F.struct("nodes", "vectors")).alias("blocks"))  # QUERY_BLOCKS of them
    pairs = graphs.select(*shard).join(graphs.select("label", "dim", bundle).distinct(), ["label", "dim"])  # numbers of shards and bundles only
    work = pairs.join(blocks, ["label", "dim", "bundle"]).repartition(parts, *shard).join(graphs.repartition(parts, *shard), shard)
    found = stored(work.mapInPandas(_query, f"label {kind}, dim int, node bigint, links bigint, root bigint, found bigint, wanted bigint"))
    recall = found.where("found is not null").groupBy("label", "dim").agg(F.coalesce(F.sum("found") / F.nullif(F.sum("wanted"), F.lit(0)), F.lit(1.0)).alias("recall"))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("root is not null"), "node", "root")
    base = nodes.select("node", "label", "dim", "least", "n").join(links, "node", "left").join(joined, "node", "left").join(recall, ["label", "dim"])
    base = base.select("node", "least", "recall", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    least = base.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = base.join(least, "root").select("node", "n_links", "component_id", "recall")
    node = F.when(F.col("usable"), F.xxhash64(*key))
    out = rows.select("vec_id", node.alias("node")).join(by_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "recall")


def brute_force(vectors: list[tuple]) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) by comparing all pairs; for tests."""
    ids, n = [v[0] for v in vectors], len(vectors)
    links, root = [0] * n, list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    units = [None if v is None or lab is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else _unit(np.array([v], float))[0] for _, v, lab in vectors]
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and vectors[i][2] == vectors[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= COSINE:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i in range(n):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return [(ids[i], links[i], least[top(i)], ids[i] == least[top(i)]) for i in range(n)]
