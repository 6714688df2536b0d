"""Graphs of any shape against plain walks, and the parallel edge shuffle against the same rounds one edge at a time."""

import hashlib
import random

import pytest

from causeway.operators import biconnected, graph, shuffle


def adjacency(edges):
    out = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def walk(adjacent, start):
    d, queue = {start: 0}, [start]
    for x in queue:
        for y in adjacent[x]:
            if y not in d:
                d[y] = d[x] + 1
                queue.append(y)
    return d


def named(adjacent):
    """The least node of each node's component."""
    out = {}
    for s in sorted(adjacent):
        if s not in out:
            out |= dict.fromkeys(walk(adjacent, s), s)
    return out


def cut_points(adjacent):
    """Nodes without which the rest of their component is in several pieces."""
    of, out = named(adjacent), []
    for v in adjacent:
        rest = {x: adjacent[x] - {v} for x in adjacent if of[x] == of[v] and x != v}
        if len(set(named(rest).values())) > 1:
            out.append((of[v], v))
    return sorted(out)


R = random.Random(4)
GRAPHS = {
    "shapes": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7), (7, 7), (8, 9), (9, 8), (3, 4), (None, 4)]  # a bridge, a loop, parallel edges
    + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2000 + (i + 1) % 24) for i in range(24)] + [(3000 + i, 3001 + i) for i in range(12)]  # a hub, a ring, a path
    + [(a, b) for k in range(4) for a in range(4000 + 3 * k, 4004 + 3 * k) for b in range(a + 1, 4004 + 3 * k)],  # cliques in a row
    "random": [(R.randrange(160), R.randrange(160)) for _ in range(190)],
    "none": [],
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "txId1 bigint, txId2 bigint")


@pytest.mark.parametrize("name", GRAPHS)
def test_articulation_points(spark, name):
    assert sorted(map(tuple, biconnected.articulation_points(frame(spark, GRAPHS[name])).collect())) == cut_points(adjacency(GRAPHS[name]))


@pytest.mark.parametrize("name", GRAPHS)
def test_eccentricities_and_centres(spark, name):
    near = adjacency(GRAPHS[name])
    of, ecc = named(near), {x: max(walk(near, x).values()) for x in near}
    edges = frame(spark, GRAPHS[name])
    assert sorted(map(tuple, graph.eccentricities(edges).collect())) == sorted((x, of[x], e) for x, e in ecc.items())
    best = {c: min((ecc[x], x) for x in near if of[x] == c) for c in set(of.values())}
    assert sorted(map(tuple, graph.centres(edges).collect())) == sorted((c, x, e) for c, (e, x) in best.items())


def test_a_word_of_sources_is_not_enough(spark, monkeypatch):
    """A component with many more nodes than one sweep starts from, in a few sweeps."""
    monkeypatch.setattr(graph, "SWEPT", 2)
    near = adjacency(GRAPHS["random"])
    out = {r["node"]: r["ecc"] for r in graph.eccentricities(frame(spark, GRAPHS["random"])).collect()}
    assert out == {x: max(walk(near, x).values()) for x in near}


def test_layers_and_shells(spark):
    edges = GRAPHS["shapes"] + GRAPHS["random"]
    near = adjacency(edges)
    sources = [x for x in near if x % 2 == 0]  # more than a word
    found = graph.layers(frame(spark, edges), spark.createDataFrame([(x,) for x in sources + sources[:3]] + [(None,)], "source bigint"), 3)
    assert sorted(map(tuple, found.collect())) == sorted((s, x, d) for s in sources for x, d in walk(near, s).items() if d <= 3)
    anchors = [(1, 2), (1000, 1), (2000, 3), (4005, 9)]
    shells = graph.shells(frame(spark, edges), spark.createDataFrame(anchors, "anchor bigint, max_distance int"), 2)
    want = [(a, h, sorted(x for x, d in walk(near, a).items() if d == h)) for a, m in anchors for h in range(1, min(m, 2) + 1)]
    assert sorted(map(tuple, shells.collect())) == [w for w in want if w[2]]


def replayed(edges, seed):
    """(edges, attempts, swaps) of the rounds for one part, pair by pair."""
    now = [list(e) for e in sorted(edges)]
    n, tries, swaps, turn = len(now), 0, 0, 0
    while n > 1 and swaps < n and tries < 20 * n:
        dealt = {}
        for k in range(n):
            draw = hashlib.md5(f"{seed}:{turn}:{k}".encode()).hexdigest()
            dealt.setdefault(int(draw[:12], 16) % (n // 2), []).append((draw, k))
        pairs = sorted((g[i][0], g[i][1], g[i + 1][1]) for g in map(sorted, dealt.values()) for i in range(0, len(g) - 1, 2))[: 20 * n - tries]
        tries += len(pairs)
        wishes, there, sound = {}, {}, []
        for u, v in now:
            there[u, v] = there.get((u, v), 0) + 1
        for draw, i, j in pairs:
            (a, b), (c, d) = now[i], now[j]
            if a != d and c != b and (a, b) != (c, d):
                sound.append((draw, i, j))
                for w in ((a, d), (c, b)):
                    wishes[w] = wishes.get(w, 0) + 1
        free = []
        for draw, i, j in sound:
            (a, b), (c, d) = now[i], now[j]
            if all(wishes[w] == 1 and there.get(w, 0) == ((a, b) == w) + ((c, d) == w) for w in ((a, d), (c, b))):
                free.append((draw, i, j))
        for _, i, j in sorted(free)[: n - swaps]:
            now[i][1], now[j][1] = now[j][1], now[i][1]
        swaps += min(len(free), n - swaps)
        turn += 1
    return sorted(map(tuple, now)), tries, swaps


def test_shuffle(spark):
    r = random.Random(2)
    parts = {
        "sparse": list({(r.randrange(40), 40 + r.randrange(40)) for _ in range(120)}), "double": [(1, 2), (1, 2), (3, 4), (5, 6), (7, 8), (1, 9), (9, 1)],
        "star": [(0, x) for x in range(1, 12)], "one": [(1, 2)], "full": [(a, b) for a in range(4) for b in range(4) if a != b], "two": [(1, 2), (3, 4)],
    }
    seeds = {p: k for k, p in enumerate(parts)} | {"star": (1 << 64) - 1}
    edges = spark.createDataFrame([(p, a, b) for p, es in parts.items() for a, b in es] + [("other", 1, 2)], "part string, txId1 bigint, txId2 bigint")
    moved, told = shuffle.shuffled(edges.repartition(5), seeds)
    out, said = [tuple(x) for x in moved.collect()], {x["part"]: x for x in told.collect()}
    assert {p for p, *_ in out} == set(parts)
    for p, before in parts.items():
        now, tries, swaps = replayed(before, seeds[p])
        after = sorted((a, b) for q, a, b in out if q == p)
        assert after == now and (said[p]["attempts"], said[p]["swaps"]) == (tries, swaps), p
        assert sorted(a for a, _ in after) == sorted(a for a, _ in before) and sorted(b for _, b in after) == sorted(b for _, b in before)
        assert swaps <= len(before) and tries <= 20 * len(before) and not any(a == b for a, b in after)
        assert len(set(after)) >= len(set(before))
    assert said["sparse"]["status"] == "ok" and said["sparse"]["changed_fraction"] > 0.3
    assert said["one"]["status"] == "not_testable" and said["one"]["attempts"] == 0
    assert shuffle.shuffled(edges.limit(0), seeds)[0].count() == 0


def test_digest_of_edges(spark):
    rows = [("b", 10, 2), ("a", 9, 1), ("a", 10, 1), ("a", 9, 1), ("b", 3, 4)]
    out = dict(map(tuple, shuffle.edge_digest(spark.createDataFrame(rows, "part string, txId1 bigint, txId2 bigint")).collect()))
    assert out == {p: hashlib.sha256(("txId1,txId2\n" + "".join(f"{a},{b}\n" for q, a, b in sorted(rows) if q == p)).encode()).hexdigest() for p in "ab"}
