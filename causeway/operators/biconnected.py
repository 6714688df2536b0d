"""Articulation points of graphs of any shape and size, after Tarjan and Vishkin.

A spanning forest is grown by least edges, its trees are numbered in preorder by ranking their Euler tours, and the least and
greatest numbers that edges outside the tree reach from every subtree come from minima over doubling ranges. A graph over
the tree's edges then links those that lie on a common cycle, and its components are the blocks; a node in two of them is an
articulation point. Each step is joins and aggregates over edges or nodes, in a logarithmic number of rounds; no task holds a
component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, stored_told
from .graph import components
from .numbering import numbered


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, trees): tree edges (a, b), and (node, tree) of every node. links: (a, b), distinct, a < b.

    Each round every tree takes the least edge that leads out of it, in an order of edges by hash that is the same for all,
    so that no cycle comes about, and trees that took each other are one from then on; their number at least halves.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    trees, taken = stored(ends.select("node", F.col("node").alias("tree"))), []
    open_, left = stored_told(links.select("a", "b", F.col("a").alias("ta"), F.col("b").alias("tb"), F.xxhash64("a", "b").alias("h")), n=F.count(F.lit(1)))
    while left["n"]:
        both = open_.select("h", "a", "b", F.col("ta").alias("tree"), F.col("tb").alias("to")).union(open_.select("h", "a", "b", "tb", "ta"))
        least = stored(both.groupBy("tree").agg(F.min(F.struct("h", "a", "b", "to")).alias("e")).select("tree", "e.a", "e.b", "e.to"))
        taken.append(least.select("a", "b").distinct())
        # two that chose each other: the smaller is the root
        back = least.select(F.col("tree").alias("to"), F.col("to").alias("back"))
        up = least.join(back, "to", "left").select("tree", F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("up"))
        roots = _jumped(stored(up))
        new = lambda old, to: roots.select(F.col("tree").alias(old), F.col("up").alias(to))
        trees = stored(trees.join(new("tree", "up"), "tree", "left").select("node", F.coalesce("up", "tree").alias("tree")))
        open_, left = stored_told(open_.join(new("ta", "ua"), "ta").join(new("tb", "ub"), "tb").where("ua <> ub").select("a", "b", F.col("ua").alias("ta"), F.col("ub").alias("tb"), "h"), n=F.count(F.lit(1)))
    return reduce(DataFrame.union, taken).distinct() if taken else links.select("a", "b"), trees


def _jumped(up: DataFrame) -> DataFrame:
    """(tree, up) with `up` followed to its root; strides double each round."""
    while True:
        step = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.tree")).select("x.tree", "y.up", (F.col("x.up") != F.col("y.up")).alias("moved"))
        nxt, told = stored_told(step, moved=F.bool_or("moved"))
        up = nxt.drop("moved")
        if not told["moved"]:
            return up


def _tour(tree: DataFrame) -> DataFrame:
    """(k, x, y, twin, left): both directions of every tree edge, each with the number of steps left on the tour that starts at its tree's root. tree: (a, b, root)."""
    both = tree.select(F.col("a").alias("x"), F.col("b").alias("y"), "root").union(tree.select("b", "a", "root"))
    arcs = stored(numbered(both, ["x", "y"], "k"))
    # the arc behind (x, y) in the tour is the one that follows (y, x) in the list of y, from its end to its beginning
    follows = arcs.alias("p").join(arcs.select((F.col("k") - 1).alias("k"), F.col("x").alias("x2")).alias("q"), "k", "left").select("p.*", F.coalesce(F.col("q.x2") == F.col("p.x"), F.lit(False)).alias("inside"))
    firsts = arcs.groupBy("x").agg(F.min("k").alias("first"))
    ends = follows.where("not inside").join(firsts, "x")  # one for each node
    after = stored(follows.where("inside").select("k", "x", "y", "root", (F.col("k") + 1).alias("then")).union(ends.select("k", "x", "y", "root", F.col("first").alias("then"))))
    twins = arcs.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("k").alias("twin"))
    turned = after.select(F.col("k").alias("twin"), "then")
    starts = firsts.join(tree.select(F.col("root").alias("x")).distinct(), "x").select(F.col("first").alias("then"), F.lit(True).alias("start"))
    steps = arcs.join(twins, ["x", "y"]).join(turned, "twin").join(starts, "then", "left")
    steps = stored(steps.select("k", "x", "y", "root", "twin", F.when(F.col("start").isNull(), F.col("then")).alias("then")))
    rank, going_on = stored_told(steps.select("k", "then", F.col("then").isNotNull().cast("bigint").alias("left")), n=F.count("then"))
    while going_on["n"]:
        going = rank.where("then is not null").alias("p").join(rank.alias("q"), F.col("p.then") == F.col("q.k")).select("p.k", "q.then", (F.col("p.left") + F.col("q.left")).alias("left"))
        rank, going_on = stored_told(going.union(rank.where("then is null")), n=F.count("then"))
    return stored(steps.drop("then").join(rank.select("k", "left"), "k"))


def preorder(tree: DataFrame, trees: DataFrame) -> DataFrame:
    """(node, root, pre, size, parent): dense numbers of all nodes, trees one after another, each node before what lies under it.

    parent: the parent's number, null for roots, which are the least nodes of their trees. tree, trees: of spanning_forest.
    """
    roots = stored(trees.groupBy("tree").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("size")))
    named = stored(trees.join(roots.select("tree", "root"), "tree").select("node", "root"))
    tour = _tour(tree.join(named.select(F.col("node").alias("a"), "root"), "a"))
    up = tour.select(F.col("k").alias("twin"), F.col("left").alias("left_up"))
    down = tour.join(up, "twin").where(F.col("left") > F.col("left_up"))
    under = down.select(F.col("y").alias("node"), "root", (-F.col("left")).alias("at"), ((F.col("left") - F.col("left_up") + 1) / 2).cast("bigint").alias("size"), F.col("x").alias("over"))
    tops = roots.select(F.col("root").alias("node"), "root", F.lit(-(1 << 62)).cast("bigint").alias("at"), "size", F.lit(None).cast("bigint").alias("over"))
    nodes = stored(numbered(under.union(tops), ["root", "at"], "pre"))
    return nodes.join(nodes.select(F.col("node").alias("over"), F.col("pre").alias("parent")), "over", "left").select("node", "root", "pre", "size", "parent")


def _subtree_bounds(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(pre, low, high): the least and greatest numbers that reach (pre, low, high) gives in each node's subtree, a range of `size` numbers.

    The ranges of one length, a power of two, are combined from two of half of it, and each node takes two that overlap.
    """
    ranges, found = reach, []
    wanted = stored(nodes.select("pre", "size", F.floor(F.log2(F.col("size").cast("double")) + 1e-12).cast("int").alias("level")))
    top = wanted.agg(F.max("level")).first()[0]
    for level in range((-1 if top is None else top) + 1):
        asked = wanted.where(F.col("level") == level).select("pre", F.explode(F.array_distinct(F.array(F.col("pre"), F.col("pre") + F.col("size") - (1 << level)))).alias("at"))
        found.append(asked.join(ranges.withColumnRenamed("pre", "at"), "at").groupBy("pre").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        if level < top:
            right = ranges.select((F.col("pre") - (1 << level)).alias("pre"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            ranges = stored(ranges.join(right, "pre", "left").select("pre", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    return reduce(DataFrame.union, found) if found else reach.limit(0)


def blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, blocks): the nodes in preorder, and (pre, block) of the tree edge over every node that is no root.

    Edges (txId1, txId2) are undirected; loops and nulls are ignored, and parallel ones count once.
    """
    ends = edges.where("txId1 <> txId2").select(F.least("txId1", "txId2").alias("a"), F.greatest("txId1", "txId2").alias("b"))
    links = stored(ends.distinct())
    tree, trees = spanning_forest(links)
    tree = stored(tree)
    nodes = stored(preorder(tree, trees))
    at = nodes.select("node", "pre", "size")
    side = lambda c: at.select(F.col("node").alias(c), F.col("pre").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    other = links.join(tree, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    first = F.col("pa") < F.col("pb")
    other = stored(other.select(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q"), F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("size")))
    far = other.select(F.col("p").alias("pre"), F.col("q").alias("to")).union(other.select("q", "p")).groupBy("pre").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    reach = stored(nodes.select("pre").join(far, "pre", "left").select("pre", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high")))
    under = nodes.where("parent is not null")
    bounds = _subtree_bounds(under, reach)
    over = nodes.where("parent is not null").select(F.col("pre").alias("parent"), F.col("size").alias("size_over"))  # a parent that is a root has no edge above
    around = under.select("pre", "parent").join(bounds, "pre").join(over, "parent").where((F.col("low") < F.col("parent")) | (F.col("high") >= F.col("parent") + F.col("size_over")))
    across = other.where(F.col("p") + F.col("size") <= F.col("q"))  # neither lies under the other
    joined = stored(components(around.select(F.col("parent").alias("a"), F.col("pre").alias("b")).union(across.select("p", "q"))))
    return nodes, under.select("pre").join(joined.select(F.col("node").alias("pre"), "component"), "pre", "left").select("pre", F.coalesce("component", "pre").alias("block"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """(component, node): the nodes whose removal disconnects their component, which is named by its least node."""
    nodes, of_edge = blocks(edges)
    tree = nodes.where("parent is not null").select("pre", "parent").join(of_edge, "pre")
    met = tree.select("pre", "block").union(tree.select("parent", "block")).groupBy("pre").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b")
    return met.join(nodes, "pre").select(F.col("root").alias("component"), "node")
