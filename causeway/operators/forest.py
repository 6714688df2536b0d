"""Forests of transactions: roots, depths, distances, anchors and neighbourhoods.

Every transaction has at most one source, and sources are older, so components are rooted trees. All walks double their
stride with each join instead of taking one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shuffled, stored, stored_told
from .graph import spaced
from .intervals import overlapping
from .numbering import numbered


#: Rows up to which those still on their way may be broadcast.
FEW = 100_000


class Forest:
    """Trees given by nodes (tx_id) and edges (txId1 parent, txId2 child)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        """Pointer jumping: `jumps[k]` leads from a node to its ancestor 2**k above, or its root."""
        up = edges.select(F.col("txId2").alias("node"), F.col("txId1").alias("up"))
        going = stored(shuffled(nodes.select(F.col("tx_id").alias("node"))).join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("bigint").alias("depth")))
        self.edges, self.jumps, there, few = edges, [], going.limit(0), False
        while True:
            now = going.unionByName(there)
            self.jumps.append(now.select("node", "up", F.col("depth").alias("steps")))
            step = (going if few else shuffled(going)).alias("a").join(now.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.up") != F.col("b.up")).alias("moved"))
            step, told = stored_told(step, n=F.count_if("moved"))
            # nodes that point to a root already are there, and take no part in further rounds
            there, going = there.unionByName(step.where("not moved").drop("moved")), step.where("moved").drop("moved")
            if not told["n"]:
                break
            few = told["n"] <= FEW
        self.nodes = there.select("node", F.col("up").alias("root"), "depth")

    def instances(self) -> DataFrame:
        """(node, root, depth, instance_id): trees numbered by their roots."""
        roots = self.nodes.where("node = root").select("root")
        return shuffled(self.nodes).join(numbered(roots, ["root"], "instance_id"), "root").select("node", "root", "depth", "instance_id")

    def meets(self, targets: DataFrame) -> DataFrame:
        """(node, root, depth, dm): dm is the depth at which a node's way to the root meets the way of its tree's target; targets: (target, depth)."""
        way = targets.select(F.col("target").alias("node"), F.col("depth").alias("dm"))
        for k, jump in enumerate(self.jumps):  # the way from the target to the root doubles by round; plans stay short
            both = F.array(F.struct("node", "dm"), F.struct(F.col("up").alias("node"), (F.col("dm") - F.col("steps")).alias("dm")))
            way = shuffled(way).join(jump, "node").select(F.inline(both)).groupBy("node").agg(F.min("dm").alias("dm"))
            if k % 4 == 3 or k == len(self.jumps) - 1:
                way = stored(way)
        met, told = stored_told(shuffled(self.jumps[0]).join(way, "node", "left").select("node", "up", "dm"), n=F.count_if(F.col("dm").isNull()))
        there, going = met.where("dm is not null"), met.where("dm is null")
        for _ in self.jumps:
            if not told["n"]:
                break
            step, told = stored_told(shuffled(going).alias("a").join(going.unionByName(there).alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up", "b.dm"), n=F.count_if(F.col("dm").isNull()))
            # nodes that met the way take no part in further rounds
            there, going = there.unionByName(step.where("dm is not null")), step.where("dm is null")
        return shuffled(self.nodes).join(there.select("node", "dm"), "node")

    def distances(self, targets: DataFrame) -> DataFrame:
        """(node, root, d): distance of every node to its tree's target; targets: (root, target)."""
        at = stored(shuffled(targets.select("target")).join(self.nodes.withColumnRenamed("node", "target"), "target").select("root", "target", "depth"))
        rows = shuffled(self.meets(at)).join(at.select("root", F.col("depth").alias("dt")), "root")
        return rows.select("node", "root", (F.col("depth") + F.col("dt") - 2 * F.col("dm")).alias("d"))

    def eccentricities(self) -> DataFrame:
        """(node, root, ecc): a farthest node is always an end of the tree's longest path.

        One end is a deepest node u, the other a node v farthest from u. A node whose way up meets the way of u elsewhere
        than v's does has the higher of these two places in common with v; one that meets it where v does is no farther
        from v than from u, as u is as deep as v or deeper. So distances to v follow from where all ways meet that of u.
        """
        ends = stored(self.nodes.groupBy("root").agg(F.min_by("node", F.struct((-F.col("depth")).alias("d"), "node")).alias("target"), F.max("depth").alias("depth")))
        far = F.col("depth") + F.col("du") - 2 * F.col("dm")
        rows = stored(shuffled(self.meets(ends)).join(ends.select("root", F.col("depth").alias("du")), "root").select("node", "root", "depth", "dm", far.alias("d")))
        v = rows.groupBy("root").agg(F.max(F.struct("d", "depth", "dm")).alias("v"))
        return shuffled(rows).join(v, "root").select("node", "root", F.greatest("d", F.col("depth") + F.col("v.depth") - 2 * F.least("dm", "v.dm")).alias("ecc"))

    def anchors(self, central: bool = True) -> DataFrame:
        """(root, anchor, max_distance): the node of least eccentricity, else id; or the first node."""
        e = self.eccentricities()
        order = F.struct("ecc", "node") if central else F.struct("node")
        return e.groupBy("root").agg(F.min_by("node", order).alias("anchor"), F.min_by("ecc", order).alias("max_distance"))

    def shells(self, anchors: DataFrame, hops: int) -> DataFrame:
        """(root, hop, nodes): nodes at exactly each distance 1..hops of the anchor, no farther than its max_distance."""
        if hops <= len(self.jumps):  # so few steps take fewer rounds than distances
            near = self._walked(anchors, hops)
        else:
            d = self.distances(anchors.select("root", F.col("anchor").alias("target"))).join(shuffled(anchors.select("root", "max_distance")), "root")
            near = d.where((F.col("d") >= 1) & (F.col("d") <= F.least(F.lit(hops), F.col("max_distance"))))
        return near.groupBy("root", F.col("d").alias("hop")).agg(F.array_sort(F.collect_list("node")).alias("nodes"))

    def _walked(self, anchors: DataFrame, hops: int) -> DataFrame:
        """(root, node, d): the steps 1..hops away from the anchors; in a tree, a way that does not turn back meets no node twice."""
        ends = self.edges.select(F.col("txId1").alias("node"), F.col("txId2").alias("other")).union(self.edges.select("txId2", "txId1"))
        layer, out = anchors.select("root", F.col("anchor").alias("node"), F.lit(None).cast("bigint").alias("past"), "max_distance"), None
        for hop in range(1, hops + 1):
            layer = shuffled(layer.where(F.col("max_distance") >= hop)).join(ends, "node").where(~F.col("other").eqNullSafe(F.col("past")))
            layer = stored(layer.select("root", F.col("other").alias("node"), F.col("node").alias("past"), "max_distance"))
            rows = layer.select("root", "node", F.lit(hop).cast("bigint").alias("d"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def articulation_points(self) -> DataFrame:
        """(node): in a tree, every node with two neighbours or more."""
        ends = self.edges.select(F.col("txId1").alias("node"), F.col("txId2").alias("other")).union(self.edges.select("txId2", "txId1")).distinct()
        return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("node")


def selected_anchors(anchors: DataFrame, n_nodes: int, per_thousand: int, edges: DataFrame | None = None, min_distance: int = 0) -> DataFrame:
    """The first instances whose anchors are kept: per_thousand of the nodes, one at least.

    With edges, an anchor less than min_distance steps from one kept before is passed over. Without, anchors stand in
    trees of their own and are never close. anchors: (instance_id, anchor, ...).
    """
    if edges is not None and min_distance > 1:
        anchors = spaced(anchors.withColumnRenamed("instance_id", "ordinal"), edges, min_distance).withColumnRenamed("ordinal", "instance_id")
    return anchors.orderBy("instance_id").limit(max(per_thousand * n_nodes // 1000, 1))


def held_out_instances(instances: DataFrame, windows: DataFrame) -> DataFrame:
    """(instance_id, window): of every instance the first holdout window of its pattern that overlaps its steps, or null.

    instances: (instance_id, pattern, step_min, step_max); windows: (ordinal, pattern, low, high), of any number. Instances of
    one pattern and range of steps are judged together, and of equal windows the first one, so that what overlaps is pairs of
    different ranges.
    """
    ranges = instances.select("pattern", F.col("step_min").alias("low"), F.col("step_max").alias("high")).distinct()
    first = windows.groupBy("pattern", "low", "high").agg(F.min("ordinal").alias("ordinal"))
    met = overlapping(ranges, first, ["pattern"]).groupBy("l.pattern", F.col("l.low").alias("step_min"), F.col("l.high").alias("step_max")).agg(F.min("r.ordinal").alias("window"))
    return instances.select("instance_id", "pattern", "step_min", "step_max").join(met, ["pattern", "step_min", "step_max"], "left").select("instance_id", "window")
