"""Graphs of any shape: components, breadth-first layers, eccentricities and centres, anchors that keep apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, stored_told
from .numbering import numbered


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected links; component is the least node reachable.

    Alternates the two star contractions of Kiveris et al. (2014): each round links every node's larger
    neighbours, then its smaller ones, to the least node seen. Minima are combined before the shuffle, and a
    node with very many links is an ordinary join key that adaptive execution may split. Rounds are logarithmic
    in practice; each is written to the shared folder. Loops and nulls are ignored; no links give no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    edges = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(u.alias("node"), v.alias("component"))
    while True:
        before = _signature(edges)
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.join(least, "u").where((v > u) & (v != F.col("m"))).select(v.alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct())
        # small star: smaller neighbours and the node itself go to the least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if _signature(edges) == before:
            break
    top = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).unionByName(top)


def _signature(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): the undirected adjacency of edges (txId1, txId2), each pair once, without loops."""
    ends = edges.select(F.col("txId1").alias("node"), F.col("txId2").alias("other")).where("node <> other")
    return ends.union(ends.select("other", "node")).distinct()


#: Sources that one word of bits stands for.
WORD = 64


def sweep(adjacent: DataFrame, starts: DataFrame, hops: int | None = None, beside: str | None = None) -> DataFrame:
    """(node, word, d, bits): the sources, a bit each, that first reach a node after d steps, up to `hops`; None: all the way.

    Breadth-first search from many sources at once. starts: (node, word, bits), sources of one word in one long. A round joins
    the frontier with the adjacency (node, other) and combines what meets at a node by bitwise or, so that a row is shuffled
    per node and word, not per source. What a round finds lies at most one step nearer than the frontier itself, so only the
    last two layers are taken off, not all that was seen. beside: a column of starts that goes along with all rows of a
    search, and is the same for all that a search reaches.
    """
    along = [beside] if beside else []
    frontier = stored(starts.groupBy("node", "word", *along).agg(F.bit_or("bits").alias("bits")).withColumn("d", F.lit(0)))
    last, out, hop = frontier.limit(0), frontier, 0
    while hops is None or hop < hops:
        hop += 1
        none = F.lit(0).cast("bigint")
        met = frontier.join(adjacent, "node").select(F.col("other").alias("node"), "word", *along, "bits", none.alias("seen"))
        known = frontier.unionByName(last).select("node", "word", *along, none.alias("bits"), F.col("bits").alias("seen"))
        found = met.unionByName(known).groupBy("node", "word", *along).agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        fresh = found.select("node", "word", *along, F.col("bits").bitwiseAND(F.bitwise_not("seen")).alias("bits"), F.lit(hop).alias("d")).where("bits <> 0")
        last = frontier
        frontier, told = stored_told(fresh, n=F.count(F.lit(1)))
        if not told["n"]:
            break
        out = out.unionByName(frontier)
    return out.select("node", "word", *along, "d", "bits")


def _numbered_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts, words): the searches of distinct sources (source), and of each word its sources by bit, (word, sources)."""
    rows = stored(numbered(sources.where("source is not null").select("source").distinct(), ["source"], "i"))
    bit = (F.col("i") % WORD).cast("int")
    starts = rows.select(F.col("source").alias("node"), F.floor(F.col("i") / WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    words = rows.groupBy(F.floor(F.col("i") / WORD).alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "source"))), lambda x: x["source"]).alias("sources"))  # WORD at most
    return starts, words


def _bits(bits: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("shiftright", bits, k).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def _opened(found: DataFrame, words: DataFrame) -> DataFrame:
    """(source, node, d) of rows of a sweep; opened where they are, after a join by word."""
    return found.join(words, "word").select("node", "d", "sources", F.explode(_bits(F.col("bits"))).alias("k")).select(F.get("sources", F.col("k")).alias("source"), "node", "d")


def layers(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, d): breadth-first distances up to `hops` from every source, itself at 0. sources: (source)."""
    starts, words = _numbered_sources(sources)
    return _opened(sweep(stored(neighbours(edges)), starts, hops), words)


def shells(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor, hop, nodes): the sorted nodes at exactly each distance 1..hops of an anchor, no farther than its max_distance. anchors: (anchor, max_distance)."""
    near = layers(edges, anchors.select(F.col("anchor").alias("source")), hops).where("d > 0")
    limits = anchors.select(F.col("anchor").alias("source"), "max_distance").distinct()
    near = near.join(limits, "source").where("d <= max_distance")
    return near.groupBy(F.col("source").alias("anchor"), F.col("d").alias("hop")).agg(F.array_sort(F.collect_list("node")).alias("nodes"))


#: Sources a component gets in one sweep by each of the two orders, so that both fill a word.
SWEPT = WORD // 2


def eccentricities(edges: DataFrame) -> DataFrame:
    """(node, component, ecc) of every node of the undirected edges: its distance to the farthest node of its component.

    Bounds by sweeps: a node at distance d of a source whose eccentricity is e has one of at least max(d, e - d) and at most
    d + e. Each sweep starts at those of a component's open nodes with the greatest upper and the least lower bounds, SWEPT
    of each, all components at once and the sources of each in one word, until the bounds of every node meet. Small
    components are done at once; few sweeps do where eccentricities differ, and in a ring, where all are equal, each closes
    a word of sources and the nodes across.
    """
    adjacent = stored(neighbours(edges))
    degree = adjacent.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    state = stored(components(adjacent, "node", "other").join(degree, "node").select("node", "component", "degree", F.lit(0).alias("low"), F.lit((1 << 31) - 1).alias("high")))
    done = []
    while True:
        part = Window.partitionBy("component")
        far = state.withColumn("r", F.row_number().over(part.orderBy(F.desc("high"), F.desc("degree"), "node"))).where(F.col("r") <= SWEPT).select("node", "component")
        near = state.withColumn("r", F.row_number().over(part.orderBy("low", F.desc("degree"), "node"))).where(F.col("r") <= SWEPT).select("node", "component")
        picked = far.union(near).distinct().withColumn("k", (F.row_number().over(part.orderBy("node")) - 1).cast("int"))  # WORD of a component at most
        starts = picked.select("node", "component", F.lit(0).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k")).alias("bits"))
        found = stored(sweep(adjacent, starts, None, "component"))
        last = found.select("component", "d", F.explode(_bits(F.col("bits"))).alias("k")).groupBy("component", "k").agg(F.max("d").alias("ecc"))
        by_bit = last.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("k", "ecc"))).alias("eccs"))
        # a component may hold most nodes, so its rows are spread over several keys
        salt = F.pmod(F.xxhash64("node"), F.lit(WORD)).cast("int")
        salted = by_bit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))
        at = found.withColumn("salt", salt).join(salted, ["component", "salt"])
        ecc = F.transform(_bits(F.col("bits")), lambda k: F.col("eccs")[k])
        bounds = at.select("node", F.array_max(F.transform(ecc, lambda e: F.greatest(F.col("d"), e - F.col("d")))).alias("l"), (F.array_min(ecc) + F.col("d")).alias("h"), F.when(F.col("d") == 0, F.array_max(ecc)).alias("own"))
        bounds = bounds.groupBy("node").agg(F.max("l").alias("l"), F.min("h").alias("h"), F.max("own").alias("own"))
        high = F.least("high", "h")
        state = stored(state.join(bounds, "node").select("node", "component", "degree", F.coalesce("own", F.greatest("low", "l")).alias("low"), F.coalesce("own", high).alias("high")))
        done.append(state.where("low = high").select("node", "component", F.col("low").alias("ecc")))
        state = state.where("low < high")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)


def centres(edges: DataFrame) -> DataFrame:
    """(component, anchor, max_distance): of every component the node of least eccentricity, then id."""
    order = F.struct("ecc", "node")
    return eccentricities(edges).groupBy("component").agg(F.min_by("node", order).alias("anchor"), F.min_by("ecc", order).alias("max_distance"))


def too_close(anchors: DataFrame, edges: DataFrame, distance: int) -> DataFrame:
    """(a, b): pairs of different anchors less than `distance` steps apart. anchors: (anchor)."""
    starts, words = _numbered_sources(anchors.select(F.col("anchor").alias("source")))
    found = sweep(stored(neighbours(edges)), starts, max(distance - 1, 0)).where("d > 0")
    met = found.join(starts.select("node").distinct(), "node", "left_semi")  # rows at anchors, before bits are opened
    return _opened(met, words).select(F.col("source").alias("a"), F.col("node").alias("b"))


def spaced(anchors: DataFrame, edges: DataFrame, distance: int) -> DataFrame:
    """The anchors (ordinal, anchor) that a walk in order of ordinal keeps if each must keep `distance` from all kept before.

    In rounds: an undecided anchor without an undecided one before it nearby is kept, and what is close to it is dropped.
    """
    close = too_close(anchors, edges, distance)
    a, b = anchors.select(F.col("anchor").alias("a"), F.col("ordinal").alias("oa")), anchors.select(F.col("anchor").alias("b"), F.col("ordinal").alias("ob"))
    later = stored(close.join(a, "a").join(b, "b").where("oa < ob").select("a", "b"))
    open_, kept = stored(anchors.select("anchor")), None
    while not open_.isEmpty():
        left = later.join(open_.select(F.col("anchor").alias("a")), "a").join(open_.select(F.col("anchor").alias("b")), "b")
        free = stored(open_.join(left.select(F.col("b").alias("anchor")), "anchor", "left_anti"))
        kept = free if kept is None else kept.union(free)
        dropped = later.join(free.select(F.col("anchor").alias("a")), "a").select(F.col("b").alias("anchor"))
        open_ = stored(open_.join(free, "anchor", "left_anti").join(dropped, "anchor", "left_anti"))
    return anchors if kept is None else anchors.join(kept, "anchor").select(anchors.columns)
