"""Degree-preserving shuffling of directed edges, in rounds of swaps that do not touch each other; digests of edge lists."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .numbering import numbered

#: Attempts that a part has for each of its edges.
PER_EDGE = 20


def dealt(rows: DataFrame, seeds: dict[str, int], sizes: dict[str, int], turn: int) -> DataFrame:
    """(part, pair, other, draw, u1, v1, u2, v2): random pairs of edges, each edge in one pair at most.

    A digest of (seed, turn, edge) puts an edge into one of half as many buckets as there are edges; those that meet there,
    two on average, are paired in order of the digest, and an odd one sits the round out. rows: (part, edge, u, v).
    """
    of_part = lambda values, kind: F.coalesce(*[F.when(F.col("part") == p, F.lit(x).cast(kind)) for p, x in values.items()])
    # seeds may be greater than a bigint
    draw = F.md5(F.concat_ws(":", of_part({p: str(x) for p, x in seeds.items()}, "string"), F.lit(str(turn)), F.col("edge").cast("string")))
    bucket = F.conv(F.substring("draw", 1, 12), 16, 10).cast("bigint") % of_part({p: max(n // 2, 1) for p, n in sizes.items()}, "bigint")
    met = rows.withColumn("draw", draw).withColumn("bucket", bucket).groupBy("part", "bucket").agg(F.array_sort(F.collect_list(F.struct("draw", "edge", "u", "v"))).alias("x"))  # a few edges
    two = met.where(F.size("x") > 1).select("part", "x", F.explode(F.sequence(F.lit(0), F.size("x").cast("int") - 2, F.lit(2))).alias("i"))
    a, b = F.get("x", F.col("i")), F.get("x", F.col("i") + 1)
    return two.select("part", a["edge"].alias("pair"), b["edge"].alias("other"), a["draw"].alias("draw"), a["u"].alias("u1"), a["v"].alias("v1"), b["u"].alias("u2"), b["v"].alias("v2"))


def acceptable(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that may trade targets all at once: no loop, and no edge that another one has or another pair proposes.

    All proposed edges and all present ones meet once, by their ends.
    """
    sound = pairs.where("u1 <> v2 and u2 <> v1 and not (u1 = u2 and v1 = v2)")
    mine = lambda u, v: F.when((F.col("u1") == F.col(u)) & (F.col("v1") == F.col(v)), 1).otherwise(0) + F.when((F.col("u2") == F.col(u)) & (F.col("v2") == F.col(v)), 1).otherwise(0)
    wish = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), mine(u, v).alias("mine"))
    wishes = sound.select("part", "pair", F.explode(F.array(wish("u1", "v2"), wish("u2", "v1"))).alias("w")).select("part", "w.u", "w.v", "pair", "w.mine", F.lit(0).alias("there"))
    there = rows.select("part", "u", "v", F.lit(None).cast("bigint").alias("pair"), F.lit(None).cast("int").alias("mine"), F.lit(1).alias("there"))
    ends = wishes.unionByName(there).groupBy("part", "u", "v").agg(F.count("pair").alias("wishes"), F.sum("there").alias("there"), F.max("pair").alias("pair"), F.max("mine").alias("mine"))
    free = ends.where("wishes = 1 and there = mine").groupBy("part", "pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return sound.join(free.select("part", "pair"), ["part", "pair"])


def _first(pairs: DataFrame, left: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """Of each part the pairs of least draw, as many as are left, and how many these are; parts with fewer stay whole and are not ranked. pairs: stored."""
    counts = {r["part"]: r["n"] for r in pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    over = [p for p, n in counts.items() if n > left[p]]
    if over:
        most = F.coalesce(*[F.when(F.col("part") == p, F.lit(left[p])) for p in over])
        ranked = numbered(pairs.where(F.col("part").isin(over)), ["draw", "pair"], "rank", ["part"]).where(F.col("rank") < most).drop("rank")
        pairs = stored(pairs.where(~F.col("part").isin(over)).unionByName(ranked))
    return pairs, {p: min(n, left[p]) for p, n in counts.items()}


def shuffled(edges: DataFrame, seeds: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(part, txId1, txId2) with targets traded within each part under its seed, and (part, attempts, swaps, changed_fraction, status).

    A parallel Markov chain: each round deals the edges of every part into random pairs, lets every pair propose to trade
    its targets, and carries out those proposals that neither make a loop or a double edge nor meet another's. So any number
    of swaps of a round may be done in any order, with the same outcome. A part ends with as many swaps as it has edges, or
    PER_EDGE attempts for each; neither is ever exceeded. Out- and in-degrees stay. A part of one edge has nothing to trade.

    The outcome depends on seeds and edges alone, not on partitions. All parts share the jobs of a round, which shuffle rows
    of an edge's size by bucket, by ends and by edge, and never by part.
    """
    rows = numbered(edges.where(F.col("part").isin(*seeds)).select("part", "txId1", "txId2"), ["txId1", "txId2"], "edge", ["part"])
    rows = stored(rows.select("part", "edge", F.col("txId1").alias("u"), F.col("txId2").alias("v"), F.col("txId2").alias("was")))
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    tries, swaps, turn = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), 0
    while going := [p for p, n in sizes.items() if n > 1 and swaps[p] < n and tries[p] < n * PER_EDGE]:
        now = rows.where(F.col("part").isin(going))
        pairs, more = _first(stored(dealt(now, seeds, sizes, turn)), {p: sizes[p] * PER_EDGE - tries[p] for p in going})
        tries = {p: n + more.get(p, 0) for p, n in tries.items()}
        taken, more = _first(stored(acceptable(pairs, now)), {p: sizes[p] - swaps[p] for p in going})
        swaps = {p: n + more.get(p, 0) for p, n in swaps.items()}
        moves = taken.select("part", F.explode(F.array(F.struct(F.col("pair").alias("edge"), F.col("v2").alias("new")), F.struct(F.col("other").alias("edge"), F.col("v1").alias("new")))).alias("m")).select("part", "m.*")
        rows = stored(rows.join(moves, ["part", "edge"], "left").select("part", "edge", "u", F.coalesce("new", "v").alias("v"), "was"))
        turn += 1
    told = rows.groupBy("part").agg((F.sum((F.col("v") != F.col("was")).cast("int")) / F.count(F.lit(1))).alias("changed_fraction"))
    count = lambda values: F.coalesce(*[F.when(F.col("part") == p, F.lit(x).cast("bigint")) for p, x in values.items()], F.lit(0).cast("bigint"))
    status = F.when(F.col("changed_fraction") > 0, "ok").otherwise("not_testable").alias("status")
    return rows.select("part", F.col("u").alias("txId1"), F.col("v").alias("txId2")), told.select("part", count(tries).alias("attempts"), count(swaps).alias("swaps"), "changed_fraction", status)


def edge_digest(edges: DataFrame) -> DataFrame:
    """(part, sha256): the digest of each part's edges as CSV text in order of their ends.

    A digest is a chain by its definition, so a part is read by one task; but it is sorted by Spark, which spills, and passes
    through in batches with the state of the hash carried along, so that the task holds one batch of it.
    """

    def run(batches):
        part, state = None, None
        for batch in batches:
            parts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(parts):
                if state is None or parts[at] != part:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([state.hexdigest()])], ["part", "sha256"])
                    part, state = parts[at], hashlib.sha256(b"txId1,txId2\n")
                end = at + next((k for k, p in enumerate(parts[at:]) if p != part), len(parts) - at)
                state.update("".join(lines[at:end]).encode())
                at = end
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([state.hexdigest()])], ["part", "sha256"])

    line = F.concat(F.col("txId1").cast("string"), F.lit(","), F.col("txId2").cast("string"), F.lit("\n")).alias("line")
    ordered = edges.select("part", "txId1", "txId2").repartition("part").sortWithinPartitions("part", "txId1", "txId2")
    return ordered.select("part", line).mapInArrow(run, "part string, sha256 string")
