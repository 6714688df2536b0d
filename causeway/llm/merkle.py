"""Merkle manifest of a dataset: a root over all rows, and a proof for each.

Rows are leaves, digests of their fields. The leaves of a group (say, a source) are sorted into runs, each a stretch of the
stored table of level 0, and numbered by the sizes of the runs. Every 16 nodes in a row make one of the next level, so the
coordinate of a node is (group, place) and that of its parent (group, place / 16); each level is read from the folder of the
one before, hashed and written to its own, `level=k` of the node store, with the digests of the children beside each node.
A group whose last level is one node ends there with its subroot; the subroots, in order of the groups, are the leaves of
one more tree, built the same way. Proofs come from a scan downwards: the nodes of a level meet their parents by coordinate,
and take over the parents' ways to the root with one step more. The last scan opens the nodes above the leaves, which hold
their children already, so leaves are neither joined nor shuffled again.

A hot group is as many runs as its rows need. What a task holds is a node with its 16 children and one way to the root, whose
length is the number of levels, the base-16 logarithm of the rows.

Cases: null fields have a digest of their own, and a null group is a group, the first one. Leaves of a group ascend by id,
null ids first; of equal ids the smaller digest comes first, and repeated rows are leaves of their own. Empty texts are
digested as such, very long ones whole. A group of one leaf has it as its subroot, and a table of one group the subroot as
its root. An empty table has no leaves, no proofs and no root. Only the named columns are read, so further ones of any name
are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import column, crc32_sql, shared_dir

#: Nodes of a run, and characters of a digest.
FAN, DIGEST = 16, 64


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field its length in bytes, a colon and its text; a null is a dash."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def _upwards(run: Column, place: Column, digest: Column) -> Column:
    """The digest of a run in which one node is replaced."""
    return F.sha2(F.concat(F.substring(run, F.lit(1), place * DIGEST), digest, F.substring(run, place * DIGEST + DIGEST + 1, F.lit(FAN * DIGEST))), 256)


def siblings(way: Column) -> Column:
    """The digests beside a way to the root, level by level, left to right, as one text."""
    others = lambda s: F.concat(F.substring(s["run"], F.lit(1), s["place"] * DIGEST), F.substring(s["run"], s["place"] * DIGEST + DIGEST + 1, F.lit(FAN * DIGEST)))
    return F.array_join(F.transform(way, others), "")


def folded(digest: Column, way: Column) -> Column:
    """The root that follows from a leaf's digest and its way."""
    return F.aggregate(way, digest, lambda got, s: _upwards(s["run"], s["place"], got))


_WAY = "array<struct<run string, place int>>"


class Trees:
    """A tree for each group, over leaves (grp, order columns, digest, carried columns), in a store of one folder a level."""

    def __init__(self, leaves: DataFrame, order: list[str | Column], carried: list[str] = ()):
        self.spark = leaves.sparkSession
        self.store = f"{shared_dir(self.spark)}/causeway/{uuid.uuid4().hex}"
        self.carried = list(carried)
        placed = numbered(leaves, order, "place", ["grp"])
        self._write(0, placed.select("grp", "place", "digest", *self.carried))
        counts = self.level(0).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        self._write("counts", counts)
        self.counts = self.spark.read.schema(counts.schema).parquet(f"{self.store}/level=counts")
        most = self.counts.agg(F.max("n")).first()[0] or 0
        self.top = 0
        while FAN**self.top < most:  # a level more than the last that has several nodes of some group
            self._write(self.top + 1, self._parents(self.top))
            self.top += 1

    def _write(self, level, rows: DataFrame) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.store}/level={level}")

    def level(self, k: int) -> DataFrame:
        """The nodes of a level: grp, place, digest, and at level 0 the carried columns, above it `run`, and at level 1 `leaves`."""
        return self.spark.read.parquet(f"{self.store}/level={k}")

    def _parents(self, k: int) -> DataFrame:
        """The nodes above level k, of the groups that have several there."""
        run, several = F.shiftright("place", 4).alias("place"), self.counts.where(F.col("n") > FAN**k).select(F.col("grp").alias("g"))
        below = self.level(k)
        node = F.struct("place", "digest", *self.carried) if k == 0 else F.struct("place", "digest")
        grouped = below.groupBy("grp", run).agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # FAN at most
        grouped = grouped.join(several, F.col("grp").eqNullSafe(F.col("g")), "left_semi")
        joined = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
        return grouped.select("grp", "place", F.sha2(joined, 256).alias("digest"), joined.alias("run"), *([F.col("nodes").alias("leaves")] if k == 0 else []))

    def subroots(self) -> DataFrame:
        """(grp, digest): the last node of each group."""
        found = []
        for k in range(self.top + 1):
            ends = self.counts.where((F.col("n") <= FAN**k) & (F.col("n") > (FAN ** (k - 1) if k else 0))).select(F.col("grp").alias("g"))
            found.append(self.level(k).select("grp", "digest").join(ends, F.col("grp").eqNullSafe(F.col("g")), "left_semi"))
        return reduce(DataFrame.unionByName, found)

    def ways(self, above: DataFrame) -> DataFrame:
        """(grp, digest, carried columns, way, and the columns of above but its way): every leaf with its way to the root.

        above: (grp, way, ...), for each group the way from its subroot on.
        """
        extra = [c for c in above.columns if c not in ("grp", "way")]
        met = lambda rows, ends: rows.alias("l").join(ends.alias("e"), F.col("l.grp").eqNullSafe(F.col("e.grp"))).select("l.*", "e.way", *[f"e.{c}" for c in extra])
        sized = met(self.counts, above)  # a row for each group
        open_ = None  # the nodes of the level above with their ways
        for k in range(self.top, 0, -1):
            nodes = self.level(k)
            last = met(nodes, sized.where((F.col("n") <= FAN**k) & (F.col("n") > FAN ** (k - 1))))
            if open_ is not None:
                up = open_.select(F.col("grp").alias("g"), F.col("place").alias("p"), "run_", "way_", *extra)
                inner = nodes.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.shiftright("place", 4) == F.col("p")))
                step = F.array(F.struct(F.col("run_").alias("run"), F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("place")))
                last = last.unionByName(inner.select(*nodes.columns, F.concat(step, "way_").alias("way"), *extra))
            open_ = last.withColumnRenamed("way", "way_").withColumn("run_", F.col("run"))
        single = met(self.level(0), sized.where("n = 1")).select("grp", "digest", *self.carried, "way", *extra)
        if open_ is None:
            return single
        leaves = open_.select("grp", "run", "way_", *extra, F.explode("leaves").alias("x"))
        step = F.array(F.struct("run", F.col("x.place").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("place")))
        return leaves.select("grp", "x.digest", *[f"x.{c}" for c in self.carried], F.concat(step, "way_").alias("way"), *extra).unionByName(single)


class Manifest:
    """The trees of all groups and the one over their subroots."""

    def __init__(self, docs: DataFrame, fields: list[str], group: str, order: str, carried: dict[str, Column] | None = None):
        carried = carried or {}
        rows = docs.select(column(docs, group).alias("grp"), column(docs, order).alias("ord"), leaf(*[column(docs, f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()])
        self.groups = Trees(rows, ["ord", "digest"], ["ord", *carried])
        subroots = self.groups.subroots().select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")
        self.roots = Trees(subroots, ["name"], ["name"])

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.roots.subroots().select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(id, grp, leaf, subroot, root, way, carried columns) of every row; way: (run, place) from the leaf's run to the root's."""
        root = self.roots.subroots().select("grp", F.col("digest").alias("root"), F.array().cast(_WAY).alias("way"))
        above = self.roots.ways(root).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "way")
        return self.groups.ways(above).withColumnRenamed("digest", "leaf").withColumnRenamed("ord", "id")


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, **carried: Column) -> Manifest:
    """The manifest of docs: leaves of `fields`, a tree for each value of `group`, leaves in order of `order`. carried: columns that proofs bring along."""
    return Manifest(docs, fields, group, order, carried)


def audited(docs: DataFrame) -> DataFrame:
    """Every document with its proof, and whether the proof still holds after the tampering that the query describes."""
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.when(chosen, leaf(*[F.col(f) for f in fields[:-1]], tampered))
    out = manifest(docs, fields, "source", "doc_id", altered=altered).proofs()
    way = F.col("way")
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(way), 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), way).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """DuckDB SQL of the query, for up to 16**levels leaves a group and groups: every level spelled out, proofs folded upwards."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda text: f"sha256({' || '.join(map(field, ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text)))})"
    low = row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    order = "row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1"
    out = [f"base AS (SELECT *, {order} AS p FROM (SELECT doc_id, source AS g, {row('text')} AS leaf, {low} AS low, {crc32_sql('doc_id::VARCHAR')} % 5 = 0 AS hit FROM documents))"]
    for t, nodes in (("a", "SELECT g, p, leaf AS d FROM base"), ("b", f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, d, g AS name FROM a_n{levels}")):
        out.append(f"{t}_n0 AS ({nodes})")
        for k in range(levels):
            run = "string_agg(d, '') OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            out.append(f"{t}_r{k} AS (SELECT g, p, d, p % 16 AS i, count(*) OVER (PARTITION BY g) AS c, {run} AS run FROM {t}_n{k})")
            out.append(f"{t}_n{k + 1} AS (SELECT DISTINCT g, p // 16 AS p, CASE WHEN c = 1 THEN d ELSE sha256(run) END AS d FROM {t}_r{k})")
    out.append(f"""way AS (SELECT s.*, a.d AS subroot, n.p AS q, b.d AS root, '' AS proof, CASE WHEN s.hit THEN s.low ELSE s.leaf END AS fold
  FROM base s JOIN a_n{levels} a ON a.g IS NOT DISTINCT FROM s.g JOIN b_n0 n ON n.name IS NOT DISTINCT FROM s.g, b_n{levels} b)""")
    last, left, right = "way", "r.run[:r.i * 64]", "r.run[r.i * 64 + 65:]"
    for t, place, group in (("a", "p", "w.g"), ("b", "q", "0")):
        for k in range(levels):
            out.append(f"""{t}_w{k} AS (SELECT w.* REPLACE (CASE WHEN r.c = 1 THEN w.proof ELSE w.proof || {left} || {right} END AS proof, CASE WHEN r.c = 1 THEN w.fold ELSE sha256({left} || w.fold || {right}) END AS fold)
  FROM {last} w JOIN {t}_r{k} r ON r.g IS NOT DISTINCT FROM {group} AND r.p = w.{place} // {FAN**k})""")
            last = f"{t}_w{k}"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}"


SQL = _sql()
