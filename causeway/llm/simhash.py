"""SimHash near-duplicates found through deletion-variant signatures.

Each document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Fingerprints of at
most MAX_BITS = 3 different bits are linked. The 64 bits are cut into two segments, so that one of them differs in at most
one bit; every segment is indexed once for each of its 32 bits, with that bit as a wildcard. Equal index keys give
candidates, which are verified over all 64 bits. Keys that more than CROWD fingerprints share are not compared pair by pair: the
rest of the fingerprint is indexed in the same way, in halves with one wildcard, which loses no link, since of three
different bits one half again has at most one. Only what then still shares a key is compared.

Equal fingerprints are one node; links are found between distinct fingerprints, so a group of copies costs one row.

Cases: null and empty texts have fingerprint zero and are linked like any other. A null id keeps its row, never becomes a
component id while its component has an id, and repeated rows get equal results. Very long texts are hashed whole. An
empty table gives an empty result. `one_of_each` carries columns of any name along; the others read the named ones only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, column, components, flagged, joined_by_key, packed, slices, stored, text_bytes

SHINGLE, SEED, MAX_BITS, CROWD = 3, 42, 3, 64
_PIECE = 1 << 18


def fingerprint(raw: bytes) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as a signed number."""
    words = raw.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > SHINGLE:
        starts, ends = starts[: -SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _PIECE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _PIECE].tolist(), ends[k : k + _PIECE].tolist())])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (XXH64 of the text, as Spark's xxhash64) and fp (bigint) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            hashes = [int.from_bytes(xxhash.xxh64_digest(x, SEED), "big", signed=True) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(map(fingerprint, texts), pa.int64())], ["doc_id", "t", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, t bigint, fp bigint")


def _variants(part: Column, bits: int, tag: int) -> Column:
    """Keys of a segment with one wildcard bit each; the segment's tag and the wildcard's place are part of the key."""
    place = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.transform(place, lambda i: part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).bitwiseOR(F.call_function("shiftleft", (i + tag * bits).cast("bigint"), F.lit(bits))))


def _segment(fp: Column, index: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, index * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key others share, with the number of them. Only counts of keys are shuffled, and then rows of shared keys."""
    return joined_by_key(rows, stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")), keys, keys[-1])


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verified pairs of fingerprints of one key."""
    a, b = rows.alias("a"), rows.alias("b")
    same = F.col("a.fp") < F.col("b.fp")
    for k in keys:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, same & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` with at most MAX_BITS different bits, each once."""
    fp = F.col("fp")
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a row becomes 64
    rows = spread.select("fp", F.explode(F.concat(*(_variants(_segment(fp, s, 32), 32, s) for s in (0, 1)))).alias("key"))
    shared = stored(_crowded(rows, ["key"]))
    few = _pairs(shared.where(F.col("n") <= CROWD).select("key", "fp"), ["key"])
    # the segment that the key does not cover, in halves; three different bits leave one half with at most one
    covered = F.shiftrightunsigned("key", 37)
    rest = F.when(covered == 0, _segment(fp, 1, 32)).otherwise(_segment(fp, 0, 32))
    many = shared.where(F.col("n") > CROWD).select("key", "fp", F.explode(F.concat(*(_variants(_segment(rest, s, 16), 16, s) for s in (0, 1)))).alias("inner"))
    inner = _crowded(many, ["key", "inner"]).select("key", "inner", "fp")
    return few.unionByName(_pairs(inner, ["key", "inner"])).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t, fp, root (a fingerprint that names the component) and component_id (least doc_id reachable by links) of every row."""
    found = stored(fingerprints(docs, doc_id, text))
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes)).select(F.col("node").alias("fp"), "component")
    roots = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(groups, "root").select("fp", "root", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "t", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component: that of the least id, rows without an id last; of repeated rows one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    found = stored(near_duplicates(docs, doc_id, text).groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("times")))
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.t").alias("t"))
    f, k = found.alias("f"), kept.alias("k")
    chosen = f.join(k, F.col("f.doc_id").eqNullSafe(F.col("k.id")) & (F.col("f.t") == F.col("k.t")), "left")
    out = stored(chosen.where(F.col("k.t").isNull() | (F.col("times") > 1)).select(F.col("doc_id").alias("id"), "f.t", F.col("k.t").isNotNull().alias("again")))
    # rows that are dropped, and those that occur several times; the others stay where they are
    mine = flagged(packed(docs, id=column(docs, doc_id), t=F.xxhash64(F.coalesce(column(docs, text), F.lit("")))), out, ["id", "t"], "out")
    same = F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.t") == F.col("o.t"))
    some = mine.where("flag").alias("d").join(out.alias("o"), same, "left").where("again is null or again").select("row", "d.id", "d.t", "again")
    single, repeated = some.where("again is null").select("row"), some.where("again").dropDuplicates(["id", "t"]).select("row")
    return mine.where("not flag").select("row").unionByName(single).unionByName(repeated).select("row.*")


def brute_force(documents: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs; for tests."""
    found = []
    for d, t in documents:
        words = (t or "").encode().translate(LOWER_AZ).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
        found.append((d, sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))))
    root = list(range(len(found)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(found):
        for j in range(i):
            if (x ^ found[j][1]).bit_count() <= MAX_BITS:
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(found):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, f"{x:016x}", least[top(i)]) for i, (d, x) in enumerate(found)]
