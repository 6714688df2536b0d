"""Substring dedup on a compacted De Bruijn graph of words.

Every run of WINDOW words is an edge (a k-mer) between two nodes, its first and its last WINDOW - 1 words. A word covered by
an edge that also starts in a document of a smaller id is removed. Five steps keep the graph far smaller than the text:

1. Every edge has a seed, the least hash among its SEED_WORDS-grams, so equal edges have equal seeds. Each batch reduces its
   seeds to distinct sorted hashes; hash ranges of them are merged, and seeds met in one document only are dropped. What is
   left is a bit table of fixed size that tells every task which edges may repeat.
2. Consecutive edges of one seed form a piece of a path, read as one row: its place (source coordinates), its seed and the
   XXH3 of its words, which are its key, and the piece that follows. Combined by key, these give its first place, how often
   it occurs, and the out-degree of its last node: one follower or several.
3. Compaction: a repeated piece is joined with its follower where the node between them does not branch, that is, where all
   its occurrences have that follower and the follower occurs as often. What hangs together is one path; its first piece
   stands for it, with the source coordinates of the whole.
4. A seed with several pieces branches inside. Such pieces are opened into single edges, and edges that occur in several
   pieces are joined to their first place; runs of them with one source become paths again.
5. Every path is read again at its source coordinates. Its occurrences are found by a join on its first piece, and words are
   removed only where the SHA-256 of the occurrence's words is that of the source's words. Hashes only ever propose.

Every join runs on minima that are combined before the shuffle; the copies of a path only meet its first one, and keys of a
large part of all rows are joined without a shuffle. The bit table is capped at MAX_BITS bits; beyond that more edges pass
the first step, which costs time but changes no result.

Words are maximal runs without ASCII white space, compared as they are.

Cases: null and empty texts have no words. Rows without an id keep all words and count for no other. Rows of one id are
never compared with each other; rows equal in id and text get equal results. A text must fit in a task's memory several
times over. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, bitmap, in_bitmap, joined_by_key, slices, stored

WINDOW, SEED_WORDS = 13, 5
#: Bits of the table for each repeated seed, and of all as a power; buckets, as powers of two, of the first exchange and of all.
SEED_BITS, MAX_BITS, FIRST_BUCKETS, MAX_BUCKETS = 16, 29, 12, 24
_GROUP = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


class _Hasher:
    """Polynomial hashes of all slices of an array through prefix sums."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, *_powers(base, 1 << 16)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.up):
            self.up, self.down = _powers(self.base, 1 << (len(values) + 1).bit_length())
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((prefix[ends] - prefix[starts]) * self.down[starts])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For seeds alone, which only choose what is compared: words that differ may have equal hashes here.
_BYTES, _WORDS = (_Hasher(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))


class Group:
    """Some consecutive texts, words joined by single spaces: their words, edges and seeds as arrays."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data]
        begins = ~space
        ends = begins.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(bounds[1:], self.starts, "right")
        self.n_words = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.hashed = hashed = _WORDS.prefix(_BYTES.slices(_BYTES.prefix(data.astype(np.uint64) + np.uint64(1)), self.starts, self.stops))
        n = max(len(self.starts) - WINDOW + 1, 0)
        self.at = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        i = np.arange(max(len(self.starts) - SEED_WORDS + 1, 0))
        grams = _WORDS.slices(hashed, i, i + SEED_WORDS)
        least = grams[:n].copy()
        for k in range(1, WINDOW - SEED_WORDS + 1):
            np.minimum(least, grams[k : k + n], out=least)
        self.seed = least[self.at]

    def content(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XXH3 of the words from each start to its end, as signed numbers."""
        raw, digest = self.raw, xxhash.xxh3_64_digest
        return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(self.starts[starts].tolist(), self.stops[ends - 1].tolist())]), ">i8").astype(np.int64)

    def cheap(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of edges that may be equal where the words are not."""
        return _WORDS.slices(self.hashed, starts, starts + WINDOW)

    def cuts(self, passed: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, word in text, edges, seed, first edge) of the maximal runs of passed edges with one seed."""
        at, seed = self.at[passed], self.seed[passed]
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        near = (at[1:] == at[:-1] + 1) & (self.text[at[1:]] == self.text[at[:-1]])
        heads = np.flatnonzero(np.concatenate([[True], ~near | (seed[1:] != seed[:-1])]))
        first = at[heads]
        return self.text[first], first - self.first[self.text[first]], np.diff(np.append(heads, len(at))), seed[heads].view(np.int64), first

    def pieces(self, passed: np.ndarray) -> tuple[np.ndarray, ...]:
        """cuts() with the content of each, and whether the next one follows at once: (text, word in text, edges, seed, content, follows)."""
        text, pos, n, seed, first = self.cuts(passed)
        if not len(text):
            return (text,) * 6
        follows = np.append((first[1:] == first[:-1] + n[:-1]) & (text[1:] == text[:-1]), False)
        return text, pos, n, seed, self.content(first, first + n - 1 + WINDOW), follows


def _groups(column: pa.Array) -> Iterator[tuple[int, int, Group, list[bytes]]]:
    """(first row, end row, group, raw texts) of the texts of a batch, about _GROUP bytes each."""
    k, raw = 0, []
    size, binary = 0, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), 64):  # a part of the batch at a time
        for x in column.slice(at, 64).cast(binary).to_pylist():
            raw.append(x or b"")
            size += len(raw[-1])
            if size >= _GROUP:
                yield k, k + len(raw), Group([b" ".join(x.split()) for x in raw]), raw
                k, raw, size = k + len(raw), [], 0
    if raw:
        yield k, k + len(raw), Group([b" ".join(x.split()) for x in raw]), raw


def _with_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def repeated_seeds(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the seeds that more than one document may hold, by the top bits of their hashes; and its size in bits as a power."""
    buckets = max(4, min(MAX_BUCKETS, (2 * docs.rdd.getNumPartitions() - 1).bit_length()))
    wide = min(buckets, FIRST_BUCKETS)

    def cut(seed: np.ndarray, several: np.ndarray, low: int, high: int, power: int) -> list[tuple]:
        """Rows (bucket, seeds, several) of sorted seeds by their top bits, for the buckets low to high of 2**power."""
        edges = np.arange(low, high, dtype=np.uint64) << np.uint64(64 - power)
        at = np.searchsorted(seed, edges).tolist() + [len(seed)]
        return [(low + b, seed[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for b, (x, y) in enumerate(zip(at, at[1:])) if x < y]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "seeds", "several"])

    def collect(batches):
        for batch in batches:
            ids, seeds, owners = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for k, _, group, _ in _groups(batch.column(1)):
                text = group.text[group.at]
                new = np.ones(len(text), bool)
                new[1:] = (group.seed[1:] != group.seed[:-1]) | (text[1:] != text[:-1])
                seeds.append(group.seed[new])
                owners.append(ids[k + text[new]])
            if not seeds:
                continue
            seed, owner = np.concatenate(seeds), np.concatenate(owners)
            order = np.argsort(seed, kind="stable")
            seed, owner = seed[order], owner[order]
            heads = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
            if not len(heads):
                continue
            several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
            seed = seed[heads]
            yield batch_of(cut(seed, several, 0, 1 << wide, wide))

    def finer(batches):  # rows of one wide bucket become rows of its narrow ones, one at a time
        each = 1 << (buckets - wide)
        for batch in batches:
            for bucket, seeds, several in zip(*(c.to_pylist() for c in batch.columns)):
                seed = np.frombuffer(seeds, np.uint64)
                yield batch_of(cut(seed, np.unpackbits(np.frombuffer(several, np.uint8), count=len(seed)).astype(bool), bucket * each, (bucket + 1) * each, buckets))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        seeds = [np.frombuffer(x, np.uint64) for x in frame["seeds"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)) for x, s in zip(frame["several"], seeds)]).astype(bool)
        seed = np.concatenate(seeds)
        again = seed[several]
        seed.sort()
        again = np.unique(np.concatenate([again, seed[1:][seed[1:] == seed[:-1]]]))
        return pd.DataFrame({"bucket": frame["bucket"][:1], "n": [len(again)], "seeds": [again.tobytes()]})

    schema = "bucket int, seeds binary, several binary"
    sent = docs.where("doc_id is not null").mapInArrow(collect, schema)
    if buckets > wide:
        sent = sent.repartition("bucket").mapInArrow(finer, schema)
    repeated = stored(sent.repartition(1 << min(buckets, FIRST_BUCKETS), "bucket").groupBy("bucket").applyInPandas(merge, "bucket int, n bigint, seeds binary"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    bits = max(buckets + 3, min(MAX_BITS, (SEED_BITS * total).bit_length()))

    def mark(batches):
        for batch in batches:
            for bucket, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.zeros(1 << (bits - buckets), bool)
                part[(np.frombuffer(seeds, np.uint64) >> np.uint64(64 - bits)).astype(np.int64) & (len(part) - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["bucket", "part"])

    table = np.zeros((1 << bits) // 8, np.uint8)
    width = len(table) >> buckets
    for row in repeated.select("bucket", "seeds").mapInArrow(mark, "bucket int, part binary").toLocalIterator():  # 2**bits bits in all
        table[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["part"], np.uint8)
    return table, bits


def _passing(table: bytes, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit, that of their top bits, in the table."""
    bit = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (np.frombuffer(table, np.uint8)[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def _pieces(docs: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """A row per document (pos null) with its words and the digest of them all, and a row per piece that may repeat. shared: the bit table of seeds."""

    def run(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for k, end, group, raw in _groups(batch.column(1)):
                text, pos, n, seed, content, follows = group.pieces(_passing(shared.value, bits, group.seed) & known[k + group.text[group.at]])
                hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(x, 42) for x in raw), ">i8").astype(np.int64)
                digests = [hashlib.sha256(b" ".join(x.split())).hexdigest() for x in raw]
                m, none = end - k, len(text)
                rows = pa.array(np.concatenate([np.arange(k, end), k + text]))
                following = pa.array(np.append(content[1:], 0)[:none], pa.int64(), mask=~follows.astype(bool))
                both = lambda a, b, kind: pa.concat_arrays([a if a is not None else pa.nulls(m, kind), b if b is not None else pa.nulls(none, kind)])
                columns = [
                    batch.column(0).take(rows), pa.array(hashes[np.concatenate([np.arange(m), text])]), both(pa.array(group.n_words, pa.int64()), None, pa.int64()), both(pa.array(digests, pa.string()), None, pa.string()),
                    both(None, pa.array(pos.astype(np.int32)), pa.int32()), both(None, pa.array(n.astype(np.int32)), pa.int32()), *(both(None, pa.array(x, pa.int64()), pa.int64()) for x in (seed, content)), both(None, following, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_words", "whole", "pos", "edges", "seed", "content", "next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, t bigint, n_words bigint, whole string, pos int, edges int, seed bigint, content bigint, next bigint")


def _opened(docs: DataFrame, seeds: tuple[Broadcast, int], places: tuple[Broadcast, int], again: tuple[Broadcast, int] | None) -> DataFrame:
    """The single edges of the pieces whose places may be among those to open: (doc_id, t, pos, seed, content, k, edge).

    again: which of them may occur several times, by a cheap hash; without it, only (hash, times) of each group's different edges.
    """
    def run(batches):
        for batch in batches:
            owners = batch.column(2).to_numpy()
            for k, _, group, raw in _groups(batch.column(1)):
                text, pos, n, seed, first = group.cuts(_passing(seeds[0].value, seeds[1], group.seed))
                hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(x, 42) for x in raw), ">i8").astype(np.int64)
                keep = np.flatnonzero(in_bitmap(places[0].value, places[1], _place(owners[k + text], hashes[text], pos))) if len(text) else np.zeros(0, np.int64)
                if not len(keep):
                    continue
                of = np.repeat(keep, n[keep])
                offset = np.arange(len(of)) - np.repeat(np.cumsum(n[keep]) - n[keep], n[keep])
                cheap = group.cheap(first[of] + offset)
                if again is None:
                    different, times = np.unique(cheap, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(different.view(np.int64)), pa.array(np.minimum(times, 2))], ["hash", "times"])
                    continue
                some = np.flatnonzero(in_bitmap(again[0].value, again[1], cheap))
                if not len(some):
                    continue
                of, offset = of[some], offset[some]
                edge = group.content(first[of] + offset, first[of] + offset + WINDOW)
                pieces, at = np.unique(of, return_inverse=True)
                content = group.content(first[pieces], first[pieces] + n[pieces] - 1 + WINDOW)[at]
                columns = [batch.column(0).take(pa.array(k + text[of])), pa.array(hashes[text[of]]), pa.array(pos[of].astype(np.int32)), pa.array(seed[of]), pa.array(content), pa.array(offset.astype(np.int32)), pa.array(edge)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "pos", "seed", "content", "k", "edge"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "hash bigint, times bigint" if again is None else f"doc_id {kind}, t bigint, pos int, seed bigint, content bigint, k int, edge bigint"
    return docs.where("doc_id is not null").withColumn("owner", F.xxhash64("doc_id")).mapInArrow(run, schema)


def _place(owner, t, pos):
    """A hash of a place, from hashes of the row's id and text and the number of the word, as columns or arrays."""
    if isinstance(t, np.ndarray):
        return owner.astype(np.int64) ^ t.astype(np.int64) ^ pos.astype(np.int64) * 40503
    return owner.bitwiseXOR(t).bitwiseXOR(pos.cast("bigint") * 40503)


def _compacted(pieces: DataFrame) -> DataFrame:
    """(seed, content, at, edges, source): the first piece of each maximal path of repeated pieces without a branch, with the edges of the path.

    pieces: (seed, content, first, edges, most, n, least_next, most_next, ends).
    """
    some = pieces.where("first.doc_id < most")
    one = (F.col("least_next") == F.col("most_next")) & ~F.col("ends")
    before = some.where(one).select(F.col("least_next").alias("content"), F.col("n").alias("times"), F.col("first.doc_id").alias("d"), F.col("first.t").alias("dt"), (F.col("first.pos") + F.col("edges")).alias("behind")).alias("a")
    b = some.alias("b")
    same = (F.col("a.content") == F.col("b.content")) & (F.col("times") == F.col("n")) & (F.col("d") == F.col("b.first.doc_id")) & (F.col("dt") == F.col("b.first.t")) & (F.col("behind") == F.col("b.first.pos"))
    linked = b.join(before, same, "left").select("seed", "b.content", "first", "edges", "n", F.col("behind").isNull().alias("head"))
    along = Window.partitionBy("first.doc_id", "first.t").orderBy("first.pos")  # of one document
    path = linked.withColumn("path", F.sum(F.col("head").cast("int")).over(along))
    return path.groupBy("first.doc_id", "first.t", "path").agg(F.min_by(F.struct("seed", "content", "first", "n"), "first.pos").alias("h"), F.sum("edges").cast("int").alias("edges")).select(
        "h.seed", "h.content", "h.n", F.lit(0).alias("at"), "edges", F.col("h.first").alias("source"))


def _runs(parts: DataFrame, kind: str) -> DataFrame:
    """(seed, content, n, owner, at, edges, source): runs of consecutive edges with consecutive sources. parts: (seed, content, n, owner, parts)."""

    def run(batches):
        for batch in batches:
            counts = batch.column(4).value_lengths().to_numpy()
            listed = batch.column(4).flatten()
            k, source = listed.field("k").to_numpy(), listed.field("source")
            doc, t, pos = source.field("doc_id"), source.field("t").to_numpy(), source.field("pos").to_numpy()
            row, same_doc = np.repeat(np.arange(len(counts)), counts), doc.dictionary_encode().indices.to_numpy()
            order = np.lexsort((k, row))
            row, k, t, pos, same_doc = (x[order] for x in (row, k, t, pos, same_doc))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1) | (same_doc[1:] != same_doc[:-1]) | (t[1:] != t[:-1]) | (pos[1:] != pos[:-1] + 1)
            heads = np.flatnonzero(new)
            sources = pa.StructArray.from_arrays([doc.take(pa.array(order[heads])), pa.array(t[heads]), pa.array(pos[heads])], ["doc_id", "t", "pos"])
            columns = [*(batch.column(c).take(pa.array(row[heads])) for c in range(4)), pa.array(k[heads]), pa.array(np.diff(np.append(heads, len(row))).astype(np.int32)), sources]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "content", "n", "owner", "at", "edges", "source"])

    return parts.mapInArrow(run, f"seed bigint, content bigint, n bigint, owner {kind}, at int, edges int, source struct<doc_id:{kind},t:bigint,pos:int>")


def _read(docs: DataFrame, paths: DataFrame, kind: str) -> DataFrame:
    """paths with `digest`, that of the words at their source coordinates."""
    wanted = paths.select("source.doc_id", "source.t", F.struct(F.col("source.pos").alias("pos"), "edges").alias("w")).groupBy("doc_id", "t").agg(F.collect_set("w").alias("wanted"))  # of one document: as many as it has edges
    wanted = stored(wanted)

    def run(batches):
        for batch in slices(batches):
            for k, (text_, wanted_) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                words = (text_ or b"").split()
                digests = [hashlib.sha256(b" ".join(words[w["pos"] : w["pos"] + w["edges"] + WINDOW - 1])).digest()[:16] for w in wanted_]
                rows = pa.array([k] * len(digests), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([w["pos"] for w in wanted_], pa.int32()), pa.array([w["edges"] for w in wanted_], pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "t", "pos", "edges", "digest"])

    mine = docs.where("doc_id is not null").withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    sources = among(mine, wanted, ["doc_id", "t"], "wanted").dropDuplicates(["doc_id", "t"]).join(wanted, ["doc_id", "t"])
    read = sources.select("doc_id", "t", "text", "wanted").mapInArrow(run, f"doc_id {kind}, t bigint, pos int, edges int, digest binary").alias("r")
    p = paths.alias("p")
    same = (F.col("p.source.doc_id") == F.col("r.doc_id")) & (F.col("p.source.t") == F.col("r.t")) & (F.col("p.source.pos") == F.col("r.pos")) & (F.col("p.edges") == F.col("r.edges"))
    return p.join(read, same).select("p.*", "digest")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n_words, whole) of all documents, and (doc_id, t, spans) of those that may have words to remove; spans of (from, to, digest) may overlap."""
    mine = _with_id(docs, doc_id, text)
    kind = mine.schema["doc_id"].dataType.simpleString()
    send = lambda table: (mine.sparkSession.sparkContext.broadcast(table[0].tobytes()), table[1])  # noqa: E731  each table once
    seeds = send(repeated_seeds(mine))
    found = stored(_pieces(mine, *seeds))
    rows, key = found.where("pos is not null"), ["seed", "content"]
    pieces = stored(rows.groupBy(*key).agg(
        F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.first("edges").alias("edges"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"), F.min("next").alias("least_next"), F.max("next").alias("most_next"),
        F.bool_or(F.col("next").isNull()).alias("ends")))
    whole = _compacted(pieces)
    branching = pieces.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seed")
    branched = among(pieces.select("seed", _place(F.xxhash64("first.doc_id"), F.col("first.t"), F.col("first.pos")).alias("place")), branching, ["seed"], "branching")  # and a few others, which does no harm
    places = send(bitmap(branched, "place"))
    again = stored(_opened(mine, seeds, places, None).groupBy("hash").agg(F.sum("times").alias("c")).where("c > 1"))
    edges = stored(_opened(mine, seeds, places, send(bitmap(again, "hash"))))
    here = F.struct("doc_id", "t", (F.col("pos") + F.col("k")).alias("pos"))
    shared = stored(edges.groupBy("seed", "edge").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("seed", "edge", "n", "least"))
    several = stored(among(edges, shared, ["seed", "edge"], "shared"))
    sources = stored(joined_by_key(several, shared, ["seed", "edge"], "first").where(F.col("doc_id") == F.col("least")).groupBy("seed", "edge").agg(F.min(here).alias("source")).join(shared, ["seed", "edge"]))
    parts = joined_by_key(several, sources, ["seed", "edge"], "later").where(F.col("least") < F.col("doc_id"))
    parts = parts.groupBy(*key, F.struct("doc_id", "t", "pos").alias("first")).agg(F.collect_list(F.struct("k", "source")).alias("parts"))  # of one piece
    parts = parts.join(pieces.select(*key, "first", "n"), [*key, "first"]).select(*key, "n", F.col("first.doc_id").alias("owner"), "parts")
    paths = stored(whole.withColumn("owner", F.lit(None).cast(kind)).unionByName(_runs(parts, kind)))
    listed = _read(mine, paths, kind).groupBy(*key).agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "edges", "owner", F.col("source.doc_id").alias("least"), "digest")).alias("p"))  # of one piece
    decided = stored(listed)
    marked = stored(among(rows.select("doc_id", "t", "pos", *key), decided, key, "decided"))
    met = joined_by_key(marked, decided, key, "met").select("doc_id", "t", "pos", F.explode("p").alias("p")).where((F.col("p.owner") == F.col("doc_id")) | F.col("p.owner").isNull() & (F.col("p.least") < F.col("doc_id")))
    start = F.col("pos") + F.col("p.at")
    span = F.struct(start.alias("from"), (start + F.col("p.edges") + (WINDOW - 1)).alias("to"), F.col("p.digest").alias("digest"))
    spans = met.select("doc_id", "t", span.alias("s")).groupBy("doc_id", "t").agg(F.collect_list("s").alias("spans"))  # of one document
    return found.where("pos is null").select("doc_id", "t", "n_words", "whole"), spans


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with `texts` also kept, the words that stay, joined by spaces (null where all stay)."""
    every, spans = repeated_spans(docs, doc_id, text)
    spans = stored(spans)
    mine = _with_id(docs, doc_id, text).where("doc_id is not null").withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = among(mine, spans, ["doc_id", "t"], "spans").join(spans, ["doc_id", "t"])

    def cut(batches):
        for batch in slices(batches):
            removed, digests, kept = [], [], []
            for text_, spans_ in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = (text_ or b"").split()
                change = np.zeros(len(words) + 1, np.int64)
                for span in spans_:
                    if hashlib.sha256(b" ".join(words[span["from"] : span["to"]])).digest()[:16] == span["digest"]:
                        change[span["from"]] += 1
                        change[span["to"]] -= 1
                stay = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                left = b" ".join([words[i] for i in stay.tolist()])
                removed.append(len(words) - len(stay))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if texts else None)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    changed = marked.select("doc_id", "t", "text", "spans").mapInArrow(cut, f"doc_id {kind}, t bigint, n_removed bigint, kept_sha256 string, kept string").dropDuplicates(["doc_id", "t"])
    out = every.join(changed, ["doc_id", "t"], "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    return out.select(*columns, *["kept"] * texts)


def brute_force(documents: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by listing every window; for tests."""
    least: dict[tuple, int] = {}
    cut = [(d, (t or "").encode().split()) for d, t in documents]
    for d, w in cut:
        for i in range(len(w) - WINDOW + 1):
            g = tuple(w[i : i + WINDOW])
            least[g] = min(d, least.get(g, d))
    out = []
    for d, w in cut:
        gone = {j for i in range(len(w) - WINDOW + 1) if least[tuple(w[i : i + WINDOW])] < d for j in range(i, i + WINDOW)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
