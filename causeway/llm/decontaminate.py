"""Benchmark decontamination by a positional inverted index of the training tokens.

A first pass over the documents cuts words and keeps, as postings, the positions that can take part in a match: those
in WINDOW consecutive words of which at least NEAR_TERMS occur in the benchmark, and for short items stretches of their
words alone. The corpus frequencies of the terms then say, for every window of the benchmark, which of its terms are the
rarest: of any WINDOW - NEAR_TERMS + 1 of them a match holds one at least, so the postings of these anchor terms alone are
joined with the anchors, and each hit gives an offset-adjusted diagonal of one item in one document. Along each diagonal
the lists of all other terms are intersected: equal terms at equal offsets. Runs of a whole window are exact phrase
matches; windows, whole in the document, in which at least NEAR_TERMS but not all terms agree are proximity matches.

A large benchmark is worked off in blocks of BLOCK_WORDS words, which bounds what the tasks and the driver hold of it.
Postings are stored in the shared folder.

Words: A-Z lower-cased, maximal runs of digits, letters and non-ASCII characters. A window is WINDOW consecutive words of
an item; an item of fewer, but not none, is one window.

Cases: null and empty texts have no words; items without words match nothing. Rows equal in id and text are one document
and get equal results; rows of one id and different texts are judged apart. A null id is carried along. Words of items
without an id are hit and contaminate like others; such items are in no list. Very long texts are indexed whole. Empty tables give empty or all-clean
results. `contaminated_removed` carries columns of any name along; `matches` reads the named ones only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, slices, stored, text_bytes, without

WINDOW, NEAR_TERMS, BLOCK_WORDS = 13, 11, 2_000_000
#: Lower-cases A-Z and makes every byte that is not of a word a space.
_WORD_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in LOWER_AZ)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class Block:
    """Some items of the benchmark: their words as term numbers, and what a stretch must have."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.terms: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.lists = [np.array([self.terms.setdefault(w, len(self.terms)) for w in ws], np.int32) for _, ws in items]
        self.long, self.short = np.zeros(len(self.terms), bool), np.zeros(len(self.terms), bool)
        for x in self.lists:
            (self.long if len(x) >= WINDOW else self.short)[x] = True
        #: Words of the shortest item under a window.
        self.least = min((len(x) for x in self.lists if len(x) < WINDOW), default=0)

    def stretches(self, found: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, terms) of the stretches of a document's words that can hold a match; -1: a word the block lacks."""
        get = self.terms.get
        at = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
        inside = at >= 0
        if not inside.any():
            return
        viable = np.zeros(len(at), bool)
        if len(at) >= WINDOW and self.long.any():
            sums = np.concatenate([[0], np.cumsum(inside & self.long[at])])
            starts = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= NEAR_TERMS)
            edges = np.zeros(len(at) + 1, np.int32)
            edges[starts] += 1
            edges[starts + WINDOW] -= 1
            viable = np.cumsum(edges)[:-1] > 0
        if self.least:
            for a, b in _runs(inside & self.short[at]):
                if b - a >= self.least:
                    viable[a:b] = True
        for a, b in _runs(viable):
            yield a, at[a:b]

    def anchors(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, item, position) of the rarest terms of every different window of an item, as many as a match cannot lack at once; each once."""
        rows = set()
        for k, x in enumerate(self.lists):
            f = frequency[x]
            width = min(WINDOW, len(x))
            needed = WINDOW - NEAR_TERMS + 1 if width == WINDOW else 1
            seen = set()
            for s in range(len(x) - width + 1):
                if (window := x[s : s + width].tobytes()) in seen:  # equal windows of an item match at the same places
                    continue
                seen.add(window)
                for p in np.lexsort((x[s : s + width], f[s : s + width]))[:needed].tolist():
                    if f[s + p]:  # a term that no stretch holds has no postings
                        rows.add((int(x[s + p]), k, s + p))
        return tuple(np.array(c, np.int32) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int32),) * 3

    def verify(self, starts: list[int], lists: list[list[int]], diagonals: list[tuple[int, int]]) -> tuple[np.ndarray, list[str], list[str]]:
        """Positions hit, items with exact matches, items with proximity matches only."""
        size = max(s + len(t) for s, t in zip(starts, lists))
        text = np.full(size, -1, np.int32)
        for s, t in zip(starts, lists):
            text[s : s + len(t)] = t
        hit, exact, near = np.zeros(size, bool), set(), set()
        for k, diagonal in diagonals:
            x = self.lists[k]
            width = min(WINDOW, len(x))
            low, high = max(0, diagonal), min(size, diagonal + len(x))
            if high - low < width:
                continue
            same = text[low:high] == x[low - diagonal : high - diagonal]
            sums = np.concatenate([[0], np.cumsum(same)])
            sums = sums[width:] - sums[:-width]
            for s in np.flatnonzero(sums == width):
                hit[low + s : low + s + width] = True
                exact.add(self.ids[k])
            if width == WINDOW and (sums >= NEAR_TERMS).any():
                near.add(self.ids[k])
        return np.flatnonzero(hit).astype(np.int32), sorted(exact - {None}), sorted(near - exact - {None})


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark as blocks of bounded size, read one row at a time."""
    items, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        found = words((row["t"] or "").encode())
        if found:
            items.append((row["i"], found))
            size += len(found)
        if size >= BLOCK_WORDS:
            yield Block(items)
            items, size = [], 0
    yield Block(items)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_hit, items, near_items, contaminated (a twentieth of the words, at least one)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole, parts = None, []
    for block in blocks(benchmark, item_id, item_text):
        index = stored(_index(mine, block, kind))
        whole = whole if whole is not None else index.select("doc_id", "text_hash", "n_words")
        if block.lists:
            parts.append(_search(index, block, kind))
    if not parts:
        return whole.select("doc_id", "text_hash", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.expr("cast(array() as array<string>) items"), F.expr("cast(array() as array<string>) near_items"), F.lit(False).alias("contaminated"))
    if len(parts) == 1:
        found = parts[0].select("doc_id", "text_hash", F.size("hits").cast("bigint").alias("n_hit"), "items", "near_items")
    else:  # hit words of several blocks overlap: count positions once
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        lists = every.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
        found = lists.select("doc_id", "text_hash", F.size("hits").cast("bigint").alias("n_hit"), "items", F.array_except("near_items", "items").alias("near_items"))
    d, f = whole.alias("d"), found.alias("f")
    joined = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    none = F.expr("cast(array() as array<string>)")
    n_hit = F.coalesce("f.n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        "d.doc_id", "d.text_hash", "d.n_words", n_hit.alias("n_hit"), F.coalesce("f.items", none).alias("items"), F.coalesce("f.near_items", none).alias("near_items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("d.n_words"))).alias("contaminated"),
    )


def _index(mine: DataFrame, block: Block, kind: str) -> DataFrame:
    """A row per document with its viable stretches: the positional postings in document order."""

    def run(batches):
        for batch in slices(batches):
            counts, hashes, starts, lists = [], [], [], []
            for raw in text_bytes(batch.column(1)):
                found = words(raw)
                spans = list(block.stretches(found))
                counts.append(len(found))
                hashes.append(int.from_bytes(xxhash.xxh64_digest(raw, 42), "big", signed=True))
                starts.append([s for s, _ in spans])
                lists.append([t for _, t in spans])
            columns = [batch.column(0), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "starts", "lists"])

    return mine.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_words bigint, starts array<int>, lists array<array<int>>")


def _search(index: DataFrame, block: Block, kind: str) -> DataFrame:
    """(doc_id, text_hash, hits, items, near_items) of documents with matches."""
    n = len(block.terms)
    index = index.where(F.size("starts") > 0).dropDuplicates(["doc_id", "text_hash"])

    def frequencies(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            found = batch.column(0).flatten().flatten().to_numpy()
            total += np.bincount(found[found >= 0], minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    frequency = np.zeros(n, np.int64)
    for row in index.select("lists").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many as the block has terms
        frequency[row["term"]] = row["n"]
    terms, items, places = block.anchors(frequency)
    wanted = np.zeros(n, bool)
    wanted[terms] = True

    def postings(batches):
        for batch in slices(batches):
            rows, found, places_ = [], [], []
            for k, (starts, lists) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for s, t in zip(starts, lists):
                    t = np.array(t, np.int32)
                    at = np.flatnonzero((t >= 0) & wanted[t])
                    rows.append(np.full(len(at), k))
                    found.append(t[at])
                    places_.append((at + s).astype(np.int32))
            if rows:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(places_))], ["term", "doc_id", "text_hash", "at"])

    anchors = index.sparkSession.createDataFrame(list(zip(terms.tolist(), items.tolist(), places.tolist())), "term int, item int, place int")
    inverted = stored(index.select("doc_id", "text_hash", "starts", "lists").mapInArrow(postings, f"term int, doc_id {kind}, text_hash bigint, at int"))
    diagonals = inverted.join(F.broadcast(anchors), "term").select("doc_id", "text_hash", F.struct("item", (F.col("at") - F.col("place")).alias("diagonal")).alias("d"))  # the anchors are part of one block
    candidates = diagonals.groupBy("doc_id", "text_hash").agg(F.collect_set("d").alias("diagonals"))  # of one document: as many as it has postings
    i, c = index.alias("i"), candidates.alias("c")
    both = i.join(c, F.col("i.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("i.text_hash") == F.col("c.text_hash")))

    def verify(batches):
        for batch in slices(batches):
            out = []
            for k, (starts, lists, found) in enumerate(zip(*(batch.column(j).to_pylist() for j in (2, 3, 4)))):
                at, exact, near = block.verify(starts, lists, [(x["item"], x["diagonal"]) for x in found])
                if len(at) or near:
                    out.append((k, at, exact, near))
            rows = pa.array([x[0] for x in out], pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[1] for x in out], pa.list_(pa.int32())), *(pa.array([x[j] for x in out], pa.list_(pa.string())) for j in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "hits", "items", "near_items"])

    return both.select("i.doc_id", "i.text_hash", "i.starts", "i.lists", "c.diagonals").mapInArrow(verify, f"doc_id {kind}, text_hash bigint, hits array<int>, items array<string>, near_items array<string>")


def digest(items: str = "items"):
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def contaminated_removed(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    return without(docs, doc_id, text, stored(matches(docs, benchmark, doc_id, text).where("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("t")).distinct()))


def brute_force(documents: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by trying every window everywhere; for tests."""
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = words((t or "").encode())
        width = min(WINDOW, len(w))
        for s in range(len(w) - width + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, []
    for d, t in documents:
        w, hit, found = words((t or "").encode()), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_force_near(documents: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, items with proximity matches only) by comparing every window with every window; for tests."""
    cut, out = [(str(i), words((t or "").encode())) for i, t in items], []
    for d, t in documents:
        w, near, exact = words((t or "").encode()), set(), set()
        for i, x in cut:
            width = min(WINDOW, len(x))
            same = {sum(a == b for a, b in zip(w[s : s + width], x[p : p + width])) for s in range(len(w) - width + 1) for p in range(len(x) - width + 1)} if x else set()
            if width in same:
                exact.add(i)
            elif width == WINDOW and max(same, default=0) >= NEAR_TERMS:
                near.add(i)
        out.append((d, sorted(near - exact)))
    return out
