"""Quality classifier: kernel ridge by random Fourier features, then isotonic calibration.

Each text becomes a vector of document statistics (lengths, character classes, repetition, line shape). A fixed random
cosine map turns the standardized vector into features whose inner products approximate a Gaussian kernel. Every
partition of training rows sums its part of the normal equations, by fold; the sums give the ridge weights, and leaving
out one fold at a time gives unbiased scores for the isotonic calibration, which pools binned scores.

Labels are learned from at most about MAX_TRAIN labelled rows, taken by a hash of their ids; statistics and scores
cover all rows and whole texts.

Cases: null and empty texts have the statistics of an empty text and get a score like any other. Label rows with a null
id or label are ignored; of repeated label rows the largest label counts; of an id with several texts one is learned
from, that of the least hash. Repeated documents get equal scores. Without labels of both kinds all scores are the prior
(0.5 with no labels). Empty tables give empty results. `accepted` carries columns of any name along; the others read the
named ones only.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes, without

#: Labelled rows to learn from, about.
MAX_TRAIN = 60_000
N_RANDOM, FOLDS, RIDGE, BINS = 220, 4, 1e-3, 400
#: Score from which a document is kept.
KEEP = 0.7

_CLASSES = np.zeros((256, 10))
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*@^~+=<>/\\_", "'\"()[]{}-", " \t\n\r"]):
    _CLASSES[list(_chars.encode()), _k] = 1
_CLASSES[128:, 9] = 1
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
N_STATISTICS = 29


def statistics(raw: bytes) -> list[float]:
    """The document statistics of one text in UTF-8."""
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASSES) / n
    words = raw.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    apart = sum(map(eq, words, words[2:]))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = raw.split(b"\n")
    distinct_lines = len(set(lines))
    chars = counts[counts > 0] / n
    bare = sum(1 for w in words if not _LETTER.search(w))
    stops = sum(w.endswith(b".") for w in words)
    commas = sum(w.endswith(b",") for w in words)
    line_sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), *shares, distinct / m, np.log1p(distinct),
        again / m, apart / m, pairs / m, bare / m, stops / m, commas / m, np.log1p(len(lines)), distinct_lines / len(lines), np.log1p(line_sizes.mean()),
        np.log1p(line_sizes.std()), float(-(chars * np.log(chars)).sum()) if len(raw) else 0.0, (counts.max() / n) if len(raw) else 0.0,
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (XXH64 of the text, as Spark's xxhash64) and the array of statistics of every row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            hashes = [int.from_bytes(xxhash.xxh64_digest(x, 42), "big", signed=True) for x in texts]
            values = pa.array([statistics(x) for x in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), values], ["doc_id", "t", "x"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, t bigint, x array<double>")


def bounded_labels(labels: DataFrame, doc_id: str, label: str, train, bound: int) -> DataFrame:
    """(label_id, y) of at most about `bound` rows on which `train` holds, taken by a hash of the id."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & train).groupBy(F.col(doc_id).alias("label_id")).agg((F.max(label) > 0).cast("double").alias("y"))
    share = bound / max(rows.count(), 1)
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


class Model:
    """What scoring needs; small, and sent with the tasks."""

    def __init__(self, mean, scale, weights, knots, values):
        self.mean, self.scale, self.weights, self.knots, self.values = mean, scale, weights, knots, values

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.values)
        raw = fourier((x - self.mean) / self.scale) @ self.weights
        return np.interp(raw, self.knots, self.values) * 0.998 + 0.002 / (1 + np.exp(-np.clip(raw * 4 - 2, -30, 30)))


def fourier(x: np.ndarray) -> np.ndarray:
    """Random cosine features of standardized rows, with a column of ones."""
    draw = np.random.default_rng(20240101)
    width = np.sqrt(2.0 * x.shape[1])
    w = draw.standard_normal((x.shape[1], N_RANDOM)) / width
    b = draw.uniform(0, 2 * np.pi, N_RANDOM)
    return np.hstack([np.sqrt(2.0 / N_RANDOM) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame) -> Model:
    """A model of rows (doc_id, x, y), whose number is bounded."""
    n, width = N_RANDOM + 1, N_STATISTICS
    rows = rows.select("x", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")).repartition(8)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if not sums["n"] or sums["y"] in (0.0, 1.0):
        return Model(None, None, None, None, float(sums["y"]) if sums["n"] else 0.5)
    mean = np.array([sums[f"avg{k}"] for k in range(width)])
    scale = np.maximum(np.array([sums[f"stddev_pop{k}"] for k in range(width)]), 1e-6)

    def normal(batches):
        total = {}
        for batch in batches:
            z, y, fold = fourier((_matrix(batch.column(0)) - mean) / scale), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                at = fold == f
                total[f] = total.get(f, 0) + z[at].T @ np.column_stack([z[at], y[at]])
        for f, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([s.astype(np.float64).tobytes()], pa.binary())], ["fold", "s"])

    parts = {f: np.zeros((n, n + 1)) for f in range(FOLDS)}
    for row in rows.mapInArrow(normal, "fold int, s binary").collect():  # 8 partitions by FOLDS matrices
        parts[row["fold"]] += np.frombuffer(row["s"]).reshape(n, n + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :n] + RIDGE * (1 + s[n - 1, n - 1]) / n * np.diag([1.0] * (n - 1) + [1e-9]), s[:, n])

    whole = sum(parts.values())
    weights, others = solve(whole), {f: solve(whole - parts[f]) for f in range(FOLDS)}

    def unseen(batches):
        for batch in batches:
            z, fold = fourier((_matrix(batch.column(0)) - mean) / scale), batch.column(2).to_numpy(zero_copy_only=False)
            raw = np.choose(fold, [z @ others[f] for f in range(FOLDS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * BINS), -BINS, 2 * BINS).astype(np.int32)), pa.array(raw), batch.column(1)], ["bin", "raw", "y"])

    bins = rows.mapInArrow(unseen, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    return Model(mean, scale, weights, *isotonic([(b["raw"], b["y"], b["n"]) for b in bins]))


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, positives, count) by score: knots and their rising rates."""
    blocks: list[list[float]] = []
    for x, y, n in points:
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rate = sum(b[1] for b in blocks) / sum(b[2] for b in blocks)
    knots = np.array([b[0] / b[2] for b in blocks])
    values = np.array([(b[1] + rate) / (b[2] + 1) for b in blocks])
    return knots, np.maximum.accumulate(values)


def scored(statistics_table: DataFrame, model: Model) -> DataFrame:
    """statistics rows with their score instead of x; further columns stay."""
    names = [c for c in statistics_table.columns if c != "x"]
    schema = ", ".join(f"`{c}` {statistics_table.schema[c].dataType.simpleString()}" for c in names) + ", score double"

    def run(batches):
        for batch in batches:
            if len(batch):
                score = np.clip(model.score(_matrix(batch.column(len(names)))), 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(score)], [*names, "score"])

    return statistics_table.select(*names, "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str, train, doc_id: str = "doc_id", text: str = "text", bound: int = MAX_TRAIN) -> DataFrame:
    """doc_id, t (hash of the text) and score of every row. train: a condition on labels that picks training rows."""
    found = stored(document_statistics(docs, doc_id, text))
    taken = bounded_labels(labels, doc_id, label, train, bound)
    rows = found.join(F.broadcast(taken), found["doc_id"] == taken["label_id"]).groupBy("doc_id").agg(F.min_by("x", "t").alias("x"), F.first("y").alias("y"))  # at most about `bound` rows
    return scored(found, fit(rows))


def accepted(docs: DataFrame, scores: DataFrame, bar: float = KEEP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score by classify() is not under the bar. Rows equal in id and text have one score."""
    return without(docs, doc_id, text, stored(scores.where(F.col("score") < bar).select(F.col("doc_id").alias("id"), "t").distinct()))
