"""Toxicity: a lexicon trie crossed with Levenshtein automata, and learned window scores that tell quotation from abuse.

The lexicon is learned: whole words and word beginnings that are over-represented in toxic training documents, with
their log odds. It is kept as a trie. A word of a text is looked up by walking the trie and the Levenshtein automaton
of the word together (bit-parallel, one edit), so that misspelled terms are caught; digits and signs that stand for
letters are undone first. Of several terms one edit away the one of the greatest weight counts.

A window around each hit holds the words before and behind it and whether quotation marks enclose it. How often each of
these stands by hits of toxic and of clean training documents gives its log odds, and their sum is the score of the window:
what surrounds hits in reports and quotations lowers a hit's weight, what surrounds them in abuse raises it. The hits of a
document are summed up in a few numbers that a logistic model, fitted on the training documents with each one's own share
of all these counts taken out, turns into a score.

The lexicon and the model are learned from at most about MAX_TRAIN labelled documents, and hold every term and window
word that these give; scores cover all rows and whole texts.

Cases: null and empty texts have no hits and get the score of that. Label rows with a null id or label are ignored; of
repeated label rows the largest label counts; of an id with several texts one is learned from, that of the least hash.
Repeated documents get equal scores. Without labels of both kinds all scores are the prior (0.5 with no labels). Empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality import bounded_labels

#: Labelled documents to learn from, about.
MAX_TRAIN = 16_000
#: Beginnings of words that may be terms, in characters. Misspellings are sought of all whole words of FUZZY characters or more.
STEMS, FUZZY = (4, 5, 6, 7, 8), 5
#: Share of a hit's weight that stays after one edit.
MISSPELLED = 0.6
#: Words before and behind a hit and characters around it that are its window; least count of what scores it, and the bound of a score.
BEFORE, BEHIND, AROUND, LEAST_SEEN, MOST = 5, 3, 60, 3, 4.0
CACHE_WORDS = 300_000
LEAST_LOG_ODDS = 1.8
WORD = re.compile(r"[^\W_]+(?:[@$!|*+]+[^\W_]+)*")
#: Signs for letters; marks of quotation.
SIGNS = str.maketrans("013457@$!|+", "oieastasiit")
MARKS = "\"“”„«»‹›"


class Lexicon:
    """Terms as a trie: child by letter, `` for a whole-word term, `*` for a beginning; payloads are term numbers."""

    def __init__(self, terms: list[tuple[str, int, int]], n_toxic: int, n_clean: int):
        """terms: (=word or ^beginning, toxic documents, clean documents)."""
        self.windows: dict[str, tuple[int, int]] = {}
        self.with_hits = 0, 0
        self.counts = [(t, c) for _, t, c in terms]
        self.sizes = n_toxic, n_clean
        self.weights = [log_odds(t, c, n_toxic, n_clean) for t, c in self.counts]
        self.trie: dict = {}
        #: Whole-word terms to seek misspelled, read forwards and backwards.
        self.sought: tuple[dict, dict] = ({}, {})
        for k, (term, _, _) in enumerate(terms):
            self._grow(self.trie, term[1:], "" if term[0] == "=" else "*", k)
            if term[0] == "=" and len(term) > FUZZY:
                for top, spelled in zip(self.sought, (term[1:], term[:0:-1])):
                    self._grow(top, spelled, "", k)
        self.known: dict[str, tuple[tuple[int, bool], ...]] = {}

    @staticmethod
    def _grow(node: dict, spelled: str, end: str, k: int) -> None:
        for c in spelled:
            node = node.setdefault(c, {})
        node[end] = k

    def weight(self, k: int, toxic: float | None = None) -> float:
        """Log odds of a term; toxic: the label of the one document to leave out."""
        if toxic is None:
            return self.weights[k]
        (t, c), (n, m) = self.counts[k], self.sizes
        return log_odds(t - 1, c, n - 1, m) if toxic else log_odds(t, c - 1, n, m - 1)

    def lookup(self, word: str) -> tuple[tuple[int, bool], ...]:
        """(term, misspelled) of each term that the word holds: itself, beginnings, else whole terms one edit away."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = self._lookup(word)
        return found

    def _lookup(self, word: str) -> tuple[tuple[int, bool], ...]:
        exact = self._exact(word)
        if exact:
            return exact
        plain = word
        if not word.isalpha():
            plain = re.sub(r"[^\w]", "", word.translate(SIGNS))
            if plain != word and (found := self._exact(plain)):
                return tuple((k, True) for k, _ in found)
        return tuple((k, True) for k in self._near(plain))

    def _exact(self, word: str) -> tuple[tuple[int, bool], ...]:
        node, found = self.trie, []
        for c in word:
            node = node.get(c)
            if node is None:
                return tuple(found)
            if "*" in node:
                found.append((node["*"], False))
        if "" in node:
            found.append((node[""], False))
        return tuple(found)

    def _near(self, word: str) -> list[int]:
        """All whole-word terms within one edit, which leaves either the word's first half as it is or the rest.

        The half that stays is walked as it is, forwards or backwards; below it pairs of a trie node and an automaton state
        are visited depth-first. A state is two sets of word positions as bits: reached without an edit, and with one.
        """
        half, found = len(word) // 2, set()
        for node, spelled, whole in ((self.sought[0], word, half), (self.sought[1], word[::-1], len(word) - half)):
            for c in spelled[:whole]:
                node = node.get(c)
                if node is None:
                    break
            else:
                self._automaton(node, spelled[whole:], found)
        return sorted(found)

    @staticmethod
    def _automaton(node: dict, rest: str, found: set[int]) -> None:
        at: dict[str, int] = {}
        for i, c in enumerate(rest):
            at[c] = at.get(c, 0) | 1 << i
        n, heap = len(rest), [(node, 1, 2)]
        while heap:
            node, same, one = heap.pop()
            if "" in node and (same | one) >> n & 1:
                found.add(node[""])
            for c, child in node.items():
                if not c:
                    continue
                here = at.get(c, 0)
                on = (same & here) << 1
                off = (one & here) << 1 | same | same << 1 | on << 1
                if on or off & (1 << n + 1) - 1:
                    heap.append((child, on, off))

    def hits(self, text: str, toxic: float | None = None) -> tuple[int, list[tuple[int, float, frozenset[str]]]]:
        """Words of the text, and of each hit the term, its weight and what stands in its window."""
        low = text.lower()
        words = WORD.findall(low)
        lookup = self.lookup
        hit_words = {w: f for w in set(words) if (f := lookup(w))}
        out = []
        if hit_words:
            best = {w: max(((k, self.weight(k, toxic) * (MISSPELLED if wrong else 1)) for k, wrong in f), key=lambda x: x[1]) for w, f in hit_words.items()}
            for i, m in enumerate(WORD.finditer(low)):
                if (found := best.get(words[i])) is not None and found[1] > 0:
                    out.append((*found, self._window(low, m, words[max(0, i - BEFORE) : i], words[i + 1 : i + 1 + BEHIND])))
        return len(words), out

    @staticmethod
    def _window(low: str, m: re.Match, before: list[str], behind: list[str]) -> frozenset[str]:
        left, right = low[max(0, m.start() - AROUND) : m.start()], low[m.end() : m.end() + AROUND]
        found = [f"<{w}" for w in before] + [f">{w}" for w in behind]
        opened = sum(left.count(c) for c in MARKS) % 2 == 1
        if opened and any(c in right for c in MARKS):
            found.append("quoted")
        return frozenset(found)

    def window_score(self, window: frozenset[str], toxic: float | None = None) -> float:
        """Log odds of a hit's surroundings, toxic against clean; toxic: the label of the one document to leave out."""
        (n, m), total = self.with_hits, 0.0
        for w in window:
            if (seen := self.windows.get(w)) is not None:
                t, c = seen
                if toxic is not None:
                    t, c = (t - 1, c) if toxic else (t, c - 1)
                total += log((t + 1) / (n + 2)) - log((c + 1) / (m + 2))
        return max(-MOST, min(MOST, total))

    def summary(self, text: str, toxic: float | None = None) -> list[float]:
        """What the model sees of a text."""
        n, found = self.hits(text, toxic)
        seen: dict[int, float] = {}
        scores = []
        for k, weight, window in found:
            score = self.window_score(window, toxic)
            seen[k] = max(seen.get(k, 0), weight * 2 / (1 + np.exp(-score)))
            scores.append(score)
        total, best, strong, hits, n = sum(seen.values()), max(seen.values(), default=0), sum(x > 3 for x in seen.values()), len(found), max(n, 1)
        return [np.log1p(total), best, np.log1p(hits), np.log1p(1000 * hits / n), np.log1p(strong), sum(scores) / max(hits, 1), max(scores, default=0.0), np.log1p(n), np.log1p(total) / np.log(n + 2), 1.0]


def log_odds(t: float, c: float, n: float, m: float) -> float:
    """Of t in n against c in m, with two documents of the overall mix added."""
    n, m = max(n, 1), max(m, 1)
    return log((max(t, 0) + 2 * n / (n + m)) / n) - log((max(c, 0) + 2 * m / (n + m)) / m)


class _Features(dict):
    """Word to the features it holds; fills itself."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(([f"={word}"] if len(word) >= 3 else []) + [f"^{word[:k]}" for k in STEMS if len(word) > k])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def _counted(rows: DataFrame, each: Callable[[str, float], Iterable[str]]) -> DataFrame:
    """(feature, toxic, clean): documents of either label that hold each feature; summed in each task first."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((f, y > 0) for f in each(x or "", y))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([y for _, y in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["feature", "y", "n"])

    counts = rows.select("text", "y").mapInArrow(run, "feature string, y boolean, n bigint")
    return counts.groupBy("feature").agg(F.coalesce(F.sum(F.when(F.col("y"), F.col("n"))), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.when(~F.col("y"), F.col("n"))), F.lit(0)).alias("clean"))


def learn(rows: DataFrame) -> tuple[Lexicon | None, np.ndarray | float]:
    """Lexicon and model weights from rows (text, y), whose number is bounded."""
    rows = stored(rows.groupBy("text").agg(F.max("y").alias("y")))  # copies of a document count once
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, m = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not n or not m:
        return None, n / (n + m) if n + m else 0.5
    features = _Features()
    t, c, share = F.col("toxic"), F.col("clean"), 2 / (n + m)
    odds = F.log((t + share * n) / n) - F.log((c + share * m) / m)  # as log_odds()
    counted = _counted(rows, lambda x, _: {f for w in set(WORD.findall(x.lower())) for f in features[w]})
    found = counted.where((t >= LEAST_SEEN) & (odds >= LEAST_LOG_ODDS - 0.3)).collect()  # terms of a bounded number of documents
    weight = {r["feature"]: log_odds(r["toxic"], r["clean"], n, m) for r in found}
    kept = []
    for r in found:
        f, w = r["feature"], weight[r["feature"]]
        shorter = max((weight.get(f"^{f[1 : k + 1]}", -9) for k in STEMS if k < len(f) - 1), default=-9)
        if w >= LEAST_LOG_ODDS and (w > shorter + 0.3 or f[0] == "=" and w >= 3):
            kept.append((f, r["toxic"], r["clean"]))
    lexicon = Lexicon(sorted(kept), n, m)

    def surroundings(text: str, y: float) -> set[str]:
        _, found = lexicon.hits(text, y)
        return {w for _, _, window in found for w in window} | ({""} if found else set())

    seen = {r["feature"]: (r["toxic"], r["clean"]) for r in _counted(rows, surroundings).where(t + c >= LEAST_SEEN).collect()}  # words by hits of a bounded number of documents
    lexicon.with_hits = seen.pop("", (0, 0))
    lexicon.windows = seen

    def run(batches):
        for batch in batches:
            x = [lexicon.summary(t or "", y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = rows.select("text", "y").mapInArrow(run, "x array<double>, y double").collect()  # at most about MAX_TRAIN rows
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found])
    return lexicon, logistic(x, y)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the last column of x is the constant."""
    w, pen = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, label: str, train, doc_id: str = "doc_id", text: str = "text", bound: int = MAX_TRAIN) -> DataFrame:
    """doc_id and score of every row. train: a condition on labels that picks training rows."""
    taken = bounded_labels(labels, doc_id, label, train, bound)
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = mine.join(F.broadcast(taken), mine["doc_id"] == taken["label_id"]).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))  # at most about `bound` rows
    lexicon, weights = learn(rows)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if lexicon is None:
                score = np.full(len(batch), weights)
            else:
                x = np.array([lexicon.summary(t.as_py() or "") for t in batch.column(1)]).reshape(len(batch), -1)
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return mine.mapInArrow(run, f"doc_id {kind}, score double")
