"""Spelling variants: words one edit apart, grouped under their frequent forms, by a self-join of the vocabulary's trie.

The vocabulary is cut by its first PREFIX characters, and every part is a trie below that prefix, of which a task works off
many. It goes down the trie level by level and keeps for the nodes of a level their active nodes: those whose prefix is one
replacement away (siblings, and children of active pairs by the same character) and those one insertion longer (children, and
again children of active pairs by the same character). Pairs of active nodes that both end a word are pairs of near words.

Words that differ before that lie in different parts. They are equal from the edit on, so that they share their last SUFFIX
characters, as words have at least LEAST: a second trie, of the words read backwards and cut by these, finds them.

A part of more than PART words is not worked off by one task: the level where its words part first is propagated by a join.
Siblings lead to a pair of words only if these are equal behind them, so words of one prefix and one rest behind the next
character, or behind the prefix, meet by equality, as many as there are characters at most. Then the part goes on as the
parts of its next characters. This is repeated until no part is too large.

Cases: null and empty texts have no words. A null id leaves all runs as they are. Words of any length are compared whole.
Repeated rows count anew; an empty table, or one without repeated words, gives an empty result. Of near words that occur
equally often the form is the first in order of code points. Only the id and text columns are read, so further columns of any
name are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, crc32_sql, stored

#: Least code points and occurrences of a word; how much more often than a word its form occurs.
LEAST, SEEN, RATIO = 7, 2, 10
#: First and last characters that cut the two tries: LEAST words that differ within the first three share the last four.
PREFIX, SUFFIX = 3, 4
#: Words of the largest part that one task takes on, and words that it takes on at a time.
PART, CHUNK = 20_000, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): letter runs in lower case, some of them with a character dropped by the rule of the query, that occur SEEN times."""
    runs = F.filter(F.split(F.translate(column(docs, text), UPPER, LOWER), r"[^a-zÀ-ÿ]+"), lambda r: F.char_length(r) >= LEAST)
    rows = docs.select(column(docs, doc_id).cast("string").alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)


class _Level:
    """The edges from the nodes of one level to those of the next, sorted by (node, character)."""

    def __init__(self, nodes: int, node: np.ndarray, character: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.keys, self.child_of_word = np.unique(node * alphabet + character, return_inverse=True)
        self.parent, self.character = self.keys // alphabet, self.keys % alphabet
        self.first = np.searchsorted(self.parent, np.arange(nodes + 1))

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, child) of all children."""
        count = self.first[nodes + 1] - self.first[nodes]
        place = np.repeat(np.arange(len(nodes)), count)
        return place, np.repeat(self.first[nodes] - (np.cumsum(count) - count), count) + np.arange(len(place))

    def child(self, nodes: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The child of each node by a character, or -1."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        key = nodes * self.alphabet + character
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of nodes of one parent, the lesser first."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gap in range(1, self.alphabet):
            i = np.flatnonzero(self.parent[:-gap] == self.parent[gap:])
            if not len(i):
                break
            left.append(i)
            right.append(i + gap)
        return np.concatenate(left), np.concatenate(right)


def near_pairs(words: list[str], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of distinct words of one part that are one edit apart. part: numbers from 0, one for each word."""
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    _, code = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
    alphabet = int(code.max()) + 1 if len(code) else 1
    none = np.zeros(0, np.int64)
    going, node, nodes, depth = np.arange(len(words)), np.asarray(part, np.int64), int(part.max()) + 1 if len(part) else 0, 0
    above: _Level | None = None
    replaced, inserted = (none, none), (none, none)  # active pairs: both of this level; one of the last level and one of this
    ends_above, found = none, []

    def ends() -> np.ndarray:
        """The word that ends at each node of this level, or -1."""
        out = np.full(nodes, -1)
        last = size[going] == depth
        out[node[last]] = going[last]
        return out

    def met(a: np.ndarray, b: np.ndarray) -> None:
        both = (a >= 0) & (b >= 0)
        found.append((a[both], b[both]))

    while nodes:
        here = ends()
        met(here[replaced[0]], here[replaced[1]])
        if above is not None:
            met(ends_above[inserted[0]], here[inserted[1]])
        more = size[going] > depth
        going, node = going[more], node[more]
        level = _Level(nodes, node, code[begin[going] + depth], alphabet)
        # one insertion longer: the children of this level's nodes, and of active pairs the children by the same character
        pairs = [level.parent * len(level.keys) + np.arange(len(level.keys))]
        if above is not None and len(level.keys):
            place, u = above.children(inserted[0])
            a = level.child(inserted[1][place], above.character[u])
            pairs.append((u * len(level.keys) + a)[a >= 0])
        key = np.unique(np.concatenate(pairs))
        inserted = (key // max(len(level.keys), 1), key % max(len(level.keys), 1))
        place, u = level.children(replaced[0])
        a = level.child(replaced[1][place], level.character[u])
        brothers = level.siblings()
        replaced = (np.concatenate([brothers[0], u[a >= 0]]), np.concatenate([brothers[1], a[a >= 0]]))
        above, ends_above = level, here
        node, nodes, depth = level.child_of_word, len(level.keys), depth + 1
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


_PAIR = "word string, n bigint, near string, near_n bigint"


def _by_tries(parts: DataFrame, backwards: bool) -> DataFrame:
    """Near pairs, both ways, of words within parts (key, depth, word, n). backwards: only of those that differ in their first PREFIX characters."""

    def emit(keys: list[str], depths: list[int], words: list[str], counts: list[int]):
        rests = [(w[::-1] if backwards else w)[d:] for w, d in zip(words, depths)]
        a, b = near_pairs(rests, np.unique(np.array(keys, object).astype(str), return_inverse=True)[1])
        a, b = a.tolist(), b.tolist()
        if backwards:
            kept = [(i, j) for i, j in zip(a, b) if words[i][:PREFIX] != words[j][:PREFIX]]
            a, b = [i for i, _ in kept], [j for _, j in kept]
        for at in range(0, len(a), CHUNK):
            i, j = a[at : at + CHUNK] + b[at : at + CHUNK], b[at : at + CHUNK] + a[at : at + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i], pa.string()), pa.array([counts[k] for k in i], pa.int64()), pa.array([words[k] for k in j], pa.string()), pa.array([counts[k] for k in j], pa.int64())], ["word", "n", "near", "near_n"])

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if len(held[0]) >= CHUNK and row[0] != held[0][-1]:  # a part is whole
                    yield from emit(*held)
                    held = ([], [], [], [])
                for kept, x in zip(held, row):
                    kept.append(x)
        if held[0]:
            yield from emit(*held)

    return parts.select("key", "depth", "word", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, _PAIR)


def _split(parts: DataFrame, spelled: Column, part: int) -> tuple[DataFrame, list[DataFrame]]:
    """Parts of at most `part` words, and the near pairs (word, n, near, near_n) whose ways part above them."""
    pairs = []
    done = []
    parts = stored(parts)
    while True:
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.min(spelled).alias("lo"), F.max(spelled).alias("hi")).where(F.col("words") > part)
        # what all words of the part begin with is skipped at once
        same = F.filter(F.sequence(F.lit(1), F.least(F.char_length("lo"), F.char_length("hi"))), lambda i: F.substring("lo", F.lit(1), i) == F.substring("hi", F.lit(1), i))
        large = stored(sizes.select("key", F.size(same).alias("d")))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, parts]), pairs
        done.append(parts.join(large, "key", "left_anti"))
        rows = stored(parts.join(large, "key").select("word", "n", spelled.alias("s"), "d"))
        prefix, after = F.substring("s", F.lit(1), F.col("d")), lambda k: F.substring("s", F.col("d") + k, F.char_length("s"))
        next_ = F.substring("s", F.col("d") + 1, F.lit(1))
        longer = rows.where(F.char_length("s") > F.col("d"))
        ends = longer.select(prefix.alias("p"), after(2).alias("rest"), "word", "n", next_.alias("c")).unionByName(rows.select(prefix.alias("p"), after(1).alias("rest"), "word", "n", F.lit("").alias("c")))
        groups = ends.groupBy("p", "rest").agg(F.collect_list(F.struct("word", "n", "c")).alias("g")).where(F.size("g") > 1)  # one for each character, and one
        two = groups.select("rest", F.explode("g").alias("x"), "g").select("rest", "x", F.explode("g").alias("y")).where("x.word <> y.word")
        # a word and one without the character that its rest begins with anyway part further down
        apart = ~F.coalesce((F.least("x.c", "y.c") == "") & (F.greatest("x.c", "y.c") == F.substring("rest", F.lit(1), F.lit(1))), F.lit(False))
        pairs.append(stored(two.where(apart).select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))))
        parts = stored(longer.select("word", "n", F.substring("s", F.lit(1), F.col("d") + 1).alias("key"), (F.col("d") + 1).alias("depth")))


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one edit apart, both ways. words: (word, n), each once, of LEAST characters or more."""
    keyed = lambda spelled, depth: words.select("word", "n", F.substring(spelled, F.lit(1), F.lit(depth)).alias("key"), F.lit(depth).alias("depth"))
    forwards, met = _split(keyed(F.col("word"), PREFIX), F.col("word"), part)
    backwards, met_back = _split(keyed(F.reverse("word"), SUFFIX), F.reverse("word"), part)
    early = F.substring("word", 1, PREFIX) != F.substring("near", 1, PREFIX)
    return reduce(DataFrame.unionByName, [_by_tries(forwards, False), _by_tries(backwards, True), *met, *(p.where(early) for p in met_back)])


def grouped(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    near = near_words(words, part).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    often = -F.col("best.m") >= RATIO * F.col("n")
    near = stored(near.select("word", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")))
    forms = stored(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each form occurs RATIO times as often, and strides double, so a few rounds do
        step = forms.alias("a").join(forms.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        step = stored(step)
        forms = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    out = words.join(near, "word", "left").join(forms, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the documents."""
    return grouped(stored(vocabulary(docs, doc_id, text)), part)


#: DuckDB SQL of the query: near words by equality of what is left when one character is dropped.
SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, {crc32_sql("doc_id || ':' || run")} AS h FROM runs WHERE length(run) >= {LEAST}),
words AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
vocab AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= {LEAST} GROUP BY word HAVING count(*) >= {SEEN}),
dropped AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
links AS (SELECT a.word, b.word AS near FROM dropped a JOIN dropped b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM dropped d JOIN vocab v ON v.word = d.rest UNION SELECT v.word, d.word FROM dropped d JOIN vocab v ON v.word = d.rest),
best AS (SELECT l.word, count(*) AS n_near, max(v.n) AS most FROM links l JOIN vocab v ON v.word = l.near GROUP BY l.word),
formed AS (SELECT w.word, w.n, b.n_near, b.most, (SELECT min(v.word) FROM links l JOIN vocab v ON v.word = l.near WHERE l.word = w.word AND v.n = b.most) AS near FROM vocab w JOIN best b ON b.word = w.word),
forms AS (SELECT word, near AS form, most AS form_n FROM formed WHERE most >= {RATIO} * n),
walk AS (SELECT word, form AS up FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.up),
roots AS (SELECT word, up AS root FROM walk WHERE up NOT IN (SELECT word FROM forms))
SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, f.form, f.form_n, coalesce(r.root, w.word) AS root
FROM vocab w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word
"""
