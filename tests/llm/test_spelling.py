"""Spelling variants against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from causeway.llm import spelling


def one_edit(a, b):
    """By definition: equal lengths and one other character, or one of them without one character is the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    """The vocabulary of (doc_id, text) rows."""
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= 2}


def plain(n):
    """Rows of every word, all words compared with all."""
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def test_active_nodes_against_all_pairs():
    r = random.Random(2)
    for t in range(200):
        words = list({"".join(r.choice("ab" + "cdé" * (t % 2)) for _ in range(r.randrange(7))) for _ in range(r.randrange(40))})
        part = np.array([r.randrange(3) if t % 3 else 0 for _ in words], np.int64)
        a, b = spelling.near_pairs(words, part)
        found = sorted(tuple(sorted((int(i), int(j)))) for i, j in zip(a, b))
        assert found == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if part[i] == part[j] and one_edit(words[i], words[j])]


@pytest.mark.parametrize("part", [spelling.PART, 40, 7])
def test_large_parts_are_split(spark, part):
    """A prefix and a suffix that a third of all words share each; parts of any size give the same."""
    r, n = random.Random(5), {"prefixes": 9, "aaaaaaa": 2, "aaaaaaaa": 2, "aaaaaaaaa": 25}
    for _ in range(250):
        n["prefixes" + "".join(r.choice("abcé") for _ in range(r.randrange(8)))] = r.choice([2, 3, 25, 300, 5000])
        n["".join(r.choice("ab") for _ in range(r.randrange(7, 10))) + "commonend"[: r.randrange(10)]] = r.choice([2, 30, 400])
        n["".join(r.choice("xy") for _ in range(r.randrange(1, 4))) + "longsuffix"] = r.choice([2, 30, 400])
    assert shown(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint"), part)) == plain(n)


def test_forms_are_followed_to_the_last(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zbcdefg": 20, "ybcdefg": 20}
    out = {r[0]: r for r in shown(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint")))}
    assert list(out.values()) == plain(n)
    assert out["abcdefg"][3:] == ("abcdefgh", 20, "abcdefghijk")  # of equal counts the first in order; then all the way


def test_documents(spark):
    r = random.Random(8)
    base = ["recommend", "recommended", "occurrence", "ÉCLAIRÉS", "éclairés", "necessary", "straße", "naïveté", "a" * 3000, "a" * 3001, "short", "×÷×÷×÷×"]
    texts = [" ".join(r.choice(base) for _ in range(r.randrange(60))) for _ in range(120)] + [None, "", " \n", "one", "word " * 3000 + "recommend", "日本語 テキスト recommendé"]
    rows = [(i, x, "clash", 1) for i, x in enumerate(texts)] + [(None, "necessary occurrence " * 40, "clash", 1)] + [(3, texts[3], "clash", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    want = plain(counted([(i, x) for i, x, *_ in rows]))
    assert len(want) > 10 and any(w[3] for w in want)
    assert shown(spelling.variants(docs)) == want


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "lonesome words")], "doc_id bigint, text string")).collect() == []
