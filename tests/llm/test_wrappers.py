"""The registered queries on the smallest tables, column by column, against plain versions of their contracts."""

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import pytest

from causeway.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect())


def test_secret_scan(spark, docs):
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    kinds = [("assign", keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    want, found = [], {}
    for i, text in docs.items():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m.group(g)) >= n)
        found[i] = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        want.append((i, *(sum(k == j for _, k, _ in spans) for j in range(3)), sha(",".join(found[i]))))
    assert rows(spark, "op1_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    for i, spans in rows(spark, "op1_secret_scan", "doc_id", "spans"):
        assert set(found[i]) <= set(spans.split(",")), "spans hold the base ones"


def windows(words):
    return [tuple(words[k : k + 13]) for k in range(len(words) - 12)] if len(words) >= 13 else [tuple(words)] if words else []


def test_decontaminate(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {r["item_id"]: word.findall(low(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    known = {}
    for item, words in items.items():
        for w in windows(words):
            known.setdefault(w, set()).add(item)
    sizes = {len(w) for w in known}
    want = []
    for i, text in docs.items():
        words, hit, met = word.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in known:
                    hit |= set(range(k, k + n))
                    met |= known[w]
        want.append((i, len(words), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit) and 20 * len(hit) >= len(words)))
    assert rows(spark, "op3_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def least_reachable(ids, near):
    """The smallest id that each reaches by links."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    import xxhash

    prints = {}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    top = least_reachable(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert rows(spark, "op4_simhash", "doc_id", "fingerprint", "component_id") == [(i, f"{prints[i]:016x}", top[i]) for i in ids]


def test_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vector = next(f.name for f in table.schema if f.dataType.simpleString().startswith("array"))
    found = {r["vec_id"]: (r["label"], np.array([np.nan if x is None else x for x in r[vector]], float) if r[vector] is not None else np.zeros(1)) for r in table.collect()}
    sound = {i: (label, v / np.linalg.norm(v)) for i, (label, v) in found.items() if label is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = []
    for label in {x for x, _ in sound.values()}:
        ids = sorted(i for i in sound if sound[i][0] == label)
        m = np.stack([sound[i][1] for i in ids])
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1)))]
    top = least_reachable(found, links)
    n = {i: sum(i in x for x in links) for i in found}
    assert rows(spark, "op5_embeddings", "vec_id", "n_links", "component_id", "kept") == sorted((i, n[i], top[i], top[i] == i) for i in found)


def test_bpe(spark, docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows(spark, "op7_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_substring_dedup(spark, docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", text or "") for i, text in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = []
    for i, ws in words.items():
        gone = {j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(ws), len(gone), sha(" ".join(w for j, w in enumerate(ws) if j not in gone))))
    assert rows(spark, "op8_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


@pytest.mark.parametrize(("name", "parts", "part"), [("op2_toxicity", 3, 1), ("op9_quality", 4, 2)])
def test_classifiers(spark, docs, name, parts, part):
    out = rows(spark, name, "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in out] == sorted(docs)
    assert all(held == (zlib.crc32(str(i).encode()) % parts == part) and 0 <= score <= 1 and predicted == int(score >= 0.7) for i, held, score, predicted in out)
