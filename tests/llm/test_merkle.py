"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from causeway.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, run int, place int, way string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(row):
    return digest(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes):
    """(root, way of each node): way as pairs of a run and a place in it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            way.append((nodes[at[i] // 16 * 16 : at[i] // 16 * 16 + 16], at[i] % 16))
            at[i] //= 16
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], ways


def plain(rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    order = lambda s: (s is not None, (s or "").encode())
    groups = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, row_digest(r))) for s in sorted({r["source"] for r in rows}, key=order)}
    trees = {s: tree([row_digest(r) for r in g]) for s, g in groups.items()}
    root, upper = tree([t for t, _ in trees.values()]) if trees else (None, [])
    out = []
    for above, (s, g) in zip(upper, groups.items()):
        for r, way in zip(g, trees[s][1]):
            way, now = way + above, dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
            fold = row_digest(now)
            for run, place in way:
                fold = digest(*run[:place], fold, *run[place + 1 :])
            out.append((r["doc_id"], row_digest(r), trees[s][0], root, digest(*(x for run, place in way for x in run[:place] + run[place + 1 :])), fold, fold == root))
    return sorted(out, key=str)


def audited(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.audited(docs).collect()), key=str)


def hot(n):
    """A third of all rows of one source, single leaves, whole runs, a run and one more, nulls and ties."""
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "Ab É", "Text " * 9]), "en", "hot", i) for i in range(n)]
    rows += [(i * 3, "Some TEXT", r.choice([None, "de"]), f"s{i % 20}", None) for i in range(n)]
    rows += [(r.choice([None, 1, 2, -3, 1 << 60]), r.choice(["x", None]), "en", r.choice([None, "", "é", "z"]), 1) for _ in range(n)]
    return rows + [(i, "A", "en", "sixteen", 1) for i in range(16)] + [(i, "A", "en", "seventeen", 1) for i in range(17)] + [(7, "Alone", "en", "one", 5)]


@pytest.mark.parametrize("rows", [hot(300), [(5, "Ab" * 200_000, "x", "s", 2)], [(i, f"A{i}", "x", f"s{i:03}", 1) for i in range(300)], []], ids=["hot", "one", "sources", "none"])
def test_proofs(spark, rows):
    assert audited(spark, rows) == plain(rows)


def test_tampering_shows(spark):
    out = audited(spark, hot(120))
    assert {r[-1] for r in out} == {True, False}


def test_a_node_store_of_levels(spark):
    """Each level is read back from its own folder; a foreign leaf or a proof of another row does not fold to the root."""
    rows = hot(300)
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)
    made = merkle.manifest(docs, list(FIELDS), "source", "doc_id")
    sizes = [made.groups.level(k).count() for k in range(made.groups.top + 1)]
    assert sizes[0] == len(rows) and sizes == sorted(sizes, reverse=True) and made.groups.top == 3
    root = made.root().collect()
    assert [r[0] for r in root] == [plain(rows)[0][3]]
    proofs = made.proofs().withColumn("same", merkle.folded(merkle.F.col("leaf"), merkle.F.col("way")) == merkle.F.col("root"))
    assert proofs.where("not same").count() == 0
    other = made.proofs().withColumn("same", merkle.folded(merkle.F.sha2(merkle.F.col("leaf"), 256), merkle.F.col("way")) == merkle.F.col("root"))
    assert other.where("same").count() == 0
    assert made.proofs().where("id is null").count() == sum(r[0] is None for r in rows)
