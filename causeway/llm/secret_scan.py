"""Secret scan with multipart credential linking, in DataFrame expressions only.

Base findings, leftmost and non-overlapping per kind: assignments of credentials, access identifiers, long hexadecimal
runs. Besides these the scan looks for weak parts, each too common to report alone: identifiers, key-like tokens and
endpoints. An interval join over scopes of SCOPE code points decides about them: an identifier is reported when a secret
starts within that distance, a secret when an identifier does, an endpoint when both do; base findings count as
identifiers (access) and secrets (assign, hex). Positions are cut into buckets as wide as the scope, and each bucket is
reduced to its first and last position of each role before the join, which decides exactly and never pairs the parts
of a crowded bucket.

Spans count code points; the end is exclusive.

Cases: a null text counts as empty and has no findings. Repeated rows get equal results; rows of one id and different
texts are judged apart; a null id is carried along. Very long texts are scanned whole. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, stored

SCOPE = 256
#: Kind, pattern, group that must be long enough and its least length. The order is the kinds' order.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Weak parts, in the same form: identifiers, key-like tokens, endpoints.
WEAK = [
    ("ident", r"""(?i)(?:account|client|user|access|tenant)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("key", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("endpoint", r"[a-z][a-z0-9+]{1,11}://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 10),
]
#: A run of hexadecimal digits, or of AKIA, can only be long enough if this occurs; it saves the full search.
_QUICK = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
_CHUNK = 128


def _running(values: Column) -> Column:
    """Sums of the array up to and including each element."""
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.expr("cast(array() as array<bigint>)").alias("a"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])


def _running_long(values: Column) -> Column:
    """The same for arrays of any length, in chunks, since growing an array copies it. values: a bound variable."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: _running(F.slice(values, c * _CHUNK + 1, _CHUNK)))

    def joined(parts: Column) -> Column:
        before = _running(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(parts, lambda c: F.element_at(c, -1))))
        return bound(before, lambda sums: F.flatten(F.transform(parts, lambda c, i: F.transform(c, lambda x: x + F.element_at(sums, i + 1)))))

    return bound(chunks, joined)


def found_spans(text: Column, number: int, pattern: str, group: int, least: int, quick: str | None = None) -> Column:
    """Array of (start, kind number, end) of the matches, leftmost and non-overlapping, that are long enough.

    The gaps between matches and the matches themselves have lengths whose running sums are the places.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    size = lambda x: F.char_length(x).cast("bigint")
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), size)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), size)
    found = F.struct(F.transform(F.split(text, pattern, -1), size).alias("gaps"), sizes.alias("sizes"), values.alias("values"))

    def spans(f: Column) -> Column:
        ends = bound(F.zip_with(F.slice(f["gaps"], 1, F.size(f["sizes"])), f["sizes"], lambda g, s: g + s), _running_long)
        listed = F.zip_with(F.zip_with(ends, f["sizes"], lambda e, s: F.struct((e - s).alias("start"), F.lit(number).alias("kind"), e.alias("end"))), f["values"], lambda x, v: F.when(v >= least, x))
        return F.filter(listed, lambda x: x.isNotNull())

    return F.when(text.rlike(quick or pattern), bound(found, spans)).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE + WEAK])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_assign, n_access, n_hex, base (their list), spans (with linked weak parts), arrays base_spans and linked_spans."""
    t = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = [found_spans(t, k, p, g, n, _QUICK.get(name)) for k, (name, p, g, n) in enumerate(BASE)]
    weak = [found_spans(t, len(BASE) + k, p, g, n) for k, (name, p, g, n) in enumerate(WEAK)]
    found = stored(mine.select("doc_id", F.xxhash64(t).alias("text_hash"), F.concat(*base).alias("base_spans"), F.concat(*weak).alias("weak_spans")))
    linked = _linked(found)
    d, w = found.alias("d"), linked.alias("w")
    out = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")), "left").select(
        "d.doc_id", "d.text_hash", "d.base_spans", F.coalesce("w.linked_spans", F.slice("d.base_spans", 1, 0)).alias("linked_spans"))
    counts = [F.size(F.expr(f"filter(base_spans, x -> x.kind = {k})")).cast("bigint").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return out.select("doc_id", "text_hash", *counts, _listed(F.col("base_spans")).alias("base"), _listed(F.concat("base_spans", "linked_spans")).alias("spans"), "base_spans", "linked_spans")


def _linked(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, linked_spans): the weak parts with complementary parts within the scope."""
    kind = F.col("p.kind")
    role = F.when(kind.isin(1, 3), "ident").when(kind == 5, "endpoint").otherwise("secret")
    parts = found.where(F.size("weak_spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode(F.concat("base_spans", "weak_spans")).alias("p"))
    parts = parts.select("doc_id", "text_hash", "p", role.alias("role"), F.floor(F.col("p.start") / SCOPE).alias("bucket"))
    key = ["doc_id", "text_hash", "bucket", "role"]
    scopes = parts.groupBy(*key).agg(F.min("p.start").alias("first"), F.max("p.start").alias("last")).where("role <> 'endpoint'").alias("s")
    near = parts.where(kind >= len(BASE)).select("*", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("other")).alias("n")
    same = F.col("n.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("n.text_hash") == F.col("s.text_hash")) & (F.col("n.other") == F.col("s.bucket"))
    start = F.col("n.p.start")
    # of the bucket before, the last position decides; of the one behind, the first; in its own bucket all are near
    close = F.when(F.col("n.other") < F.col("n.bucket"), F.col("s.last") >= start - SCOPE).when(F.col("n.other") > F.col("n.bucket"), F.col("s.first") <= start + SCOPE).otherwise(True)
    met = near.join(scopes, same & close & (F.col("n.role") != F.col("s.role")))
    decided = met.groupBy("n.doc_id", "n.text_hash", "n.role", "n.p").agg(F.count_distinct("s.role").alias("roles"))
    linked = decided.where((F.col("role") != "endpoint") | (F.col("roles") == 2))
    return linked.groupBy("doc_id", "text_hash").agg(F.collect_list("p").alias("linked_spans"))  # of one document: as many as its text holds
