"""As-of lookups with narrow spans and hot keys, against plain loops."""

import random

from causeway.operators import asof


def test_last_before_over_spans(spark):
    r = random.Random(1)
    writes = [(r.choice([1, 1, 1, 2, None]), r.randrange(400)) for _ in range(150)]
    probes = [(r.choice([1, 1, 2, 3, None]), r.randrange(450), k) for k in range(200)]
    out = asof.last_before(spark.createDataFrame(probes, "key bigint, at bigint, n int"), spark.createDataFrame(writes, "key bigint, at bigint"), "key", "at", span=16)
    want = {n: max((a for k, a in writes if k == key and k is not None and a < at), default=None) for key, at, n in probes}
    assert {x["n"]: x["last"] for x in out.collect()} == want and out.columns == ["key", "at", "n", "last"]


def test_least_entered_over_spans(spark):
    r = random.Random(2)
    entered = [(e % 2, e, s) for e, s in zip(r.sample(range(300), 120), r.sample(range(900), 120))]
    probes = [(r.randrange(3), r.randrange(1000), r.randrange(300), r.choice([None, *range(0, 300, 3)]), k) for k in range(300)]
    low = sorted(e for _, e, _ in entered)
    probes += [(p, t, low[0], low[1], 1000 + 10 * t + p) for p in (0, 1) for t in range(0, 999, 37)]
    out = asof.least_entered(spark.createDataFrame(probes, "pool int, at bigint, x bigint, y bigint, n int"), spark.createDataFrame(entered, "pool int, entity bigint, since bigint"), ["pool"], "at", ["x", "y"], span=64)
    want = {n: min((e for p, e, s in entered if p == pool and s < at and e not in (x, y)), default=None) for pool, at, x, y, n in probes}
    assert {x["n"]: x["least"] for x in out.collect()} == want


def test_a_hot_key_is_spread(spark):
    """Half of all rows have one key: no partition of the result's plan needs them together."""
    n = 40_000
    writes = spark.range(n).selectExpr("if(id % 2 = 0, 7, -id) as key", "id * 64 as at")
    out = asof.last_before(writes.selectExpr("key", "at", "at div 64 as n"), writes, "key", "at", span=1 << 12)
    rows = {r["n"]: r["last"] for r in out.where("key = 7").collect()}
    assert len(rows) >= n // 2 and all(rows[k] == (None if k == 0 else (k - 2) * 64) for k in range(0, n, 2))
