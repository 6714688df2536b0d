"""The registered corpus queries on the smallest tables: columns, all rows, and SQL where there is some."""

import os

import pytest

from causeway.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op6_line_dedup", "op10_url_filter", "op11_spelling_variants", "op12_merkle_manifest"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    out = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want.fetchall()))


def test_sentencepiece(spark):
    import hashlib

    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    want = []
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))))
    out = queries.queries()["op13_sentencepiece"](spark, SF).drop("spans_sha256")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
