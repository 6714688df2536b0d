"""Single files written and read by many tasks."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from causeway.sources import json_ranges, single_file


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_csv_by_many_tasks(spark, tmp_path, chunk):
    """The same bytes as one writer's, whatever the chunks and parts; quotes, nulls, floats, an order that is left out."""
    r = random.Random(chunk)
    rows = [(i, r.choice(["a,b", 'q"q', "line\nline", None, "é", ""]), r.choice([0.1, 1e300, 1e-7, 2.0, None])) for i in range(200)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "_i int, s string, x double").repartition(7)
    single_file.write_csv(df, tmp_path / "a.csv", ["_i"], chunk=chunk)
    want = io.StringIO(newline="")
    csv.writer(want, lineterminator="\n").writerows([("s", "x"), *((s, x) for _, s, x in rows)])
    assert (tmp_path / "a.csv").read_bytes() == want.getvalue().encode()
    single_file.write_csv(df.limit(0), tmp_path / "a.csv", ["_i"], header=False)
    assert (tmp_path / "a.csv").read_bytes() == b""


def test_written_again_by_a_retry(spark, tmp_path):
    """A task that runs twice writes the same bytes to the same place."""
    body = single_file.json_rows(spark.range(500).selectExpr("id", "string(id) as s"), ["id"], chunk=100)
    pieces = ['{"rows":', body, "]}"]
    single_file.write_pieces(tmp_path / "m.json", pieces)
    first = (tmp_path / "m.json").read_bytes()
    single_file._write(str(tmp_path / "m.json"), body, len(pieces[0]))
    assert (tmp_path / "m.json").read_bytes() == first
    assert json.loads(first) == {"rows": [{"id": i, "s": str(i)} for i in range(500)]}


def text(r):
    return "".join(r.choice(['a', '"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "😀", " "]) for _ in range(r.randrange(9)))


def record(r, i):
    return {"id": i, "name": text(r), "xs": [r.randrange(9) for _ in range(r.randrange(4))], "m": {"k": text(r), "n": None}}


@pytest.mark.parametrize(("size", "layout"), [(5, {}), (64, {"indent": 2}), (1000, {"separators": (",", ":")}), (1 << 20, {"ensure_ascii": False})])
def test_json_by_ranges(spark, tmp_path, size, layout):
    """Strings full of brackets, quotes and backslashes, ranges that end anywhere, empty lists, nested lists of records."""
    r = random.Random(size)
    rows, deep = [record(r, i) for i in range(30)], [record(r, i) for i in range(20)]
    whole = {"seed": 7, text(r) + "q": [1, [2, {"x": text(r)}]], "rows": rows, "none": [], "b": {"deep": {"rows": deep, "z": text(r)}, "note": text(r)}, "last": text(r)}
    (tmp_path / "d.json").write_text(" \n" + json.dumps(whole, **layout) + "\n", encoding="utf-8")
    lists = {"rows", "none", "b.deep.rows"}
    document = json_ranges.Document(spark, tmp_path / "d.json", size)
    value, places = document.read(lists)
    assert value == whole | {"rows": [], "b": whole["b"] | {"deep": {"rows": [], "z": whole["b"]["deep"]["z"]}}} and set(places) == lists
    out = document.records(places, dict.fromkeys(lists, set(record(r, 0)))).orderBy("place").collect()
    assert [json.loads(x["json"]) for x in out if x["section"] == "rows"] == rows and [json.loads(x["json"]) for x in out if x["section"] == "b.deep.rows"] == deep
    assert len(out) == 50 and not any(x["fault"] for x in out)


@pytest.mark.parametrize(("bad", "message"), [('{"id": NaN, "x": 1}', "constant"), ('{"id": 1, "id": 2, "x": 1}', "twice"), ('{"id": 1}', "fields do not match"), ("7", "no object"), ('{"id": 1, "x": 1', None), ("", None)])
def test_faulty_records(spark, tmp_path, bad, message):
    (tmp_path / "d.json").write_text('{"rows": [{"id": 0, "x": 1}, ' + bad + "]}")
    document = json_ranges.Document(spark, tmp_path / "d.json", 16)
    try:
        _, places = document.read({"rows"})
        faults = [x["fault"] for x in document.records(places, {"rows": {"id", "x"}}).collect() if x["fault"]]
    except ValueError:
        assert message is None
        return
    assert len(faults) == 1 and (message is None or message in faults[0])


def test_faulty_documents(spark, tmp_path):
    for k, said in enumerate(["[1]", '{"a": NaN}', '{"a": 1, "a": 2}', '{"b": {"rows": [], "rows": []}}']):
        (tmp_path / f"{k}.json").write_text(said)
        with pytest.raises(ValueError):
            json_ranges.Document(spark, tmp_path / f"{k}.json", 16).read({"b.rows"})


def test_numbers_are_made_behind_the_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(single_file, "PART_VALUES", 100)
    rows = spark.range(200).select("id", F.when(F.col("id") % 9 > 0, F.col("id") / 8).alias("x")).repartition(3)
    single_file.write_pieces(tmp_path / "n.csv", [single_file.number_rows(rows, ["id"], [F.col("id"), F.col("x"), F.col("id") * 3])])
    assert (tmp_path / "n.csv").read_text() == "".join(f"{i},{i / 8 if i % 9 else ''},{i * 3}\n" for i in range(200))
    with pytest.raises(ValueError, match="not numbers: s"):
        single_file.number_rows(rows, ["id"], [F.lit("a,b").alias("s")])
