"""Raw directories read in many parts, and the code of every fault."""

import random

import pytest

from causeway import storage
from causeway.plans import protocol
from causeway.simulation import bundle
from causeway.sources import raw
from causeway.sources.rows import with_rows


def written(root, n=40, change=None):
    ids = [1000 + 7 * k for k in range(n)]
    random.Random(3).shuffle(ids)
    lines = {
        "features": [",".join([str(i), str(1 + k % 49), *["0.5"] * 165]) for k, i in enumerate(ids)],
        "classes": ["txId,class", *(f"{i},{['1', '2', 'unknown'][k % 3]}" for k, i in enumerate(ids))],
        "edgelist": ["txId1,txId2", *(f"{a},{b}" for a, b in zip(ids, ids[1:]))],
    }
    if change:
        change(lines)
    root.mkdir(parents=True, exist_ok=True)
    for name, file in raw.RAW.items():
        (root / file).write_text("".join(f"{x}\n" for x in lines[name]))
    return ids


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_of_many_parts_are_dense(spark, tmp_path, small_parts):
    (tmp_path / "x.txt").write_text("".join(f"{k}\n" for k in range(60_000)))
    out = with_rows(spark.read.schema("v bigint").csv(str(tmp_path / "x.txt")))
    assert out.rdd.getNumPartitions() > 4 and out.where("v <> __row").count() == 0 and out.count() == 60_000


def test_a_directory_of_many_parts_is_accepted(spark, tmp_path, small_parts):
    ids = written(tmp_path, 10_000)
    nodes, edges, prints = protocol.load_graph(spark, tmp_path)
    assert nodes.count() == 10_000 and edges.count() == 9_999 and len(prints) == 3
    rows = {r["row"]: r["txId"] for r in raw.read(spark, tmp_path)["features"].collect()}
    assert [rows[k] for k in range(10_000)] == ids

    def swap(lines):
        lines["classes"][9000], lines["classes"][9001] = lines["classes"][9001], lines["classes"][9000]

    written(tmp_path / "swapped", 10_000, swap)
    with pytest.raises(ValueError, match="RAW_ID_ORDER"):
        protocol.load_graph(spark, tmp_path / "swapped")


def replaced(name, row, column, value):
    def change(lines):
        cells = lines[name][row].split(",")
        cells[column] = value
        lines[name][row] = ",".join(cells)

    return change


def several(*changes):
    return lambda lines: [c(lines) for c in changes]


@pytest.mark.parametrize(
    ("code", "change"),
    [
        ("RAW_FEATURE_SCHEMA", lambda x: x["features"].clear()), ("RAW_FEATURE_WIDTH", lambda x: x["features"].__setitem__(0, "1,2,3")), ("RAW_FEATURE_SCHEMA", lambda x: x["features"].__setitem__(5, x["features"][5] + ",1")),
        ("RAW_NONFINITE_FEATURE", lambda x: x["features"].__setitem__(5, x["features"][5][:-4])), ("RAW_NONFINITE_FEATURE", replaced("features", 3, 9, "inf")), ("RAW_NONFINITE_FEATURE", replaced("features", 3, 9, "nan")),
        ("RAW_NONFINITE_FEATURE", replaced("features", 3, 166, "x")), ("RAW_NONFINITE_FEATURE", replaced("features", 3, 50, "")), ("RAW_ID_TYPE", replaced("features", 3, 0, "1.0")), ("RAW_ID_TYPE", replaced("features", 3, 0, "-4")),
        ("RAW_ID_TYPE", replaced("features", 3, 0, "9223372036854775808")), ("RAW_TIME_STEP", replaced("features", 3, 1, "x")), ("RAW_TIME_STEP", replaced("features", 3, 1, "50")), ("RAW_TIME_STEP", replaced("features", 3, 1, "0")),
        ("RAW_CLASS_SCHEMA", replaced("classes", 0, 1, "kind")), ("RAW_CLASS_SCHEMA", lambda x: x["classes"].clear()), ("RAW_ID_TYPE", replaced("classes", 4, 0, "a")), ("RAW_CLASS_VALUE", replaced("classes", 4, 1, "3")),
        ("RAW_EDGE_SCHEMA", replaced("edgelist", 0, 0, "a")), ("RAW_EDGE_TYPE", replaced("edgelist", 2, 1, "2.5")), ("RAW_ORPHAN_EDGE", replaced("edgelist", 2, 1, "5")),
        ("RAW_SELF_LOOP", lambda x: x["edgelist"].append("1000,1000")), ("RAW_DUPLICATE_EDGE", lambda x: x["edgelist"].append(x["edgelist"][3])),
        ("RAW_ID_DUPLICATE", several(replaced("features", 4, 0, "1000"), replaced("features", 5, 0, "1000"))), ("RAW_ID_ORDER", lambda x: x["classes"].pop()),
    ],
)
def test_codes(spark, tmp_path, code, change):
    written(tmp_path, 40, change)
    with pytest.raises(ValueError, match=f"^{code}$"):
        protocol.load_graph(spark, tmp_path)


def test_missing_files(spark, tmp_path):
    with pytest.raises(ValueError, match="RAW_FILES_MISSING"):
        protocol.load_graph(spark, tmp_path)


def test_values_may_be_left_unread(spark, tmp_path):
    written(tmp_path, 40, replaced("features", 3, 9, "inf"))
    assert protocol.load_graph(spark, tmp_path, check_values=False)[0].count() == 40 and bundle.FEATURES == 165


def test_contiguous_directories(spark, tmp_path):
    """Generated directories number their transactions by row, and edges stay within them; values come back as they are."""

    def numbered(ends=(1, 2), swap=False):
        def change(lines):
            lines["features"] = [",".join([str(k), "1", *(str(k + j / 4) for j in range(165))]) for k in range(40)]
            lines["classes"] = ["txId,class", *(f"{k},1" for k in range(40))]
            lines["edgelist"] = ["txId1,txId2", f"{ends[0]},{ends[1]}"]
            if swap:
                for name, k in (("features", 5), ("classes", 6)):
                    lines[name][k], lines[name][k + 1] = lines[name][k + 1], lines[name][k]

        return change

    written(tmp_path / "good", 40, numbered())
    assert protocol.load_graph(spark, tmp_path / "good", contiguous=True)[0].count() == 40
    values = {r["txId"]: r["features"] for r in raw.read(spark, tmp_path / "good", with_values=True)["features"].collect()}
    assert values == {k: [k + j / 4 for j in range(165)] for k in range(40)}
    written(tmp_path / "swapped", 40, numbered(swap=True))
    assert protocol.load_graph(spark, tmp_path / "swapped")[0].count() == 40
    with pytest.raises(ValueError, match="RAW_ID_SEQUENCE"):
        protocol.load_graph(spark, tmp_path / "swapped", contiguous=True)
    written(tmp_path / "far", 40, numbered((1, 40)))
    with pytest.raises(ValueError, match="RAW_EDGE_RANGE"):
        protocol.load_graph(spark, tmp_path / "far", contiguous=True)
    with pytest.raises(ValueError, match="RAW_ORPHAN_EDGE"):
        protocol.load_graph(spark, tmp_path / "far")
    written(tmp_path / "others", 40)
    with pytest.raises(ValueError, match="RAW_ID_SEQUENCE"):
        protocol.load_graph(spark, tmp_path / "others", contiguous=True)


def test_every_file_is_parsed_once(spark, tmp_path, monkeypatch):
    """What is at fault in a row is told as it is parsed; numbers of rows follow from the stored table."""
    written(tmp_path / "good", 40)
    plans = []
    monkeypatch.setattr(raw, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.stored(df))
    rows = raw.read(spark, tmp_path / "good", with_values=True)["features"].collect()
    assert sorted(r["row"] for r in rows) == list(range(40)) and all(r["features"] == [0.5] * 165 for r in rows)
    assert [p.count("FileScan csv") for p in plans if "FileScan csv" in p] == [1, 1, 1]
    written(tmp_path / "late", 40, replaced("features", 3, 1, "3000000000"))
    with pytest.raises(ValueError, match="^RAW_FEATURE_SCHEMA$"):
        raw.read(spark, tmp_path / "late")
