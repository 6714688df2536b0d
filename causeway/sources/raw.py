"""Raw directories of three CSV files, read strictly: every fault has a stable code.

All columns are read as text, so that a value that does not fit is a fault of its column and not of the reader.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..storage import stored
from .rows import in_order, placed, starts

# File names, columns and codes of the contract.
RAW = {"features": "elliptic_txs_features.csv", "classes": "elliptic_txs_classes.csv", "edgelist": "elliptic_txs_edgelist.csv"}
WIDTH = 167
HEADERS = {"classes": ["txId", "class"], "edgelist": ["txId1", "txId2"]}
SCHEMA_CODES = {"features": "RAW_FEATURE_SCHEMA", "classes": "RAW_CLASS_SCHEMA", "edgelist": "RAW_EDGE_SCHEMA"}


def integer(column: Column) -> Column:
    """The value of a text that is a whole number from 0 to the greatest bigint, else null."""
    return F.when(column.rlike(r"^[0-9]+$"), column.try_cast("bigint"))


def finite(column: Column) -> Column:
    """Whether a text is a finite number."""
    value = column.try_cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _stable(code: str, work: Callable):
    """The result of work, whose faults in reading become one code."""
    try:
        return work()
    except PySparkException as x:
        raise ValueError(code) from x


def _text(spark: SparkSession, root: Path, name: str, columns: list[str]) -> DataFrame:
    """The rows of a file as texts, with `__bad` on rows of another width."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", __bad string"
    options = {"header": name in HEADERS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "enforceSchema": True, "encoding": "UTF-8"}
    return spark.read.option("columnPruning", False).schema(schema).csv(f"{root}/{RAW[name]}", **options)


def _checked(rows: DataFrame, columns: list[Column], faults: list[tuple[str, Column]]) -> DataFrame:
    """`row` and the columns of every row of a file, stored; raises the first code some row of which is at fault.

    The file is parsed once: the faults of a row are stored beside its columns, and looked for in the table.
    """
    marks = [f"__f{k}" for k in range(len(faults))]
    table = stored(placed(rows.select(*columns, *(c.alias(m) for m, (_, c) in zip(marks, faults)))))
    found = table.agg(*(F.bool_or(m).alias(m) for m in marks)).first()
    for m, (code, _) in zip(marks, faults):
        if found[m]:
            raise ValueError(code)
    numbered = in_order(table.drop(*marks), stored(starts(table)), "row")
    return numbered.select("row", *[c for c in numbered.columns if c != "row"])


def read(spark: SparkSession, root: str | Path, check_values: bool = True, with_values: bool = False) -> dict[str, DataFrame]:
    """features (row, txId, time_step), classes (row, txId, class) and edgelist (row, txId1, txId2), typed and stored.

    check_values: whether the 165 further columns of every row must be finite numbers. with_values: features also has these,
    as `features`, an array of doubles.
    """
    root = Path(root)
    if not all((root / f).is_file() for f in RAW.values()):
        raise ValueError("RAW_FILES_MISSING")
    code = SCHEMA_CODES["features"]
    first = _stable(code, lambda: spark.read.text(f"{root}/{RAW['features']}").where(F.trim("value") != "").first())
    if first is None:
        raise ValueError(code)
    if first[0].count(",") + 1 != WIDTH:
        raise ValueError("RAW_FEATURE_WIDTH")
    names = [f"c{k}" for k in range(WIDTH)]
    f = _text(spark, root, "features", names)
    wide = F.col("__bad").isNotNull() & (F.length(F.regexp_replace("__bad", "[^,]", "")) >= WIDTH)
    ident, step = integer(F.col("c0")), integer(F.col("c1"))
    values = [F.array(*(F.col(c).try_cast("double") for c in names[2:])).alias("features")] if check_values or with_values else []
    f = f.select(ident.alias("txId"), step.alias("step"), wide.alias("wide"), *values)
    # an array without the infinite value gives null, not false, if some element is null
    sound = ~F.array_contains("features", float("inf")) & ~F.isnan(F.array_max("features")) & (F.array_min("features") > float("-inf"))
    values = ~F.coalesce(sound, F.lit(False)) if check_values else F.lit(False)
    faults = [(code, F.col("wide")), ("RAW_NONFINITE_FEATURE", values), ("RAW_ID_TYPE", F.col("txId").isNull()), ("RAW_TIME_STEP", F.col("step").isNull()), (code, F.col("step") >= 1 << 31)]
    kept = [F.col("features")] if with_values else []
    out = {"features": _stable(code, lambda: _checked(f, [F.col("txId"), F.col("step").try_cast("int").alias("time_step"), *kept], faults))}
    for name, type_code in (("classes", "RAW_ID_TYPE"), ("edgelist", "RAW_EDGE_TYPE")):
        a, b = HEADERS[name]
        code = SCHEMA_CODES[name]
        header = _stable(code, lambda name=name: spark.read.text(f"{root}/{RAW[name]}").first())
        if header is None or [x.strip().strip('"') for x in header[0].split(",")] != [a, b]:
            raise ValueError(code)
        rows = _text(spark, root, name, [a, b])
        second = integer(F.col(b)) if name == "edgelist" else F.col(b)
        faults = [(code, F.col("__bad").isNotNull() & F.col("__bad").contains(",")), (type_code, integer(F.col(a)).isNull())]
        faults += [(type_code, second.isNull())] if name == "edgelist" else []
        out[name] = _stable(code, lambda rows=rows, a=a, b=b, second=second, faults=faults: _checked(rows, [integer(F.col(a)).alias(a), second.alias(b)], faults))
    return out


def contract_faults(tables: dict[str, DataFrame], contiguous: bool = False) -> list[tuple[str, DataFrame]]:
    """(code, rows at fault) of a raw directory, in the order in which they are raised.

    contiguous: ids must be the numbers of their rows, as in every generated directory, and ends of edges must be among them.
    """
    f, c, e = tables["features"], tables["classes"], tables["edgelist"]
    ends = e.select("txId1", "txId2")
    beyond = F.greatest("txId1", "txId2") >= f.count() if contiguous else F.lit(False)
    return [
        ("RAW_ID_DUPLICATE", checks.duplicates(f, ["txId"])), ("RAW_ID_DUPLICATE", checks.duplicates(c, ["txId"])),
        *([("RAW_ID_SEQUENCE", f.where("not (txId <=> row)"))] if contiguous else []),
        ("RAW_ID_ORDER", f.alias("f").join(c.alias("c"), "row", "full").where("not (f.txId <=> c.txId)")),
        *([("RAW_EDGE_RANGE", ends.where(beyond))] if contiguous else []), ("RAW_ORPHAN_EDGE", checks.orphans(ends, f.select(F.col("txId").alias("tx_id")))),
        ("RAW_CLASS_VALUE", c.where("class is null or class not in ('1', '2', 'unknown')")), ("RAW_TIME_STEP", f.where("time_step not between 1 and 49")),
        ("RAW_SELF_LOOP", e.where("txId1 = txId2")), ("RAW_DUPLICATE_EDGE", checks.duplicates(ends, ["txId1", "txId2"])),
    ]


def need_contract(tables: dict[str, DataFrame], contiguous: bool = False) -> None:
    """Raises the code of the first fault."""
    for code, rows in contract_faults(tables, contiguous):
        if not rows.isEmpty():
            raise ValueError(code)
