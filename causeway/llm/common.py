"""What the corpus operators share: shared-folder tables, Arrow maps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..storage import shared_dir, stored  # noqa: F401

#: Keys that hold at least this part of all rows are hot: there are at most as many of them.
HOT = 1024
#: Bits of the bitmaps that keep rows without a partner out of a shuffle.
BITMAP_BITS = 25
#: Byte map of A-Z to a-z; every other byte stays.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows as one struct `row` beside the given columns, so that no column of docs can clash with them."""
    return docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def _pages(marks: DataFrame, place: Column) -> DataFrame:
    """(page, bits): a bitmap of places as pages of 4 KB."""
    page, bit = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit((1 << 15) - 1))
    return marks.select(page.alias("page"), bit.alias("bit")).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap(marks: DataFrame, hashed: str, bits: int = 27) -> tuple[np.ndarray, int]:
    """A bitmap of the low bits of the hashes in a column, whatever their number, as bytes on the driver; and its bits as a power."""
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in _pages(marks, F.col(hashed).bitwiseAND(F.lit((1 << bits) - 1))).toLocalIterator():  # 2**bits bits in all
        table[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def in_bitmap(table: bytes, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of bitmap()."""
    bit = hashes.view(np.int64) & ((1 << bits) - 1)
    return (np.frombuffer(table, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def flagged(rows: DataFrame, marks: DataFrame, key: list[str], tag: str, name: str = "flag") -> DataFrame:
    """rows with whether their key may be one of marks: false for most that are not, never for one that is.

    The marks are a bitmap of 2**BITMAP_BITS bits by a hash of the key, whatever their number, which is broadcast. tag: names
    the join in plans.
    """
    page_, bits_, bit_ = (f"__{x}_{tag}" for x in ("page", "bits", "bit"))
    place = F.pmod(F.xxhash64(*key), F.lit(1 << BITMAP_BITS))
    # cut into lines of 64 bytes, which is what a row is handed; lines without a mark are left out
    lines = _pages(marks, place).select("page", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    lines = lines.select((F.col("page") * 64 + F.col("k")).alias(page_), F.substring("bits", F.col("k") * 64 + 1, F.lit(64)).alias(bits_)).where(F.col(bits_) != F.unhex(F.lit("00" * 64)))
    placed = rows.withColumn(page_, F.shiftright(place, 9).cast("int")).withColumn(bit_, place.bitwiseAND(F.lit(511)).cast("int")).join(F.broadcast(lines), page_, "left")  # 2**(BITMAP_BITS - 9) lines at most
    byte = F.conv(F.hex(F.substring(bits_, F.shiftright(bit_, 3) + 1, F.lit(1))), 16, 10).cast("int")
    one = F.call_function("shiftright", byte, F.col(bit_).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return placed.select(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns], F.coalesce(one, F.lit(False)).alias(name))


def among(rows: DataFrame, marks: DataFrame, key: list[str], tag: str) -> DataFrame:
    """The rows whose key may be one of marks."""
    return flagged(rows, marks, key, tag, "__may").where("__may").drop("__may")


def without(docs: DataFrame, doc_id: str, text: str, out: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose id and hash of the text are not among (id, t). Most that stay are not shuffled."""
    mine = flagged(packed(docs, id=column(docs, doc_id), t=F.xxhash64(F.coalesce(column(docs, text), F.lit("")))), out, ["id", "t"], "out")
    same = F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.t") == F.col("o.t"))
    judged = mine.where("flag").alias("d").join(out.alias("o"), same, "left_anti")
    return mine.where("not flag").select("row").unionByName(judged.select("row")).select("row.*")


def joined_by_key(rows: DataFrame, keyed: DataFrame, key: list[str], tag: str, n: str = "n") -> DataFrame:
    """rows joined with keyed, which has each key once and in `n` how many rows have it; both are stored tables.

    A key with at least 1/HOT of the rows, of which there are at most HOT, is broadcast, so its rows stay where they are;
    so do most rows without a partner.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT >= total
    top = keyed.where(hot)  # at most HOT rows
    return rows.join(F.broadcast(top), key).unionByName(among(rows, keyed.where(~hot), key, tag).join(keyed.where(~hot), key))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a task holds few texts as objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def held_out(doc_id: str, parts: int, part: int):
    """crc32 of the id as text, modulo parts, is part. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8: per byte an exclusive or, then eight shifts by the polynomial."""
    digits = f"hex(encode({text}))"
    steps = f"flatten([[('0x' || {digits}[2 * i - 1 : 2 * i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, length({digits}) // 2 + 1)])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
