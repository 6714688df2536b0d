"""One file that many tasks write, each its own range of bytes.

Rows are sorted into runs, and each run is turned into chunks of text that know their place in it. The sizes of the runs give
every chunk its place in the file, and then any task may write any chunk, in any order and more than once, with the same bytes
as the outcome. The driver sets the file's size and writes what stands around the rows. The path must be on a file system that
driver and executors all mount.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_batches, stored

#: Bytes from which on a chunk is closed.
CHUNK = 1 << 20
#: Numbers that a task of number_rows turns into text.
PART_VALUES = 4_000_000


@dataclass
class Body:
    """Rows as chunks of text (place, data), stored, and their bytes in all; listed: the members of a JSON list, each behind a comma."""

    chunks: DataFrame
    size: int
    listed: bool = False


def _body(rows: DataFrame, order: list[str], text: Callable[[pa.RecordBatch], str], chunk: int = CHUNK, then: Callable[[DataFrame], DataFrame] = lambda x: x, parts: tuple[int, ...] = ()) -> Body:
    def run(batches):
        at, held, part = 0, [], TaskContext.get().partitionId()

        def closed():
            data = "".join(held).encode()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.large_binary())], ["run", "at", "size", "data"])

        for batch in batches:
            held.append(text(batch))
            if sum(map(len, held)) >= chunk:
                out = closed()
                yield out
                at, held = at + out.column(2)[0].as_py(), []
        if any(held):
            yield closed()

    small_batches(rows.sparkSession)
    ordered = then(rows.repartitionByRange(*parts, *order).sortWithinPartitions(*order)).drop(*[c for c in order if c.startswith("_")])
    made = stored(ordered.mapInArrow(run, "run bigint, at bigint, size bigint, data binary"))
    runs = made.groupBy("run").agg(F.sum("size").alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a row per run
    chunks = made.join(F.broadcast(before), "run").select((F.col("before") + F.col("at")).alias("place"), "data")
    return Body(chunks, runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def csv_rows(rows: DataFrame, order: list[str], chunk: int = CHUNK) -> Body:
    """CSV lines in order of some columns, of which those that begin with an underscore are left out."""

    def text(batch: pa.RecordBatch) -> str:
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n").writerows(zip(*(c.to_pylist() for c in batch.columns)))
        return out.getvalue()

    return _body(rows, order, text, chunk)


def number_rows(rows: DataFrame, order: list[str], columns: list[Column], chunk: int = CHUNK) -> Body:
    """CSV lines of the columns, which must be numbers, in order of some columns of rows; null is empty.

    For wide files: only rows are sorted, of which the columns are made behind the shuffle, and Spark turns them into text.
    """
    if wrong := [c for c, t in rows.select(*columns).dtypes if t not in ("tinyint", "smallint", "int", "bigint", "float", "double")]:
        raise ValueError(f"not numbers: {', '.join(wrong)}")
    line = F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).alias("line")
    parts = max(1, -(-rows.count() * len(columns) // PART_VALUES))  # what is sorted says little of the work behind it
    return _body(rows, order, lambda batch: "".join([x + "\n" for x in batch.column(0).to_pylist()]), chunk, lambda x: x.select(line), (parts,))


def json_rows(rows: DataFrame, order: list[str], chunk: int = CHUNK) -> Body:
    """The rows as the members of a JSON list, a line each, nulls included, without the bracket at its end; columns of the order that begin with an underscore are left out."""
    fields = [c for c in rows.columns if not c.startswith("_")]
    lines = rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    body = _body(lines, [f"_{i}" for i in range(len(order))], lambda batch: "".join([",\n" + r for r in batch.column(0).to_pylist()]), chunk)
    return Body(body.chunks, body.size, True)


def write_pieces(path: str | Path, pieces: list[str | Body]) -> None:
    """Write texts and bodies one behind the other. A body of a list is opened by the bracket in place of its first comma."""
    path, places, at = str(path), [], 0
    for p in pieces:
        places.append(at)
        at += p.size if isinstance(p, Body) else len(p.encode())
    with open(path, "wb") as f:
        f.truncate(at)
    for p, base in zip(pieces, places):
        if isinstance(p, Body):
            _write(path, p, base)
    with open(path, "r+b") as f:
        for p, base in zip(pieces, places):
            if not isinstance(p, Body):
                f.seek(base)
                f.write(p.encode())
        f.flush()
        os.fsync(f.fileno())


def _write(path: str, body: Body, base: int) -> None:
    listed = body.listed

    def run(batches):
        done = 0
        with open(path, "r+b", buffering=0) as f:
            for batch in batches:
                for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if place == 0 and listed:
                        data = b"[" + data[1:]
                    if os.pwrite(f.fileno(), data, base + place) != len(data):
                        raise OSError(f"short write at {base + place}")
                    done += len(data)
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    n = body.chunks.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n != body.size:
        raise OSError(f"{path}: wrote {n} bytes of {body.size}")


def write_csv(rows: DataFrame, path: str | Path, order: list[str], header: bool = True, chunk: int = CHUNK) -> None:
    """One CSV file in order of some columns, of which those that begin with an underscore are left out."""
    names = io.StringIO(newline="")
    csv.writer(names, lineterminator="\n").writerow([c for c in rows.columns if not c.startswith("_")])
    write_pieces(path, [*([names.getvalue()] if header else []), csv_rows(rows, order, chunk)])
