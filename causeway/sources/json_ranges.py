"""A large JSON object read by tasks, each a range of its bytes.

Whether a range begins inside a string follows from how many quotes stand before it, and how deep it begins from the brackets
before it, so two passes that count these per range tell every task the state in which it starts. A third pass finds where the
members of an object begin and end, level by level, and a fourth the members of long lists, each of which is the task's in
whose range it begins. The driver reads the values that are no long lists. The path must be on a file system that driver and
executors all mount.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and members of an object outside of long lists that the driver takes on.
RANGE, MEMBERS = 8 << 20, 10_000


def strict(text: str | bytes) -> Any:
    """A JSON value without NaN, infinities and doubled keys."""

    def refuse(value):
        raise ValueError(f"JSON constant is not allowed: {value}")

    def pairs(found):
        out = dict(found)
        if len(out) != len(found):
            raise ValueError(f"JSON object has a key twice: {next(k for k, _ in found if sum(k == j for j, _ in found) > 1)}")
        return out

    return json.loads(text, parse_constant=refuse, object_pairs_hook=pairs)


def _read(path: str, begin: int, end: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(begin)
        return np.frombuffer(f.read(max(end - begin, 0)), np.uint8)


def _quotes(path: str, begin: int, raw: np.ndarray) -> np.ndarray:
    """Places in raw of the quotes that begin or end a string: those behind an even number of backslashes."""
    at = np.flatnonzero(raw == 34)
    slashes = raw == 92
    doubtful = at[(at == 0) | slashes[at - 1]]
    gone = []
    for i in doubtful.tolist():
        n = 0
        while i - 1 - n >= 0 and slashes[i - 1 - n]:
            n += 1
        back = begin
        while i - 1 - n < 0 and back > 0 and _read(path, back - 1, back)[0] == 92:  # the run began in an earlier range
            n, back = n + 1, back - 1
        if n % 2:
            gone.append(i)
    return np.setdiff1d(at, gone) if gone else at


def _depths(path: str, begin: int, raw: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(outside, depth) of every byte: whether it is in no string, and in how many brackets it stands, its own not counted."""
    opened = np.zeros(len(raw) + 1, np.int64)
    opened[_quotes(path, begin, raw) + 1] = 1
    outside = (np.cumsum(opened[:-1]) + inside) % 2 == 0
    step = np.where(outside, np.isin(raw, (91, 123)).astype(np.int64) - np.isin(raw, (93, 125)), 0)
    return outside, depth + np.cumsum(step) - step


def _change(path: str, begin: int, raw: np.ndarray, inside: int) -> int:
    """By how much deeper a range ends than it begins."""
    outside, depth = _depths(path, begin, raw, bool(inside), 0)
    return _after(raw, outside, depth) if len(raw) else 0


def _after(raw: np.ndarray, outside: np.ndarray, depth: np.ndarray) -> int:
    """The depth behind the last byte."""
    return int(depth[-1]) + (int(raw[-1] in (91, 123)) - int(raw[-1] in (93, 125)) if outside[-1] else 0)


class Document:
    """One file with a JSON object."""

    def __init__(self, spark: SparkSession, path: str | Path, size: int = RANGE):
        path = str(path)
        self.spark, self.path, self.bytes, self.range = spark, path, os.path.getsize(path), size
        count = -(-self.bytes // size)
        ranges = spark.range(0, count, 1, max(min(count, 4 * spark.sparkContext.defaultParallelism), 1)).select(F.col("id").alias("range"))
        earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
        quoted = self._map(ranges, ["range"], "n", lambda r, begin, raw: len(_quotes(path, begin, raw)))
        quoted = quoted.select("range", (before("n") % 2).alias("inside"))
        deep = self._map(quoted, ["range", "inside"], "n", lambda r, begin, raw: _change(path, begin, raw, r[1]))
        self.ranges = deep.select("range", "inside", before("n").alias("depth")).repartition(ranges.rdd.getNumPartitions(), "range").cache()

    def _map(self, ranges: DataFrame, columns: list[str], name: str, value) -> DataFrame:
        path, size, end = self.path, self.range, self.bytes

        def run(batches):
            for batch in batches:
                rows = list(zip(*(batch.column(k).to_pylist() for k in range(len(columns)))))
                found = [value(r, r[0] * size, _read(path, r[0] * size, min((r[0] + 1) * size, end))) for r in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(found, pa.int64())] if rows else [pa.array([], pa.int64())] * (len(columns) + 1), [*columns, name])

        return ranges.select(*columns).mapInArrow(run, ", ".join(f"{c} bigint" for c in [*columns, name]))

    def _marks(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """(place, byte) of commas, colons and the closing bracket right inside of objects, given as (begin, end, depth of their inside)."""
        path, size, end = self.path, self.range, self.bytes

        def run(batches):
            for batch in batches:
                places, kinds = [], []
                for k, inside, depth in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    lo, hi = k * size, min((k + 1) * size, end)
                    if not any(a < hi and b > lo for a, b, _ in spans):
                        continue
                    raw = _read(path, lo, hi)
                    outside, at = _depths(path, lo, raw, bool(inside), depth)
                    for a, b, d in spans:
                        i = np.flatnonzero(outside & (at == d) & np.isin(raw, (44, 58, 125)))
                        i = i[(i + lo >= a) & (i + lo < b)]
                        places += (i + lo).tolist()
                        kinds += raw[i].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(kinds, pa.int64())], ["place", "kind"])

        found = self.ranges.mapInArrow(run, "place bigint, kind bigint").limit(2 * MEMBERS + 1).collect()
        if len(found) > 2 * MEMBERS:
            raise ValueError(f"JSON object has more than {MEMBERS} members")
        return sorted(map(tuple, found))

    def _slice(self, begin: int, end: int) -> bytes:
        return _read(self.path, begin, end).tobytes()

    def members(self, begin: int, end: int, depth: int) -> dict[str, tuple[int, int]]:
        """Key to (begin, end) of its value, of the object whose bracket stands at `begin`."""
        out, key, start = {}, None, begin + 1
        marks = self._marks([(begin + 1, end, depth)])
        if not marks or marks[-1] != (end - 1, 125):
            raise ValueError("JSON object is not closed")
        for place, kind in marks:
            if kind == 58:
                key, start = strict(self._slice(start, place)), place + 1
                if key in out:
                    raise ValueError(f"JSON object has a key twice: {key}")
            else:
                if key is not None:
                    out[key] = self._trimmed(start, place)
                key, start = None, place + 1
        return out

    def _trimmed(self, begin: int, end: int) -> tuple[int, int]:
        while begin < end and self._slice(begin, begin + 1).isspace():
            begin += 1
        while begin < end and self._slice(end - 1, end).isspace():
            end -= 1
        return begin, end

    def read(self, lists: set[str]) -> tuple[dict, dict[str, tuple[int, int, int]]]:
        """(value, places): the object without its long lists, which are named by dotted paths, and (begin, end, depth) of these."""
        begin, end = self._trimmed(0, self.bytes)
        if self._slice(begin, begin + 1) != b"{":
            raise ValueError("JSON document must be an object")
        places: dict[str, tuple[int, int, int]] = {}

        def value(path: str, lo: int, hi: int, depth: int) -> Any:
            if path in lists and self._slice(lo, lo + 1) == b"[":
                places[path] = (lo, hi, depth + 1)
                return []
            if (not path or any(x.startswith(path + ".") for x in lists)) and self._slice(lo, lo + 1) == b"{":
                return {k: value(f"{path}.{k}" if path else k, a, b, depth + 1) for k, (a, b) in self.members(lo, hi, depth + 1).items()}
            return strict(self._slice(lo, hi))

        return value("", begin, end, 0), places

    def records(self, places: dict[str, tuple[int, int, int]], fields: dict[str, set[str]]) -> DataFrame:
        """(section, place, json, fault): every member of the lists at `places`, and what is wrong with it, or null."""
        path, size, end = self.path, self.range, self.bytes

        def starts(lo: int, raw: np.ndarray, inside: bool, depth: int) -> Iterator[tuple[str, int]]:
            outside, at = _depths(path, lo, raw, inside, depth)
            for name, (a, b, d) in places.items():
                if a < lo + len(raw) and b > lo:
                    i = np.flatnonzero(outside & (((at == d) & (raw == 44)) | ((at == d - 1) & (raw == 91)))) + lo
                    yield from ((name, p) for p in i.tolist() if a <= p < b - 1)

        def finish(begin: int, level: int, stop: int) -> int:
            """Where the member of a list ends that begins here, outside of strings and `level` brackets deep."""
            at, inside, depth = begin, False, level
            while at < stop:
                raw = _read(path, at, min(at + (1 << 16), stop))
                outside, deep = _depths(path, at, raw, inside, depth)
                i = np.flatnonzero(outside & (deep == level) & np.isin(raw, (44, 93)))
                if len(i):
                    return at + int(i[0])
                quoted = len(_quotes(path, at, raw))
                depth = _after(raw, outside, deep)
                at, inside = at + len(raw), inside ^ bool(quoted % 2)
            return stop

        def run(batches):
            for batch in batches:
                out: list[tuple] = []
                for k, inside, depth in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    lo, hi = k * size, min((k + 1) * size, end)
                    if not any(a < hi and b > lo for a, b, _ in places.values()):
                        continue
                    raw = _read(path, lo, hi)
                    found = list(starts(lo, raw, bool(inside), depth))
                    for n, (name, at) in enumerate(found):
                        _, stop, level = places[name]
                        close = found[n + 1][1] if n + 1 < len(found) and found[n + 1][0] == name else finish(at + 1, level, stop - 1)
                        text = _read(path, at + 1, close).tobytes().strip()
                        if text or close < stop - 1 or raw[at - lo] == 44:
                            out.append((name, at, text.decode("utf-8", "replace"), _fault(text, fields[name])))
                        if len(out) >= 1000:
                            yield _batch(out)
                            out = []
                yield _batch(out)

        return self.ranges.mapInArrow(run, "section string, place bigint, json string, fault string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["section", "place", "json", "fault"])


def _fault(text: bytes, fields: set[str]) -> str | None:
    try:
        value = strict(text)
    except ValueError as e:
        return str(e)
    if not isinstance(value, dict):
        return f"record is no object: {value!r}"
    return f"record fields do not match: {sorted(fields ^ set(value))}" if fields != set(value) else None
