"""Line dedup by winnowing, in DataFrame expressions only.

A text is a sequence of lines; blank lines take no part and always stay. A run of lines counts as repeated if the same run
occurred before and it has LEAST characters over all its lines together, or WINDOW lines of any length.

Of every WINDOW consecutive lines the one with the least hash is selected; so is the lesser of two lines that have LEAST
characters together, and every line that has as many. A repeated run is thus sure to hold selected lines, the same ones
wherever it occurs. One row is stored for each selected position, with digests of 128 bits of what lies around it: of each
window or pair that selected it, and of a long line alone. Positions whose line is selected once are dropped. The others are joined by line and compared outward, to the
left and to the right, with the first position of the same surroundings in order of (id, text, line). Every later one is a
repetition. Selected positions overlap in their windows, so the matches of neighbouring positions join up to the maximal
run; its lines are deleted, and its first occurrence stays. Positions are judged on the input, not on what is left.

All occurrences meet their first one through a combined minimum, never each other. Lines that hold a large part of all
positions are joined without a shuffle, and texts without a repeated run are not shuffled at all.

Cases: null and empty texts have no lines and stay as they are. Ids may be of any type that has an order. Rows equal in id
and text are one document; rows of one id and different texts are ordered by a hash of the text. Rows without an id come
last in the order. Very long texts are worked whole, in time proportional to their lines. An empty table gives an empty
result. Columns of any name are carried along by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, column, flagged, joined_by_key, packed, stored

#: Lines of a repeated run of any length, and characters of a run of fewer lines.
WINDOW, LEAST = 3, 100


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return F.translate(line, " \t\r", "") == ""


def _positions(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t, h, around): a row for each selected line, with the patterns around it: (kind, a, b, lines)."""
    numbered = F.transform(_lines(F.col("text")), lambda s, i: F.when(~_blank(s), F.struct(i.alias("line"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit("second"), s).alias("g"), F.char_length(s).alias("n"))))
    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text"))
    rows = rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.array_compact(numbered).alias("x"))
    starts = F.when(F.size("x") >= WINDOW, F.sequence(F.lit(0), F.size("x") - WINDOW)).otherwise(F.expr("cast(array() as array<int>)"))
    least = lambda i: F.least(*[F.struct(F.get("x", i + k)["h"].alias("h"), (i + k).alias("at")) for k in range(WINDOW)])["at"]
    rows = rows.withColumn("chosen", F.transform(starts, least))
    pairs = F.when(F.size("x") > 1, F.transform(F.sequence(F.lit(0), F.size("x") - 2), lambda i: F.when(F.get("x", i)["n"] + F.get("x", i + 1)["n"] >= LEAST, F.when(F.get("x", i + 1)["h"] < F.get("x", i)["h"], i + 1).otherwise(i))))
    rows = rows.withColumn("paired", F.coalesce(pairs, F.expr("cast(array() as array<int>)")))
    long = F.filter(F.transform("x", lambda s, i: F.when(s["n"] >= LEAST, i)), lambda i: i.isNotNull())
    rows = rows.select("id", "t", "x", "chosen", "paired", F.explode(F.array_union(F.array_union("chosen", long), F.array_compact("paired"))).alias("at"))

    def pattern(kind: int, first: int, n: int, holds: Column) -> Column:
        part = [F.get("x", F.col("at") + first + k) for k in range(n)]
        found = F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.xxhash64(*[p["h"] for p in part]).alias("a"), F.xxhash64(*[p["g"] for p in part]).alias("b"), F.array(*[p["line"] for p in part]).alias("lines"))
        return F.when(holds & (F.col("at") + first >= 0) & (F.col("at") + first + n <= F.size("x")), found)

    here = F.get("x", F.col("at"))
    windows = [pattern(k, -k, WINDOW, F.get("chosen", F.col("at") - k) == F.col("at")) for k in range(WINDOW)]
    two = [pattern(WINDOW + k, -k, 2, F.get("paired", F.col("at") - k) == F.col("at")) for k in range(2)]
    alone = pattern(WINDOW + 2, 0, 1, here["n"] >= LEAST)
    return rows.select("id", "t", here["h"].alias("h"), F.array_compact(F.array(*windows, *two, alone)).alias("around"))


def _place(line: Column) -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "t", line.alias("line"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, lines): per document, by id and text hash, the numbers of the lines of repeated runs."""
    positions = stored(_positions(docs, doc_id, text))
    place = _place(F.get(F.get("around", F.lit(0))["lines"], F.lit(0)))
    count = F.count(F.lit(1)).alias("n")
    several = stored(positions.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), count).where("a <> b").select("h", "n"))
    around = stored(joined_by_key(positions, several, ["h"], "line").select("id", "t", "h", F.explode("around").alias("p")).select("id", "t", "h", "p.*"))
    key, place = ["h", "kind", "a", "b"], _place(F.get("lines", F.lit(0)))
    first = stored(around.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), count).where("first <> last").drop("last"))
    later = joined_by_key(around, first, key, "around").where(place > F.col("first"))
    return later.groupBy("id", "t").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))  # of one document: as many as it has lines


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_removed): every row of docs as a struct, its text freed of repeated runs, and its lines counted."""
    gone = stored(repeated_lines(docs, doc_id, text))
    whole = column(docs, text)
    mine = packed(docs, id=column(docs, doc_id), t=F.xxhash64(F.coalesce(whole, F.lit(""))), text=whole)
    mine = flagged(mine, gone, ["id", "t"], "gone")
    same = F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.t") == F.col("g.t"))
    changed = mine.where("flag").alias("d").join(gone.alias("g"), same, "left").select("row", "text", "lines")
    joined = changed.unionByName(mine.where("not flag").select("row", "text", F.lit(None).cast("array<int>").alias("lines")))
    cut = bound(_lines(F.col("text")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lines")), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(_lines(F.col("text"))))
    return joined.select("row", F.when(F.col("lines").isNull(), F.col("text")).otherwise(cut).alias("kept"), n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_removed"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns and rows, with `text` freed of repeated runs."""
    fields = [(F.col("kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return judged(docs, doc_id, text).select(*fields)


#: DuckDB SQL of the query: every window, long line and long pair against the first equal one, without fingerprints.
SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, u.i - 1 AS line, ls[u.i] AS s FROM base, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u),
full_lines AS (SELECT doc_id, line, s, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM numbered WHERE replace(replace(replace(s, ' ', ''), chr(9), ''), chr(13), '') <> ''),
pairs AS (SELECT a.doc_id, a.line AS l0, b.line AS l1, a.s AS s0, b.s AS s1, b.k FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
windows AS (SELECT p.doc_id, l0, l1, c.line AS l2, s0, s1, c.s AS s2 FROM pairs p JOIN full_lines c ON p.doc_id = c.doc_id AND c.k = p.k + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s0, s1, s2 ORDER BY doc_id, l0) AS r FROM windows),
ranked_pairs AS (SELECT *, row_number() OVER (PARTITION BY s0, s1 ORDER BY doc_id, l0) AS r FROM pairs WHERE length(s0) + length(s1) >= {LEAST}),
ranked_lines AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS r FROM full_lines WHERE length(s) >= {LEAST}),
gone AS (SELECT doc_id, l0 AS line FROM ranked WHERE r > 1 UNION SELECT doc_id, l1 FROM ranked WHERE r > 1 UNION SELECT doc_id, l2 FROM ranked WHERE r > 1
  UNION SELECT doc_id, l0 FROM ranked_pairs WHERE r > 1 UNION SELECT doc_id, l1 FROM ranked_pairs WHERE r > 1 UNION SELECT doc_id, line FROM ranked_lines WHERE r > 1),
flagged AS (SELECT n.doc_id, n.line, n.s, g.line IS NOT NULL AS g FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.line = g.line)
SELECT b.doc_id, CASE WHEN b.text = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE f.g) AS n_removed,
  sha256(coalesce(string_agg(f.s, chr(10) ORDER BY f.line) FILTER (WHERE NOT f.g), '')) AS kept_sha256
FROM base b JOIN flagged f ON b.doc_id = f.doc_id GROUP BY b.doc_id, b.text
"""
