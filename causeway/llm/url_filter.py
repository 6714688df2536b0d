"""URL filter by a temporal list join.

A list is a log of dated entries: on a day a key (a host or a domain above it) is added to a list or taken off. Per key
and list the log becomes validity intervals, which are cut at the borders of PERIOD days. A capture stands for its host
and every domain above it; an equi-join on (key, period) and a check of the day find, as of the fetch, the entries active
then. Captures are reduced to distinct hosts and days, and these to distinct keys and days, before the as-of join: a host
or domain of a third of all captures has at most PERIOD rows in a period. Intervals of one key and list do not overlap.
An active allowance beats a block if its key is at least as specific.

Cases: a null, empty or unreadable url has no host, meets no entry and is not blocked; so has a capture without a day.
White space around a url is ignored, a scheme may be missing before two slashes, backslashes are slashes, the host is what
stands behind the last @ of the authority, and one dot at its end is dropped. IPv4 and bracketed IPv6 addresses (names whose
last label is a number) match only themselves. Hosts may have any number of labels. Entries with a null key, list or day are ignored; of entries for one key, list and
day a removal wins. Captures may repeat and ids may be null: each row gets the result of its url and day. Empty tables
give empty or unblocked results. `evaluate` reads only the named columns; `kept` carries columns of any name along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

PERIOD, FOREVER = 64, 1 << 20


#: The authority of a url: behind an optional scheme and two slashes, up to the path, query or fragment; browsers read a
#: backslash as a slash. Then what is behind the last @, without port and one trailing dot. An address has no domain above it.
AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?[/\\][/\\]([^/?#\\]*)"
NAME = r"^(\[[^\]]*\]|[^:]*)"
ADDRESS = r"(^\[|(^|\.)([0-9]+|0x[0-9a-f]*)$)"


def host(url: Column) -> Column:
    """Lower-case host of a url, empty without one."""
    plain = F.regexp_replace(F.translate(F.lower(url), "\t\n\r", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    authority = F.regexp_extract(plain, AUTHORITY, 1)
    name = F.regexp_extract(F.regexp_extract(authority, "([^@]*)$", 1), NAME, 1)
    return F.coalesce(F.regexp_replace(name, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, from_day, to_day): when each key is on each list. entries: key, list, day, added."""
    dated = entries.where("key is not null and list is not null and day is not null").groupBy("key", "list", "day").agg(F.bool_and("added").alias("added"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("key", "list").orderBy("day")), F.lit(FOREVER))
    return dated.select("key", "list", F.col("day").alias("from_day"), until.alias("to_day"), "added").where("added").drop("added")


def keys(host_name: Column) -> Column:
    """The host and every domain above it that is not the last label alone, most specific first; of an address itself alone."""
    labels = F.split(host_name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.regexp_like(host_name, F.lit(ADDRESS)), F.array(host_name)).otherwise(above)


def _decided(moments: DataFrame, entries: DataFrame, last_day: int) -> DataFrame:
    """(host, day, n_active, blocked) of the distinct (host, day) that meet an active entry."""
    probes = moments.where("host <> '' and day is not null").distinct().select("host", "day", F.posexplode(keys(F.col("host"))).alias("above", "key"))
    first, last = F.floor(F.col("from_day") / PERIOD), F.floor(F.least(F.col("to_day") - 1, F.lit(last_day)) / PERIOD)
    active = intervals(entries).where((F.col("to_day") > F.col("from_day")) & (F.col("from_day") <= last_day)).select("key", "list", "from_day", "to_day", F.explode(F.sequence(first, last)).alias("period"))
    days = probes.select("key", "day", F.floor(F.col("day") / PERIOD).alias("period")).distinct()  # of one key and period at most PERIOD
    met = days.join(active, ["key", "period"]).where((F.col("from_day") <= F.col("day")) & (F.col("day") < F.col("to_day")))
    by_key = met.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("list") == "block").alias("block"), F.bool_or(F.col("list") == "allow").alias("allow"))
    # above: labels cut off the host; the smaller, the more specific
    found = probes.join(by_key, ["key", "day"]).groupBy("host", "day").agg(
        F.sum("n").alias("n_active"), F.min(F.when(F.col("block"), F.col("above"))).alias("block"), F.min(F.when(F.col("allow"), F.col("above"))).alias("allow"))
    return found.select("host", "day", "n_active", (F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("allow") > F.col("block")))).alias("blocked"))


def _judged(captures: DataFrame, entries: DataFrame, last_day: int) -> DataFrame:
    """(row, host, n_active, blocked): every capture, whole, with what its host and day meet."""
    when = F.col("day").cast("bigint")
    mine = packed(captures, host=host(F.col("url")), day=F.when(when.isNotNull(), F.least(when, F.lit(last_day))))
    found = _decided(mine.select("host", "day"), entries, last_day)
    return mine.join(found, ["host", "day"], "left").select("row", "host", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def evaluate(captures: DataFrame, entries: DataFrame, last_day: int) -> DataFrame:
    """Per capture (id, url, day): id, host, n_active, blocked. last_day: of all captures; later days count as that day."""
    return _judged(captures.select("id", "url", "day"), entries, last_day).select("row.id", "host", "n_active", "blocked")


def kept(captures: DataFrame, entries: DataFrame, last_day: int) -> DataFrame:
    """The captures that are not blocked, with all their columns."""
    return _judged(captures, entries, last_day).where("not blocked").select("row.*")


#: DuckDB SQL of the query: the log is replayed for each capture and key.
SQL = rf"""
WITH plain AS (SELECT page_id, regexp_replace(translate(lower(url), chr(9) || chr(10) || chr(13), ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS u FROM pages),
caps AS (SELECT page_id, coalesce(regexp_replace(regexp_extract(regexp_extract(regexp_extract(u, '{AUTHORITY}', 1), '([^@]*)$', 1), '{NAME}', 1), '\.$', ''), '') AS host, CAST(page_id * 7919 % 1460 AS BIGINT) AS day FROM plain),
hosts AS (SELECT DISTINCT host FROM caps WHERE host <> ''),
split_hosts AS (SELECT host, string_split(host, '.') AS ls FROM hosts),
keys AS (SELECT host, u.i - 1 AS above, array_to_string(ls[u.i:], '.') AS key FROM split_hosts, LATERAL (SELECT unnest(range(1, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN 2 ELSE greatest(len(ls), 2) END)) AS i) u),
seeds AS (SELECT key, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS r FROM (SELECT DISTINCT key FROM keys)),
log AS (SELECT key, CASE WHEN r // 7 % 5 = 0 THEN 'allow' ELSE 'block' END AS list, r % 300 + n * (40 + r % 100) AS day, n % 2 = 0 AS added
  FROM seeds, range(0, 12) t(n) WHERE r % 3 = 0),
active AS (SELECT c.page_id, k.above, l.list FROM caps c JOIN keys k ON k.host = c.host
  JOIN log l ON l.key = k.key AND l.day <= c.day AND l.added
  WHERE NOT EXISTS (SELECT 1 FROM log m WHERE m.key = l.key AND m.list = l.list AND m.day > l.day AND m.day <= c.day)),
found AS (SELECT page_id, count(*) AS n_active, min(above) FILTER (WHERE list = 'block') AS b, min(above) FILTER (WHERE list = 'allow') AS a FROM active GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(f.n_active, 0) AS n_active, coalesce(f.b IS NOT NULL AND (f.a IS NULL OR f.a > f.b), false) AS blocked
FROM caps c LEFT JOIN found f ON c.page_id = f.page_id
"""
