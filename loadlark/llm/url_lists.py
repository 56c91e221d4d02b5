"""URL filters: a temporal join of captures with dated list entries.

An entry adds a host (and so all hosts below it) to a list, or removes it, from
a date on. For each list and host the entries in order of their dates are
validity intervals, each ending where the next one begins. A capture has one key
for its host and each parent of it; joined on the key, at most one interval of a
list holds its fetch time, so the as-of join is an equi-join with a range check.
The most specific host decides, and an allow entry wins over a block one of the
same host.

Intervals are as large as the lists, so nothing is broadcast by hand; Spark
broadcasts them if they are small. Before the join only captures' distinct
(host, day of fetch) count, so a host that a third of all captures share meets
its intervals once a day, not once a capture.

A parent such as ``com`` is a key of very many hosts. Keys are counted first, with
partial counts in each task; those of more than ``hot`` hosts and days, and of more
than a hundred thousandth of all, are at most 100,000, so they may be broadcast. Where
the lists don't hold such a key its rows end there, before the shuffle; where they do,
its rows are dealt by host to as many places as it needs, each with the key's intervals.

Defined cases: a null or unparsable URL or a null fetch time matches nothing
(``decision`` ``keep``); a null or empty host or a null date in an entry is ignored; several
entries of one list, host and date count as one, and an add wins; repeated
captures each get a row; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def normal(host: Column) -> Column:
    """A host, of a capture or an entry, in lower case, without a final dot or a leading www; null if nothing is left."""
    host = F.regexp_replace(F.rtrim(F.lower(host), F.lit(".")), r"^www\.", "")
    return F.when(host != "", host)


def host_of(url: Column) -> Column:
    """The normal host of a URL; null if there is none."""
    return normal(F.regexp_extract(url, HOST, 1))


def keys_of(host: Column) -> Column:
    """``array<struct<key, labels>>``: the host and its parents down to one label."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.array_join(F.slice(parts, i, n), ".").alias("key"), (n - i + 1).alias("labels")),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``list, verdict, key, since, until`` (exclusive, null: still valid) of ``entries(list, verdict, host, day, added)``."""
    keyed = entries.withColumn("_key", normal(F.col("host")))
    at = keyed.filter("_key is not null and day is not null and list is not null").groupBy(
        "list", "verdict", F.col("_key").alias("key"), F.to_date("day").alias("since")
    ).agg(F.max(F.coalesce("added", F.lit(True))).alias("added"))
    following = Window.partitionBy("list", "verdict", "key").orderBy("since")
    return at.withColumn("until", F.lead("since").over(following)).filter("added").drop("added")


def decide(captures: DataFrame, entries: DataFrame, hot: int = 1_000_000) -> DataFrame:
    """``page_id, host, fetched, decision, list, matched, since`` of ``captures(page_id, url, fetched)``."""
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.to_date("fetched").alias("fetched"))
    distinct = durable(seen.filter("host is not null and fetched is not null").select("host", "fetched").distinct())
    keyed = distinct.select("host", "fetched", F.explode(keys_of(F.col("host"))).alias("k")).select(
        "host", "fetched", "k.key", "k.labels"
    )
    valid = intervals(entries)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    least = max(hot, (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 100_000)
    listed = valid.select("key").distinct().withColumn("listed", F.lit(True))
    common = durable(
        counts.filter(F.col("n") > least).join(listed, "key", "left")
        .select("key", F.coalesce("listed", F.lit(False)).alias("listed"), F.ceil(F.col("n") / least).cast("int").alias("places"))
    )  # 100,000 keys at most
    places = F.coalesce("places", F.lit(1))
    dealt = (
        keyed.join(F.broadcast(common), "key", "left").filter(F.coalesce("listed", F.lit(True)))
        .select("host", "fetched", "key", "labels", F.pmod(F.xxhash64("host", "fetched"), places).cast("int").alias("place"))
    )
    everywhere = valid.join(F.broadcast(common), "key", "left").withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("listed", "places")
    hit = dealt.join(everywhere, ["key", "place"]).filter("since <= fetched and (until is null or fetched < until)")
    # the most specific key, then allow before block, then the list's name
    best = hit.groupBy("host", "fetched").agg(
        F.min(F.struct((-F.col("labels")).alias("l"), "verdict", "list", "key", "since")).alias("b")
    ).select("host", "fetched", F.col("b.verdict").alias("v"), F.col("b.list").alias("list"), F.col("b.key").alias("matched"), F.col("b.since").alias("since"))
    return seen.join(best, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", F.when(F.col("v") == "block", "drop").otherwise("keep").alias("decision"),
        "list", "matched", "since",
    )


# The query's lists and fetch times. The tables have neither, so both follow from
# digests of hosts and page ids: reproducible, and the same in any SQL.


def _number(text: Column, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus


def sample_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch day in 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.concat(F.lit("fetch"), F.col("page_id").cast("string")), 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Three dated entries for about half of the hosts: two lists of blocks, one of allows; the third entry may remove."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    chosen = hosts.filter(_number(F.concat(F.lit("list"), "host"), 2) == 0)
    rows = chosen.withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    salt = F.concat("host", F.lit("/"), F.col("i").cast("string"))
    kind = _number(F.concat(F.lit("kind"), "host"), 3)
    return rows.select(
        F.when(kind == 0, "malware").when(kind == 1, "adult").otherwise("trusted").alias("list"),
        F.when(kind == 2, "allow").otherwise("block").alias("verdict"),
        "host",
        F.date_add(F.lit("2023-10-01").cast("date"), _number(salt, 400).cast("int")).alias("day"),
        (_number(F.concat(F.lit("add"), salt), 3) != 0).alias("added"),
    )


_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT % {}"
ORACLE = f"""
WITH seen AS (
  SELECT page_id, nullif(regexp_replace(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '^www\\.', ''), '') AS host,
    DATE '2024-01-01' + ({_MD5.format("'fetch' || page_id::VARCHAR", 366)})::INT AS fetched
  FROM pages
),
entries AS (
  SELECT CASE {_MD5.format("'kind' || host", 3)} WHEN 0 THEN 'malware' WHEN 1 THEN 'adult' ELSE 'trusted' END AS list,
    CASE {_MD5.format("'kind' || host", 3)} WHEN 2 THEN 'allow' ELSE 'block' END AS verdict, host AS key,
    DATE '2023-10-01' + ({_MD5.format("host || '/' || i::VARCHAR", 400)})::INT AS since,
    ({_MD5.format("'add' || host || '/' || i::VARCHAR", 3)}) <> 0 AS added
  FROM (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL) h, range(3) r(i)
  WHERE {_MD5.format("'list' || host", 2)} = 0
),
spans AS (
  SELECT *, lead(since) OVER (PARTITION BY list, verdict, key ORDER BY since) AS until
  FROM (SELECT list, verdict, key, since, bool_or(added) AS added FROM entries GROUP BY ALL)
),
hits AS (
  SELECT s.page_id, v.list, v.verdict, v.key, v.since,
    row_number() OVER (PARTITION BY s.page_id ORDER BY len(string_split(v.key, '.')) DESC, v.verdict, v.list, v.key, v.since) AS n
  FROM seen s JOIN spans v ON v.added AND (s.host = v.key OR ends_with(s.host, '.' || v.key))
    AND v.since <= s.fetched AND (v.until IS NULL OR s.fetched < v.until)
)
SELECT s.page_id, s.host, s.fetched, CASE WHEN h.verdict = 'block' THEN 'drop' ELSE 'keep' END AS decision,
  h.list, h.key AS matched, h.since
FROM seen s LEFT JOIN hits h ON h.page_id = s.page_id AND h.n = 1
"""
