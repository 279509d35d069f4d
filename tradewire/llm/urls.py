"""URL filters: a temporal join of captures with dated block and allow lists.

A list is a log: (key, on, action), where a key is a host or a host and its first path segments (`host/a/b`), and the
action is block, allow or remove. An entry holds from its date up to the next entry of its key (several of one date: the
last by action name stands), which turns the log into validity intervals. A capture is evaluated as of its fetch date
against every key it falls under: its host, each parent domain, its host with one, two ... all path segments. Of the
entries active on that date the most specific one decides (a path before a host, a longer one before a shorter one).

Captures are first reduced to distinct (host, path, date). The as-of join is an equi-join on the key with a range
condition on disjoint intervals, one match at most for each key. Keys that many captures fall under, as a top-level
domain, are dealt by a salt on both sides, so no task has them alone. Verdicts go back to the captures with hot keys
apart. All on the JVM.

Defined results: a null, empty or relative URL has no host and verdict `none`; a null date matches nothing; hosts are
lower-cased, without port, user or trailing dot; empty path segments do not count; list rows with a null key, date or
action are no entries; repeated captures give a row each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewire.llm.common import dropped, hot_join, stored

#: The span of made-up dates of the query, in days from its first day.
FIRST_DAY, DAYS = "2024-01-01", 366
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host, '' without one."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$|\.(:[0-9]*)?$", ""))


def segments_of(url: Column) -> Column:
    """The path segments that are not empty."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")


def intervals(log: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): disjoint for each key, valid_to exclusive and null where open."""
    rows = log.filter(F.col("key").isNotNull() & F.col("on").isNotNull() & F.col("action").isNotNull())
    daily = rows.groupBy("key", F.col("on").cast("date").alias("valid_from")).agg(F.max("action").alias("action"))
    valid_to = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return daily.withColumn("valid_to", valid_to).filter(F.col("action") != "remove").select("key", "action", "valid_from", "valid_to")


def salted(asked: DataFrame, spans: DataFrame, total: int, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both with a salt: keys of over a thousandth of `total` rows, so at most `share` of them, are dealt, others have 0."""
    most = max(1000, total // share)
    hot = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("key").alias("hot"), F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot = F.broadcast(stored(hot))
    salts = F.coalesce("salts", F.lit(1))
    left = asked.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("look"), salts).cast("int")).drop("hot", "salts")
    right = spans.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hot", "salts")
    return left, right


def evaluate(captures: DataFrame, log: DataFrame, id_col: str, url_col: str, date_col: str) -> DataFrame:
    """Per capture: id, host, fetched_on, verdict (block, allow, none), matched key, valid_from."""
    log = log.filter(F.col("key").isNotNull())
    rows = captures.select(
        F.col(id_col).alias("id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(F.array_join(segments_of(F.col(url_col)), "/"), F.lit("")).alias("path"), F.col(date_col).cast("date").alias("fetched_on")
    ).withColumn("look", F.concat_ws("|", F.coalesce(F.col("fetched_on").cast("string"), F.lit("")), "host", "path"))
    counts = stored(rows.groupBy("look").agg(F.count(F.lit(1)).alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("fetched_on").alias("fetched_on")))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    # Keys of more labels or segments than any in the list are not asked for, so a very long URL has few keys.
    in_key = F.split("key", "/")
    most_labels, most_segments = (x or 0 for x in log.select(F.size(F.split(in_key[0], r"\.")).alias("l"), (F.size(in_key) - 1).alias("s")).agg(F.max("l"), F.max("s")).first())
    parents = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - max(1, most_labels) + 1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (F.size(labels) - i).alias("depth")))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(max(1, most_segments)))), lambda j: F.struct(F.concat_ws("/", "host", F.array_join(F.slice(segments, F.lit(1), j), "/")).alias("key"), (j + (1 << 20)).alias("depth")))
    keys = F.when(F.col("path") != "", F.concat(paths, parents)).otherwise(parents)
    asked = counts.filter((F.col("host") != "") & F.col("fetched_on").isNotNull()).select("look", "fetched_on", F.inline(keys))
    left, right = salted(asked, intervals(log), counts.count())
    right = right.withColumnRenamed("key", "matched").withColumnRenamed("salt", "of_salt")
    active = left.join(right, (F.col("key") == F.col("matched")) & (F.col("salt") == F.col("of_salt")) & (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    verdict = stored(active.groupBy("look").agg(F.max_by(F.struct("action", "matched", "valid_from"), "depth").alias("v")))
    hot = stored(counts.select("look", "n").filter(F.col("n") > 1000))  # what hot_join can ask for
    dropped(counts)
    out = hot_join(rows, verdict, "look", hot, captures.count())
    return out.select("id", "host", "fetched_on", F.coalesce("v.action", F.lit("none")).alias("verdict"), F.col("v.matched").alias("matched"), F.col("v.valid_from").alias("valid_from"))


def hashed(x: Column, at: int) -> Column:
    """16 bits of the MD5 of a text, from hex digit `at` (1-based)."""
    return F.conv(F.substring(F.md5(x), at, 4), 16, 10).cast("int")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a date its URL's digest gives, against a log that digests give too.

    Keys are hosts and their parents, each blocked on one date and removed or allowed on a later one; hosts with one and
    with two path segments, of which two thirds have entries; and for each host one of another domain, which nothing
    falls under.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), hashed(F.col("url"), 1) % DAYS)
    captures = pages.withColumn("fetched_on", day)
    hosts = pages.select(host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("s")).select("host", F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("s1"), F.coalesce(F.get("s", F.lit(1)), F.lit("")).alias("s2")).distinct()
    first = F.date_add(F.lit(FIRST_DAY).cast("date"), hashed(F.col("key"), 1) % 180)
    again = F.date_add(first, 1 + hashed(F.col("key"), 5) % 180)
    of = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    made = F.array(of(F.col("host"), 0), of(F.regexp_replace("host", r"^[^.]*\.", ""), 1), of(F.concat_ws("/", "host", "s1"), 2), of(F.concat_ws("/", "host", "s1", "s2"), 2), of(F.concat(F.md5("host"), F.lit(".invalid")), 0))
    keys = hosts.select(F.inline(made)).distinct()
    pick = hashed(F.col("key"), 9) % 3
    log = keys.filter((F.col("kind") < 2) | (pick < 2)).select("key", F.explode(F.array(
        F.struct(first.alias("on"), F.when((F.col("kind") == 2) & (pick == 0), "allow").otherwise("block").alias("action")),
        F.struct(again.alias("on"), F.when(pick == 1, "remove").otherwise("allow").alias("action")),
    )).alias("e")).select("key", "e.on", "e.action")
    return evaluate(captures, log, "page_id", "url", "fetched_on").withColumnRenamed("id", "page_id")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$|\.(:[0-9]*)?$', '', 'g')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s,
         (DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 4))::INTEGER % 366)::INTEGER)::DATE AS fetched_on
  FROM pages
), keys AS (
  SELECT DISTINCT key, kind FROM (
    SELECT host AS key, 0 AS kind FROM p UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 1 FROM p
    UNION ALL SELECT host || '/' || coalesce(s[1], ''), 2 FROM p UNION ALL SELECT host || '/' || coalesce(s[1], '') || '/' || coalesce(s[2], ''), 2 FROM p
    UNION ALL SELECT md5(host) || '.invalid', 0 FROM p)
), picked AS (
  SELECT key, kind, ('0x' || substr(md5(key), 9, 4))::INTEGER % 3 AS pick,
         (DATE '2024-01-01' + (('0x' || substr(md5(key), 1, 4))::INTEGER % 180)::INTEGER)::DATE AS first_on,
         1 + ('0x' || substr(md5(key), 5, 4))::INTEGER % 180 AS gap FROM keys
), log AS (
  SELECT key, first_on AS on_, CASE WHEN kind = 2 AND pick = 0 THEN 'allow' ELSE 'block' END AS action FROM picked WHERE kind < 2 OR pick < 2
  UNION ALL
  SELECT key, (first_on + gap::INTEGER)::DATE, CASE WHEN pick = 1 THEN 'remove' ELSE 'allow' END FROM picked WHERE kind < 2 OR pick < 2
), daily AS (SELECT key, on_, max(action) AS action FROM log GROUP BY key, on_
), spans AS (SELECT key, action, on_ AS valid_from, lead(on_) OVER (PARTITION BY key ORDER BY on_) AS valid_to FROM daily
), asked AS (
  SELECT page_id, fetched_on, array_to_string(string_split(host, '.')[i:], '.') AS key, len(string_split(host, '.')) - i AS depth
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION ALL SELECT page_id, fetched_on, host || '/' || array_to_string(s[:j], '/'), 1000000 + j FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM p WHERE host <> '')
), best AS (
  SELECT a.page_id, arg_max(s.action, a.depth) AS verdict, arg_max(a.key, a.depth) AS matched, arg_max(s.valid_from, a.depth) AS valid_from
  FROM asked a JOIN spans s ON a.key = s.key AND s.valid_from <= a.fetched_on AND (s.valid_to IS NULL OR a.fetched_on < s.valid_to)
  WHERE s.action <> 'remove' GROUP BY a.page_id
)
SELECT p.page_id, p.host, p.fetched_on, coalesce(b.verdict, 'none') AS verdict, b.matched, b.valid_from FROM p LEFT JOIN best b USING (page_id)
"""
