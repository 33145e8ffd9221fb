"""URL filters with dated lists: entries become validity intervals, and an as-of join asks each capture.

A list is a log of dated events (kind, pattern, action, listed_at): ``add`` opens an entry, ``remove`` closes it; of
several events of one entry at one time the removal counts. Consecutive events of an entry give its intervals
[valid_from, valid_to). Kinds: ``domain`` (the host or any domain above it), ``host`` (that host alone) and
``prefix`` (host and leading path). A capture (url, fetched_at) is blocked if an entry of its host, of a domain above
it or of a prefix of its path is valid at fetched_at.

A capture has a key for its host, for each domain above it (from one label on) and for each leading path, but no
deeper than the deepest entry of the list, so that a very long url makes no more keys than an entry could match.
Each key meets at most the intervals that touch the capture's month: intervals are repeated for each month they touch, up to the last month that any capture has, so the join is on (key, month) with a range
check inside. The list side is broadcast if counted small; else keys are shuffled by (key, month), where a hot host
spreads over months and skewed partitions are split.

Defined cases: urls are parsed as scheme://[user@]host[:port][/path][?query][#fragment], hosts and schemes
lower-cased; a null or unparsable url has no keys and is not blocked; a null fetch time is not blocked; list events
with nulls are ignored; repeated captures are answered each; an empty list blocks nothing; captures keep their other
columns, whatever their names, but for columns named like the answer's (n_entries, first_entry, listed_from), which
the answer replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, free, plain

_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """kind, pattern, valid_from, valid_to (null: still open)."""
    e = events.where("kind is not null and pattern is not null and action in ('add', 'remove') and listed_at is not null")
    e = e.groupBy("kind", "pattern", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "pattern").orderBy("listed_at")
    e = e.withColumn("before", F.lag("action").over(w)).where("before is null and action = 'add' or before <> action")
    e = e.withColumn("valid_to", F.lead("listed_at").over(w)).where("action = 'add'")
    return e.select("kind", "pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def url_parts(url: Column) -> tuple[Column, Column]:
    return F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def depth_of(kind: Column, pattern: Column) -> Column:
    """Labels of a domain entry, path segments of a prefix entry: how deep a url's keys have to go."""
    segments = F.size(F.filter(F.split(pattern, "/"), lambda x: x != "")) - 1
    return F.when(kind == "domain", F.size(F.split(pattern, r"\."))).when(kind == "prefix", segments).otherwise(0)


def keys_of(url: Column, labels_most: int, segments_most: int) -> Column:
    """Array of keys 'kind:pattern' that an entry of at most these depths may have to block the url."""
    host, path = url_parts(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    none = F.array().cast("array<string>")

    def domain(k):
        return F.concat(F.lit("domain:"), F.array_join(F.slice(labels, n - k + 1, k), "."))

    def prefix(k):
        return F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))

    segments = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, max(1, segments_most))
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels_most))), domain) if labels_most > 0 else none
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(segments_most))), prefix) if segments_most >= 0 else none
    keys = F.concat(domains, F.array(F.concat(F.lit("host:"), host)), prefixes)
    return F.when(url.isNotNull() & (host != ""), F.array_distinct(keys)).otherwise(none)


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


ANSWER = ("n_entries", "first_entry", "listed_from")


def blocked(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (id, url, fetched_at) with n_entries, first_entry (least key), listed_from of the valid entries."""
    scratch = Scratch(captures.sparkSession, "url-filters")
    captures = captures.select(*plain([c for c in captures.columns if c.lower() not in ANSWER]))
    spans = scratch.write(intervals(events).withColumn("key", F.concat_ws(":", "kind", "pattern")), "intervals")
    depth = depth_of(F.col("kind"), F.col("pattern"))
    deep = spans.agg(*[F.max(F.when(F.col("kind") == k, depth)).alias(k) for k in ("domain", "prefix")]).first()
    bounds = captures.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    if bounds["lo"] is None:
        spans = spans.where("false")
        lo = hi = F.lit(0)
    else:
        lo, hi = _month(F.lit(bounds["lo"])), _month(F.lit(bounds["hi"]))
    begin, end = F.greatest(_month(F.col("valid_from")), lo), F.least(F.coalesce(_month(F.col("valid_to")), hi), hi)
    months = spans.where(begin <= end).select("key", "valid_from", "valid_to", F.explode(F.sequence(begin, end)).alias("month"))
    months = scratch.write(months, "months")
    asked = captures.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct()
    asked = asked.select("url", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(keys_of(F.col("url"), deep["domain"] or 0, -1 if deep["prefix"] is None else deep["prefix"])).alias("key"))
    met = asked.join(bounded(months, months.count()), ["key", "month"]).where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    found = met.groupBy("url", "fetched_at").agg(F.count("*").alias("n_entries"), F.min("key").alias("first_entry"), F.max("valid_from").alias("listed_from"))
    url, at = free(captures, "asked_url", "asked_at")
    found = found.withColumnsRenamed({"url": url, "fetched_at": at})
    both = captures.join(found, (F.col("url") == F.col(url)) & (F.col("fetched_at") == F.col(at)), "left")
    return both.select(*plain(captures), *ANSWER)


#: The first day of the capture calendar, and the length of its cycle in days.
CALENDAR, CYCLE = "2024-01-01", 366


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: the calendar gives each one by its identifier."""
    at = F.expr(f"timestamp_ntz'{CALENDAR} 00:00:00'") + F.make_dt_interval(F.pmod(F.col("page_id") * 37, F.lit(CYCLE)).cast("int"), F.pmod(F.col("page_id"), F.lit(24)).cast("int"))
    return pages.select("page_id", "url", at.alias("fetched_at"))


def events_of(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts and paths, by rules on the bytes of the pattern.

    A pattern's number is the first seven hexadecimal digits of its MD5. Every host whose number is divisible by 5 is
    added and (if by 10) removed 90 days later; every domain of two labels whose number is divisible by 3 is added,
    removed after 30 days and added again after 200; every host and first path segment whose number is divisible by 7
    is added. The day of the first event is the number modulo 180.
    """
    host, path = url_parts(F.col("url"))
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(1))
    parts = pages.where("url is not null").select(host.alias("host"), segment.alias("segment")).where("host <> ''").distinct()
    day = F.expr(f"timestamp_ntz'{CALENDAR} 00:00:00'")

    def log(kind: str, pattern: Column, every: int, *steps: tuple[str, int, int]) -> DataFrame:
        number = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("long")
        base = parts.select(pattern.alias("pattern")).where("pattern is not null").distinct().withColumn("c", number).where(F.col("c") % every == 0)
        out = None
        for action, after, only in steps:
            at = day + F.make_dt_interval((F.col("c") % 180 + after).cast("int"))
            one = base.where(F.col("c") % only == 0).select(F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), at.alias("listed_at"))
            out = one if out is None else out.unionByName(one)
        return out

    domain = F.when(F.size(F.split("host", r"\.")) >= 2, F.array_join(F.slice(F.split("host", r"\."), -2, 2), "."))
    hosts = log("host", F.col("host"), 5, ("add", 0, 1), ("remove", 90, 10))
    domains = log("domain", domain, 3, ("add", 0, 1), ("remove", 30, 1), ("add", 200, 1))
    prefixes = log("prefix", F.when(F.col("segment").isNotNull(), F.concat_ws("/", "host", "segment")), 7, ("add", 0, 1))
    return hosts.unionByName(domains).unionByName(prefixes)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = blocked(captures_of(pages), events_of(pages))
    return out.select("page_id", "url", "fetched_at", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "first_entry", "listed_from")


OP10_SQL = r"""
WITH cap AS (
  SELECT page_id, url,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(((page_id * 37) % 366)::INTEGER) + to_hours((page_id % 24)::INTEGER) AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda x: x <> '') AS segs
  FROM pages),
parts AS (SELECT DISTINCT host, segs[1] AS segment, string_split(host, '.') AS labels FROM cap WHERE url IS NOT NULL AND host <> ''),
pats AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM parts
  UNION SELECT DISTINCT 'domain', labels[-2] || '.' || labels[-1] FROM parts WHERE len(labels) >= 2
  UNION SELECT DISTINCT 'prefix', host || '/' || segment FROM parts WHERE segment IS NOT NULL),
num AS (SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS c FROM pats),
steps(kind, every_, action, after, only_) AS (VALUES
  ('host', 5, 'add', 0, 1), ('host', 5, 'remove', 90, 10), ('domain', 3, 'add', 0, 1), ('domain', 3, 'remove', 30, 1),
  ('domain', 3, 'add', 200, 1), ('prefix', 7, 'add', 0, 1)),
ev AS (
  SELECT kind, pattern, TIMESTAMP '2024-01-01 00:00:00' + to_days((c % 180 + after)::INTEGER) AS listed_at, max(action) AS action
  FROM num JOIN steps USING (kind) WHERE c % every_ = 0 AND c % only_ = 0 GROUP BY ALL),
chg AS (
  SELECT *, lag(action) OVER (PARTITION BY kind, pattern ORDER BY listed_at) AS before FROM ev),
iv AS (
  SELECT kind, pattern, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY kind, pattern ORDER BY listed_at) AS valid_to
  FROM chg WHERE (before IS NULL AND action = 'add') OR before <> action),
keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(
    list_concat(
      list_transform(generate_series(1, len(string_split(host, '.'))), lambda k: 'domain:' || array_to_string(string_split(host, '.')[len(string_split(host, '.')) - k + 1:], '.')),
      ['host:' || host],
      list_transform(generate_series(0, len(segs)), lambda k: 'prefix:' || host || '/' || array_to_string(segs[1:k], '/'))))) AS key
  FROM cap WHERE url IS NOT NULL AND host <> ''),
met AS (
  SELECT page_id, count(*) AS n_entries, min(key) AS first_entry, max(valid_from) AS listed_from
  FROM keys JOIN iv ON key = kind || ':' || pattern AND action = 'add' AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
  GROUP BY page_id)
SELECT page_id, url, fetched_at, coalesce(n_entries, 0) AS n_entries, first_entry, listed_from
FROM cap LEFT JOIN met USING (page_id)
"""
