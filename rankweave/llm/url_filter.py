"""URL filter by a temporal list join.

A list entry (domain, effective_on, action) holds from its date until the next entry of the same
domain: entries become validity intervals [valid_from, valid_to). A capture is looked up under its
host and every parent domain; at each level the interval that holds the day of the fetch is found as
of that day. The most specific one decides.

The as-of join runs over the distinct (domain, day) that captures ask for: they are laid among the
intervals of the domain by day, and each takes the last interval begun. A domain has at most one
question and one interval a day, so its group is bounded by the calendar however many captures it has.
Answers go back to the distinct (host, day) and from there to the captures by equi-joins, whose large
keys adaptive execution splits. Nothing is broadcast by hand.

Defined cases: a null or malformed URL has no host and is kept with action `none`; a null fetch
date finds no entry. An address (IPv4, or IPv6 in brackets) has no parents. Two entries of one domain
on one day: `block` wins over `allow`. Entries with a null domain or date are ignored. Repeated
captures are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to, action): valid_to is null where nothing follows."""
    clean = entries.where("domain IS NOT NULL AND effective_on IS NOT NULL")
    daily = clean.groupBy(F.lower("domain").alias("domain"), F.col("effective_on").alias("valid_from")).agg(F.max("action").alias("action"))
    return daily.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from")))


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked (domain, fetched_on), distinct -> those with an interval that holds the day, with its since and action."""
    rule = F.struct("valid_from", "valid_to", "action")
    begun = spans.select("domain", F.col("valid_from").alias("day"), F.lit(0).alias("asks"), rule.alias("rule"))
    line = begun.unionByName(asked.select("domain", F.col("fetched_on").alias("day"), F.lit(1).alias("asks")), allowMissingColumns=True)
    latest = F.last("rule", ignorenulls=True).over(Window.partitionBy("domain").orderBy("day", "asks"))
    found = line.withColumn("rule", latest).where("asks = 1 AND rule IS NOT NULL AND (rule.valid_to IS NULL OR day < rule.valid_to)")
    return found.select("domain", F.col("day").alias("fetched_on"), F.col("rule.valid_from").alias("since"), F.col("rule.action").alias("action"))


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", default: str = "none") -> DataFrame:
    """captures (key, url, fetched_on) -> key, url, host, fetched_on, rule_domain, rule_since, action, kept."""
    levels = F.expr("transform(sequence(1, greatest(size(labels) - 1, 1)), i -> struct(i AS level, array_join(slice(labels, i, size(labels)), '.') AS domain))")
    labels = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.split("host", r"\."))
    rows = captures.select(F.col(key).alias("key"), "url", host_of(F.col("url")).alias("host"), "fetched_on")
    hosts = rows.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    asked = hosts.withColumn("labels", labels).select("host", "fetched_on", F.explode(levels).alias("at")).select("host", "fetched_on", "at.level", "at.domain")
    hits = asked.join(as_of(asked.select("domain", "fetched_on").distinct(), intervals(entries)), ["domain", "fetched_on"])
    best = hits.groupBy("host", "fetched_on").agg(F.min(F.struct("level", "domain", "since", "action")).alias("rule"))
    action = F.coalesce("rule.action", F.lit(default))
    return rows.join(best, ["host", "fetched_on"], "left").select(
        F.col("key").alias(key), "url", "host", "fetched_on", F.col("rule.domain").alias("rule_domain"), F.col("rule.since").alias("rule_since"), action.alias("action"), (action != "block").alias("kept")
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch date; a digest of the URL gives one in 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _digit(F.col("url"), 1, 360)).alias("fetched_on"))


def _digit(c: Column, at: int, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c.cast("binary")), at, 4), 16, 10).cast("int"), F.lit(modulus))


def dated_list(pages: DataFrame) -> DataFrame:
    """The dated list of the query, derived by rule for every host and its registered domain: of
    each three domains one is blocked and later allowed again, one is allowed, one is unlisted."""
    host = pages.select(host_of(F.col("url")).alias("domain")).where("domain IS NOT NULL")
    parent = host.select(F.substring_index("domain", ".", -2).alias("domain"))
    domains = host.union(parent).distinct().withColumn("kind", _digit(F.col("domain"), 1, 3))
    start = F.lit("2024-01-01").cast("date")
    first = domains.where("kind < 2").select(
        "domain", F.date_add(start, _digit(F.col("domain"), 5, 180)).alias("effective_on"), F.when(F.col("kind") == 0, F.lit("block")).otherwise(F.lit("allow")).alias("action")
    )
    second = domains.where("kind = 0").select("domain", F.date_add(start, 180 + _digit(F.col("domain"), 9, 180)).alias("effective_on"), F.lit("allow").alias("action"))
    return first.union(second)


SQL = r"""
WITH captures AS (
  SELECT page_id, url,
         nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 4))::INT % 360) AS fetched_on
  FROM pages),
domains AS (
  SELECT DISTINCT domain, ('0x' || substr(md5(domain), 1, 4))::INT % 3 AS kind FROM (
    SELECT host AS domain FROM captures WHERE host IS NOT NULL
    UNION ALL SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') FROM captures WHERE host IS NOT NULL)),
entries AS (
  SELECT domain, DATE '2024-01-01' + (('0x' || substr(md5(domain), 5, 4))::INT % 180) AS since,
         CASE WHEN kind = 0 THEN 'block' ELSE 'allow' END AS action FROM domains WHERE kind < 2
  UNION ALL
  SELECT domain, DATE '2024-01-01' + (180 + ('0x' || substr(md5(domain), 9, 4))::INT % 180), 'allow' FROM domains WHERE kind = 0),
daily AS (SELECT domain, since, max(action) AS action FROM entries GROUP BY ALL),
asked AS (
  SELECT page_id, url, fetched_on, level, array_to_string(list_slice(string_split(host, '.'), level, len(string_split(host, '.'))), '.') AS domain
  FROM (SELECT *, unnest(range(1, CASE WHEN regexp_matches(host, '^(\d{1,3}(\.\d{1,3}){3}|\[.*)$') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END)) AS level FROM captures WHERE host IS NOT NULL)),
hits AS (
  SELECT a.page_id, a.url, a.level, d.domain, d.since, d.action
  FROM asked a ASOF JOIN daily d ON a.domain = d.domain AND a.fetched_on >= d.since),
best AS (SELECT page_id, url, arg_min(domain, level) AS rule_domain, arg_min(since, level) AS rule_since, arg_min(action, level) AS action FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, c.host, c.fetched_on, b.rule_domain, b.rule_since, coalesce(b.action, 'none') AS action, coalesce(b.action, 'none') <> 'block' AS kept
FROM captures c LEFT JOIN best b USING (page_id, url)
"""
