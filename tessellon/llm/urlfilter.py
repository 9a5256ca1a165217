"""URL filters as a temporal list join (DataFrame functions only).

List entries are dated: (list_name, kind, pattern, action, since). An entry holds from its date until the next entry of
the same list, kind and pattern; ``remove`` ends it. A capture is judged by the entries in force at its fetch time.

Kinds: ``domain`` (the host and all hosts below it), ``host`` (that host alone), ``prefix`` (host and leading path
segments). Each capture is spread over the keys that could match it (no more labels and segments than the list's own
longest patterns have), joined to the intervals by equal key with the fetch time inside, and the most specific entry
decides: the longer prefix, then host, then the longer domain; at a tie block goes before allow, then the list's name.
The join is by key, so Spark broadcasts the intervals when they are small and splits hot hosts when they aren't.
Verdicts are worked out once for each URL and time and joined back by both, so they don't depend on how captures
are stored or dealt out.

Matching: schemes, user names, ports, queries and fragments don't count; hosts are compared in lower case without dots at
their end; a bracketed IPv6 address is one label, so it matches host and prefix entries only; paths are compared as they
are spelt, in upper and lower case and with their percent-encoding, without empty segments.

Defined results: a null or unreadable URL matches nothing; a null fetch time matches nothing; no match means not
blocked; entries with a null field, and of entries of the same moment all but the one whose action sorts last, are left
out; repeated captures are judged one by one; very long URLs are read whole; an empty table gives an empty table, an
empty list blocks nothing; extra columns are ignored.

The query: pages have no fetch time and there is no list, so both are made by rule. Page n is fetched on day n mod 365 of
2023. Each domain, host and leading path of the pages' URLs is on each of three lists by an eighth, from a day and to a
day that its MD5 gives; every second entry comes back later. The list trusted allows, the others block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise

ENTRY_SCHEMA = "list_name string, kind string, pattern string, action string, since timestamp_ntz"
LISTS = ("review", "spam", "trusted")
CRAWL_START, CRAWL_DAYS = "2023-01-01", 365


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, kind, pattern, action, valid_from, valid_to (null: still in force) of the entries that block or allow."""
    rows = entries.where(" and ".join(f"{c} is not null" for c in ("list_name", "kind", "pattern", "action", "since"))).groupBy("list_name", "kind", _pattern().alias("pattern"), "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("list_name", "kind", "pattern").orderBy("since"))
    return rows.withColumn("valid_to", until).where(F.col("action") != "remove").select("list_name", "kind", "pattern", "action", F.col("since").alias("valid_from"), "valid_to")


def _pattern():
    """An entry's pattern in the form that captures are spread to: its host in lower case without dots at the end."""
    parts = F.filter(F.split("pattern", "/"), lambda x: x != "")
    host = F.regexp_replace(F.lower(F.substring_index("pattern", "/", 1)), r"\.+$", "")
    return F.array_join(F.concat(F.array(host), F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))), "/")


def _place(url):
    """Host and path segments of a URL column."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)), r"\.+$", "")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, F.filter(F.split(path, "/"), lambda s: s != "")


def _best(seen: DataFrame, valid: DataFrame) -> DataFrame:
    """url, t, best: the deciding entry of each of seen (distinct url, t) that any entry matches."""
    longest = valid.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("labels"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("segments")).first()
    labels, segments = longest["labels"] or 0, longest["segments"] if longest["segments"] is not None else -1
    host, path = _place(F.col("url"))
    rows = seen.withColumns({"host": host, "path": path}).where("host <> ''").withColumn("label", F.when(~F.col("host").startswith("["), F.split("host", r"\.")).otherwise(F.array().cast("array<string>")))
    upto = lambda lo, n: F.when(n >= lo, F.sequence(F.lit(lo), n)).otherwise(F.array().cast("array<int>"))
    domain = F.transform(upto(1, F.least(F.size("label"), F.lit(labels))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("label", F.size("label") - i + 1, i), ".").alias("pattern")))
    prefix = F.transform(upto(0, F.least(F.size("path"), F.lit(segments))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.concat(F.array("host"), F.slice("path", F.lit(1), i)), "/").alias("pattern")))
    one = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    spread = rows.select("url", "t", F.explode(F.concat(one, domain, prefix)).alias("key")).select("url", "t", "key.kind", "key.pattern")
    hit = spread.join(valid, ["kind", "pattern"]).where("valid_from <= t and (valid_to is null or t < valid_to)")
    rank = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    weight = F.struct(rank.alias("rank"), F.length("pattern").alias("len"), (F.col("action") == "block").alias("block"), F.col("list_name"), F.col("kind"), F.col("pattern"))
    return hit.groupBy("url", "t").agg(F.max(weight).alias("best"))


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """The id, URL and fetch time of each capture, blocked, and what decided: list_name, kind, pattern (null: nothing)."""
    valid = materialise(intervals(entries), "url-intervals")  # its size is known from here on, and decides how it is joined
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp_ntz").alias("t"))
    best = materialise(_best(rows.where("url is not null and t is not null").select("url", "t").distinct(), valid), "url-verdicts")
    return rows.join(best, ["url", "t"], "left").select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t").alias(time_col), F.coalesce("best.block", F.lit(False)).alias("blocked"), "best.list_name", "best.kind", "best.pattern")


def keep(captures: DataFrame, entries: DataFrame, **columns) -> DataFrame:
    """The captures that are not blocked."""
    return verdicts(captures, entries, **columns).where(~F.col("blocked"))


def listed(pages: DataFrame) -> DataFrame:
    """The query's dated entries, made by rule from the URLs of pages (see above)."""
    host, path = _place(F.col("url"))
    upto = lambda i: F.array_join(F.concat(F.array("host"), F.slice("path", 1, i)), "/")
    at = pages.where("url is not null").select(host.alias("host"), path.alias("path")).where("host <> ''")
    keys = F.array(
        F.struct(F.lit("domain").alias("kind"), F.substring_index("host", ".", -3).alias("pattern")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")),
        *(F.when(F.size("path") >= i, F.struct(F.lit("prefix").alias("kind"), upto(i).alias("pattern"))) for i in (1, 2)),
    )
    own = at.select(F.explode(keys).alias("k")).where("k is not null").select("k.*").distinct()
    n = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "pattern", "list_name").cast("binary")), 1, 8), 16, 10).cast("bigint")
    own = own.withColumn("list_name", F.explode(F.array(*map(F.lit, LISTS)))).withColumn("n", n).where("n % 8 = 0").withColumn("n", F.floor(F.col("n") / 8))
    does = F.when(F.col("list_name") == "trusted", "allow").otherwise("block")
    from_day = F.col("n") % CRAWL_DAYS
    to_day = from_day + 30 + F.floor(F.col("n") / CRAWL_DAYS) % 97
    dated = lambda day, action: F.struct(action.alias("action"), (F.lit(CRAWL_START).cast("timestamp_ntz") + F.make_dt_interval(day.cast("int"))).alias("since"))
    steps = F.array(dated(from_day, does), dated(to_day, F.lit("remove")), F.when(F.col("n") % 2 == 0, dated(to_day + 40, does)))
    return own.select("list_name", "kind", "pattern", F.explode(steps).alias("s")).where("s is not null").select("list_name", "kind", "pattern", "s.action", "s.since")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", (F.lit(CRAWL_START).cast("timestamp_ntz") + F.make_dt_interval(F.pmod("page_id", F.lit(CRAWL_DAYS)).cast("int"))).alias("fetch_time"))
    return verdicts(captures, listed(pages))


ORACLE = rf"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '{CRAWL_START} 00:00:00' + to_days(CAST(page_id % {CRAWL_DAYS} AS INTEGER)) AS fetch_time,
         regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 2)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages
), keys AS (
  SELECT DISTINCT kind, pattern FROM (
    SELECT 'domain' AS kind, regexp_extract(host, '([^.]*\.){{0,2}}[^.]*$') AS pattern FROM captures WHERE host <> ''
    UNION ALL SELECT 'host', host FROM captures WHERE host <> ''
    UNION ALL SELECT 'prefix', host || '/' || segs[1] FROM captures WHERE host <> '' AND len(segs) >= 1
    UNION ALL SELECT 'prefix', host || '/' || segs[1] || '/' || segs[2] FROM captures WHERE host <> '' AND len(segs) >= 2)
), named AS (
  SELECT kind, pattern, list_name, ('0x' || substr(md5(kind || '|' || pattern || '|' || list_name), 1, 8))::BIGINT AS h
  FROM keys, (VALUES {", ".join(f"('{x}')" for x in LISTS)}) t(list_name)
), numbered AS (
  SELECT kind, pattern, list_name, h // 8 AS n, (h // 8) % {CRAWL_DAYS} AS from_day, (h // 8) % {CRAWL_DAYS} + 30 + ((h // 8) // {CRAWL_DAYS}) % 97 AS to_day,
         CASE WHEN list_name = 'trusted' THEN 'allow' ELSE 'block' END AS does FROM named WHERE h % 8 = 0
), entries AS (
  SELECT list_name, kind, pattern, does AS action, from_day AS day FROM numbered
  UNION ALL SELECT list_name, kind, pattern, 'remove', to_day FROM numbered
  UNION ALL SELECT list_name, kind, pattern, does, to_day + 40 FROM numbered WHERE n % 2 = 0
), valid AS (
  SELECT *, TIMESTAMP '{CRAWL_START} 00:00:00' + to_days(CAST(day AS INTEGER)) AS since,
         TIMESTAMP '{CRAWL_START} 00:00:00' + to_days(CAST(lead(day) OVER (PARTITION BY list_name, kind, pattern ORDER BY day) AS INTEGER)) AS valid_to FROM entries
), could AS (
  SELECT page_id, url, fetch_time, 'host' AS kind, host AS pattern FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, url, fetch_time, 'domain', array_to_string(list_slice(string_split(host, '.'), -i, -1), '.') FROM captures, generate_series(1, 3) t(i) WHERE host <> '' AND i <= len(string_split(host, '.'))
  UNION ALL SELECT page_id, url, fetch_time, 'prefix', array_to_string(list_concat([host], segs[1:i]), '/') FROM captures, generate_series(0, 2) t(i) WHERE host <> '' AND i <= len(segs)
), hits AS (
  SELECT c.page_id, c.url, c.fetch_time, v.list_name, v.kind, v.pattern, v.action = 'block' AS block,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetch_time ORDER BY CASE v.kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC,
                            length(v.pattern) DESC, v.action = 'block' DESC, v.list_name DESC) AS i
  FROM could c JOIN valid v ON v.kind = c.kind AND v.pattern = c.pattern AND v.action <> 'remove' AND v.since <= c.fetch_time AND (v.valid_to IS NULL OR c.fetch_time < v.valid_to)
)
SELECT c.page_id, c.url, c.fetch_time, coalesce(h.block, false) AS blocked, h.list_name, h.kind, h.pattern
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.url = c.url AND h.fetch_time = c.fetch_time AND h.i = 1"""
