"""Temporal list join: captures are judged by the list entries that were active when they were fetched.

Dated entries (added or removed) of a host, domain or URL prefix become validity intervals. A capture
asks for its URL's host, every parent domain and every path prefix, as far as the list's longest entries
reach; an equi join on that key with the capture's time inside the interval is the as-of join. Keys that
no entry has, such as those of large top-level domains, are dropped before it. Of several active entries
the most specific one decides, then the latest, then a block before an allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bitmap_filter, positive_hash, probe_filter

#: Rank of an exact host; parent domains rank by their labels below it, prefixes by their segments above.
HOST_RANK = 1 << 20
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
_PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The lowered host without a trailing dot; empty for what isn't a URL."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def lookup_keys(host: Column, segments: Column, labels_asked: int, segments_asked: int) -> Column:
    """Distinct keys with their rank: the host's parent domains, the host, then ever longer prefixes."""
    labels, none = F.split(host, "\\."), F.array().cast("array<struct<key:string,rank:int>>")
    count, deep = F.least(F.size(labels), F.lit(labels_asked)), F.least(F.size(segments), F.lit(segments_asked))
    domains = F.transform(
        F.sequence(F.lit(1), count),
        lambda k: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")).alias("key"), k.alias("rank")),
    )
    exact = F.array(F.struct(F.concat(F.lit("h:"), host).alias("key"), F.lit(HOST_RANK).alias("rank")))
    prefixes = F.transform(
        F.sequence(F.lit(1), deep),
        lambda k: F.struct(F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")).alias("key"), (k + HOST_RANK).alias("rank")),
    )
    asked = F.concat(F.when(count > 0, domains).otherwise(none), exact, F.when(deep > 0, prefixes).otherwise(none))
    return F.when(host == "", none).otherwise(asked)


def entry_key(kind: Column, pattern: Column) -> Column:
    """The key of an entry: kind is ``host``, ``domain`` or ``prefix`` (host and path)."""
    clean = F.rtrim(F.regexp_replace(F.trim(pattern), r"^\.+", ""), F.lit("/."))
    host, path = F.lower(F.split_part(clean, F.lit("/"), F.lit(1))), _segments(clean)
    rest = F.when(F.size(path) > 1, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(kind == "host", F.concat(F.lit("h:"), host))
        .when(kind == "domain", F.concat(F.lit("d:"), host))
        .when(kind == "prefix", F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(rest, "/")))
    )


def validity(entries: DataFrame) -> DataFrame:
    """key, verdict, category, since, until of dated entries (kind, pattern, action, verdict, category, day).

    An ``add`` holds until the key's next entry of the same list side (verdict), a ``remove`` ends it.
    Of entries on one day the removal counts last. Entries with a null day, kind or pattern are left out.
    """
    order = Window.partitionBy("key", "verdict").orderBy("day", F.col("action") == "remove", "category")
    return (
        entries.select(entry_key(F.col("kind"), F.col("pattern")).alias("key"), "verdict", "category", "action", F.col("day").alias("since"), "day")
        .where("key IS NOT NULL AND day IS NOT NULL")
        .withColumn("until", F.lead("day").over(order))
        .where("action = 'add' AND (until IS NULL OR until > since)")
        .select("key", "verdict", "category", "since", "until")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a row of ``captures`` (capture_id, url, fetched): the verdict, the entry's key, category and start.

    Without an active entry the verdict is ``none``; so it is for null or unreadable URLs and null
    times. A bitmap of the list's keys, of bounded size, drops keys that no entry has; the others are
    joined with the entries' intervals by a sort-merge join, which Spark splits where a host has very
    many captures; a capture's matches are then reduced by partial aggregation. Repeated rows are judged
    each; an empty list or table is fine.
    """
    intervals = validity(entries)
    key = F.col("key")
    longest = intervals.agg(
        F.max(F.when(key.startswith("d:"), F.size(F.split(key, "\\.")))).alias("labels"),
        F.max(F.when(key.startswith("p:"), F.size(F.split(key, "/")) - 1)).alias("segments"),
    ).first()
    marked = captures.select("capture_id", "url", "fetched", F.monotonically_increasing_id().alias("row"))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), _PATH, 1)
    parsed = marked.select("capture_id", "row", "fetched", host_of(F.col("url")).alias("host"), _segments(path).alias("segments"))
    itself = F.array(F.struct(F.concat(F.lit("#"), F.col("row")).alias("key"), F.lit(0).alias("rank")))
    keys = F.concat(itself, lookup_keys(F.col("host"), F.col("segments"), longest["labels"] or 0, longest["segments"] or 0))
    asked = parsed.withColumn("k", F.explode(keys)).select("capture_id", "row", "host", "fetched", "k.key", "k.rank")
    asked = probe_filter(asked, bitmap_filter(intervals, positive_hash("key")), positive_hash("key")).where("maybe OR rank = 0").drop("maybe")
    active = (asked["key"] == F.col("i.key")) & (F.col("i.since") <= asked["fetched"]) & (F.col("i.until").isNull() | (asked["fetched"] < F.col("i.until")))
    hit = asked.join(intervals.alias("i"), active, "left")
    best = F.max(F.when(F.col("i.key").isNotNull(), F.struct("rank", "since", (F.col("verdict") == "block").alias("blocks"), "category", F.col("i.key").alias("key"), "verdict")))
    return (
        hit.groupBy("capture_id", "row", "host").agg(best.alias("best"))
        .select("capture_id", "host", F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.key").alias("entry"),
                F.col("best.category").alias("category"), F.col("best.since").alias("active_since"))
    )
