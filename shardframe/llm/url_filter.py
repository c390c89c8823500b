"""URL filters: captures against dated list entries, as of the time of the fetch.

A list entry adds or removes a pattern on a date: a ``host``, a ``domain`` with all hosts under it, or a path ``prefix`` of a
host. The dated entries of a pattern become validity intervals (from an addition to the next entry of the same list
and pattern), and a capture is blocked if an interval of one of its keys holds its fetch date. The keys of a capture
are its host, the domains above it, and the prefixes of its path, no longer ones than the lists have. The as-of join is
an equality join on key and month: an interval lies in every month that it reaches into and that has captures, and a capture
in one; months without captures cost nothing, however far apart the captures are (the calendar has 120,000 months). So a pattern that changes daily for years meets a capture with a month's entries, and a
host that holds a third of all captures is dealt by month; what is still uneven Spark splits (adaptive skew join).

Defined results: scheme and host are compared without case, without user, port, and final dot; paths with case, empty
segments left out, matched by whole segments. Patterns of entries are read by the same rules. A capture without a URL with a host, or without a date, is not blocked. An
entry without list, kind, pattern or date, or a prefix without a segment, counts for nothing. Of entries of one list, pattern and date the removal wins;
repeated entries count once. Repeated captures are judged each. Without entries nothing is blocked; an empty table gives
an empty result. Other columns of the captures are carried along; a column with the name of an added one (``host``, ``blocked``, ``lists``, ``n_active``,
``active_since``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm.shared import written

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; empty without one."""
    return _host(F.regexp_extract(url, AUTHORITY, 1))


def _host(authority: Column) -> Column:
    authority = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.$", ""))


def segments_of(url: Column) -> Column:
    """Segments of the path that aren't empty."""
    return _segments(F.regexp_extract(url, PATH, 1))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def pattern_of(kind: Column, pattern: Column) -> Column:
    """An entry's pattern as the keys of captures are written: a host, or a host and the segments of a prefix."""
    prefix = F.split(pattern, "/", 2)
    segments = _segments(F.coalesce(F.get(prefix, F.lit(1)), F.lit("")))
    return F.when(kind == "prefix", F.array_join(F.concat(F.array(_host(prefix[0])), segments), "/")).otherwise(_host(pattern))


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, pattern, valid_from, valid_to`` (open if null) from ``list, kind, pattern, action, dated``."""
    order = Window.partitionBy("list", "kind", "pattern").orderBy("dated", "action")
    known = entries.dropna(subset=["list", "kind", "pattern", "action", "dated"]).select(
        "list", "kind", pattern_of(F.col("kind"), F.col("pattern")).alias("pattern"), "action", F.to_date("dated").alias("dated")
    )
    return (
        known.distinct()
        .withColumn("valid_to", F.lead("dated").over(order))
        .filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("dated") < F.col("valid_to"))))
        .select("list", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")
    )


def keys_of(host: Column, segments: Column, labels: Column, depth: Column) -> Column:
    """Keys of a capture: its host, its domains of at most ``labels`` labels, its prefixes of at most ``depth`` segments."""
    parts = F.split(host, r"\.", -1)
    take = F.least(F.size(parts), labels)
    domains = F.when(take > 0, F.transform(F.sequence(F.lit(1), take), lambda k: F.array_join(F.slice(parts, -k, k), ".")))
    deep = F.least(F.size(segments), depth)
    prefixes = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    none = F.array().cast("array<string>")
    key = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    return F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))),
        F.transform(F.coalesce(domains, none), key("domain")),
        F.transform(F.coalesce(prefixes, none), key("prefix")),
    )


def captured_months(captures: DataFrame, fetched: str) -> list[int]:
    """Months that have captures: as many as the calendar has, at most."""
    month = _month(F.to_date(F.col(fetched)))
    return sorted(r[0] for r in captures.select(month.alias("m")).filter("m IS NOT NULL").distinct().collect())


def monthly_intervals(valid: DataFrame, months: list[int]) -> DataFrame:
    """A row for each interval and each of the months that it reaches into."""
    used = F.lit(months).cast("array<int>") if months else F.array().cast("array<int>")
    first, last = _month(F.col("valid_from")), _month(F.date_sub("valid_to", 1))
    reached = F.filter(used, lambda m: (m >= first) & (F.col("valid_to").isNull() | (m <= last)))
    return valid.withColumn("month", F.explode(reached)).select("list", "kind", "pattern", "month", "valid_from", "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with ``host, blocked, lists`` (sorted, comma-joined), ``n_active`` and ``active_since`` (the earliest)."""
    own = [c for c in captures.columns if c.lower() not in ("host", "blocked", "lists", "n_active", "active_since", "_uid")]
    seen = written(
        captures.select(
            *[F.col(f"`{c}`") for c in own],
            F.monotonically_increasing_id().alias("_uid"),
            F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        ),
        "captures",
    )
    valid = written(intervals(entries), "intervals")
    reach = valid.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.", -1)))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/", -1)) - 1)), F.lit(0)).alias("depth"),
    ).first()
    day = F.to_date(F.col(fetched))
    monthly = monthly_intervals(valid, captured_months(seen, fetched))
    keys = F.explode(keys_of(F.col("host"), segments_of(F.col(url)), F.lit(reach.labels), F.lit(reach.depth)))
    asked = (
        seen.filter((F.col("host") != "") & day.isNotNull())
        .select("_uid", day.alias("day"), keys.alias("k"))
        .select("_uid", "day", _month(F.col("day")).alias("month"), "k.kind", "k.pattern")
    )
    active = (
        asked.join(monthly, ["kind", "pattern", "month"])
        .filter((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
        .groupBy("_uid")
        .agg(
            F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
            F.count(F.lit(1)).alias("n_active"),
            F.min("valid_from").alias("active_since"),
        )
    )
    return seen.join(active, "_uid", "left").select(
        *[F.col(f"`{c}`") for c in own],
        "host",
        F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "active_since",
    )
