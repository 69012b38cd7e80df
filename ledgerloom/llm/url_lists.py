"""Dated URL lists, joined as of the time of fetch.

Dated entries become validity intervals of their pattern. A pattern's
intervals stand in one array, no longer than the number of list dates; each
distinct (host, date) of the captures looks up its host and all parent domains
as of that date, and the longest pattern with an active entry decides.
Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: What an entry can say; ``drop`` ends the entry before it.
ACTIONS = ("block", "allow", "drop")


def host_of(url: Column) -> Column:
    """Lower-case host, empty where the URL has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels and more; a single label stands for itself."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to, action) from (pattern, entry_date, seq, action).

    Of a pattern's entries of one date the one with the greatest (seq, action)
    holds. ``valid_to`` is the pattern's next date, NULL for the last. Entries
    with a NULL pattern, date or action say nothing.
    """
    daily = (
        entries.filter("pattern is not null and entry_date is not null and action is not null")
        .groupBy("pattern", "entry_date")
        .agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    )
    until = F.lead("entry_date").over(W.partitionBy("pattern").orderBy("entry_date"))
    return daily.select("pattern", F.col("entry_date").alias("valid_from"), until.alias("valid_to"), "action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Add host, verdict (block, allow or pass) and pattern (the one that decides) to captures with url and fetch_date.

    The list is looked up once per distinct (host, fetch_date), so a host with
    most of the captures is as cheap as any; the answers return by an
    equi-join whose hot keys adaptive execution splits. NULL and malformed
    URLs have an empty host and pass, as does a NULL date. Repeated captures
    stay; columns called like the added ones are replaced.
    """
    timelines = (
        intervals(entries)
        .filter("action in ('block', 'allow')")
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "action"))).alias("timeline"))
    )
    rows = captures.drop("host", "verdict", "pattern").withColumn("host", host_of(F.col("url")))
    asked = rows.filter("host <> '' and fetch_date is not null").select("host", "fetch_date").distinct()
    looked = asked.withColumn("pattern", F.explode(suffixes(F.col("host")))).join(timelines, "pattern")
    active = F.filter(
        "timeline",
        lambda x: (x["valid_from"] <= F.col("fetch_date")) & (x["valid_to"].isNull() | (F.col("fetch_date") < x["valid_to"])),
    )
    verdicts = (
        looked.select("host", "fetch_date", "pattern", F.get(active, F.lit(0))["action"].alias("action"))
        .filter("action is not null")
        .groupBy("host", "fetch_date")
        .agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("v"))
        .select("host", "fetch_date", F.col("v.action").alias("verdict"), F.col("v.pattern").alias("pattern"))
    )
    joined = rows.join(verdicts, ["host", "fetch_date"], "left")
    names = [c for c in rows.columns]
    return joined.select(*names, F.coalesce("verdict", F.lit("pass")).alias("verdict"), "pattern")


def example_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date, which the table lacks: spread over four years by page_id."""
    return pages.select(
        "page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 37 % 1461).cast("int")).alias("fetch_date")
    )


def example_entries(pages: DataFrame) -> DataFrame:
    """A dated list about all hosts and parent domains of the pages: six entries each, by turns block, allow and drop."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), "page_id").filter("host <> ''")
    patterns = (
        hosts.groupBy("host").agg(F.min("page_id").alias("m")).select(F.explode(suffixes(F.col("host"))).alias("pattern"), "m")
    )
    patterns = patterns.groupBy("pattern").agg(F.min("m").alias("m"))
    k = patterns.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    turn = F.element_at(F.array(*map(F.lit, ACTIONS)), ((F.col("m") + F.col("k")) % 3 + 1).cast("int"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("m") * 7 + F.col("k") * 241) % 1461).cast("int"))
    return k.select("pattern", day.alias("entry_date"), F.col("k").alias("seq"), turn.alias("action"))
