"""URL filtering by a sort-merge range join, in DataFrame operations only.

The canonical key of a host is its labels in reverse, each with an end mark that sorts below every
other character. All hosts under a rule's host then form one interval of keys, and such intervals
are nested or apart. Their ends cut the key space into segments; each end carries the stack of the
rules that are active from there on. Urls and ends are dealt out by ranges of the key (a frequent
host is spread by the page's id), each range is sorted once, and a sweep hands every url the stack
of the last end before it. The stack that is active where a range begins comes from the ranges
before. The url's path then picks among the stack's few rules.

Defined cases: a null url, or one without ``://``, has an empty host and path and is fit by no
rule; a rule fits if the path starts with the rule's (an empty path doesn't start with ``/``); of
the rules that fit, the one with the longest host and path together wins, of these the one with the
longest host, of these the one that sorts first, block before allow; a url without a rule gets the
default verdict; rules with a null host are ignored and a null rule path is empty; a null id and
repeated rows are rows like others; further columns are passed on inside ``row``; empty tables of
urls or rules give an empty result or default verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

_END = "\u0001"
_ENDED = "\u0002"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, *_AZ)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url.cast("string"), _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), _PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    """Labels from the top-level domain down; the two marks can't occur inside."""
    return F.reverse(F.split(F.translate(host, _END + _ENDED, "\u0003\u0003"), r"\."))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, _END), F.lit(_END))


def _ends(rules: DataFrame) -> DataFrame:
    """Both ends of every rule host's interval, each with the stack of rules active from there on.

    A host's stack is that of its ancestors and its own rules, found by equality with each of its
    prefixes of labels; an interval's end leaves the stack of the host without this one.
    """
    own = rules.where("host is not null").select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")
    )
    own = own.withColumn("rule", F.concat("host", "path")).withColumn("_labels", _labels(F.col("host"))).withColumn("_key", _key(F.col("_labels")))
    at = own.groupBy("_key", "_labels").agg(F.collect_set(F.struct("rule", "host", "path", "verdict")).alias("_own"))
    depths = F.sequence(F.lit(1), F.size("_labels"))
    up = at.select("_key", F.explode(F.transform(depths, lambda n: _key(F.slice("_labels", 1, n)))).alias("_up"))
    found = up.join(at.select(F.col("_key").alias("_up"), "_own"), "_up")
    stacks = found.groupBy("_key").agg(
        F.flatten(F.collect_list("_own")).alias("_on"),
        F.flatten(F.collect_list(F.when(F.col("_up") != F.col("_key"), F.col("_own")))).alias("_after"),
    )
    closed = F.concat(F.substring("_key", F.lit(1), F.length("_key") - 1), F.lit(_ENDED))
    return stacks.select("_key", F.col("_on").alias("_stack")).unionByName(stacks.select(closed.alias("_key"), F.col("_after").alias("_stack"))).groupBy("_key").agg(
        # An end may meet the next start at one key only if hosts hold marks, which _labels replaces.
        F.max_by("_stack", F.size("_stack")).alias("_stack")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """One row per page: row (the columns ``keep``), host, path, rule, verdict.

    ``rules`` has host, path, verdict. ``keep`` defaults to the id alone, so that page bodies aren't moved.
    """
    n = partitions(pages.sparkSession)
    urls = pages.select(F.struct(*(keep or [id_col])).alias("row"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    urls = urls.withColumn("_key", F.when(F.col("host") == "", F.lit("")).otherwise(_key(_labels(F.col("host")))))
    none = F.lit(None)
    ends = _ends(rules)
    kind = ends.schema["_stack"].dataType
    events = urls.withColumns({"_stack": none.cast(kind), "_salt": F.xxhash64("row", "path")}).unionByName(
        ends.withColumns({"row": none.cast(urls.schema["row"].dataType), "host": none.cast("string"), "path": none.cast("string"), "_salt": F.lit(-(2**63))})
    )
    # Ends sort before the urls at the same key: the least salt is theirs alone, or else _stack decides.
    ranged = events.repartitionByRange(n, "_key", F.col("_stack").isNull(), "_salt").withColumn("_range", F.spark_partition_id())
    dealt = materialise(ranged, "url-ranges")
    order = F.struct("_key")
    last = dealt.where("_stack is not null").groupBy("_range").agg(F.max_by("_stack", order).alias("_last"))
    every = dealt.sparkSession.range(2 * n + 1).select(F.col("id").cast("int").alias("_range"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(last, "_range", "left").select("_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    sweep = Window.partitionBy("_range").orderBy("_key", F.col("_stack").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("_active", F.last("_stack", ignorenulls=True).over(sweep)).where("host is not null")
    swept = swept.join(carried, "_range", "left").withColumn("_active", F.coalesce("_active", "_carried"))
    fits = F.filter(
        "_active",
        lambda r: F.startswith(F.col("path"), r["path"]) & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))),
    )
    best = F.array_min(
        F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("a"), (-F.length(r["host"])).alias("b"), r["rule"].alias("rule"), F.when(r["verdict"] == "block", 0).otherwise(1).alias("c"), r["verdict"].alias("verdict")))
    )
    judged = swept.withColumn("_best", F.when(F.col("host") != "", best))
    return judged.select("row", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
