"""Not-modified revisits of a web archive, resolved to the full responses they confirm.

A revisit is joined, by canonical URL, to the latest full response before it. If a validator of the revisit (its ETag, or else its
Last-Modified) equals that of the response, the revisit stands for the response's payload, and the headers that a not-modified answer may
change are merged into the response's.

The as-of join needs no task that holds all records of a URL: records are dealt in ranges of (URL, time), each range fills forward by itself, and the
last response of the ranges before is carried over. A URL with a third of all records spreads over a third of the ranges.

Nulls and edges: a record with a null URL or time is never joined; records of one URL and time are in the order of their ids, and rows repeated in full
are kept and resolved alike; a revisit without validators, with another validator, or with no response before it stays unresolved, with its reason;
null headers are none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.session import cut

# fixed values: the header fields that a 304 answer may carry for the stored response
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without last slash, sorted query without campaign fields; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(fields, lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(name: str) -> Column:
    value = F.trim(F.col("headers")[name])
    return F.when(value != "", value)


def _etag(value: Column) -> Column:
    """Validators of revisits are compared weakly."""
    return F.regexp_replace(value, "^W/", "")


def latest_before(records: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``records`` with column ``name``: the last non-null ``value`` of rows before, by ``order``, with the same ``key``."""
    dealt = records.withColumn("_value", value).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt, "ranges")  # fixes which range a row is in
    within = W.partitionBy("_part", key).orderBy(*order)
    local = F.last("_value", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1))
    filled = dealt.withColumn("_local", local)
    place = F.struct(*order)
    ends = dealt.filter(F.col("_value").isNotNull()).groupBy(key, "_part").agg(F.max_by("_value", place).alias("_end"))
    parts = dealt.select(key, "_part").distinct().join(ends, [key, "_part"], "left")
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(key, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried")).filter("_carried is not null")
    out = filled.join(carried, [key, "_part"], "left")
    return out.withColumn(name, F.coalesce("_local", "_carried")).drop("_part", "_value", "_local", "_carried")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, refers_to, outcome, headers) of every revisit among ``records``.

    ``records``: record_id string, url string, ts long, kind (``response`` or ``revisit``), headers map of lower-case names.
    """
    own = records.select(
        F.col("record_id").cast("string"), F.col("ts").cast("long"), "kind",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), canonical_url(F.col("url").cast("string")).alias("canonical_url"),
    )
    joinable = own.filter("canonical_url is not null and ts is not null")
    response = F.when(F.col("kind") == RESPONSE, F.struct("record_id", "headers"))
    seen = latest_before(joinable, "canonical_url", ["ts", "record_id"], response, "full").filter(F.col("kind") == REVISIT)
    alone = own.filter((F.col("kind") == REVISIT) & (F.col("canonical_url").isNull() | F.col("ts").isNull()))
    both = seen.unionByName(alone, allowMissingColumns=True)

    tag, date = _etag(_header("etag")), _header("last-modified")
    full = lambda name: F.trim(F.col("full.headers")[name])
    same = F.when(tag.isNotNull(), tag == _etag(full("etag"))).when(date.isNotNull(), date == full("last-modified"))
    outcome = (
        F.when(F.col("full").isNull(), "no earlier response")
        .when(tag.isNull() & date.isNull(), "no validator")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("validator mismatch")
    )
    allowed = F.map_filter("headers", lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    stored = F.map_filter("full.headers", lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    done = both.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "canonical_url", F.when(resolved, F.col("full.record_id")).alias("refers_to"), "outcome",
        F.when(resolved, F.map_concat(stored, allowed)).otherwise(F.col("headers")).alias("headers"),
    )
