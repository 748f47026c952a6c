"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's path.  Its canonical key is the host with its labels reversed,
a separator and the path, and it covers the interval of keys that start with
it.  A url has one key for each of its host's label suffixes (no more than the
deepest rule has labels), so "fits" becomes "the key lies in the interval".

Rules and url keys are range-partitioned together; each range is swept in key
order with a stack of the rules that are open, which are nested, so the top of
the stack is the longest path for that host.  Rules opened in an earlier range
reach a later one through its first key: the rules open there are those whose
key is a prefix of it.  Equal url keys may lie in many ranges (a hash of the
row breaks ties), so one hot host or url is no hot task.

Among a url's fitting rules the one with the most characters (host and path)
wins, then the longer host.  Of rules with equal host and path the greatest
action wins ('block' over 'allow').
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm.common import default_partitions, with_row_id
from cardflow.session import materialize

SEP = "\x01"

#: The rules (host, path, action) of the registered query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame (host, path, action)."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased;
    empty for a null url or one without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column, labels: Column | None = None) -> Column:
    rev = F.reverse(F.split(host, "\\."))
    return F.concat_ws(".", rev if labels is None else F.slice(rev, F.lit(1), labels))


def _sweep(events: pd.DataFrame) -> pd.DataFrame:
    """One range in key order.  kind -1 and 0: rules open at its start, and
    rules that begin in it; 1: a url's key."""
    rid, rule = [], []
    stack: list[tuple[str, int]] = []
    for key, kind, r, number in sorted(zip(events["key"], events["kind"], events["rid"], events["number"])):
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind < 1:
            if not stack or stack[-1][0] != key:
                stack.append((key, number))
        elif stack:
            rid.append(r)
            rule.append(stack[-1][1])
    return pd.DataFrame({"rid": pd.Series(rid, dtype="int64"), "number": pd.Series(rule, dtype="int64")})


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                ranges: int | None = None) -> DataFrame:
    """Judge every row's ``url``.  Returns page_id, host, path, rule (host and
    path as one text, null if none fits) and verdict (the rule's action, or
    ``default``).

    Null and malformed urls have empty host and path and get ``default``;
    repeated rows are judged each; rules with an empty or null host, a null
    path or a U+0001 are ignored; empty tables give empty results.  Rules whose
    host has upper-case letters match the lower-cased host.
    """
    spark = pages.sparkSession
    ranges = ranges or default_partitions(spark)
    own = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").where(
        (F.col("host") != "") & F.col("path").isNotNull() & ~F.contains("host", F.lit(SEP)))
    own = own.groupBy("host", "path").agg(F.max("action").alias("action"))
    own = with_row_id(own.withColumn("key", F.concat(_reversed(F.col("host")), F.lit(SEP), "path")), "number")
    most = own.agg(F.max(F.size(F.split("host", "\\."))).alias("labels"),
                   F.max(F.length("key")).alias("chars")).first()
    labels, chars = most["labels"] or 1, most["chars"] or 0

    urls = with_row_id(pages.select("page_id", url_host(F.col("url")).alias("host"),
                                    url_path(F.col("url")).alias("path")), "rid")
    # no rule is longer than ``chars``, so what follows in a key decides nothing
    suffix = F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", "\\.")), F.lit(labels))))
    keys = (urls.select("rid", "host", "path", suffix.alias("n"))
            .select("rid", "path", _reversed(F.col("host"), F.col("n")).alias("top"))
            .where(~F.contains("top", F.lit(SEP)))  # no rule's host holds one
            .select(F.substring(F.concat("top", F.lit(SEP), "path"), 1, chars).alias("key"),
                    F.lit(1).alias("kind"), "rid", F.lit(-1).cast("long").alias("number"),
                    F.xxhash64("rid").alias("tie")))
    opens = own.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("rid"), "number",
                       F.lit(0).cast("long").alias("tie"))
    events = materialize(
        keys.union(opens).repartitionByRange(ranges, "key", "kind", "tie")
        .select("key", "kind", "rid", "number", F.spark_partition_id().alias("part")), "ranges")

    heads = events.groupBy("part").agg(F.min("key").alias("head"))
    carried = (heads.select("part", "head", F.explode(F.sequence(F.lit(0), F.length("head"))).alias("n"))
               .select("part", F.expr("substring(head, 1, n)").alias("key"))
               .join(own.select("key", "number"), "key")
               .select("key", F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("rid"), "number", "part"))
    hits = events.union(carried).groupBy("part").applyInPandas(_sweep, "rid long, number long")

    weight = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = (hits.join(own.select("number", F.concat("host", "path").alias("rule"), "action",
                                 weight.alias("weight")), "number")
            .groupBy("rid").agg(F.max_by("rule", "weight").alias("rule"),
                                F.max_by("action", "weight").alias("action")))
    return urls.join(best, "rid", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


#: DuckDB SQL of the registered query, written for its four rules.
SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
j AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j"""
