"""URL filters as a sort-merge range join (operator 7).

A URL becomes a canonical key: host labels in reverse, then path and query
(``https://blog.example.com/a?x`` -> ``com.example.blog./a?x``). A rule for a host covers it and its
subdomains, one with a path covers that host's paths that begin so; either is a prefix of keys, which
is an interval of the sorted order. Prefix intervals are nested or apart. So one sweep over URLs
and interval starts in key order, with a stack of the rules now open, finds for every URL all rules
that cover it; the top of the stack is the most specific and decides.

Range partitions: bounds are drawn from a hash sample of the keys (they balance the work and change no
result); a URL goes to its partition, a rule to each partition its interval meets, so no partition
needs another's stack. Both sides may be of any size; nothing but the bounds is broadcast.

Defined cases: a null URL or one without ``scheme://host`` has a null key, matches no rule and takes
the default action. Case of scheme and host, user info, port, trailing dots and the fragment don't count.
Rules with equal prefixes: the smallest rule id is innermost. A rule whose id or pattern is null, or whose
pattern is empty, covers nothing. Ids of any size are kept as they are (they travel as text).
An empty rule table leaves all URLs to the default. Repeated rows are each returned. Other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule_id, pattern, action): the default rules of the query.
RULES = [
    (1, "example.com", "allow"),
    (2, "example.net", "allow"),
    (3, "example.org", "allow"),
    (10, "ads-track.example.com", "block"),
    (11, "adult-x.example.com", "block"),
    (12, "casino-win.example.net", "block"),
    (13, "cheap-pills.example.net", "block"),
    (14, "free-bets.example.net", "block"),
    (15, "spam-farm.example.org", "block"),
]


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def url_key(url: Column) -> Column:
    """The canonical key of a URL; null if there is none."""
    shape = r"(?is)^\s*[a-z][a-z0-9+.\-]*://([^/?#\s]*)([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, shape, 1)), r"^.*@|:[0-9]*$|\.+$", "")
    host = F.regexp_replace(host, r":[0-9]*$|\.+$", "")
    rest = F.trim(F.regexp_extract(url, shape, 2))
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(_reversed(host), rest))


def rule_prefix(pattern: Column) -> Column:
    """The key prefix that a rule covers; null if none."""
    p = F.regexp_replace(F.trim(pattern), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(p, r"^([^/?#]*)", 1)), r"^\*\.|:[0-9]*$|\.+$", ""), r":[0-9]*$|\.+$", "")
    rest = F.regexp_extract(p, r"(?s)^[^/?#]*(.*)$", 1)
    rest = F.when((rest == "") | rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(_reversed(host), rest))


def url_filter(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Rows (page_id, url, rule_id, action, covering): the deciding rule and how many cover the URL."""
    spark = urls.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = urls.schema[id_col].dataType.simpleString()
    left = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("key", url_key(F.col("url")))
    keys = left.where("key is not null").select("key")
    every = max(1, keys.count() // (50 * parts))
    sample = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().limit(500 * parts).collect())
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)] if len(sample) >= parts else []
    bounds = sorted(set(bounds))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) if k is not None else 0 for k in key])

    @F.pandas_udf("array<int>")
    def meets(prefix: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(bounds, p), bisect_right(bounds, p + "\U0010ffff") + 1)) for p in prefix])

    r = rules.select(F.col("rule_id").cast("long").alias("rule_id"), rule_prefix(F.col("pattern").cast("string")).alias("key"), F.col("action").cast("string").alias("action")).where("key is not null and rule_id is not null").dropDuplicates()
    none = F.lit(None)
    right = r.select(F.explode(meets("key")).alias("part"), "key", F.lit(0).alias("kind"), (-F.col("rule_id")).alias("tie"), none.cast("string").alias("page_id"), none.cast("string").alias("url"), F.col("rule_id").cast("string").alias("rule_id"), "action")
    found = left.where("key is not null").select(place("key").alias("part"), "key", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.col("page_id").cast("string").alias("page_id"), "url", none.cast("string").alias("rule_id"), none.cast("string").alias("action"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, str, str]] = []
        at = None
        for b in batches:
            out = []
            for part, key, is_url, page, url, rule, action in zip(b["part"], b["key"], b["kind"], b["page_id"], b["url"], b["rule_id"], b["action"]):
                if part != at:
                    stack, at = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_url:
                    top = stack[-1] if stack else (None, None, default)
                    out.append((page, url, top[1], top[2], len(stack)))
                else:
                    stack.append((key, rule, action))
            yield pd.DataFrame(out, columns=["page_id", "url", "rule_id", "action", "covering"])

    order = ("part", "key", "kind", "tie")
    swept = found.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions(*order).mapInPandas(sweep, "page_id string, url string, rule_id string, action string, covering int")
    swept = swept.select(F.col("page_id").cast(kind).alias("page_id"), "url", F.col("rule_id").cast("long").alias("rule_id"), "action", "covering")
    keyless = left.where("key is null").select("page_id", "url", none.cast("long").alias("rule_id"), F.lit(default).alias("action"), F.lit(0).alias("covering"))
    return swept.unionByName(keyless)


def rules_frame(spark: SparkSession, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """Rules as a table."""
    return spark.createDataFrame(rules, "rule_id long, pattern string, action string")


def _oracle() -> str:
    values = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
    return rf"""
WITH r0(rule_id, pattern, action) AS (VALUES {values}),
r AS (SELECT rule_id, action, array_to_string(list_reverse(string_split(pattern, '.')), '.') || '.' AS prefix FROM r0),
u0 AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM pages),
u AS (SELECT page_id, url, array_to_string(list_reverse(string_split(host, '.')), '.') || '.' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS key FROM u0),
m AS (SELECT u.page_id, u.url, r.rule_id, r.action, length(r.prefix) AS n FROM u LEFT JOIN r ON starts_with(u.key, r.prefix)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, rule_id) AS k, count(rule_id) OVER (PARTITION BY page_id) AS covering FROM m)
SELECT page_id, url, CAST(rule_id AS BIGINT) AS rule_id, coalesce(action, 'allow') AS action, CAST(covering AS INTEGER) AS covering FROM k WHERE k = 1
"""


ORACLE = _oracle()
