"""URL filters by a sort-merge range join, with DataFrame functions only.

A host is turned round label by label, each label closed by a dot (``net.example.``): a rule's host
and all its subdomains are then one interval of keys, and the intervals of rules nest. Rules and urls
are sorted together by key; a sweep carries the stack of the last rule that opened (that rule and the
rules that its interval lies in), and a url drops from the top what its key has left behind. What
remains is every rule whose interval holds the url; the path decides between them.

The sweep runs in parallel by top-level label and, since one label may hold most urls, by a hash of
the page: each such slice holds its share of the urls and all rules of the label. A stack travels as
one array with each rule; it holds the rules on the way from one host up to its top-level label, which should be
thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: then up to ``?``, ``#``; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def key_of(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> (key, stack): for each host with a rule, the rules of it and of the hosts above it."""
    known = rules.where("host <> '' and path is not null and verdict is not null").distinct()
    known = known.select(key_of(F.col("host")).alias("key"), F.struct(
        key_of(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    own = known.groupBy("key").agg(F.collect_list("r").alias("own"))
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    chains = own.select("key", F.explode(above).alias("up"))
    chains = chains.join(own.select(F.col("key").alias("up"), "own"), "up")
    return chains.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", slices: int | None = None) -> DataFrame:
    """(page_id, url, ...), (host, path, verdict) -> (page_id, host, path, rule, verdict): one row for each page.

    A rule fits if the url's host is its host or a subdomain and the url's path starts with its path; the
    longest fitting rule (host and path together, then the longer host) decides, of equal ones ``block``; pages
    that no rule fits, or without a host, get a null rule and ``otherwise``. Null urls have an empty host and path; repeated
    pages and null ids keep a row each; rules with a null or empty host, or a null part, fit nothing;
    other columns are not read.
    """
    slices = slices or max(8, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host")))
    part = F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(slices)).cast("int")
    stacks = rule_stacks(rules)
    kind = stacks.schema["stack"].dataType
    top = F.substring_index("key", ".", 1).alias("top")
    urls = urls.select(top, part.alias("slice"), "key", F.lit(1).alias("is_url"), "page_id", "host", "path", F.lit(None).cast(kind).alias("stack"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("page_id", urls.schema["page_id"].dataType), ("host", "string"), ("path", "string"))]
    opens = stacks.select(top, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "key", F.lit(0).alias("is_url"), *none, "stack")
    sweep = Window.partitionBy("top", "slice").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = urls.union(opens).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    order = lambda r: F.struct(F.length(r["rule"]), F.length(r["key"]), r["verdict"], r["rule"])
    best = F.array_max(F.transform(fits, order))
    out = swept.select("page_id", "host", "path", best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
