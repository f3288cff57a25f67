"""URL allow and block rules, by a sort-merge range join.

A rule (host, path) fits its host and all subdomains when the url's path starts with the rule's path.
Keys put the host's labels in reverse order before the path, so the urls that a rule fits under one
host are an interval of keys that starts with the rule's own key, and intervals nest or are disjoint.
A url has one key for each parent domain that is no longer than the longest rule host. Keys of urls and
rules are range partitioned together (with the page id as last column, so one hot key spreads over many
partitions); each partition is swept in key order with a stack of the active nested rules, which
starts with the rules that reach over its lower bound. The longest rule over all keys of a url wins.

Ties of length go to the longer host, then to `block`. Null urls and urls without `://` have an empty host and
path and get the default verdict, as do urls that no rule fits. Repeated pages give a row each; an empty
table or an empty rule set works; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "rule string, verdict string, n_rule int, n_host int"
#: Rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def key(labels: Column, path: Column) -> Column:
    """Neither a host nor a path holds `?` or `#`, so the key can be read in one way only."""
    return F.concat(F.array_join(labels, "?"), F.lit("#"), path)


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def reaching(bounds: list[tuple[int, str]]):
    """mapInArrow over rules: (partition, rule) for each partition whose first key lies in the rule's interval."""
    firsts = [first for _, first in bounds]

    def run(batches):
        for batch in batches:
            rows = []
            for rule in batch.to_pylist():
                at = bisect_left(firsts, rule["key"])
                while at < len(firsts) and firsts[at].startswith(rule["key"]):
                    rows.append({"part": bounds[at][0], **rule})
                    at += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_rule", pa.int32()), ("n_host", pa.int32())]))

    return run


def sweep(carried: dict[int, list[dict]]):
    """mapInArrow over sorted (key, page_id, host, path, first, rule...): the innermost active rule of each url key."""

    def run(batches):
        stack = [(r["key"], {k: r[k] for k in ("rule", "verdict", "n_rule", "n_host")}) for r in carried.get(TaskContext.get().partitionId(), [])]
        for batch in batches:
            col = batch.to_pydict()
            keys, found, kept = col["key"], [], []
            for i, (at, rule) in enumerate(zip(keys, col["best"])):
                while stack and not at.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    stack.append((at, rule))
                else:
                    kept.append(i)
                    found.append(stack[-1][1] if stack else None)
            if kept:
                out = batch.take(pa.array(kept))
                best = pa.array(found, pa.struct([("n_rule", pa.int32()), ("n_host", pa.int32()), ("verdict", pa.string()), ("rule", pa.string())]))
                yield pa.record_batch([out.column("page_id"), out.column("host"), out.column("path"), out.column("first"), best], ["page_id", "host", "path", "first", "best"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url) under rules (host, path, verdict)."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host is not null and path is not null and verdict is not null")
    best = F.struct((F.length("host") + F.length("path")).alias("n_rule"), F.length("host").alias("n_host"), F.col("verdict").alias("verdict"), F.concat("host", "path").alias("rule"))
    # Of rules with one key the last is on top of the stack: block comes after allow.
    ruled = rules.distinct().select(key(labels(F.col("host")), F.col("path")).alias("key"), best.alias("best"), F.size(labels(F.col("host"))).alias("depth"))
    depth = ruled.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]

    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("struct<n_rule:int,n_host:int,verdict:string,rule:string>")
    if depth == 0:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # A url below more domains than any rule host has labels needs no key for the deeper ones.
    count = F.least(F.size(labels(F.col("host"))), F.lit(depth))
    keyed = urls.filter("host <> ''").select("page_id", "host", "path", F.explode(F.sequence(F.lit(1), count)).alias("n"))
    keyed = keyed.select(key(F.slice(labels(F.col("host")), F.lit(1), F.col("n")), F.col("path")).alias("key"), "page_id", "host", "path", (F.col("n") == 1).cast("int").alias("first"), none.alias("best"))
    both = keyed.unionByName(ruled.select("key", F.lit(None).cast("bigint").alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0).alias("first"), "best"))
    # Rules sort before urls of the same key, and rules of one key by verdict.
    order = ["key", F.col("best").isNull(), F.col("best.verdict"), "page_id"]
    ranged = cut(both.repartitionByRange(*order).sortWithinPartitions(*order))
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    bounds = sorted(((r["part"], r["key"]) for r in first.collect()), key=lambda x: x[1])  # one row a partition
    flat_rules = ruled.select("key", "best.rule", "best.verdict", "best.n_rule", "best.n_host")
    reach = flat_rules.mapInArrow(reaching(bounds), f"part int, key string, {RULE}").collect()  # at most nesting depth rows a partition
    carried: dict[int, list[dict]] = {}
    for r in sorted(reach, key=lambda r: (len(r["key"]), r["verdict"])):
        carried.setdefault(r["part"], []).append(r.asDict())
    swept = ranged.mapInArrow(sweep(carried), "page_id bigint, host string, path string, first int, best struct<n_rule:int,n_host:int,verdict:string,rule:string>")
    judged = swept.groupBy("page_id", "host", "path").agg(F.max("best").alias("best"), F.sum("first").alias("rows"))
    judged = judged.select("page_id", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row")).drop("_row")
    judged = judged.unionByName(urls.filter("host = ''").withColumn("best", none))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def _case(column: str) -> str:
    """The rules of the registered query, longest first."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    value = {"rule": lambda r: r[0] + r[1], "verdict": lambda r: r[2]}[column]
    return " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{value(r)}'" for r in ordered)


OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
hosts AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts)
SELECT page_id, host, path, CASE {_case("rule")} END AS rule, CASE {_case("verdict")} ELSE 'allow' END AS verdict
FROM hosts
"""
