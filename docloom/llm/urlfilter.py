"""URL filters as a sort-merge range join.

The canonical key of a host is its labels from the last to the first, each with an end
mark, so a rule's host and all its subdomains are one interval of keys.  Urls are put in ranges of
(key, path, row); a rule goes to every range that its interval meets, which an equi-join of the ranges'
hosts and their parents with the rules' hosts finds, and to a range within one host only if its path meets the
range's paths.  In each range urls and rules' hosts are merged in key order with a stack of the hosts whose
intervals are open; intervals nest, so the stack holds just the hosts on the url's own, and each has its rules by
path: the beginnings of the url's path of the lengths that occur there are looked up.  The longest rule wins.
A host with a third of all urls is spread over as many ranges as it fills.

Defined cases: a null url or one without "://" has an empty host and path, which only a rule with an
empty host and path fits; of rules that fit, the longest host and path together wins, then
the longer host, then block before allow; rules that occur twice count once; rows with equal ids are judged one by
one; a very long url is one row; an empty table gives no rows; further columns of the urls are kept under their
names by :func:`filter_urls`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import ascii_lower, materialize

#: Urls of one range.
URLS_A_RANGE = 50_000
#: End of a label in a key; sorts below every character of a label.
END = "\x01"
#: Verdict on urls that no rule fits.
DEFAULT = "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    marked = F.array_join(F.transform(F.reverse(F.split(host, r"\.", -1)), lambda x: F.concat(x, F.lit(END))), "")
    return F.when(host == "", F.lit("")).otherwise(marked)


class _Host(NamedTuple):
    key: str
    host: str
    verdicts: dict[str, str]  # by path
    lengths: list[int]  # of the paths, the longest first


def _hosts(rules: Iterable[tuple[str, str, str, str]]) -> list[_Host]:
    """Rules (key, verdict, host, path) by their hosts, in key order; block wins where both are said."""
    found: dict[tuple[str, str], dict[str, str]] = {}
    for key, verdict, host, path in rules:
        own = found.setdefault((key, host), {})
        if own.get(path) != "block":
            own[path] = verdict
    return [_Host(key, host, own, sorted({len(p) for p in own}, reverse=True)) for (key, host), own in sorted(found.items())]


def _sweep(keys: list[str], hosts: list[str], paths: list[str], rules: list[_Host]) -> list[tuple[str, str] | None]:
    """For urls in key order: the rule that wins, as host and path together, and its verdict."""
    out: list[tuple[str, str] | None] = []
    stack: list[_Host] = []
    at = 0
    for key, host, path in zip(keys, hosts, paths):
        while at < len(rules) and rules[at].key <= key:
            while stack and not rules[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        best = None
        for rule in stack:  # from the shortest host to the longest
            if rule.host and host != rule.host and not host.endswith("." + rule.host):
                continue
            for n in rule.lengths:
                if n <= len(path) and (verdict := rule.verdicts.get(path[:n])) is not None:
                    if best is None or len(rule.host) + n >= len(best[0]):
                        best = (rule.host + path[:n], verdict)
                    break
        out.append(best)
    return out


def _merge(urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """One range: all its urls with what the sweep finds for them."""
    urls = urls.sort_values(["key", "path"], kind="stable")
    won = _sweep(urls["key"].tolist(), urls["host"].tolist(), urls["path"].tolist(), _hosts(zip(rules["key"], rules["verdict"], rules["rule_host"], rules["rule_path"])))
    rule, verdict = [w and w[0] for w in won], [w[1] if w else DEFAULT for w in won]
    return urls[["kept", "host", "path"]].assign(rule=pd.Series(rule, urls.index, object), verdict=pd.Series(verdict, urls.index, object))


def _judged(urls: DataFrame, kept: Column, url: Column, rules: DataFrame) -> DataFrame:
    keyed = urls.select(kept.alias("kept"), url.alias("_url")).select(F.monotonically_increasing_id().alias("row"), "kept", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    keyed = materialize(keyed.withColumn("key", key_of(F.col("host"))), "urls")
    n = max(1, -(-keyed.count() // URLS_A_RANGE))
    ranged = materialize(keyed.repartitionByRange(n, "key", "path", "row").withColumn("part", F.spark_partition_id()), "url-ranges")
    place = F.struct("key", "path")
    bounds = ranged.groupBy(F.col("part").alias("of_part")).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    # a rule's interval meets a range if its host is one of the range's hosts or a parent of one
    labels = F.split("host", r"\.", -1)
    parents = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    hosts = ranged.select(F.col("part").alias("of_part"), "host").distinct().select("of_part", F.explode(parents).alias("rule_host")).distinct().join(bounds, "of_part")
    lines = rules.select("verdict", F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).distinct()
    meets = (F.col("low.key") < F.col("high.key")) | (F.col("rule_path") <= F.col("high.path")) & ((F.col("rule_path") >= F.col("low.path")) | F.col("low.path").startswith(F.col("rule_path")))
    placed = hosts.join(lines, "rule_host").where(meets).select("of_part", key_of(F.col("rule_host")).alias("key"), "verdict", "rule_host", "rule_path")
    text = T.StringType()
    out = T.StructType([T.StructField("kept", ranged.schema["kept"].dataType), *[T.StructField(c, text) for c in ("host", "path", "rule", "verdict")]])
    return ranged.groupBy("part").cogroup(placed.groupBy("of_part")).applyInPandas(_merge, out)


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of every url; rules has (verdict, host, path)."""
    return _judged(urls, urls[id_col], urls[url_col], rules).withColumnRenamed("kept", id_col)


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of urls that are allowed, with all their columns."""
    judged = _judged(urls, F.struct(*[urls[c] for c in urls.columns]), urls[url_col], rules).where(F.col("verdict") == "allow")
    return judged.select(*[F.col("kept").getField(c).alias(c) for c in urls.columns])
