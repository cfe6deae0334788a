"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (action, host, path). It fits its host and every subdomain, if the url's path starts with the rule's
path; of all fitting rules the longest (host and path characters; of equal ones, the longer host) wins. Rules that
share host and path are merged, block before allow.

Defined results: a null url, or one without `://`, has empty host and path and fits no rule; an empty rule list
gives the default verdict everywhere; rows are never dropped and repeated rows are judged alike; the result has
only the columns named in `keep` and its own four, and a name of the input may be one of these. A-Z in a rule's host
count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import UPPER, lower_ascii

LOW = str.maketrans(UPPER, UPPER.lower())
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_RULES = 200_000  #: more rules are joined instead of broadcast


def trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nested dicts by host label from the right; under "/" a node's rules by path segment, "" holding the open ends."""
    root: dict = {}
    for action, host, path in sorted(rules, key=lambda r: r[0] == "block"):  # a later block replaces an allow
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault(("path", segment), {})
        node.setdefault("ends", {})[rest] = (host + path, action, len(host) + len(path), len(host))
    return root


def longest(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning rule and its action."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        at, low = node, 0
        while at is not None:
            for rest, rule in at.get("ends", {}).items():
                if path.startswith(rest, low) and (best is None or rule[2:] > best[2:]):
                    best = rule
            cut = path.find("/", low)
            if cut < 0:
                break
            at, low = at.get(("path", path[low:cut])), cut + 1
    return best and best[:2]


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column; both empty where there is no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", keep: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """keep, host, path, rule (null if none fits) and verdict of every row."""
    rules = [(action, h.translate(LOW), p) for action, h, p in rules]
    host, path = split_url(F.col(url))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]  # names of the input may be those of the result
    if len(rules) > MAX_RULES:
        return _joined(rows, rules, names, default)
    shared = pages.sparkSession.sparkContext.broadcast(trie(rules))

    @F.pandas_udf("rule string, action string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = shared.value
        for hosts, paths in parts:
            found = [longest(root, h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "action"], dtype=object)

    judged = rows.withColumn("_j", judge("host", "path"))
    return judged.select(*names, "host", "path", F.col("_j.rule").alias("rule"), F.coalesce("_j.action", F.lit(default)).alias("verdict"))


def _joined(rows: DataFrame, rules: Sequence[tuple[str, str, str]], names: list[Column], default: str) -> DataFrame:
    """For rule lists too long to broadcast: equi-join on rule host, then the longest fitting path."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct()
    fits = urls.select("host", "path", F.explode(tails).alias("rule_host")).join(listed, "rule_host").where(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), order).alias("_j"))
    return rows.join(best, ["host", "path"], "left").select(*names, "host", "path", F.col("_j.rule").alias("rule"), F.coalesce("_j.action", F.lit(default)).alias("verdict"))
