"""URL filters by a trie over reversed host labels and path segments.

Rules are (host, path, verdict).  A rule fits its host and every subdomain
when the url's path starts with the rule's path; the deepest fitting rule
wins: more host labels first, then the longer path.  The trie is built from
the rules on the driver and broadcast; its size is that of the rule list,
checked against ``MAX_RULES`` (rules beyond it raise).

Defined cases: a null url, or one without ``://``, has an empty host and
path and fits no rule; no fitting rule gives a null rule and the default
verdict; repeated rules with one verdict count once, with two verdicts they
raise.  Host letters A-Z are lower-cased; a port or user part stays in the
host text.  Other columns pass through, except that earlier columns named
host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_RULES = 1_000_000
VERDICT = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])


class UrlTrie:
    """Nested dicts: host labels from the last to the first, then path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        n = 0
        for host, path, verdict in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, tail = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            found = node.setdefault("tails", {}).setdefault(tail, (f"{host}{path}", verdict))
            if found[1] != verdict:
                raise ValueError(f"two verdicts for {host}{path}")

    @staticmethod
    def _longest_path(node: dict, path: str):
        best = None
        for part in path.split("/"):
            fits = [tail for tail in node.get("tails", ()) if part.startswith(tail)]
            if fits:
                best = node["tails"][max(fits, key=len)]
            node = node.get("segments", {}).get(part)
            if node is None:
                break
        return best

    def match(self, host: str, path: str):
        """(rule, verdict) of the deepest fitting rule, or None."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._longest_path(node["paths"], path) or best
        return best


def host_column(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url",
               default: str = "allow") -> DataFrame:
    """``df`` plus host, path, rule and verdict; see the module text."""
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(VERDICT)
    def verdicts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    own = {"host", "path", "rule", "verdict"}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in own]
    return (df.select(*rest, host_column(F.col(f"`{url}`")).alias("host"), path_column(F.col(f"`{url}`")).alias("path"))
            .withColumn("_v", verdicts("host", "path"))
            .select(*rest, "host", "path", F.col("_v.rule").alias("rule"), F.col("_v.verdict").alias("verdict")))
