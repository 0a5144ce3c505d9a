"""URL filters: a broadcast trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and every subdomain of it, for
paths that start with the rule's path (as text). Of the rules that fit, the
longest (host and path together, then host) wins over all others; between an
allow and a block rule of the same host and path, block wins. A url that no
rule fits gets the default verdict.

Null urls, and urls without ``://``, have an empty host and path: no rule fits
them. Every input row gives one output row; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000  # the broadcast trie holds at most so many rules


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


class Trie:
    """Nodes are dicts: host labels from the right, then path segments.

    Under a host node the key ``("/",)`` opens the path part. A path node's
    key is a whole segment; the last, possibly partial segment of a rule is
    stored as an ending ``(rest, rank, rule, verdict)`` to be met by prefix.
    """

    HOST, ENDS, PATH = "h", "e", "p"

    def __init__(self, rules):
        self.root: dict = {}
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES}")
        for verdict, host, path in rules:
            host = host.lower()
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(self.HOST, {}).setdefault(label, {})
            *segments, last = path.split("/")
            for s in segments:
                node = node.setdefault(self.PATH, {}).setdefault(s, {})
            rank = (len(host) + len(path), len(host), verdict == "block")
            node.setdefault(self.ENDS, []).append((last, rank, host + path, verdict))

    def match(self, host: str, path: str):
        """The rule and verdict of the longest fit, or ``(None, None)``."""
        best = None
        node = self.root
        segments = path.split("/")
        if not host:
            return None, None
        for label in reversed(host.split(".")):
            node = node.get(self.HOST, {}).get(label)
            if node is None:
                break
            at = node
            for i, s in enumerate(segments):
                for last, rank, rule, verdict in at.get(self.ENDS, ()):
                    # the rest of the path begins with the rule's last, partial segment
                    if s.startswith(last) and (best is None or rank > best[0]):
                        best = (rank, rule, verdict)
                at = at.get(self.PATH, {}).get(s) if i + 1 < len(segments) else None
                if at is None:
                    break
        return (best[1], best[2]) if best else (None, None)


def filter_urls(df: DataFrame, rules, url_col: str = "url", keep: tuple[str, ...] = (),
                default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict for each row of ``df``.

    ``rules``: ``(verdict, host, path)`` triples, at most ``MAX_RULES``.
    """
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype="object")

    src = df.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return src.withColumn("_j", judge("host", "path")).select(
        *keep, "host", "path", F.col("_j.rule").alias("rule"),
        F.coalesce(F.col("_j.verdict"), F.lit(default)).alias("verdict"))
