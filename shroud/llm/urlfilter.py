"""Allow and block rules for URLs: longest match over host and path.

The rules form one trie: reversed host labels first, path segments below each
host. A small rule set goes to all tasks as that trie; a rule set above the
bound is joined by key instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for a null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class _Node:
    __slots__ = ("labels", "segments", "ends")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}


class UrlTrie:
    """Longest match: the rule with the most host labels, then the longest path.

    A rule's path is split at ``/``; all but its last part are whole segments
    below the host's node, the last part is a prefix of the next segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root = _Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, _Node())
            *whole, last = path.split("/")
            at = node
            for segment in whole:
                at = at.segments.setdefault(segment, _Node())
            if at.ends.get(last, ("", ""))[0] != "block":  # of two equal rules the block counts
                at.ends[last] = (verdict, host + path)

    def hosts(self, host: str) -> list[_Node]:
        """Nodes of the host and of all it is a subdomain of, longest first."""
        node, out = self.root, [self.root]
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            out.append(node)
        return [n for n in reversed(out) if n.segments or n.ends]

    @staticmethod
    def below(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in range(len(segment), -1, -1) if node.ends else ():
                if (found := node.ends.get(segment[:n])) is not None:
                    best = found
                    break
            node = node.segments.get(segment)
            if node is None:
                break
        return best

    def match(self, nodes: list[_Node], path: str) -> tuple[str, str] | None:
        segments = path.split("/")
        return next((m for node in nodes if (m := self.below(node, segments)) is not None), None)


def _judge(trie, default: str):
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t: UrlTrie = trie.value
        for hosts, paths in batches:
            seen: dict[str, list[_Node]] = {}
            rules, verdicts = [], []
            for host, path in zip(hosts, paths, strict=True):
                nodes = seen.get(host)
                if nodes is None:
                    nodes = seen[host] = t.hosts(host)
                found = t.match(nodes, path)
                rules.append(found and found[1])
                verdicts.append(found[0] if found else default)
            yield pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": pd.Series(verdicts, dtype=object)})

    return judge


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by equi-joins, for rule sets of any size: each distinct
    (host, path) looks up its host's suffixes with its path's prefixes of the
    lengths that rules have."""
    h, p, r, v = fresh(pages, "host", "path", "rule", "verdict")
    lengths = sorted(x[0] for x in rules.select(F.length("path")).distinct().collect())  # at most the longest path's length
    keys = pages.select("host", "path").distinct().withColumnsRenamed({"host": h, "path": p})
    labels = F.split(F.col(h), r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.when(F.col(h) != "", F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>")))
    tries = (keys.withColumn("s", F.explode(suffixes))
             .withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")))
             .where(F.col("n") <= F.length(p)).withColumn("prefix", F.expr(f"substring(`{p}`, 1, n)")))
    one = (rules.groupBy("host", "path").agg(F.max("verdict").alias(v)))  # 'block' > 'allow'
    hit = tries.join(one, (tries["s"] == one["host"]) & (tries["prefix"] == one["path"]))
    rank = F.struct(F.when(F.col("s") == "", 0).otherwise(F.size(F.split(F.col("s"), r"\."))), F.length("prefix"))
    best = hit.groupBy(h, p).agg(F.max_by(F.struct(F.concat("s", "prefix").alias("rule"), F.col(v).alias("verdict")), rank).alias(r))
    return (pages.join(best, (pages["host"] == best[h]) & (pages["path"] == best[p]), "left")
            .withColumns({"rule": F.col(f"{r}.rule"), "verdict": F.coalesce(F.col(f"{r}.verdict"), F.lit(default))}).drop(h, p, r))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow",
               max_trie_rules: int = 200_000) -> DataFrame:
    """``pages`` with ``host, path, rule`` (host and path of the rule that
    counts, else null) and ``verdict`` (the rule's, else ``default``).

    ``rules`` has ``verdict`` (allow or block), ``host``, ``path``. A rule fits its host
    and all subdomains if the URL's path starts with the rule's path; an empty
    host fits all. Most host labels win, then the longest path, then block.

    ``rules`` becomes a broadcast trie if it has ``max_trie_rules`` at most (a
    bound on what is collected; one row more is read to tell), else
    the verdicts come from joins.

    Defined cases: a null URL or one without ``://`` has an empty host and path
    and gets what rules for the empty host say, else the default; repeated rows
    are all judged; an empty table gives no rows; columns of ``pages`` named
    like the results are replaced."""
    spark = pages.sparkSession
    p = pages.drop("host", "path", "rule", "verdict") if url_col not in ("host", "path", "rule", "verdict") else pages
    p = p.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rules = rules.select("verdict", F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path"))
    small = rules.limit(max_trie_rules + 1).collect()
    if len(small) > max_trie_rules:
        return _by_join(p, rules, default)
    ship_package(spark)
    trie = spark.sparkContext.broadcast(UrlTrie([(r["verdict"], r["host"], r["path"]) for r in small]))
    judged = F.pandas_udf(_judge(trie, default), "rule string, verdict string")
    m, = fresh(p, "judged")
    return p.withColumn(m, judged("host", "path")).withColumns({"rule": F.col(f"{m}.rule"), "verdict": F.col(f"{m}.verdict")}).drop(m)
