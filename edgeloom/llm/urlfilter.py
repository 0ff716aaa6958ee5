"""URL filter: a trie over reversed host labels and path segments.

Rules are (action, host, path). A rule fits its host and all subdomains where
the url's path starts with the rule's path, letter by letter. Among fitting
rules the one with the most host labels wins, then the longest path; of two
equal rules block wins over allow. A url that no rule fits gets ``default``.

The trie travels to the executors only while the rules' serialised size stays
within ``broadcast_bytes``; beyond it ``judge_urls`` joins the host suffixes and
path prefixes of each url with the rule table instead, to the same result.

Defined cases: host and path of a null url, or one without "://", are empty
strings and fit no rule; an empty rule list gives the default throughout; repeated rows
are judged one by one; other columns pass through unless named as an output.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # action, host, path


def url_host(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the right, then path segments; the last segment of a rule is a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            known = node.setdefault("ends", {}).get(last)
            if known is None or action == "block":
                node["ends"][last] = (action, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the best fitting rule."""
        if not host:
            return None
        chain, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            chain.append(node)
        segments = path.split("/")
        for node in reversed(chain):
            found = self._path(node, segments)
            if found:
                return found
        return None

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for depth, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                # The rest of the path from here on starts with what the rule ends in.
                for length in range(len(segment), -1, -1):
                    hit = ends.get(segment[:length])
                    if hit:
                        found = hit
                        break
            node = node.get("paths", {}).get(segment)
            # A whole segment of a rule is followed by a slash in the url.
            if node is None or depth + 1 == len(segments):
                break
        return found


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    default: str = "allow",
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (allow or block)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    located = pages.select(*kept, url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path"))
    blob = pickle.dumps(Trie(rules).root)
    if len(blob) > broadcast_bytes:
        return _judge_by_join(located, kept, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(blob)

    @F.pandas_udf("rule string, action string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie([])
        trie.root = pickle.loads(shared.value)
        for hosts, paths in batches:
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [f[1] for f in found], "action": [f[0] for f in found]}, dtype=object)

    judged = located.withColumn("_match", match("host", "path"))
    return judged.select(
        *kept, "host", "path", F.col("_match.rule").alias("rule"), F.coalesce(F.col("_match.action"), F.lit(default)).alias("verdict")
    )


def _judge_by_join(located: DataFrame, kept: list[str], rules: list[Rule], default: str) -> DataFrame:
    """Host suffixes x path prefixes of the lengths that occur in rules, joined by equality.

    The best rule is found once per distinct (host, path) and joined back.
    """
    spark = located.sparkSession
    known = spark.createDataFrame(rules, "action string, r_host string, r_path string")
    known = known.groupBy("r_host", "r_path").agg(F.max(F.struct(F.expr("action = 'block'").alias("b"), "action")).alias("m")).select("r_host", "r_path", "m.action")
    lengths = sorted({len(p) for _, _, p in rules})
    targets = located.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    tried = targets.select("host", "path", F.explode(suffixes).alias("r_host"), prefixes.alias("p")).select("host", "path", "r_host", F.explode("p").alias("r_path"))
    rank = F.struct(F.size(F.split("r_host", r"\.")).alias("h"), F.length("r_path").alias("p"), F.concat("r_host", "r_path").alias("rule"), "action")
    best = tried.join(known, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    joined = located.join(best, ["host", "path"], "left")
    return joined.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
