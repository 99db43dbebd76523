"""URL filters: pattern rules behind an index of literal tokens.

Every rule is a host and a path prefix, ``*`` standing for any run of characters within a label or segment.  It is indexed
by the one of its literal tokens (host labels, whole path segments) that is rarest among the URLs at hand.  A URL's tokens
fetch the candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL has: host labels, and path segments that the rule itself ends."""
        labels = [f".{x}" for x in self.host.split(".")]
        segments = [f"/{x}" for x in self.path.split("/")[1:-1]]
        return [t for t in labels + segments if "*" not in t and len(t) > 1]

    def pattern(self) -> str:
        host = re.escape(self.host).replace(r"\*", "[^./]*")
        path = re.escape(self.path).replace(r"\*", "[^/]*")
        return rf"(?s)(?:[^/]*\.)?{host}{path}"


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: str, path: str) -> set[str]:
    return {f".{x}" for x in host.split(".")} | {f"/{x}" for x in path.split("/")}


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs (host, path) have each of the given tokens; the result is no longer than the list of tokens.

    Tasks count for themselves, so a token of all URLs moves as one row a task."""
    wanted = set(tokens)
    if not wanted:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for host, path in zip(batch["host"], batch["path"], strict=True):
                found.update(wanted & url_tokens(host, path))
        if found:
            yield pd.DataFrame({"token": list(found), "n": list(found.values())})

    counts = urls.mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list[tuple[str, str, str]]]:
    """Rarest token -> (pattern, rule text, verdict).  Rules without a literal token stand under None: every URL tries them."""
    index: dict[str | None, list[tuple[str, str, str]]] = {}
    for rule in rules:
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append((rule.pattern(), rule.text, rule.verdict))
    return index


def judge(
    df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_rules: int = 100_000
) -> DataFrame:
    """All rows with host, path, rule (the text of the longest fitting rule, else null) and verdict (else ``default``).

    Of equally long rules the first in the list wins.  A null or odd URL has an empty host and path, which no rule with a
    host fits.  No row moves: the rules are a parameter of at most ``max_rules`` entries and go with the tasks; the corpus
    is read once more for the token counts.  Columns of ``df`` that have the names of the new ones are replaced.
    """
    if len(rules) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    split = df.select(host_of(col(url).cast("string")).alias("host"), path_of(col(url).cast("string")).alias("path"))
    index = build_index(rules, token_counts(split, [t for r in rules for t in r.tokens()]))
    order = {rule.text: n for n, rule in reversed(list(enumerate(rules)))}

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def fitting(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = []
        for host, path in zip(hosts, paths, strict=True):
            place, best = host + path, None
            for token in (url_tokens(host, path) | {None}) & index.keys():
                for pattern, text, verdict in index[token]:
                    if re.match(pattern, place):
                        rank = (-len(text), order[text])
                        if best is None or rank < best[0]:
                            best = rank, text, verdict
            found.append((best[1], best[2]) if best else (None, default))
        return pd.DataFrame(found, columns=["rule", "verdict"])

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    address = df.select(*map(col, kept), host_of(col(url).cast("string")).alias("host"), path_of(col(url).cast("string")).alias("path"))
    made = address.withColumn("__judged", fitting("host", "path"))
    return made.select(*map(col, kept), "host", "path", F.col("__judged.rule").alias("rule"), F.col("__judged.verdict").alias("verdict"))
