"""URL filters: pattern rules indexed by their rarest literal token.

A rule is (name, action, regex, tokens): a url can only match it if it holds all of the tokens. The index files a
rule under the one of its tokens that is rarest among the table's urls; a url's tokens fetch the few rules filed under
them and only those run their regular expression. A rule without tokens is tried on every url.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """name; action allow or block; regex over `host + path`; tokens that every match holds whole; precedence."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    weight: int = 0


def host_rule(name: str, action: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the url's path starts with the rule's; longer rules win.

    The path's last token may be cut off within a url's token, so only complete tokens are filed.
    """
    host, slash, path = name.partition("/")
    whole = _TOKEN.findall(host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(name, action, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tuple(whole), len(name))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns: both empty for a null or where there is no `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def token_counts(df: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """How many rows hold each of the rules' tokens; the answer has at most as many rows as there are tokens."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    toks = F.array_distinct(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+"))
    held = df.select(F.explode(F.array_intersect(toks, F.array(*map(F.lit, wanted)))).alias("t"))
    return {r.t: r.n for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule, verdict and n_tried (regular expressions that ran) to every row.

    Of the rules that match, the one with the greatest weight wins, then the smallest name; without a match, rule is
    null and verdict the default. Columns of these names that df has already are replaced. Rules are a driver-side
    list (a few thousand patterns); urls of any number and length are handled row by row, so no host is hot.
    """
    tune(df.sparkSession)
    base = df.drop("host", "path", "rule", "verdict", "n_tried")
    host, path = url_parts(F.col(url))
    base = base.withColumns({"host": host, "path": path})
    counts = token_counts(base, (t for r in rules for t in r.tokens))
    index: dict[str, list[Rule]] = {}
    always = [r for r in rules if not r.tokens]
    for r in rules:
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    compiled = {r: re.compile(r.regex, re.S) for r in rules}

    @F.pandas_udf("rule string, verdict string, n_tried int")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for h, p in zip(host, path, strict=True):
            whole = h + p
            cand = always + [r for t in set(_TOKEN.findall(whole.lower())) for r in index.get(t, ())]
            fits = [r for r in cand if compiled[r].search(whole)]
            best = min(fits, key=lambda r: (-r.weight, r.name), default=None)
            out.append((best.name if best else None, best.action if best else default, len(cand)))
        return pd.DataFrame(out, columns=["rule", "verdict", "n_tried"])

    j = base.withColumn("_j", judge("host", "path"))
    return j.select(*base.columns, "_j.rule", "_j.verdict", "_j.n_tried")
