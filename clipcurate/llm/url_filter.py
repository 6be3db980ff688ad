"""URL filtering by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import LOWER, UPPER, free_name, materialize

#: Rules up to this many (of a few hundred bytes each) are broadcast to every task; with more, they are joined by token like
#: any table.
BROADCAST_RULES = 50_000
TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``rule`` names it; ``regex`` is matched against host + path; ``tokens`` are whole tokens that every match holds.

    Of the rules that fit, the highest ``rank`` wins, then the longest name, then the largest name.
    """

    rule: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int = 0


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def prefix_rule(text: str, action: str, rank: int = 1) -> Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the path."""
    host, _, path = text.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), "/" + path
    whole = re.findall(rf"{TOKEN}(?![0-9A-Za-z]|$)", path)  # a url's token may go on where the path ends
    return Rule(text, action, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", tuple(re.findall(TOKEN, host) + whole), rank)


def wildcard_rule(text: str, action: str, rank: int = 0) -> Rule:
    """``*`` stands for any characters, ``|`` for the start of a host or of a label in it, ``^`` for one character that is no
    letter or digit, or the end; the rest is literal and may stand anywhere. Only literal tokens with such a mark, or
    punctuation, on both sides are sure to be whole tokens of a url."""
    regex = "".join({"*": ".*", "|": "(?:^|\\.)", "^": "(?:[^0-9A-Za-z]|$)"}.get(c, _quoted(c)) for c in text)
    tokens = [m[1] for m in re.finditer(r"(?<=[^0-9A-Za-z*])([0-9A-Za-z]+)(?=[^0-9A-Za-z*])", text)]
    return Rule(text, action, regex, tuple(tokens), rank)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there to ``? #`` or the end.
    Null, or without ``://``: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _indexed(places: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """Each rule under the token of its own that the fewest urls hold, and the rules that have no token."""
    spark = places.sparkSession
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    words = spark.createDataFrame([(t,) for t in wanted], "token string")
    if len(wanted) <= BROADCAST_RULES:
        words = F.broadcast(words)
    counts = places.select(F.explode("tokens").alias("token")).join(words, "token").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()}  # no more rows than the rules have tokens
    rows = [(min((t.lower() for t in r.tokens), key=lambda t: (seen.get(t, 0), t)), r.rule, r.action, r.regex, r.rank) for r in rules if r.tokens]
    return spark.createDataFrame(rows, "token string, rule string, action string, regex string, rank int"), [r for r in rules if not r.tokens]


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with a struct column ``url_verdict`` (or see ``free_name``): host, path, rule (null if none fits), verdict.

    Each distinct host + path is split into tokens; a token fetches the rules indexed under it, and only these run their
    regular expression. Rules without a sure token are tried on every url. No rule fits: ``default``. Null and empty
    urls, and those without ``://``, have an empty host and path, which rules can fit only if they fit the empty text.
    Repeated rows are judged once and each returned; all other columns are returned as they are.
    """
    host, path = host_and_path(F.col(url))
    into = free_name(pages, "url_verdict")
    at = lambda c: F.col(into)[c]
    keyed = pages.withColumn(into, F.struct(host.alias("host"), path.alias("path")))
    places = keyed.select(F.concat(at("host"), at("path")).alias("place")).distinct()
    places = places.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.lower("place"), F.lit(TOKEN), F.lit(0))))
    index, loose = _indexed(places, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fetched = places.select("place", F.explode("tokens").alias("token")).join(index, "token").where(F.expr("regexp(place, regex)"))
    fits = fetched.select("place", F.struct("rank", F.length("rule").alias("n"), "rule", "action").alias("fit"))
    if loose:  # all in one pass
        each = [F.when(F.col("place").rlike(r.regex), F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.rule)).alias("n"), F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"))) for r in loose]
        fits = fits.unionByName(places.select("place", F.explode(F.array_compact(F.array(*each))).alias("fit")))
    best = materialize(fits.groupBy("place").agg(F.max("fit").alias("best")), "verdicts")  # so that a hot place's pages can be split
    verdict = F.struct(at("host").alias("host"), at("path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.col("best.rank").alias("rank"))
    joined = keyed.select(F.struct(*pages.columns).alias("page"), into).join(best, F.concat(at("host"), at("path")) == F.col("place"), "left")
    return joined.select("page.*", verdict.alias(into))
