"""URL filtering by pattern rules indexed by their rarest literal token, in DataFrame functions only.

Each rule is a regular expression with the literal tokens that every URL it fits must contain; a URL's tokens are also
taken without the digits at their end, for rules that leave a number open. Spark counts, over all URLs, the tokens that
rules name; a rule is filed under the rarest of its own. Each URL's tokens then fetch candidate rules from that index,
and only those candidates run their regular expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a filter may have: the index is broadcast, and stays small by this bound.
MAX_RULES = 100_000
#: Host and path rules in the order of the contract: verdict and rule (fixed values).
BASE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Further pattern rules: verdict, expression on host + path, and its literal tokens.
PATTERN_RULES = (
    ("block", r"(^|\.)spam-[^./]*\.", ("spam",)),
    ("block", r"(^|[.-])(cheap|discount)-pills\.", ("pills",)),
    ("block", r"(^|[./-])casino[./-]", ("casino",)),
    ("block", r"^ad\d*\.", ("ad",)),
    ("block", r"^ads\d*\.", ("ads",)),
    ("block", r"/(wp-login|xmlrpc)\.php(?![\s\S])", ("php",)),
)


@dataclass(frozen=True)
class Rule:
    """base: the host and path rule that it stands for, else None. The longer base rule wins, and any before the others."""

    verdict: str
    regex: str
    tokens: tuple[str, ...]
    base: str | None = None


def base_rule(verdict: str, text: str) -> Rule:
    """A rule of host and path: fits the host and its subdomains, if the path starts with the rule's path."""
    host, _, path = text.partition("/")
    # the last token of the path may go on in a URL, so it is no whole token unless a delimiter ends it
    whole = re.findall(r"[a-z0-9]+", host) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", "/" + path)]
    return Rule(verdict, f"^([^/]*\\.)?{re.escape(host)}/{re.escape(path)}".replace("\\/", "/"), tuple(whole), text)


def default_rules() -> list[Rule]:
    return [base_rule(*r) for r in BASE_RULES] + [Rule(*r) for r in PATTERN_RULES]


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty if there is none."""
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ://."""
    # the atomic group holds on to the first ://, so that one in the query is not tried
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, fetched, fitted.

    The longest base rule that fits decides; else any fitting pattern rule that blocks; else the URL is allowed. rule
    is that base rule or null. fetched counts the candidate rules that a URL's tokens brought up, fitted those that fit.
    Null URLs and URLs without :// have empty host and path and are allowed. Repeated rows are judged each for itself.
    Other columns are not read; an empty table gives an empty result. rules must not be more than MAX_RULES.
    """
    spark, rules = pages.sparkSession, default_rules() if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    # the higher number wins: base rules by length above pattern rules, and among these blocks above allows
    ranked = sorted(rules, key=lambda r: (r.base is not None, len(r.base or ""), r.verdict == "block"))
    fields = [{"number": i + 1, "verdict": r.verdict, "regex": r.regex, "tokens": r.tokens, "base": r.base} for i, r in enumerate(ranked)]
    kind = "array<struct<number:int,verdict:string,regex:string,tokens:array<string>,base:string>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(fields)), kind)))
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    words = F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+")
    stems = F.transform(words, lambda t: F.regexp_replace(t, "[0-9]+$", ""))
    tokens = F.array_distinct(F.filter(F.concat(words, stems), lambda t: t != ""))
    tokened = parts.select("page_id", "url", "host", "path", F.explode_outer(F.concat(F.array(F.lit("")), tokens)).alias("token"))
    named = table.select(F.explode("tokens").alias("token")).distinct()
    counts = tokened.select("token").join(F.broadcast(named), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # a rule's rarest token over all URLs
    filed = table.select("number", "verdict", "regex", "base", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = filed.groupBy("number", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    fetched = tokened.join(F.broadcast(index), "token", "left")
    fits = F.when(F.col("regex").isNotNull(), F.regexp_like(F.concat("host", "path"), F.col("regex"))).otherwise(False)
    # partial sums inside each task: a URL that very many rows share is no hot group
    best = fetched.groupBy("page_id", "url", "host", "path").agg(
        F.max(F.when(fits, F.col("number"))).alias("number"),
        F.sum((F.col("token") == "").cast("long")).alias("copies"),
        F.sum(F.col("regex").isNotNull().cast("long")).alias("fetched"),
        F.sum(fits.cast("long")).alias("fitted"),
    )
    decided = best.join(F.broadcast(table.select("number", "verdict", "base")), "number", "left")
    each = decided.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    per_copy = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("fetched", "fitted")]
    return each.select("page_id", "host", "path", F.col("base").alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"), *per_copy)


#: The contract in other words: positions instead of expressions, and a table of rules of which the longest that fits wins.
ORACLE = r"""
WITH rules (verdict, rule) AS (
  VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
rest AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
host_end AS (
  SELECT k, page_id, s, list_min([p for p in [strpos(s, '/'), strpos(s, '?'), strpos(s, '#'), length(s) + 1] if p > 0]) AS h FROM rest),
tail AS (
  SELECT k, page_id, translate(substr(s, 1, h - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(s, h) AS t FROM host_end),
parts AS (
  SELECT k, page_id, host, substr(t, 1, list_min([p for p in [strpos(t, '?'), strpos(t, '#'), length(t) + 1] if p > 0]) - 1) AS path FROM tail),
fits AS (
  SELECT k, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
    WHEN regexp_matches(host || path, '(^|\.)spam-[^./]*\.') THEN 'block'
    WHEN contains(host || path, 'cheap-pills.') AND regexp_matches(host || path, '(^|[.-])cheap-pills\.') THEN 'block'
    WHEN contains(host || path, 'discount-pills.') AND regexp_matches(host || path, '(^|[.-])discount-pills\.') THEN 'block'
    WHEN regexp_matches(host || path, '(^|[./-])casino[./-]') THEN 'block'
    WHEN regexp_full_match(split_part(host, '.', 1), 'ads?[0-9]*') AND contains(host, '.') THEN 'block'
    WHEN ends_with(path, '/wp-login.php') OR ends_with(path, '/xmlrpc.php') THEN 'block'
    ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (k)
"""
