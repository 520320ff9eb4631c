"""URL rules indexed by their rarest literal token. DataFrame functions only.

A rule is a pattern ``host/path``: it fits that host and all its subdomains where the URL's path
starts with the rule's path (from its first slash on; ``*`` in the path stands for any characters).
Host labels, and path segments that end in a slash and hold no ``*``, are the rule's literal
tokens: any URL that the rule fits has them too. Every rule is indexed by the one of its tokens
that occurs in the fewest URLs of the table. A URL's tokens fetch candidate rules, and only those
run their regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules above this number are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens: labels as ``h:label``, closed path segments as ``p:segment``, and the token of rules without any."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    closed = F.regexp_extract_all(path, F.lit(r"(?<=/)[^/]+(?=/)"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x))))


def rule_table(rules: DataFrame) -> DataFrame:
    """``rule, verdict, regex, weight, tokens`` of ``rules(rule, verdict)``.

    The regular expression matches ``host + path``. Null rules are dropped and repeated ones count
    once, with the least verdict in text order.
    """
    rules = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    quoted = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), F.when(path == "", F.lit("(?:/|$)")).otherwise(F.regexp_replace(quoted(path), r"\*", ".*")))
    regex = F.when(host == "", F.concat(F.lit("(?s)^[^/]*"), F.regexp_replace(quoted(path), r"\*", ".*"))).otherwise(regex)
    literal = F.filter(_tokens(host, path), lambda x: (x != "") & (x != "h:") & ~x.contains("*"))
    return rules.select("rule", "verdict", regex.alias("regex"), F.length("rule").alias("weight"), F.when(F.size(literal) == 0, F.array(F.lit(""))).otherwise(literal).alias("tokens"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    The longest fitting rule decides (of equal lengths the first in text order); without one, rule
    is null and the verdict is ``default``. Null and malformed urls have an empty host and path and
    can only meet rules without a host. Rows that repeat stay repeated, null ids stay, other columns
    are ignored, and empty tables give the default verdict or an empty table.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    urls = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = rule_table(rules)
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    side = F.broadcast if small else lambda x: x
    found = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(side(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    priced = rules.select("rule", "verdict", "regex", "weight", F.explode("tokens").alias("token")).join(found, "token", "left")
    index = priced.groupBy("rule").agg(F.min_by(F.struct("token", "verdict", "regex", "weight"), F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r")).select("rule", "r.*")
    index = index.groupBy("token").agg(F.collect_list(F.struct("rule", "verdict", "regex", "weight")).alias("rules"))
    looked = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    subject = F.concat("host", "path")
    fits = F.filter("rules", lambda r: F.rlike(subject, r["regex"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct((-r["weight"]).alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (
        looked.join(side(index), "token", "left").withColumn("best", best)
        .groupBy("row", "page_id", "host", "path").agg(F.min("best").alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
