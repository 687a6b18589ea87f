"""URL filter: rules on hosts and paths, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bloom import bloom_filter, may_hold
from groundwork.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, ``www.`` or ``m.``, default port, query, fragment, ``.html`` and last slash.

    Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    return F.when(host != "", F.concat(host, path))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of rules of one length the one with the longer host."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        label = F.lit(rule.host + rule.path)
        name = F.when(fits, label) if name is None else name.when(fits, label)
        verdict = F.when(fits, F.lit(rule.verdict)) if verdict is None else verdict.when(fits, F.lit(rule.verdict))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``listed`` has one column of URLs, in any spelling. A rule decides where one fits. Else a URL is blocked if its
    canonical form is that of a listed one: the Bloom filter, which has a fixed size, passes possible hits, and only
    those are joined with the list. A null URL or one without ``://`` has empty host and path and is allowed;
    null URLs in the list are ignored, repeated ones count once.
    """
    url = F.col(f"`{url_col}`")
    listed = listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("listed_key")).where(
        "listed_key IS NOT NULL")
    bloom = written(bloom_filter(listed, "listed_key"), "url-bloom")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        canonical(url).alias("key"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = may_hold(rows.select("*", rule.alias("rule"), verdict.alias("verdict")), bloom, "key")
    open_rows = F.col("verdict").isNull() & F.col("bloom_hit") & F.col("key").isNotNull()
    names = ["id", "host", "path", "rule", "verdict"]
    sure = rows.where(~open_rows).select(*names[:4], F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    # Every listed URL once, so that the join repeats no page.
    exact = written(listed.distinct(), "listed-urls")
    maybe = rows.where(open_rows).join(exact, F.col("key") == F.col("listed_key"), "left").select(
        *names[:4], F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return sure.unionByName(maybe).withColumnRenamed("id", id_col)
