"""robots.txt: parsing by windows, patterns as regular expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_LINE = r"(?i)^\s*(user-agent|disallow|allow|crawl-delay|sitemap)\s*:\s*(.*?)\s*$"


def rules(files: DataFrame, host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(host, line_no, agent, kind, value) of each rule of each file.

    Lines are exploded and grouped by windows over one host: user-agent lines in a row
    open one group, to which the rules after them belong.  A comment starts at the first
    ``#`` of a line or after a space.  Rules before any agent and empty patterns are dropped.
    """
    lines = files.select(F.col(host_col).alias("host"), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("line_no", "raw"))
    bare = F.regexp_replace("raw", r"(^|\s)#.*$", "")
    parsed = lines.select("host", "line_no", F.lower(F.regexp_extract(bare, _LINE, 1)).alias("kind"), F.regexp_extract(bare, _LINE, 2).alias("value")).where("kind <> ''")
    order = Window.partitionBy("host").orderBy("line_no")
    opens = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("group", F.sum(opens.cast("int")).over(order))
    agents = grouped.where("kind = 'user-agent' AND value <> ''").select("host", "group", F.lower("value").alias("agent")).distinct()
    own = grouped.where("kind IN ('disallow', 'allow', 'crawl-delay') AND value <> ''").join(agents, ["host", "group"])
    maps = grouped.where("kind = 'sitemap' AND value <> ''").select("host", "line_no", F.lit(None).cast("string").alias("agent"), "kind", "value")
    return own.select("host", "line_no", "agent", "kind", "value").union(maps)


def for_agent(parsed: DataFrame, agent: str = "bingbot") -> DataFrame:
    """Rules that hold for an agent: those of its own name if a host has any, else those of ``*``."""
    mine = parsed.where(F.col("agent").isin(agent.lower(), "*"))
    named = F.max((F.col("agent") == agent.lower()).cast("int")).over(Window.partitionBy("host"))
    return mine.withColumn("named", named).where((F.col("named") == 0) | (F.col("agent") == agent.lower())).drop("named")


def pattern_regex(pattern: Column) -> Column:
    """Regular expression of a path pattern: anchored at the start, ``*`` for any text, a final ``$`` for the end."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(ends, F.lit(r"\z")).otherwise(F.lit("")))


def pattern_matches(pattern: str, target: str) -> bool:
    """The same rule on plain strings, for tests and drivers."""
    body, ends = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
    return re.match("(?s:" + ".*".join(map(re.escape, body.split("*"))) + ")" + ends, target) is not None


@F.pandas_udf(BooleanType())
def _any_matches(target: pd.Series, patterns: pd.Series) -> pd.Series:
    def one(text: str | None, own: list[str] | None) -> bool | None:
        if text is None or own is None:
            return None
        return compiled(tuple(own)).match(text) is not None if len(own) else False

    return pd.Series([one(t, p) for t, p in zip(target, patterns, strict=True)], dtype="object")


@lru_cache(maxsize=10_000)
def compiled(patterns: tuple[str, ...]) -> re.Pattern[str]:
    """One expression that matches where any of the patterns does."""
    parts = [(p[:-1], r"\Z") if p.endswith("$") else (p, "") for p in patterns]
    return re.compile("(?s:" + "|".join(".*".join(map(re.escape, body.split("*"))) + end for body, end in parts) + ")")


def allowed(urls: DataFrame, agent_rules: DataFrame, host: Column, target: Column, excluded: list[str] | None = None) -> DataFrame:
    """URLs with ``robots_allowed``: false for ``/robots.txt`` of a host with rules and for a path that any disallow pattern meets; an allow never wins over it.

    Patterns are gathered per host, as many as its robots.txt has, and joined by host, so a
    URL is tested against its own host's patterns only.  They are one regular expression a host, compiled once a task
    and used in Arrow batches.  ``excluded`` adds patterns of the configuration to every host.
    """
    extra = F.array(*(F.lit(x) for x in excluded or [])).cast("array<string>")
    patterns = agent_rules.where("kind = 'disallow'").groupBy("host").agg(F.collect_set("value").alias("patterns"))
    known = agent_rules.select("host").distinct().join(patterns, "host", "left").select(F.col("host").alias("robots_host"), "patterns")
    joined = urls.withColumn("_host", host).withColumn("_target", target).join(known, F.col("_host") == F.col("robots_host"), "left")
    tests = F.concat(F.coalesce("patterns", F.array().cast("array<string>")), extra)
    blocked = F.when(F.size(tests) == 0, F.lit(False)).otherwise(_any_matches(F.col("_target"), tests))
    root = (F.col("robots_host").isNotNull() | (F.size(extra) > 0)) & (F.col("_target") == "/robots.txt")
    return joined.withColumn("robots_allowed", ~(blocked | root)).drop("_host", "_target", "robots_host", "patterns")


def crawl_delay(agent_rules: DataFrame, most: int = 5) -> DataFrame:
    """(host, delay): seconds between requests, 0 where it is no number, at most ``most``."""
    first = agent_rules.where("kind = 'crawl-delay'").groupBy("host").agg(F.min_by("value", "line_no").alias("value"))
    return first.select("host", F.least(F.coalesce(F.expr("try_cast(value AS int)"), F.lit(0)), F.lit(most)).alias("delay"))
