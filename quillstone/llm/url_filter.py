"""URL filters by a sort-merge range join over reversed-host keys.

A rule's canonical key is its host with the labels reversed, then its path; the keys
under a rule form one interval. Each distinct url stands once for every suffix of its
host, so a rule for a domain meets its subdomains. Interval starts, ends and urls are
sorted together and swept: a start pushes its rule, an end pops back to the enclosing
rule (kept with the end), so a url reads the top of the stack. Of the rules found for
the suffixes of a url the longest wins (code points, then the longer host). Rules nest in
two ways, by host and by path: the suffixes of a host take the first, intervals of paths
the second, as one interval cannot hold both (a rule for a domain and a path lies apart
from the keys of its subdomains).

A host with a large share of all urls is spread by salting them; its rules alone are
repeated, once a salt. Equal urls are swept once. A null url, or one without ``://``, has an empty host and path and gets
the default verdict; so does a url that no rule fits. Urls may be of any length. Equal
rules count once, a block before an allow; a null rule, or one without ``/``, fits no url
and is left out. Ties of length go to the longer host. Empty tables are fine; columns of
pages named host, path, rule or verdict are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, keep, partitions

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def hot_hosts(stood: DataFrame, parts: int) -> DataFrame:
    """(_rev, _salts) of the hosts with more than one of 4 * parts shares of all rows: so at most 4 * parts rows."""
    counts = keep(stood.groupBy("_rev").agg(F.count("*").alias("_n")), "hosts")
    share = max(1, (counts.agg(F.sum("_n").alias("n")).first()["n"] or 0) // (4 * parts))
    return counts.filter(F.col("_n") > share).select("_rev", F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_salts"))


def rule_events(rules: DataFrame, hot: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals; an end carries the enclosing rule, as a stack does after a pop."""
    named = (
        rules.filter(F.contains("rule", F.lit("/"))).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("_b"))
        .withColumn("verdict", F.when(F.col("_b"), "block").otherwise("allow"))
        .withColumn("_path", F.expr("substring(rule, instr(rule, '/'))"))
        .withColumn("_rev", F.array_join(reversed_labels(ascii_lower(F.substring_index("rule", "/", 1))), "."))
        .withColumn("_rule", F.struct(F.length("rule").alias("n"), F.length("_rev").alias("h"), "rule", "verdict"))
        .select("_rev", "_path", "_rule")
    )
    # The enclosing rule: the longest proper prefix of the path that is a rule of the same host.
    inner = named.withColumn("_k", F.explode(F.sequence(F.lit(0), F.length("_path") - 1))).withColumn("_prefix", F.expr("left(_path, _k)"))
    outer = named.select("_rev", F.col("_path").alias("_prefix"), F.col("_rule").alias("_outer"))
    above = inner.join(outer, ["_rev", "_prefix"]).groupBy("_rev", "_path").agg(F.max("_outer").alias("_outer"))
    both = named.join(above, ["_rev", "_path"], "left")
    none = F.lit(None).cast("string")
    nothing = F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("h"), none.alias("rule"), none.alias("verdict"))
    path = F.col("_path").cast("binary")
    # Byte FF is part of no UTF-8 text, so an end comes after all that begin with the rule's path.
    events = F.array(
        F.struct(path.alias("key"), F.lit(0).alias("ord"), F.col("_rule").alias("top")),
        F.struct(F.concat(path, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("ord"), F.coalesce("_outer", nothing).alias("top")),
    )
    return (
        both.withColumn("_e", F.explode(events)).join(F.broadcast(hot), "_rev", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .select("_rev", "_salt", F.col("_e.key").alias("_key"), F.col("_e.ord").alias("_ord"), F.col("_e.top").alias("_top"), none.alias("_url"))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", parts: int | None = None) -> DataFrame:
    """Distinct urls that some rule fits, with the longest rule and its verdict. rules(rule 'host/path', verdict)."""
    named = urls.select(F.col(url_col).alias("_url")).filter(F.col("_url").contains("://")).distinct()
    labels = reversed_labels(host_of(F.col("_url")))
    stood = (
        named.select("_url", labels.alias("_l"), path_of(F.col("_url")).alias("_p"))
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_l"))))
        .withColumn("_rev", F.array_join(F.slice("_l", 1, F.col("_k")), "."))
    )
    hot = hot_hosts(stood, parts or partitions(urls.sparkSession))
    events = rule_events(rules, hot)
    salt = F.pmod(F.xxhash64("_url"), F.coalesce("_salts", F.lit(1))).cast("int")
    stood = stood.join(F.broadcast(hot), "_rev", "left").select(
        "_rev", salt.alias("_salt"), F.col("_p").cast("binary").alias("_key"), F.lit(1).alias("_ord"),
        F.lit(None).cast(events.schema["_top"].dataType).alias("_top"), "_url",
    )
    sweep = Window.partitionBy("_rev", "_salt").orderBy("_key", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(stood).withColumn("_top", F.last("_top", ignorenulls=True).over(sweep))
    best = swept.filter(F.col("_url").isNotNull() & F.col("_top.rule").isNotNull()).groupBy("_url").agg(F.max("_top").alias("_top"))
    return best.select("_url", F.col("_top.rule").alias("rule"), F.col("_top.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """Every row of pages with host, path, rule and verdict; columns of pages with those names are replaced."""
    clash = {"host", "path", "rule", "verdict"} - {url_col}
    kept = pages.select([c for c in pages.columns if c not in clash])
    judged = judge_urls(pages, rules, url_col, parts).withColumnRenamed("_url", "_quill_url")
    joined = kept.join(judged, F.col(url_col) == F.col("_quill_url"), "left").drop("_quill_url")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default))).withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
