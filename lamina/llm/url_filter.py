"""URL filters: rules for a host and its subdomains and for a path's beginning, matched by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, sized_join

#: Hex digits of a digest that the join is on; the whole digest confirms.
PREFIX = 8
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """verdict, host, path of each rule, as a DataFrame without Python behind it."""
    rows = F.array(*(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(("verdict", "host", "path"), r, strict=True))) for r in rules))
    return spark.range(1, numPartitions=1).select(F.inline(rows)) if rules else spark.range(0).select(*(F.lit(None).cast("string").alias(k) for k in ("verdict", "host", "path")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z in lower case) and path (then up to ? # or the end); both
    empty for null or without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (host and path of the rule that wins, else null) and verdict of each row.

    A url stands for the expressions host suffix x path prefix, of the lengths that rules have (their distinct label
    counts and path lengths are all that the driver gets of the rules). The expressions meet the rules by a short
    prefix of their digests, and the whole digest confirms. Of the rules that fit, the longest wins (host and path
    together); of equals that with the longer host, then a block. Without a rule the verdict is default.

    A null url, or one without ://, has host and path empty. A rule with a null part fits nothing. Null ids are
    kept; repeated rows give a row each; an empty table none, and no rules give default throughout. Other columns are
    left out."""
    rules = rules.where("verdict is not null and host is not null and path is not null").select("verdict", ascii_lower(F.col("host")).alias("host"), "path")
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("chars")).first()
    own = rules.select(_digest(F.col("host"), F.col("path")).alias("_digest"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict").alias("_found"))
    own = own.select(F.substring("_digest", 1, PREFIX).alias("_prefix"), F.col("_digest").alias("_whole"), "_found")

    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", "_url", host.alias("_host"), path.alias("_path"))
    numbers = lambda xs: F.array(*map(F.lit, sorted(xs))).cast("array<int>")
    labels = F.split("_host", r"\.")
    hosts = F.transform(F.filter(numbers(sizes["labels"]), lambda k: k <= F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    paths = F.transform(F.filter(numbers(sizes["chars"]), lambda k: k <= F.length("_path")), lambda k: F.substring(F.col("_path"), F.lit(1), k))
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(h, p))))
    each = parts.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), digests)).alias("_expression"))
    each = each.withColumn("_prefix", F.substring("_expression", 1, PREFIX))
    met = sized_join(each, own, ["_prefix"], "left").withColumn("_found", F.when(F.col("_expression") == F.col("_whole"), F.col("_found")))
    best = met.groupBy("_id", "_url", "_host", "_path").agg(F.max("_found").alias("_found"), F.count(F.when(F.col("_expression").isNull(), 1)).alias("_rows"))
    rows = best.select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))  # repeated rows
    return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))
