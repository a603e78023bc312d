"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

URLs that a list of host and path rules judges are the labelled transactions: their tokens and the verdict. FP-growth
mines token combinations; those that imply a verdict with enough support and confidence, and that no part of
them implies as surely, are the learned rules. An inverted index from a rule's rarest token to the rule finds
the rules of a URL; URLs with the same tokens are judged once.

Tokens that occur in the very same labelled URLs (a host and those above it, say) would double the combinations with each of
them, though a combination with several of them is implied by its part with one. So one token stands for all of them while mining, and each
rule is then written out for every choice of one token of each class: the pruned rules are the same, and need not be mined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import written

MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.01, 0.7, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the queries.
RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host_: Column, path_: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule whose host is the URL's or above it and whose path begins the URL's; else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last that fits stands outermost
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Sorted distinct tokens: the host, each of its parents, its first label, path segments (digits as one #), names of query fields."""
    labels = F.split(host_, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.filter(F.split(F.regexp_replace(path_, r"\d+", "#"), "/"), lambda s: s != "")
    asked = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != "")
    parts = F.concat(
        F.when(host_ == "", F.array().cast("array<string>")).otherwise(F.concat(above, F.array(F.concat(F.lit("l:"), labels[0])))),
        F.transform(segments, lambda s: F.concat(F.lit("p:"), s)),
        F.transform(asked, lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))),
    )
    return F.array_sort(F.array_distinct(F.coalesce(parts, F.array().cast("array<string>"))))


def learn(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens array, verdict) -> rules: (rule_tokens, size, verdict, confidence, support), pruned.

    Repeated rows count as often; null tokens or verdicts teach nothing; of an empty table there are no rules. A rule goes if it has a verdict among its conditions, or if a rule with a part of its tokens says the same with no less confidence.
    """
    total = labelled.count()
    # tokens of the same URLs have the same number and sums of hashes; only frequent ones can be in a rule
    alike = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")).withColumns({"a": F.xxhash64("tokens", "verdict").cast("decimal(38,0)"), "b": F.xxhash64(F.lit(1), "tokens", "verdict").cast("decimal(38,0)")})
    seen = alike.select(F.explode("tokens").alias("token"), "n", "a", "b").groupBy("token").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= min_support * total)
    # no more than 1 / min_support tokens of a URL's length each can be frequent: a small table
    classes = written(seen.groupBy("n", "a", "b").agg(F.array_sort(F.collect_set("token")).alias("members")).select(F.col("members")[0].alias("token"), "members"))
    standing = labelled.withColumn("t", F.monotonically_increasing_id()).select("t", "verdict", F.explode("tokens").alias("token")).join(classes.select("token"), "token").groupBy("t", "verdict").agg(F.collect_set("token").alias("tokens"))
    transactions = written(standing.select(F.concat("tokens", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items")))
    if not (taking_part := transactions.count()):  # no token is frequent
        return labelled.sparkSession.createDataFrame([], "rule_tokens array<string>, size int, verdict string, confidence double, support double")
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(transactions).associationRules
    rules = found.where(F.col("consequent")[0].startswith("v:") & ~F.exists("antecedent", lambda t: t.startswith("v:"))).select(
        F.array_sort("antecedent").alias("rule_tokens"), F.size("antecedent").alias("size"), F.expr("substring(consequent[0], 3)").alias("verdict"), "confidence", "support"
    )
    rules = written(rules)
    # support and confidence are shares of all labelled URLs, of which some may have no frequent token
    rules = rules.withColumn("support", F.col("support") * F.lit(taking_part / total)).where(F.col("support") >= min_support * (1 - 1e-12))
    # a shorter rule is found by one token it shares; the parts of a rule are among the rules of its tokens
    part = rules.select(F.col("rule_tokens").alias("part"), F.col("size").alias("part_size"), "verdict", F.col("confidence").alias("part_confidence"), F.col("rule_tokens")[0].alias("token"))
    whole = rules.withColumn("token", F.explode("rule_tokens"))
    weaker = whole.join(part, ["token", "verdict"]).where((F.col("part_size") < F.col("size")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "rule_tokens")) == 0)).select("rule_tokens", "verdict").distinct()
    pruned = rules.join(weaker, ["rule_tokens", "verdict"], "left_anti").withColumn("rule", F.monotonically_increasing_id())
    held = written(pruned)
    choices = held.select("rule", F.explode("rule_tokens").alias("token")).join(classes, "token").groupBy("rule").agg(F.collect_list("members").alias("members"))
    every = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda done, next_: F.flatten(F.transform(done, lambda d: F.transform(next_, lambda t: F.concat(d, F.array(t))))))
    return written(held.join(choices, "rule").select(F.explode(every).alias("rule_tokens"), "size", "verdict", "confidence", "support").withColumn("rule_tokens", F.array_sort("rule_tokens")))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens array -> tokens, verdict: that of the most confident learned rule that fits (then support, then fewer tokens, then the tokens' order); none: no row. An empty table gives none."""
    held = rules.withColumn("rule", F.monotonically_increasing_id()).withColumn("token", F.explode("rule_tokens"))
    often = urls.select(F.explode("tokens").alias("token")).join(held.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    # a rule with a token that no URL has fits none; else it is found by its rarest token
    rarest = held.join(often, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"), *(F.first(c).alias(c) for c in ("rule_tokens", "verdict", "confidence", "support", "size")))
    index = rarest.where("r.n > 0").withColumn("token", F.col("r.token")).drop("r", "rule")
    hit = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", "support", -F.col("size"), "rule_tokens"))
    return hit.groupBy("tokens").agg(best.alias("learned"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """id_col, host, path, rule, verdict: one row per row. A listed rule decides first, then the learned ones, then `allow`.

    Null URLs and those without :// have an empty host and path and no tokens: `allow`. Repeated rows are judged alike. Without labelled URLs nothing is learned.
    """
    parsed = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "given": verdict, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    held = written(parsed.select(id_col, "host", "path", "rule", "given", "tokens"))
    labelled = held.where(F.col("given").isNotNull()).select("tokens", F.col("given").alias("verdict"))
    if labelled.isEmpty():
        return held.select(id_col, "host", "path", "rule", F.coalesce("given", F.lit(DEFAULT)).alias("verdict"))
    open_ = held.where(F.col("given").isNull()).select("tokens").distinct()
    learned = match(open_, learn(labelled, min_support, min_confidence))
    return held.join(learned, "tokens", "left").select(id_col, "host", "path", "rule", F.coalesce("given", "learned", F.lit(DEFAULT)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
