"""Operator 3: URL filters by association rules, in Spark functions only.

A list of host and path rules judges the URLs that it covers.  For all others,
Spark's FP-growth mines combinations of URL tokens that come with a label: the
transactions are the distinct URLs' tokens plus ``block`` where a block rule of
the list judges the URL (allow-listed and unlisted URLs carry no label).
Combinations are kept if their support and confidence are high enough and no
smaller combination inside them is as confident.  They are matched by an
inverted index: a rule is posted under its rarest token, joined with the URL's
tokens, and then checked whole.  A URL that some rule fits is blocked.

Hosts are matched with the list the same way: every suffix of a distinct host
is looked up by an equi-join, so the list may be long.

Defined results: a null URL, or one without ``://``, has empty host and path
and is allowed; equal rule lengths: block goes before allow, then the smaller
rule string; every row gets a verdict, repeated ones too; without any blocked
URL to learn from, nothing but the list blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlint.llm.common import lower_ascii
from vectorlint.session import materialize

#: (verdict, host, path) rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: URLs that a combination must be seen in, however small the table.
MIN_URLS = 25
_LABEL = "\0block"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (list_verdict, rule_host, rule_path, rule)."""
    quoted = [", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in (a, h, p, h + p)) for a, h, p in rules]
    names = "list_verdict, rule_host, rule_path, rule"
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({q})' for q in quoted)} AS t({names})") if quoted else spark.sql("SELECT '' AS list_verdict, '' AS rule_host, '' AS rule_path, '' AS rule WHERE false")


def split_urls(urls: DataFrame) -> DataFrame:
    """Adds host and path to rows with ``url``."""
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")
    return (urls.withColumn("__rest", rest)
            .withColumn("host", lower_ascii(F.regexp_extract("__rest", "^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1)).drop("__rest"))


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, list_verdict): the longest rule of each distinct (url, host, path) that one fits."""
    hosts = urls.select("host").distinct().withColumn("labels", F.split("host", r"\."))
    suffix = F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, k, size(labels)), '.'))")
    fit = hosts.select("host", F.explode(suffix).alias("rule_host")).join(rules, "rule_host")
    best = F.max_by(F.struct("rule", "list_verdict"), F.struct(F.length("rule"), F.col("list_verdict") == "block", F.col("order")))
    ranked = fit.withColumn("order", F.hash("rule"))
    return (urls.select("url", "host", "path").join(ranked, "host").where("startswith(path, rule_path)")
            .groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.list_verdict"))


def url_tokens(urls: DataFrame) -> DataFrame:
    """(url, tokens): distinct tokens of scheme, host labels and host tail, path
    segments, extension, parameters and fragment."""
    return urls.selectExpr(
        "url",
        """array_distinct(filter(concat(
            array(concat('scheme:', lower(substring_index(url, '://', 1)))),
            transform(split(host, '[.]'), x -> concat('label:', x)),
            array(concat('site:', substring_index(host, '.', -2)), concat('top:', substring_index(host, '.', -1))),
            transform(split(path, '/'), x -> concat('segment:', lower(x))),
            array(concat('extension:', lower(regexp_extract(path, '[.]([A-Za-z0-9]{1,8})$', 1)))),
            transform(split(regexp_extract(url, '[?]([^#]*)', 1), '&'), x -> concat('parameter:', lower(x))),
            array(concat('fragment:', regexp_extract(url, '#([\\\\s\\\\S]*)$', 1)))),
            t -> NOT t RLIKE ':$')) AS tokens""")


def mine(labelled: DataFrame) -> DataFrame:
    """Pruned rules (rule_id, antecedent, first, confidence, support) from
    (tokens, blocked): ``first`` is the antecedent's rarest token."""
    baskets = labelled.select(F.expr(f"CASE WHEN blocked THEN array_append(tokens, '{_LABEL}') ELSE tokens END").alias("items")).where("size(items) > 0")
    n = baskets.count()
    support = max(MIN_SUPPORT, min(1.0, MIN_URLS / max(1, n)))
    model = FPGrowth(itemsCol="items", minSupport=support).fit(baskets)
    items = materialize(model.freqItemsets, "itemsets")
    label = F.array_contains("items", _LABEL)
    hits = items.where(label & (F.size("items") > 1)).select(F.sort_array(F.array_remove("items", _LABEL)).alias("antecedent"), F.col("freq").alias("hits"))
    every = hits.join(items.where(~label).select(F.sort_array("items").alias("antecedent"), "freq"), "antecedent")
    every = materialize(every.select("antecedent", F.size("antecedent").alias("size"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / max(1, n)).alias("support")), "antecedents")
    # By size: the best confidence inside a combination comes from the combinations with one token less, which are all there.
    level = every.where("size = 1").withColumn("inside", F.lit(0.0))
    levels = [level]
    for k in range(2, (every.agg(F.max("size")).first()[0] or 1) + 1):
        own = every.where(F.col("size") == k)
        less = own.select("antecedent", F.explode(F.expr("transform(antecedent, t -> array_remove(antecedent, t))")).alias("less"))
        below = level.select(F.col("antecedent").alias("less"), F.greatest("confidence", "inside").alias("c"))
        level = materialize(own.join(less.join(below, "less").groupBy("antecedent").agg(F.max("c").alias("inside")), "antecedent").select(*level.columns), "antecedents-by-size")
        levels.append(level)
    # Only what is more confident than all combinations inside it; all of that.
    rules = reduce(DataFrame.unionByName, levels).where(f"confidence >= {MIN_CONFIDENCE} AND confidence > inside").withColumn("rule_id", F.xxhash64("antecedent"))
    sizes = items.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("rule_id", F.explode("antecedent").alias("token")).join(sizes, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("m"))
    return rules.join(rarest, "rule_id").select("rule_id", "antecedent", F.col("m.token").alias("first"), "confidence", "support")


def mined_matches(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence): the most confident mined rule that fits each URL."""
    posted = tokens.select("url", "tokens", F.explode("tokens").alias("first")).join(rules, "first").where("size(array_except(antecedent, tokens)) = 0")
    return posted.groupBy("url").agg(F.max(F.struct("confidence", "support", "antecedent")).alias("m")).select("url", F.array_join("m.antecedent", " ").alias("mined"), F.col("m.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule that fits), confidence of every row."""
    listing = rule_table(pages.sparkSession, RULES if rules is None else rules)
    rows = pages.select("page_id", "url")
    urls = split_urls(rows.where("url IS NOT NULL").select("url").distinct())
    by_list = urls.join(listed(urls, listing), "url", "left")
    tokens = url_tokens(by_list).join(by_list.select("url", "rule", F.coalesce(F.col("list_verdict") == "block", F.lit(False)).alias("blocked")), "url")
    mined = mined_matches(tokens.where("rule IS NULL"), mine(tokens))
    found = by_list.join(mined, "url", "left").select(
        "url", "rule", F.coalesce("list_verdict", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "mined", "confidence")
    out = split_urls(rows).join(found, "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined", "confidence")
