"""URL filters: host and path rules, and token combinations mined from labels by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Fixed values of the contract: verdict, host, path.
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD = "=bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return T.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path, else null."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        found = found.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, each domain the host lies in, path parts, file ending, query keys, fragment.

    Digits become one token each run, so pages of a site share their tokens.
    """
    low = F.lower(F.coalesce(url, F.lit("")))
    labels = F.split(host, r"\.")
    domains = F.transform(
        labels, lambda _, i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))
    )
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, r"\d+", "#")))
    keys = F.transform(F.regexp_extract_all(low, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("q:"), k))
    rest = F.filter(
        F.array(
            F.concat(F.lit("s:"), F.regexp_extract(low, r"^([a-z]+)://", 1)),
            F.concat(F.lit("e:"), F.regexp_extract(low, r"\.([a-z]{2,5})(?:[?#]|$)", 1)),
            F.concat(F.lit("f:"), F.regexp_extract(low, r"#(.+)$", 1)),
        ),
        lambda t: F.length(t) > 2,
    )
    return F.array_sort(F.array_distinct(F.concat(domains, parts, keys, rest)))


def mine(
    labelled: DataFrame, support: float = 0.002, confidence: float = 0.75, least: int = 5, lift: float = 1.5
) -> DataFrame:
    """Rules (antecedent, confidence, support, key) that tell bad urls, from rows of (tokens, bad).

    FP-growth runs over all labelled rows. A rule must hold for a share `support` of them and at least `least` rows, with
    this confidence and a lift over the share of bad rows; a rule is dropped where one with fewer of the same tokens is
    as confident. `key` is the rarest token of the rule, its entry in the inverted index. The number of rules is bounded by
    the token combinations of a url divided by `support`, not by the number of urls. Without labels there are no rules.
    """
    spark = labelled.sparkSession
    rows = session.settle(
        labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "baskets"
    )
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, key string")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(rows)
    bad = model.associationRules.filter(F.array_contains("consequent", BAD) & (F.col("lift") >= lift))
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = session.settle(bad.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    rarest = (
        found.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token")
        .groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    )
    keyed = session.settle(found.join(rarest, "antecedent"), "rules")
    own = keyed.select(F.col("antecedent").alias("tokens"), F.col("confidence").alias("own"))
    shorter = _hits(own, keyed).filter((F.size("antecedent") < F.size("tokens")) & (F.col("confidence") >= F.col("own")))
    kept = keyed.join(shorter.select(F.col("tokens").alias("antecedent")).distinct(), "antecedent", "left_anti")
    return session.settle(kept, "rules")


def _hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a row and a rule all of whose tokens it has: rules are looked up by their key, then checked in full."""
    entries = rows.withColumn("key", F.explode("tokens"))
    return entries.join(rules, "key").filter(F.size(F.array_except("antecedent", "tokens")) == 0)


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, found: the most confident rule for each distinct token set that has one."""
    best = F.struct("confidence", "support", (-F.size("antecedent")).alias("size"), "antecedent")
    return _hits(rows.select("tokens").distinct(), rules).groupBy("tokens").agg(F.max(best).alias("found"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of pages whose document has a label. A page's document is the last number in its path; it is bad if
    any of its labels has quality 0 or toxic 1."""
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract("path", r"(\d{1,18})\D*$", 1)
    own = pages.select("tokens", F.when(number != "", number.cast("bigint")).alias("doc_id"))
    return own.join(bad.filter("doc_id is not null and bad is not null").hint("merge"), "doc_id").select("tokens", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules=BASE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the mined rule, or null), confidence; one row per page.

    A base rule decides where one fits; else a mined rule blocks; else the page is allowed. A null url, or one without ://,
    has an empty host and path, fits no rule, and is allowed unless a mined rule fits the tokens it has left. Rules are
    matched once for each distinct set of tokens, then joined back, so a host with a third of all pages costs one match.
    Repeated rows are judged alike. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("base", base_rule(F.col("host"), F.col("path"), rules))
    rows = session.settle(rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url"), "urls")
    mined = mine(labelled_pages(rows, labels))
    found = session.settle(matches(rows, mined), "matches")
    return rows.join(found, "tokens", "left").select(
        "page_id",
        "host",
        "path",
        F.col("base.rule").alias("rule"),
        F.coalesce("base.verdict", F.when(F.col("found").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("base").isNull(), F.col("found.antecedent")).alias("mined"),
        F.when(F.col("base").isNull(), F.col("found.confidence")).alias("confidence"),
    )
