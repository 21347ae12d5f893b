"""URL filters: association rules over URL token combinations, mined from labelled URLs.

FP-growth finds frequent combinations of tokens and a label; rules with enough support and
confidence stay. An inverted index files each rule under its rarest token: a URL fetches
the rules of its tokens, drops those whose other tokens it lacks, and takes the verdict of
the most confident one left. DataFrame expressions only.

Defined cases: a null URL, or one without ``://``, has empty host and path and no tokens of
them; a URL that no rule fits is allowed; of rules that fit alike the one of more confidence,
support, tokens and then the later verdict by name is taken; URLs of any length are read
whole; repeated rows, and rows without a page_id, are judged each; other columns of any name
take no part; an empty table, or one without labels, gives no rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Given rules as (rule, verdict); host before the first slash, path from it on.
GIVEN = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SUPPORT, CONFIDENCE, LONGEST = 0.01, 0.75, 3
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels by their place from the end, path
    segments (numbers alike) and names of the query."""
    labels = F.reverse(F.split(host, r"\."))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    segments = F.transform(F.split(F.lower(path), "[/._-]+"), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(F.lower(query), "[&;]"), lambda x: F.concat(F.lit("q="), F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    every = F.concat(scheme, placed, segments, names)
    return F.coalesce(F.array_distinct(F.filter(every, lambda x: F.length(x) > F.instr(x, "="))), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """Rules (rule_id, needs, verdict, confidence, support) from rows (tokens, verdict)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= longest))
    rules = rules.select(F.array_sort("antecedent").alias("needs"), F.substring(F.col("consequent")[0], 2, 64).alias("verdict"), "confidence", "support").where(~F.exists("needs", lambda x: x.startswith("=")))
    return staged(rules.withColumn("rule_id", F.xxhash64("needs", "verdict")), "rules")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (key columns and ``tokens``) with the verdict of the best rule that fits, for
    those that some rule fits."""
    # a rule is filed under its token that fewest rules need
    uses = rules.select(F.explode("needs").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    spread = rules.select("*", F.explode("needs").alias("token")).join(uses, "token")
    filed = spread.groupBy("rule_id").agg(F.min(F.struct("uses", "token"))["token"].alias("token"), F.first("needs").alias("needs"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    asked = urls.select("page_key", "tokens", F.explode("tokens").alias("token"))
    fits = asked.join(filed, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("needs").alias("n"), "verdict"))["verdict"]
    return fits.groupBy("page_key").agg(best.alias("mined"))


def filter_urls(pages: DataFrame, given: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict: the given rules decide where they fit, and are
    the labels that the rules for all other URLs are mined from."""
    given = GIVEN if given is None else given
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("own", given_rule(F.col("host"), F.col("path"), given)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    # equal token sets are judged once
    rows = staged(rows.select("page_id", "host", "path", "own", "tokens", F.xxhash64("tokens").alias("page_key")), "urls")
    rules = mine(rows.where("own is not null").select("tokens", F.col("own.verdict").alias("verdict")))
    open_rows = rows.where("own is null").groupBy("page_key").agg(F.first("tokens").alias("tokens"))
    # written, so that the pages of a hot key are split and not read beside an aggregation
    judged = staged(judge(open_rows, rules).select(F.col("page_key").alias("_key"), "mined"), "judged")
    out = rows.join(judged, F.col("page_key") == F.col("_key"), "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "mined", F.lit(DEFAULT)).alias("verdict"))
