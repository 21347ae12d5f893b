"""Positional index of symbols, string table, point lookups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of one EDS that one task orders; longer ones are summed in two levels.
BUCKET = 1 << 16
#: Symbols of one bucket of the range join.
SPAN = 4096


def prefix_sums(rows: DataFrame, **sums: Column) -> DataFrame:
    """``rows`` (with eds_id and pos) and exclusive prefix sums by pos: within buckets of
    positions, then over the buckets' totals, so that one long EDS has many tasks."""
    rows = rows.withColumn("_bucket", F.floor(F.col("pos") / BUCKET))
    within = Window.partitionBy("eds_id", "_bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_eds").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("eds_id").alias("_eds"), F.col("_bucket").alias("_b")).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select("_eds", "_b", *(F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums))
    joined = rows.join(totals, (F.col("eds_id") == F.col("_eds")) & (F.col("_bucket") == F.col("_b")))
    for n, c in sums.items():
        joined = joined.withColumn(n, (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{n}")).cast("long"))
    return joined.drop("_bucket", "_eds", "_b", *(f"_{n}" for n in sums))


def index(symbols: DataFrame) -> DataFrame:
    """symbols with size, first_len, is_deg, cum_set, cum_common and cum_deg."""
    rows = symbols.withColumn("size", F.size("alts")).withColumn("first_len", F.length(F.col("alts")[0]["s"])).withColumn("is_deg", F.col("size") > 1)
    return prefix_sums(rows, cum_set=F.col("size"), cum_common=F.when(F.col("size") == 1, F.col("first_len")).otherwise(0), cum_deg=F.when(F.col("size") > 1, F.col("size")).otherwise(0))


def strings(symbols: DataFrame) -> DataFrame:
    """eds_id, pos, alt_no, string_id, s, len, src: a row each alternative."""
    rows = index(symbols).select("eds_id", "pos", "cum_set", F.posexplode("alts").alias("alt_no", "x"))
    return rows.select("eds_id", "pos", "alt_no", (F.col("cum_set") + F.col("alt_no")).alias("string_id"), F.col("x.s").alias("s"), F.length("x.s").alias("len"), F.col("x.src").alias("src"))


def read_symbol(symbols: DataFrame, pos: int) -> DataFrame:
    return symbols.where(F.col("pos") == pos)


def eds_statistics(symbols: DataFrame) -> DataFrame:
    lens = F.aggregate("alts", F.lit(0).cast("long"), lambda n, x: n + F.length(x["s"]))
    empty = F.size(F.filter("alts", lambda x: x["s"] == ""))
    rows = symbols.select("eds_id", F.size("alts").alias("k"), lens.alias("chars"), empty.alias("e"))
    one = F.when(F.col("k") == 1, F.col("chars"))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.groupBy("eds_id").agg(
        F.count("*").alias("n"), F.sum("k").cast("long").alias("m"), F.sum("chars").alias("n_chars"), F.count(F.when(F.col("k") > 1, 1)).alias("num_degenerate"),
        long(F.min(one)).alias("min_ctx"), long(F.max(one)).alias("max_ctx"), F.round(F.coalesce(F.avg(one), F.lit(0.0)), 6).alias("avg_ctx"), long(F.sum(one)).alias("common_chars"),
        long(F.sum(F.when(F.col("k") > 1, F.col("k") - 1))).alias("change_size"), F.sum("e").cast("long").alias("empty_strings"),
    )


def source_statistics(symbols: DataFrame) -> DataFrame:
    each = symbols.select("eds_id", F.explode("alts").alias("x")).select("eds_id", F.col("x.src").alias("src"))
    sizes = each.groupBy("eds_id").agg(F.max(F.size("src")).cast("long").alias("max_paths_per_string"), F.round(F.avg(F.size("src")), 6).alias("avg_paths_per_string"))
    paths = each.select("eds_id", F.explode("src").alias("p")).groupBy("eds_id").agg(F.countDistinct("p").alias("num_paths"))
    return paths.join(sizes, "eds_id")


def memory_estimate(stats: DataFrame) -> DataFrame:
    """Bytes that an engine with all strings, or with the index alone, would take."""
    full, index_only = F.expr("n_chars + 32 * m + 24 * n"), F.expr("17 * n + 4 * m + 64")
    return stats.select("eds_id", (full + F.floor(full / 5)).cast("long").alias("full_bytes"), (index_only + F.floor(index_only / 10)).cast("long").alias("index_bytes"))


def stats_verbose(stats: DataFrame) -> DataFrame:
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    return stats.select("eds_id", rate("m", "n").alias("strings_per_symbol"), rate("n_chars", "m").alias("chars_per_string"), F.round(100 * F.coalesce(F.try_divide(F.col("num_degenerate").cast("double"), F.col("n")), F.lit(0.0)), 6).alias("degenerate_percent"), F.when(F.col("min_ctx") < 5, "transform").otherwise("none").alias("advice"))


def extract(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """eds_id, qid, text, status of (eds_id, qid, pos, len, changes): the chosen strings of a
    range of symbols, clipped to the end."""
    n = symbols.groupBy("eds_id").agg(F.count("*").alias("n"))
    asked = queries.withColumnRenamed("pos", "p0").join(n, "eds_id").withColumn("count", F.greatest(F.least(F.col("n") - F.col("p0"), F.col("len")), F.lit(0)))
    spans = F.sequence(F.floor(F.col("p0") / SPAN), F.floor((F.col("p0") + F.col("count") - 1) / SPAN))
    held = symbols.withColumn("_bucket", F.floor(F.col("pos") / SPAN))
    hits = asked.select("eds_id", "qid", "p0", "count", "changes").where("count > 0").withColumn("_bucket", F.explode(spans))
    hits = hits.join(held, ["eds_id", "_bucket"]).where("pos >= p0 and pos < p0 + count")
    choice = F.get("changes", (F.col("pos") - F.col("p0")).cast("int"))
    s = F.when((choice < 0) | (choice >= F.size("alts")), F.lit(None)).otherwise(F.get("alts", choice)["s"])
    parts = F.array_sort(F.collect_list(F.struct("pos", s.alias("s"))))
    text = hits.groupBy("eds_id", "qid").agg(parts.alias("parts"))
    out = asked.join(text, ["eds_id", "qid"], "left")
    bad = F.exists(F.coalesce("parts", F.array().cast("array<struct<pos:bigint,s:string>>")), lambda x: x["s"].isNull())
    status = F.when((F.col("p0") < 0) | (F.col("p0") >= F.col("n")), "OUT_OF_RANGE").when(F.col("len") == 0, "OK").when(F.size("changes") != F.col("count"), "WRONG_COUNT").when(bad, "BAD_CHOICE").otherwise("OK")
    text = F.array_join(F.transform("parts", lambda x: x["s"]), "")
    return out.select("eds_id", "qid", status.alias("status"), F.when(status == "OK", F.coalesce(text, F.lit(""))).alias("text"))
