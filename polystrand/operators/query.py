"""Position queries: locate a common position, decode choices, match a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import intersect

#: Common positions of one bucket of the range join.
SPAN = 4096


def locate(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (eds_id, common_pos, ...) with the symbol ``start`` and ``offset`` that hold
    the common position, or nulls. A range join by buckets of positions."""
    common = index.where("size = 1 and first_len > 0").select(F.col("eds_id").alias("_eds"), F.col("pos").alias("start"), "cum_common", "first_len")
    spans = F.sequence(F.floor(F.col("cum_common") / SPAN), F.floor((F.col("cum_common") + F.col("first_len") - 1) / SPAN))
    common = common.withColumn("_bucket", F.explode(spans))
    asked = queries.withColumn("_b", F.floor(F.col("common_pos") / SPAN))
    on = (F.col("eds_id") == F.col("_eds")) & (F.col("_b") == F.col("_bucket")) & (F.col("common_pos") >= F.col("cum_common")) & (F.col("common_pos") < F.col("cum_common") + F.col("first_len"))
    return asked.join(common, on, "left").withColumn("offset", F.col("common_pos") - F.col("cum_common")).drop("_eds", "_bucket", "_b", "cum_common", "first_len")


def decode(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (eds_id, deg_no, ...) with the degenerate symbol ``pos`` and the alternative
    ``local`` of the deg_no-th string of degenerate symbols, or nulls."""
    each = index.where("is_deg").select(F.col("eds_id").alias("_eds"), "pos", "cum_deg", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("local"))
    each = each.withColumn("_no", F.col("cum_deg") + F.col("local")).drop("cum_deg")
    return queries.join(each, (F.col("eds_id") == F.col("_eds")) & (F.col("deg_no") == F.col("_no")), "left").drop("_eds", "_no")


def walk(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (eds_id, qid, common_pos, deg, pattern) with ``status`` and ``path``: the
    paths that all chosen strings share (null without sources)."""
    total = index.groupBy("eds_id").agg(F.max(F.col("cum_deg") + F.when(F.col("is_deg"), F.col("size")).otherwise(0)).alias("total"))
    asked = locate(index, queries).join(total, "eds_id", "left")
    # common characters do not decrease along a string, so a walk's symbols are in few buckets
    ahead = index.select("eds_id", "pos", "size", "alts", "cum_deg", "cum_common", F.floor(F.col("cum_common") / SPAN).alias("_bucket"))
    spans = F.sequence(F.floor((F.col("common_pos") - F.col("offset")) / SPAN), F.floor((F.col("common_pos") + F.length("pattern") - 1) / SPAN))
    on = asked.where("start is not null and pattern <> ''").withColumn("_bucket", F.explode(spans))
    on = on.join(ahead, ["eds_id", "_bucket"]).where("pos >= start and cum_common < common_pos + length(pattern)")
    symbols = F.array_sort(F.collect_list(F.struct("pos", "size", "alts", "cum_deg")))
    seen = on.groupBy("eds_id", "qid").agg(symbols.alias("symbols"))
    rows = asked.join(seen, ["eds_id", "qid"], "left")
    need = F.length("pattern")
    state = "struct<text:string,k:int,status:string,path:array<int>,first:boolean>"
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<int>").alias("path"), F.lit(True).alias("first")).cast(state)

    def step(acc, x):
        deg = x["size"] > 1
        choice = F.get("deg", acc["k"])
        local = (choice - x["cum_deg"]).cast("int")
        wrong = F.when(deg & choice.isNull(), "TOO_FEW_CHOICES").when(deg & ((choice < 0) | (choice >= F.col("total"))), "BAD_CHOICE").when(deg & ((local < 0) | (local >= x["size"])), "WRONG_SYMBOL")
        taken = F.get(x["alts"], F.when(deg & wrong.isNull(), local).otherwise(F.lit(0)))
        piece = F.when(acc["first"], F.substring(taken["s"], F.col("offset").cast("int") + 1, F.length(taken["s"]))).otherwise(taken["s"])
        path = F.when(acc["path"].isNull(), taken["src"]).otherwise(intersect(acc["path"], taken["src"]))
        status = F.coalesce(wrong, F.when(F.size(path) == 0, "NO_MATCH"))
        after = F.struct(F.concat(acc["text"], F.coalesce(piece, F.lit(""))).alias("text"), (acc["k"] + deg.cast("int")).alias("k"), status.alias("status"), path.alias("path"), F.lit(False).alias("first")).cast(state)
        return F.when(acc["status"].isNotNull() | (F.length(acc["text"]) >= need), acc).otherwise(after)

    end = F.aggregate("symbols", start, step)
    rows = rows.withColumn("_end", end)
    found = F.coalesce(F.col("_end.status"), F.when(F.substring(F.col("_end.text"), 1, need) == F.col("pattern"), "MATCH").otherwise("NO_MATCH"))
    status = F.when(F.col("total").isNull(), "NO_MATCH").when(F.col("pattern") == "", "MATCH").when(F.col("start").isNull(), "NO_MATCH").otherwise(found)
    return rows.select("eds_id", "qid", status.alias("status"), F.col("_end.path").alias("path"))


def check_position(index: DataFrame, queries: DataFrame) -> DataFrame:
    return walk(index, queries).select("eds_id", "qid", "status")
