"""Contiguous shards of near-equal bytes, from global prefix sums.

Documents stand in the order of (hash of the text, salt, doc_id). Sizes are summed per
(hash, salt), these per bucket of hashes, and the prefix sums of the bucket totals give
every document its place in the byte line, which is cut at equal targets. Equal texts
are neighbours: a group of at most ``whole_share`` of a shard is kept whole, a larger one
is cut like any other rows, or the sizes could not be near equal.

Defined cases: null text has no bytes and counts 1; repeated rows each take their place;
an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BUCKETS, SALTS = 1024, 256


def shard_by_bytes(docs: DataFrame, shards: int = 8, whole_share: float = 0.05) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = staged(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "sizes")
    # buckets follow the order of h, so that a bucket's rows are neighbours
    bucket = F.shiftright("h", 54) + F.lit(BUCKETS // 2)
    sums = rows.groupBy("h", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("b")).withColumn("bucket", bucket)
    totals = sums.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    starts = totals.select(F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"))
    total = totals.agg(F.sum("b")).first()[0] or 0
    within = Window.partitionBy("bucket").orderBy("h", "salt").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("bucket", "h")
    placed = sums.join(F.broadcast(starts), F.col("bucket") == F.col("_bucket"))
    placed = placed.withColumn("n0", F.col("_n0") + F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("b0", F.col("_b0") + F.coalesce(F.sum("b").over(within), F.lit(0)))
    placed = placed.select(F.col("h").alias("_h"), F.col("salt").alias("_salt"), "n0", "b0", F.min("b0").over(group).alias("g0"), F.sum("b").over(group).alias("gb"))
    own = Window.partitionBy("h", "salt").orderBy("doc_id")
    sofar = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.row_number().over(own) - 1).withColumn("kb", F.coalesce(F.sum("size").over(sofar), F.lit(0)))
    rows = rows.join(placed, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt")))
    middle = F.when(F.col("gb") * shards <= F.lit(whole_share * total), F.col("g0") + F.col("gb") / 2).otherwise(F.col("b0") + F.col("kb") + F.col("size") / 2)
    shard = F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    rows = staged(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("k")).alias("at")), "places")
    firsts = rows.groupBy("shard").agg(F.min("at").alias("first")).withColumnRenamed("shard", "_shard")  # one row a shard
    return rows.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
