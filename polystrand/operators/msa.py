"""Alignments to EDS: rows are (msa_id, seq_no from 1, seq), of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import ALTS


def parse(texts: DataFrame) -> DataFrame:
    """(msa_id, seq_no, name, seq) of (msa_id, text): FASTA records, lines joined."""
    records = F.filter(F.split("text", "(?:^|\n)>"), lambda r: F.trim(r) != "")
    rows = texts.select("msa_id", F.posexplode(records).alias("k", "r"))
    return rows.select("msa_id", (F.col("k") + 1).alias("seq_no"), F.trim(F.substring_index("r", "\n", 1)).alias("name"), F.regexp_replace(F.regexp_replace("r", "^[^\n]*", ""), r"\s", "").alias("seq"))


def regions(rows: DataFrame, least: int = 0) -> DataFrame:
    """msa_id, region, first (column, from 0), len, common. With ``least`` the runs of common
    columns that are shorter, and touch neither end, belong to the region around them."""
    cells = rows.select("msa_id", "seq_no", F.posexplode(F.split("seq", "")).alias("col", "ch")).where("ch <> ''")
    same = (F.min("ch") == F.max("ch")) & (F.min("ch") != "-")
    # of a single sequence all columns are common: its gaps go with the text
    columns = cells.groupBy("msa_id", "col").agg((same | (F.count("*") == 1)).alias("common"))
    by, every = Window.partitionBy("msa_id").orderBy("col"), Window.partitionBy("msa_id")
    edge = F.coalesce((F.col("common") != F.lag("common").over(by)).cast("int"), F.lit(1))
    columns = columns.withColumn("run", F.sum(edge).over(by)).withColumn("last", F.max("col").over(every))
    runs = columns.groupBy("msa_id", "run").agg(F.min("col").alias("first"), F.max("col").alias("end"), F.first("common").alias("common"), F.first("last").alias("last"))
    alone = F.col("common") & ((F.col("end") - F.col("first") + 1 >= least) | (F.col("first") == 0) | (F.col("end") == F.col("last")))
    runs = runs.withColumn("alone", alone if least else F.lit(True))
    of = Window.partitionBy("msa_id").orderBy("run")
    starts = F.col("alone") | F.coalesce(F.lag("alone").over(of), F.lit(True))
    runs = runs.withColumn("region", F.sum(starts.cast("int")).over(of) - 1)
    return runs.groupBy("msa_id", "region").agg(F.min("first").alias("first"), (F.max("end") - F.min("first") + 1).alias("len"), F.bool_and(F.col("common") & F.col("alone")).alias("common"))


def to_symbols(rows: DataFrame, least: int = 0) -> DataFrame:
    """Symbols: a common region's text with the universal source, or the distinct gapless
    texts of a region in order of first appearance with the rows that have them."""
    cut = F.regexp_replace(F.expr("substring(seq, first + 1, len)"), "-", "")
    parts = regions(rows, least).join(rows, "msa_id").select("msa_id", "region", "common", "seq_no", cut.alias("s"))
    pooled = parts.groupBy("msa_id", "region", "common", "s").agg(F.min("seq_no").alias("first"), F.array_sort(F.collect_set(F.col("seq_no").cast("int"))).alias("rows"))
    src = F.when(F.col("common"), F.array(F.lit(0))).otherwise(F.col("rows"))
    alts = F.array_sort(F.collect_list(F.struct("first", "s", src.alias("src"))))
    out = pooled.groupBy("msa_id", "region").agg(alts.alias("alts"))
    return out.select(F.col("msa_id").alias("eds_id"), F.col("region").cast("long").alias("pos"), F.transform("alts", lambda x: F.struct(x["s"].alias("s"), x["src"].alias("src"))).cast(ALTS).alias("alts"))
