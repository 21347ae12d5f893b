"""Strings, alignments and variants derived from the star schema, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.algebra import ALTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(x: Column) -> Column:
    return F.substring(F.lit("ACGT"), (F.pmod(x, F.lit(4)) + 1).cast("int"), F.lit(1))


def dna(x: Column, length: Column, digits: int = 4) -> Column:
    """The first ``length`` of the base-4 digits of x, the lowest first, as letters."""
    return F.substring(F.concat(*(base(F.floor(x / 4**i)) for i in range(digits))), F.lit(1), length.cast("int"))


def order_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, o, and the alternatives of each order, by line number."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.groupBy(F.col("o_custkey").alias("c"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln")).agg(F.min("l_partkey").alias("pk"), F.array_sort(F.collect_set((F.col("l_suppkey") % 8 + 1).cast("int"))).alias("src"))
    one = F.struct("ln", dna(F.col("pk"), F.col("pk") % 5).alias("s"), "src")
    return lines.groupBy("c", "o").agg(F.array_sort(F.collect_list(one)).alias("x"))


def eds_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string a customer, a symbol an order, an alternative a line."""
    rows = order_alternatives(spark, sf_dir)
    src = lambda a: F.when(F.size("x") == 1, F.array(F.lit(0))).otherwise(a["src"])
    alts = F.transform("x", lambda a: F.struct(a["s"].alias("s"), src(a).alias("src"))).cast(ALTS)
    pos = F.row_number().over(Window.partitionBy("c").orderBy("o")) - 1
    return rows.select(F.col("c").cast("string").alias("eds_id"), pos.cast("long").alias("pos"), alts.alias("alts"))


def eds_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two or more lines, the first two as alternatives, a separator before each."""
    rows = order_alternatives(spark, sf_dir).where(F.size("x") >= 2)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("o")) - 1)
    sep = F.array(F.struct(dna(F.col("o"), F.col("o") % 8, 8).alias("s"), F.array(F.lit(0)).alias("src"))).cast(ALTS)
    second = F.when(F.col("o") % 2 == 0, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    two = F.array(F.struct(F.col("x")[0]["s"].alias("s"), F.array(F.lit(1), F.lit(2)).alias("src")), F.struct(F.col("x")[1]["s"].alias("s"), second.alias("src"))).cast(ALTS)
    pair = F.posexplode(F.array(sep, two)).alias("h", "alts")
    return rows.select("c", "k", pair).select(F.col("c").cast("string").alias("eds_id"), (2 * F.col("k") + F.col("h")).cast("long").alias("pos"), "alts")


def part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return parts.select("p_brand", F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("size"), rank.alias("rk"))


def msa_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows (msa_id, seq_no, seq): a brand, a column a part, four sequences."""
    p, k = F.col("p"), F.col("k")
    cell = F.when((p * 31 + k * 17) % 23 == 0, "-").when((p * 7 + k * 13) % 29 == 0, base(p + k)).otherwise(base(p))
    cells = part_columns(spark, sf_dir).withColumn("k", F.explode(F.array(*(F.lit(i) for i in range(4))))).withColumn("ch", cell)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "ch"))), lambda x: x["ch"]), "")
    return cells.groupBy("p_brand", "k").agg(seq.alias("seq")).select(F.col("p_brand").alias("msa_id"), (F.col("k") + 1).alias("seq_no"), "seq")


def fasta_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_columns(spark, sf_dir).withColumn("ch", base(F.col("p")))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "ch"))), lambda x: x["ch"]), "")
    return rows.groupBy(F.col("p_brand").alias("vcf_id")).agg(F.concat(F.lit(">ref\n"), F.regexp_replace(seq, "(.{60})", "$1\n"), F.lit("\n")).alias("text"))


def vcf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (vcf_id, line_no, line): a header, and a variant at every fifth part key."""
    by = Window.partitionBy("p_brand").orderBy("p")
    ch = base(F.col("p"))
    # the letters from its own place on, which are those of the reference text there
    near = F.concat(ch, F.coalesce(F.lead(ch, 1).over(by), F.lit("")), F.coalesce(F.lead(ch, 2).over(by), F.lit("")))
    rows = part_columns(spark, sf_dir).withColumn("near", near).where("p % 5 = 0 and p_brand is not null").withColumnRenamed("p_brand", "vcf_id")
    p, kind = F.col("p"), F.col("size") % 6
    rows = rows.withColumn("ref", F.expr("substring(near, 1, cast(1 + size % 3 as int))"))
    alt = F.when(kind == 0, base(p + 1)).when(kind == 1, "<DEL>").when(kind == 2, F.concat("ref", F.lit("GT"))).when(kind == 3, F.concat(base(p + 1), F.lit(","), base(p + 2))).when(kind == 4, "<INS>").otherwise("<INV>")
    n = F.when(kind == 3, 2).otherwise(1)
    gts = [F.concat(((p + 3 * k) % (n + 1)).cast("string"), F.lit("|"), ((p + k) % 2).cast("string")) for k in range(4)]
    line = F.concat_ws("\t", F.lit("chr1"), F.col("rk").cast("string"), F.lit("."), "ref", alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *gts)
    lines = rows.select("vcf_id", F.col("p").alias("line_no"), line.alias("line"))
    with_lines = table(spark, sf_dir, "part").where("p_partkey % 5 = 0 and p_brand is not null").select(F.col("p_brand").alias("vcf_id")).distinct()
    head = with_lines.select("vcf_id", F.lit(-1).cast("long").alias("line_no"), F.lit("##fileformat=VCFv4.2").alias("line"))
    return lines.unionByName(head)
