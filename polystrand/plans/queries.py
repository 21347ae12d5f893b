"""The registered queries of the string operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.algebra import alts_text, intersect, product
from ..operators import index as ix
from ..operators import generate, leds, msa, query, report, vcf
from ..session import cut
from ..sources import eds
from . import fixtures as fx
from .oracles import ORACLES  # noqa: F401

QUERIES = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def shown(symbols: DataFrame) -> DataFrame:
    """Symbols with text in place of arrays."""
    src = F.array_join(F.transform("alts", lambda x: F.concat(F.lit("{"), F.array_join(x["src"].cast("array<string>"), ","), F.lit("}"))), "")
    return symbols.select("eds_id", "pos", alts_text(F.col("alts")).alias("alts"), src.alias("srcs"))


def plain(symbols: DataFrame) -> DataFrame:
    return symbols.select("eds_id", "pos", alts_text(F.col("alts")).alias("alts"))


def both_texts(symbols: DataFrame) -> DataFrame:
    return eds.serialize_both(symbols)


@registered
def eds_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.eds_statistics(fx.eds_orders(spark, sf_dir))


@registered
def parse_eds(spark, sf_dir):
    rows = ix.strings(eds.parse(eds.serialize(fx.eds_orders(spark, sf_dir))))
    return rows.select("eds_id", "pos", F.col("alt_no").cast("long").alias("alt_no"), "string_id", "s", F.col("len").cast("long").alias("len"))


@registered
def parse_seds(spark, sf_dir):
    rows = ix.strings(eds.parse(both_texts(fx.eds_orders(spark, sf_dir))))
    return rows.select("eds_id", "string_id", "s", F.array_join(F.col("src").cast("array<string>"), ",").alias("src"))


@registered
def normalize_eds(spark, sf_dir):
    return eds.serialize(fx.eds_separated(spark, sf_dir), compact=True).select("eds_id", eds.normalized(F.col("eds")).alias("eds"))


@registered
def serialize_full(spark, sf_dir):
    return eds.serialize(fx.eds_orders(spark, sf_dir))


@registered
def serialize_compact(spark, sf_dir):
    return eds.serialize(fx.eds_separated(spark, sf_dir), compact=True)


@registered
def serialize_seds(spark, sf_dir):
    return eds.serialize_sources(fx.eds_orders(spark, sf_dir))


@registered
def validate_eds(spark, sf_dir):
    rows = both_texts(fx.eds_separated(spark, sf_dir))
    kind = F.col("eds_id").cast("long") % 6
    text = F.when(kind == 1, F.expr("substring(eds, 2)")).when(kind == 2, F.expr("substring(eds, 1, length(eds) - 1)")).otherwise(F.col("eds"))
    seds = F.when(kind == 3, F.concat("seds", F.lit("{1}"))).when(kind == 4, F.concat("seds", F.lit("{}"))).when(kind == 5, F.concat("seds", F.lit("{-1}"))).otherwise(F.col("seds"))
    return eds.validate(rows.select("eds_id", text.alias("eds"), seds.alias("seds")))


@registered
def source_statistics(spark, sf_dir):
    return ix.source_statistics(fx.eds_orders(spark, sf_dir))


@registered
def memory_estimate(spark, sf_dir):
    return ix.memory_estimate(eds_statistics(spark, sf_dir))


@registered
def stats_verbose(spark, sf_dir):
    return ix.stats_verbose(eds_statistics(spark, sf_dir))


@registered
def stats_json(spark, sf_dir):
    """The report's JSON, its whole numbers picked out by path."""
    rows = report.stats_json(cut(fx.eds_orders(spark, sf_dir)), index_only=True)
    paths = {"n": "structure.n_symbols", "chars": "structure.N_characters", "regular": "structure.regular_symbols", "max_ctx": "context_lengths.max", "change": "variations.total_change_size", "bytes": "memory.current_bytes", "full_bytes": "memory.estimated_full_bytes", "paths": "sources.num_paths"}
    return rows.select("eds_id", *(F.get_json_object("json", f"$.{p}").cast("long").alias(n) for n, p in paths.items()), F.get_json_object("json", "$.recommendations.needs_transformation").alias("transform"))


@registered
def stats_text(spark, sf_dir):
    """Figures of the report's text, without the commas between thousands."""
    text = report.stats_text(cut(fx.eds_orders(spark, sf_dir)))
    line = lambda k: F.regexp_replace(F.substring_index(F.split("text", "\n")[k], " ", -1), ",", "")
    return text.select("eds_id", line(2).alias("n"), line(3).alias("chars"), line(10).alias("avg_ctx"))


@registered
def symbol_lines(spark, sf_dir):
    return report.symbol_lines(fx.eds_orders(spark, sf_dir))


@registered
def variants_overlap(spark, sf_dir):
    """Neighbouring variants, and whether they overlap."""
    by = Window.partitionBy("vcf_id").orderBy("pos", "line_no")
    rows = variants(spark, sf_dir).where("status = 'NONE'").withColumn("p2", F.lead("pos").over(by)).withColumn("r2", F.lead("ref").over(by)).where("p2 is not null")
    return rows.select("vcf_id", "line_no", vcf.overlap(F.col("pos"), F.col("ref"), F.col("p2"), F.col("r2")).alias("overlap"))


@registered
def eds_index(spark, sf_dir):
    return ix.index(fx.eds_orders(spark, sf_dir)).select("eds_id", "pos", F.col("size").cast("long").alias("size"), F.col("first_len").cast("long").alias("first_len"), "is_deg", "cum_set", "cum_common", "cum_deg")


@registered
def read_symbol(spark, sf_dir):
    return shown(ix.read_symbol(fx.eds_orders(spark, sf_dir), 2))


@registered
def extract(spark, sf_dir):
    symbols = fx.eds_orders(spark, sf_dir)
    asked = symbols.select("eds_id").distinct().select("eds_id", F.lit(0).cast("long").alias("qid"), F.lit(1).cast("long").alias("pos"), F.lit(2).cast("long").alias("len"), F.array(F.lit(0), F.lit(1)).alias("changes"))
    return ix.extract(symbols, asked)


@registered
def source_intersect(spark, sf_dir):
    rows = fx.eds_orders(spark, sf_dir).where("size(alts) > 1").select("eds_id", "pos", F.col("alts")[0]["src"].alias("a"), F.col("alts")[1]["src"].alias("b"))
    return rows.select("eds_id", "pos", F.array_join(intersect(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("paths"))


def neighbours(spark, sf_dir):
    rows = fx.eds_separated(spark, sf_dir)
    return rows.select("eds_id", "pos", "alts", F.lead("alts").over(leds.in_order()).alias("next")).where("next is not null")


@registered
def merge_cartesian(spark, sf_dir):
    rows = neighbours(spark, sf_dir)
    return plain(rows.select("eds_id", "pos", product(F.col("alts"), F.col("next"), False).alias("alts")))


@registered
def merge_linear(spark, sf_dir):
    rows = neighbours(spark, sf_dir)
    return shown(rows.select("eds_id", "pos", product(F.col("alts"), F.col("next"), True).alias("alts")))


@registered
def merge_adjacent(spark, sf_dir):
    return shown(leds.merge_adjacent(fx.eds_separated(spark, sf_dir), 0, 1, linear=True))


@registered
def is_leds(spark, sf_dir):
    return leds.is_leds(fx.eds_separated(spark, sf_dir), 3)


@registered
def leds_candidates(spark, sf_dir):
    return leds.candidates(fx.eds_separated(spark, sf_dir), 3).select("eds_id", "pos", "cand")


@registered
def leds_pairs(spark, sf_dir):
    return leds.pairs(fx.eds_separated(spark, sf_dir), 3).select("eds_id", "pos", "pick")


@registered
def eds_to_leds_linear(spark, sf_dir):
    return shown(leds.to_leds(fx.eds_separated(spark, sf_dir), 3, linear=True))


@registered
def eds_to_leds_cartesian(spark, sf_dir):
    return plain(leds.to_leds(fx.eds_separated(spark, sf_dir), 3))


def position_queries(spark, sf_dir, index: DataFrame) -> DataFrame:
    """Per string: its text from the first common position on by one choice throughout (0),
    the same without choices (1), and a text that cannot occur (2)."""
    start = index.where("size = 1 and first_len > 0").groupBy("eds_id").agg(F.min("pos").alias("p0"))
    pick = F.col("eds_id").cast("long") % 2
    rows = index.join(start, "eds_id").where("pos >= p0")
    s = F.when(F.col("size") == 1, F.col("alts")[0]["s"]).otherwise(F.get("alts", pick.cast("int"))["s"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "size", "cum_deg", s.alias("s"))))
    rows = rows.groupBy("eds_id").agg(parts.alias("x")).withColumn("pick", pick)
    deg = F.transform(F.filter("x", lambda v: v["size"] > 1), lambda v: (v["cum_deg"] + F.col("pick")).cast("int"))
    text = F.substring(F.array_join(F.transform("x", lambda v: v["s"]), ""), 1, 9)
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("qid"), deg.alias("deg"), text.alias("pattern")), F.struct(F.lit(1).cast("long").alias("qid"), F.array().cast("array<int>").alias("deg"), text.alias("pattern")), F.struct(F.lit(2).cast("long").alias("qid"), deg.alias("deg"), F.lit("X").alias("pattern")))
    return rows.select("eds_id", F.lit(0).cast("long").alias("common_pos"), F.explode(kinds).alias("q")).select("eds_id", "common_pos", "q.*")


@registered
def check_position(spark, sf_dir):
    index = cut(ix.index(fx.eds_separated(spark, sf_dir)))
    return query.check_position(index, position_queries(spark, sf_dir, index))


@registered
def path_intersection(spark, sf_dir):
    index = cut(ix.index(fx.eds_separated(spark, sf_dir)))
    found = query.walk(index, position_queries(spark, sf_dir, index).where("qid = 0"))
    return found.select("eds_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@registered
def locate_common(spark, sf_dir):
    index = ix.index(fx.eds_orders(spark, sf_dir))
    asked = index.select("eds_id").distinct().withColumn("common_pos", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 2, 5)))))
    return query.locate(index, asked).select("eds_id", "common_pos", "start", "offset")


@registered
def decode_degenerate(spark, sf_dir):
    index = ix.index(fx.eds_orders(spark, sf_dir))
    asked = index.select("eds_id").distinct().withColumn("deg_no", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 7, 99)))))
    return query.decode(index, asked).select("eds_id", "deg_no", "pos", F.col("local").cast("long").alias("local"))


@registered
def parse_msa(spark, sf_dir):
    rows = fx.msa_parts(spark, sf_dir)
    record = F.concat(F.lit(">s"), F.col("seq_no").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n"))
    texts = rows.groupBy("msa_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", record.alias("r")))), lambda x: x["r"]), "").alias("text"))
    return msa.parse(texts).select("msa_id", F.col("seq_no").cast("long").alias("seq_no"), "name", "seq")


@registered
def msa_to_eds(spark, sf_dir):
    return shown(msa.to_symbols(fx.msa_parts(spark, sf_dir)))


@registered
def msa_to_leds(spark, sf_dir):
    return shown(msa.to_symbols(fx.msa_parts(spark, sf_dir), 3))


@registered
def parse_fasta(spark, sf_dir):
    return vcf.parse_fasta(fx.fasta_parts(spark, sf_dir))


@registered
def fasta_region(spark, sf_dir):
    fasta = vcf.parse_fasta(fx.fasta_parts(spark, sf_dir))
    return fasta.select("vcf_id", vcf.fasta_region(fasta, F.lit(10), F.lit(25)).alias("region"))


def variants(spark, sf_dir) -> DataFrame:
    return vcf.parse(fx.vcf_parts(spark, sf_dir))


@registered
def parse_vcf(spark, sf_dir):
    return variants(spark, sf_dir).where("status <> 'HEADER'").select("vcf_id", "line_no", "status", "pos", "ref")


@registered
def vcf_skip_stats(spark, sf_dir):
    return variants(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@registered
def vcf_alts(spark, sf_dir):
    return variants(spark, sf_dir).where("status = 'NONE'").select("vcf_id", "line_no", F.array_join("alts", ",").alias("alts"))


@registered
def vcf_genotypes(spark, sf_dir):
    rows = variants(spark, sf_dir).where("status = 'NONE'")
    return rows.select("vcf_id", "line_no", F.array_join(F.transform("gts", lambda g: F.array_join(g.cast("array<string>"), "|")), ";").alias("gts"))


@registered
def vcf_groups(spark, sf_dir):
    return vcf.groups(variants(spark, sf_dir)).select("vcf_id", "line_no", "begin", F.col("end").cast("long").alias("end"), F.col("group_no").cast("long").alias("group_no"))


@registered
def vcf_stats(spark, sf_dir):
    return vcf.statistics(variants(spark, sf_dir))


@registered
def vcf_haplotypes(spark, sf_dir):
    rows = vcf.haplotypes(variants(spark, sf_dir), vcf.parse_fasta(fx.fasta_parts(spark, sf_dir)))
    return rows.select("vcf_id", "begin", "end", "hap", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@registered
def vcf_to_eds(spark, sf_dir):
    return shown(vcf.to_symbols(variants(spark, sf_dir), vcf.parse_fasta(fx.fasta_parts(spark, sf_dir))))


@registered
def vcf_to_leds(spark, sf_dir):
    symbols = vcf.to_symbols(variants(spark, sf_dir), vcf.parse_fasta(fx.fasta_parts(spark, sf_dir)))
    return shown(leds.to_leds(symbols, 2, linear=True))


@registered
def random_eds(spark, sf_dir):
    return shown(generate.random_eds(spark, "random", 5000, 400, max_alts=4))


@registered
def generate_patterns(spark, sf_dir):
    return generate.generate_patterns(ix.index(fx.eds_separated(spark, sf_dir)), 5, 10)
