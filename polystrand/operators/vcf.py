"""Variant calls with a reference sequence to EDS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import ALTS
from ..session import cut

#: Positions of one stretch of variants.
STRETCH = 1 << 16
#: Letters of one piece of a reference text.
PIECE = 4096


def parse_fasta(texts: DataFrame) -> DataFrame:
    """(vcf_id, name, seq) of (vcf_id, text): the first record."""
    record = F.split("text", "(?:^|\n)>")
    body = F.when(F.trim(record[0]) == "", F.get(record, F.lit(1))).otherwise(record[0])
    return texts.select("vcf_id", F.regexp_replace(F.substring_index(body, "\n", 1), r"^\s+|\s+$", "").alias("name"), F.regexp_replace(F.regexp_replace(body, "^[^\n]*", ""), r"\s", "").alias("seq"))


def fasta_region(fasta: DataFrame, start: Column, length: Column) -> Column:
    return F.substring(fasta["seq"], (start + 1).cast("int"), length.cast("int"))


def alt_strings(alt: Column, ref: Column) -> Column:
    """Alternative strings: <DEL> is empty, <INS> the reference text, other <...> null."""
    one = lambda x: F.when(x == "<DEL>", "").when(x == "<INS>", ref).when(x.startswith("<"), F.lit(None).cast("string")).otherwise(x)
    return F.transform(F.split(alt, ",", -1), one)


def genotype(field: Column) -> Column:
    """Allele numbers of a sample: before the colon, split at / or else at |, no-calls and
    what is not a number, or is out of range, dropped."""
    g = F.substring_index(field, ":", 1)
    parts = F.when(g.contains("/"), F.split(g, "/", -1)).otherwise(F.split(g, r"\|", -1))
    numbers = F.transform(parts, lambda x: F.regexp_extract(x, r"^\s*([+-]?\d+)", 1))
    return F.filter(F.transform(numbers, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def parse(lines: DataFrame) -> DataFrame:
    """Variants of (vcf_id, line_no, line): chrom, pos, ref, alts, gts and status (NONE,
    HEADER, MALFORMED, UNSUPPORTED_SV). Fields split at tabs, or at white space if there
    are fewer than five."""
    dropped = lambda f: F.filter(f, lambda x: x != "")
    tabs, spaces = dropped(F.split("line", "\t")), dropped(F.split("line", r"\s+"))
    rows = lines.withColumn("_f", F.when(F.size(tabs) >= 5, tabs).otherwise(spaces))
    f = lambda i: F.get("_f", F.lit(i))
    rows = rows.withColumn("_alts", alt_strings(f(4), f(3))).withColumn("_pos", F.regexp_extract(f(1), r"^\s*(\d+)", 1).try_cast("long"))
    status = F.when((F.col("line") == "") | F.col("line").startswith("#"), "HEADER").when((F.size("_f") < 5) | F.col("_pos").isNull(), "MALFORMED").when(F.exists("_alts", lambda x: x.isNull()), "UNSUPPORTED_SV").otherwise("NONE")
    gts = F.transform(F.slice("_f", 10, F.greatest(F.size("_f") - 9, F.lit(0))), genotype)
    return rows.select("vcf_id", "line_no", status.alias("status"), f(0).alias("chrom"), F.col("_pos").alias("pos"), f(3).alias("ref"), F.col("_alts").alias("alts"), gts.alias("gts"))


def statistics(variants: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    variants = cut(variants.select("vcf_id", "line_no", "status", "pos", "ref"))
    counts = variants.where("status <> 'HEADER'").groupBy("vcf_id").agg(F.count("*").alias("total"), n("NONE").alias("processed"), n("MALFORMED").alias("malformed"), n("UNSUPPORTED_SV").alias("unsupported"))
    found = groups(variants).groupBy("vcf_id").agg(F.countDistinct("group_no").alias("groups"))
    return counts.join(found, "vcf_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))


def overlap(pos: Column, ref: Column, other_pos: Column, other_ref: Column) -> Column:
    """Whether the reference spans of two variants have a column in common."""
    return (pos < other_pos + F.length(other_ref)) & (other_pos < pos + F.length(ref))


def groups(variants: DataFrame) -> DataFrame:
    """Supported variants with begin and end (half-open, from 0) and group_no: overlapping
    ones are a group. Both the farthest end so far and the number of the group are found
    within stretches of positions, then over stretches, so that one long sequence has many
    tasks."""
    # read four times
    rows = cut(variants.where("status = 'NONE'"))
    rows = rows.withColumn("begin", F.col("pos") - 1).withColumn("end", F.col("pos") - 1 + F.length("ref")).withColumn("_part", F.floor(F.col("pos") / STRETCH))
    by = Window.partitionBy("vcf_id", "_part").orderBy("pos", "line_no")
    over = Window.partitionBy("_vcf").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)

    def before(rows: DataFrame, total: Column, carried: Column) -> DataFrame:
        parts = rows.groupBy(F.col("vcf_id").alias("_vcf"), F.col("_part").alias("_p")).agg(total.alias("_t")).select("_vcf", "_p", carried.over(over).alias("_b"))
        return rows.join(parts, (F.col("vcf_id") == F.col("_vcf")) & (F.col("_part") == F.col("_p"))).drop("_vcf", "_p")

    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = before(rows, F.max("end"), F.max("_t")).withColumn("_reach", F.greatest(reach, F.col("_b"))).drop("_b")
    rows = rows.withColumn("_new", F.coalesce((F.col("begin") >= F.col("_reach")).cast("int"), F.lit(1)))
    rows = before(rows, F.sum("_new"), F.sum("_t"))
    return rows.withColumn("group_no", F.sum("_new").over(by) + F.coalesce("_b", F.lit(0)) - 1).drop("_new", "_reach", "_b", "_part")


def texts_between(ranges: DataFrame, fasta: DataFrame) -> DataFrame:
    """``ranges`` (vcf_id, begin, end: half-open, from 0, no two with one begin) with ``span``,
    their part of the reference text. The text is cut into pieces, so a range costs what it
    covers and not its distance from the start of the text."""
    # a begin before the first letter counts as the first
    first = F.greatest("begin", F.lit(0))
    last = first + F.col("end") - F.col("begin") - 1
    pieces = fasta.select("vcf_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_piece", "_text"))
    asked = ranges.select("vcf_id", "begin", first.alias("_first"), last.alias("_last")).where("_last >= _first")
    asked = asked.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_first") / PIECE), F.floor(F.col("_last") / PIECE))))
    at = F.greatest(F.col("_first") - F.col("_piece") * PIECE, F.lit(0))
    upto = F.least(F.col("_last") - F.col("_piece") * PIECE, F.lit(PIECE - 1))
    text = F.substring(F.col("_text"), (at + 1).cast("int"), (upto - at + 1).cast("int"))
    found = asked.join(pieces.hint("merge"), ["vcf_id", "_piece"]).select("vcf_id", "begin", F.struct("_piece", text.alias("t")).alias("x"))
    found = found.groupBy("vcf_id", "begin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("span"))
    return ranges.join(found.hint("merge"), ["vcf_id", "begin"], "left").withColumn("span", F.coalesce("span", F.lit("")))


def haplotypes(variants: DataFrame, fasta: DataFrame) -> DataFrame:
    """vcf_id, group_no, begin, end, hap, first (its order), samples: the distinct texts of
    each group; alternatives are applied to the reference span one at a time."""
    rows = cut(groups(variants).join(fasta.select("vcf_id"), "vcf_id"))
    of = Window.partitionBy("vcf_id", "group_no")
    spans = rows.groupBy("vcf_id", "group_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = texts_between(spans, fasta).select("vcf_id", "group_no", F.col("begin").alias("gb"), F.col("end").alias("ge"), "span")
    rows = rows.withColumn("v", F.row_number().over(of.orderBy("pos", "line_no")))
    rows = rows.withColumn("n", F.first(F.size("gts")).over(of.orderBy("pos", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.join(spans.hint("merge"), ["vcf_id", "group_no"])
    at = (F.col("begin") - F.col("gb")).cast("int")
    applied = lambda alt: F.concat(F.substring(F.col("span"), F.lit(1), at), alt, F.substring(F.col("span"), at + F.length("ref") + 1, F.length("span")))
    haps = F.concat(F.array("span"), F.transform("alts", applied))
    haps = rows.select("vcf_id", "group_no", "gb", "ge", "v", "n", "span", haps.alias("haps"), "gts")
    haps = cut(haps)  # read three times
    named = haps.select("vcf_id", "group_no", "gb", "ge", "n", "v", F.posexplode("haps").alias("a", "hap"))
    # the reference text comes first, then (variant, alternative)
    named = named.groupBy("vcf_id", "group_no", "gb", "ge", "n", "hap").agg(F.min(F.when(F.col("a") == 0, F.struct(F.lit(0).alias("v"), F.lit(0).alias("a"))).otherwise(F.struct(F.col("v").alias("v"), F.col("a").alias("a")))).alias("first"))
    each = haps.select("vcf_id", "group_no", "n", "span", "haps", F.posexplode("gts").alias("k", "alleles")).where("k < n")
    alleles = F.explode_outer("alleles").alias("allele")
    each = each.select("vcf_id", "group_no", "k", "span", "haps", alleles)
    known = (F.col("allele") > 0) & (F.col("allele") < F.size("haps"))
    carried = each.where("allele is not null").select("vcf_id", "group_no", (F.col("k") + 1).alias("sample"), F.when(known, F.get("haps", F.col("allele"))).otherwise(F.col("span")).alias("hap"))
    # a sample without any call in the group carries the reference
    called = carried.select("vcf_id", "group_no", "sample").distinct()
    silent = each.select("vcf_id", "group_no", (F.col("k") + 1).alias("sample"), F.col("span").alias("hap")).distinct().join(called, ["vcf_id", "group_no", "sample"], "left_anti").select("vcf_id", "group_no", "sample", "hap")
    samples = carried.unionByName(silent).groupBy("vcf_id", "group_no", "hap").agg(F.array_sort(F.collect_set(F.col("sample").cast("int"))).alias("samples"))
    out = named.join(samples, ["vcf_id", "group_no", "hap"], "left").where("n = 0 or samples is not null")
    return out.select("vcf_id", "group_no", F.col("gb").alias("begin"), F.col("ge").alias("end"), "hap", "first", F.when(F.col("n") == 0, F.array(F.lit(0))).otherwise(F.col("samples")).alias("samples"))


def to_symbols(variants: DataFrame, fasta: DataFrame) -> DataFrame:
    """Symbols: reference text between groups with the universal source, and each group's
    carried haplotypes."""
    alts = F.array_sort(F.collect_list(F.struct("first", "hap", "samples")))
    fasta = cut(fasta.select("vcf_id", "seq"))
    found = haplotypes(variants, fasta).groupBy("vcf_id", "group_no", "begin", "end").agg(alts.alias("x"))
    found = found.select("vcf_id", "begin", "end", F.transform("x", lambda a: F.struct(a["hap"].alias("s"), a["samples"].alias("src"))).cast(ALTS).alias("alts"))
    found = cut(found)
    by = Window.partitionBy("vcf_id").orderBy("begin")
    before = found.select("vcf_id", F.coalesce(F.lag("end").over(by), F.lit(0)).alias("from"), F.col("begin").alias("to"))
    last = fasta.select("vcf_id", F.length("seq").cast("long").alias("to")).join(found.groupBy("vcf_id").agg(F.max("end").alias("from")), "vcf_id", "left").select("vcf_id", F.coalesce("from", F.lit(0)).alias("from"), "to")
    gaps = before.unionByName(last).where("to > from").select("vcf_id", F.col("from").alias("begin"), F.col("to").alias("end"))
    # a call may lie beyond the end of the text
    gaps = gaps.join(fasta.select("vcf_id", F.length("seq").cast("long").alias("_n")), "vcf_id").withColumn("end", F.least("end", "_n")).drop("_n")
    gaps = texts_between(gaps.where("end > begin"), fasta).where("span <> ''")
    gaps = gaps.select("vcf_id", "begin", F.array(F.struct(F.col("span").alias("s"), F.array(F.lit(0)).alias("src"))).cast(ALTS).alias("alts"), F.lit(0).alias("o"))
    rows = gaps.unionByName(found.select("vcf_id", "begin", "alts", F.lit(1).alias("o")))
    place = F.row_number().over(Window.partitionBy("vcf_id").orderBy("begin", "o")) - 1
    return rows.select(F.col("vcf_id").alias("eds_id"), place.cast("long").alias("pos"), "alts")
