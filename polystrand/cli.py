"""Command line: python -m polystrand.cli TOOL ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import generate, leds, msa, report, vcf
from .operators import index as ix
from .sources import eds


def one_text(spark: SparkSession, path: str, key: str, name: str = "text") -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit("input").alias(key), F.col("value").alias(name))


def written(symbols: DataFrame, out: str, sources: str | None, compact: bool) -> None:
    """The text of one string, which is one driver-side row by its format."""
    Path(out).write_text(eds.serialize(symbols, compact).first()["eds"] + "\n")
    if sources:
        Path(sources).write_text(eds.serialize_sources(symbols).first()["seds"] + "\n")


def read(spark: SparkSession, path: str, sources: str | None) -> DataFrame:
    texts = one_text(spark, path, "eds_id", "eds")
    if sources:
        texts = texts.join(one_text(spark, sources, "eds_id", "seds"), "eds_id")
    return eds.parse(texts)


def random_symbols(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    number = a.number if a.variability is None else round(a.variability * a.length)
    return generate.random_eds(spark, "input", a.length, number, a.max_alternatives, a.snp_ratio, a.min_context, a.alphabet, a.seed, a.min_alternatives, a.variant_length_max)


def expect(path: str, suffix: str) -> str:
    if not path.endswith(suffix):
        raise SystemExit(f"the input must be a {suffix} file")
    return path


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="polystrand")
    tools = top.add_subparsers(dest="tool", required=True)
    for name in ("msa2eds", "vcf2eds", "eds2leds", "stats", "patterns", "random"):
        t = tools.add_parser(name)
        if name != "random":
            t.add_argument("-i", "--input", required=True)
        t.add_argument("-o", "--output")
        t.add_argument("-s", "--sources")
        t.add_argument("-l", "--length", type=int, default={"patterns": 10, "random": 1000}.get(name, 0))
        t.add_argument("-n", "--number", type=int, default=100)
        t.add_argument("--full", action="store_true")
        t.add_argument("--seed", type=int, default=1)
        if name == "vcf2eds":
            t.add_argument("-r", "--reference", required=True)
        if name == "stats":
            t.add_argument("-j", "--json", action="store_true")
            t.add_argument("-v", "--verbose", action="store_true")
            t.add_argument("-f", "--full-mode", action="store_true", help="report the memory of all strings, not of the index")
            t.add_argument("-p", "--print", action="store_true", help="print the symbols")
        if name == "random":
            t.add_argument("--max-alternatives", type=int, default=3)
            t.add_argument("--min-alternatives", type=int, default=2)
            t.add_argument("--variant-length-max", type=int, default=1)
            t.add_argument("--snp-ratio", type=float, default=0.7)
            t.add_argument("--variability", type=float, help="share of places that vary, in place of -n")
            t.add_argument("--min-context", type=int, default=0)
            t.add_argument("--alphabet", default="ACGT")
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.tool == "stats":
        symbols = read(spark, a.input, a.sources)
        if a.json:
            files = spark.createDataFrame([("input", a.input, Path(a.input).stat().st_size)], "eds_id string, path string, size_bytes long")
            print(report.stats_json(symbols, files, index_only=not a.full_mode).first()["json"])
        else:
            print(report.stats_text(symbols, a.verbose, index_only=not a.full_mode).first()["text"])
        if a.print:
            for row in report.symbol_lines(symbols).orderBy("pos").toLocalIterator():
                print(row["line"])
        return
    if a.tool == "patterns":
        found = generate.generate_patterns(ix.index(read(spark, a.input, a.sources)), a.number, a.length, a.seed)
        found.orderBy("pattern_id").select("pattern").write.text(a.output or "patterns")
        return
    if a.tool == "random":
        written(random_symbols(spark, a), a.output or "random.eds", a.sources, False)
        return
    stem = Path(a.input).with_suffix("")
    if a.tool == "msa2eds":
        symbols = msa.to_symbols(msa.parse(one_text(spark, expect(a.input, ".msa"), "msa_id")), a.length)
    elif a.tool == "vcf2eds":
        lines = one_text(spark, expect(a.input, ".vcf"), "vcf_id").select("vcf_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        variants = vcf.parse(lines)
        symbols = vcf.to_symbols(variants, vcf.parse_fasta(one_text(spark, a.reference, "vcf_id")))
        print(vcf.statistics(variants).select(F.to_json(F.struct("*"))).first()[0])
        symbols = leds.to_leds(symbols, a.length, linear=True) if a.length else symbols
    else:
        if a.length <= 0:
            raise SystemExit("-l must be positive")
        symbols = leds.to_leds(read(spark, expect(a.input, ".eds"), a.sources), a.length, linear=a.sources is not None)
    out = a.output or (f"{stem}_l{a.length}.leds" if a.length else f"{stem}.eds")
    sources = (a.sources if a.tool != "eds2leds" else f"{Path(out).with_suffix('')}.seds" if a.sources else None) or (None if a.tool == "eds2leds" else str(Path(out).with_suffix(".seds")))
    # braces are kept wherever neighbours of one alternative would otherwise fuse
    written(symbols, out, sources, compact=a.tool == "eds2leds" and not a.full)


if __name__ == "__main__":
    main()
