"""Reports on strings: statistics as nested JSON and as text, and symbols as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import eds_statistics, memory_estimate, source_statistics

UNITS = ["B", "KB", "MB", "GB", "TB"]
#: The least context at which no transform is advised.
READY = 5


def fixed(x: Column, digits: int) -> Column:
    """A number of 0 or more with one or two decimals as the reference prints it: the exact
    binary value is rounded, a tie to the even digit (format_string rounds the shortest
    decimal text, ties up)."""
    whole, scale, low = F.floor(x), 10**digits, (1 << 30) - 1
    part = ((x.cast("double") - whole) * float(1 << 60)).cast("long")
    tail = part.bitwiseAND(low) * scale
    head = F.shiftright(part, 30) * scale + F.shiftright(tail, 30)
    rest, n = F.shiftleft(head.bitwiseAND(low), 30) + tail.bitwiseAND(low), F.shiftright(head, 30)
    up = (rest > 1 << 59) | ((rest == 1 << 59) & (n % 2 == 1))
    n = n + up.cast("long")
    return F.concat((whole + F.floor(n / scale)).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def format_size(size: Column) -> Column:
    """Bytes with one decimal in the largest unit of at least 1."""
    out = F.concat(fixed(size / 1024 ** (len(UNITS) - 1), 1), F.lit(f" {UNITS[-1]}"))
    for k in reversed(range(len(UNITS) - 1)):
        out = F.when(size < 1024 ** (k + 1), F.concat(fixed(size / 1024**k, 1), F.lit(f" {UNITS[k]}"))).otherwise(out)
    return out


def format_number(n: Column) -> Column:
    """Whole numbers with commas between thousands."""
    return F.format_number(n.cast("long"), 0)


def gathered(symbols: DataFrame, index_only: bool = False) -> DataFrame:
    """All figures of a report, a row a string: statistics, sources (null without) and bytes."""
    stats = eds_statistics(symbols)
    sources = source_statistics(symbols.where(F.col("alts")[0]["src"].isNotNull()))
    rows = stats.join(memory_estimate(stats), "eds_id").join(sources, "eds_id", "left")
    return rows.withColumn("current", F.col("index_bytes" if index_only else "full_bytes")).withColumn("reduction", F.col("full_bytes") / F.col("index_bytes"))


def stats_json(symbols: DataFrame, files: DataFrame | None = None, index_only: bool = False) -> DataFrame:
    """(eds_id, json): file, structure, context lengths, variations, memory, sources and
    recommendations. ``files`` (eds_id, path, size_bytes) are the texts that were read."""
    rows = gathered(symbols, index_only)
    empty = F.lit(None)
    rows = rows.join(files, "eds_id", "left") if files is not None else rows.withColumns({"path": empty.cast("string"), "size_bytes": empty.cast("long")})
    c, mb, has = F.col, lambda x: fixed(F.col(x) / 1048576, 1).cast("double"), F.col("num_paths").isNotNull()
    memory = [c("current").alias("current_bytes"), mb("current").alias("current_mb")]
    memory += [c("full_bytes").alias("estimated_full_bytes"), mb("full_bytes").alias("estimated_full_mb"), fixed(c("reduction"), 1).cast("double").alias("reduction_factor")] if index_only else [F.lit("FULL").alias("mode")]
    ready = c("min_ctx") >= READY
    json = F.struct(
        F.struct(c("path"), c("size_bytes"), F.lit("METADATA_ONLY" if index_only else "FULL").alias("storage_mode")).alias("file"),
        F.struct(c("n").alias("n_symbols"), c("n_chars").alias("N_characters"), c("m").alias("m_strings"), c("num_degenerate").alias("degenerate_symbols"), (c("n") - c("num_degenerate")).alias("regular_symbols")).alias("structure"),
        F.struct(c("min_ctx").alias("min"), c("max_ctx").alias("max"), fixed(c("avg_ctx"), 2).cast("double").alias("avg")).alias("context_lengths"),
        F.struct(c("change_size").alias("total_change_size"), c("common_chars").alias("common_characters"), "empty_strings").alias("variations"),
        F.struct(*memory).alias("memory"),
        F.struct(has.alias("loaded"), has.alias("file_provided"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("num_paths", "max_paths_per_string")), fixed(F.coalesce("avg_paths_per_string", F.lit(0.0)), 2).cast("double").alias("avg_paths_per_string")).alias("sources"),
        F.struct((~ready).alias("needs_transformation"), ready.alias("ready_for_indexing"), c("min_ctx").alias("min_context_length"), F.when(ready, "ready for indexing").otherwise(f"polystrand eds2leds -l {READY}").alias("suggested_command")).alias("recommendations"),
    )
    return rows.select("eds_id", F.to_json(json).alias("json"))


def stats_text(symbols: DataFrame, verbose: bool = False, index_only: bool = False) -> DataFrame:
    """(eds_id, text): the same figures as lines."""
    c, two = F.col, lambda x: fixed(x, 2)
    mode = "METADATA_ONLY" if index_only else "FULL"
    sections: list[tuple[str, list[tuple[str, Column]]]] = [
        ("Structure", [("Number of symbols (n)", format_number(c("n"))), ("Total characters (N)", format_number(c("n_chars"))), ("Total strings (m)", format_number(c("m"))), ("Degenerate symbols", format_number(c("num_degenerate"))), ("Regular symbols", format_number(c("n") - c("num_degenerate")))]),
        ("Context lengths", [("Minimum", c("min_ctx").cast("string")), ("Maximum", c("max_ctx").cast("string")), ("Average", two(c("avg_ctx")))]),
        ("Variations", [("Total change size", format_number(c("change_size"))), ("Common characters", format_number(c("common_chars"))), ("Empty strings", format_number(c("empty_strings")))]),
    ]
    if verbose:
        sections.append(("Details", [("Strings per symbol", two(c("m") / c("n"))), ("Characters per string", two(c("n_chars") / c("m"))), ("Degenerate symbols, %", two(100 * c("num_degenerate") / c("n")))]))
    sections.append(("Memory", [(f"Current ({mode})", format_size(c("current"))), *([("All strings", format_size(c("full_bytes"))), ("Reduction factor", fixed(c("reduction"), 1))] if index_only else [])]))
    lines = [F.lit("EDS statistics")]
    for title, figures in sections:
        lines += [F.lit(f"{title}:"), *(F.concat(F.lit(f"  {name:<30}"), F.lpad(value, F.greatest(F.length(value), F.lit(12)), F.lit(" "))) for name, value in figures)]
    paths = F.concat(F.lit("Sources: "), format_number(c("num_paths")), F.lit(" paths, at most "), c("max_paths_per_string").cast("string"), F.lit(" a string"))
    lines += [F.coalesce(paths, F.lit("Sources: not loaded")), F.when(c("min_ctx") < READY, f"Advice: transform to a context of {READY}").otherwise("Advice: ready for indexing")]
    return gathered(symbols, index_only).select("eds_id", F.concat_ws("\n", *lines).alias("text"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """(eds_id, pos, line): each symbol with its strings in quotes, an empty one as epsilon."""
    one = F.transform("alts", lambda x: F.when(x["s"] == "", "ε").otherwise(F.concat(F.lit('"'), x["s"], F.lit('"'))))
    line = F.concat(F.lit("Set "), F.col("pos").cast("string"), F.lit(": {"), F.array_join(one, ", "), F.lit("}"), F.when(F.size("alts") > 1, " [degenerate]").otherwise(""))
    return symbols.select("eds_id", "pos", line.alias("line"))
