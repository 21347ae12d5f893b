"""EDS and source files: parsing, validation and serialising, many files a table.

A text table is (eds_id, eds[, seds]); symbols are (eds_id, pos, alts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import ALTS, alts_text, src_text


def load(spark: SparkSession, path: str) -> DataFrame:
    """(eds_id, eds) of whole files; eds_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("eds_id"), F.col("value").alias("eds"))


def from_strings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "eds_id string, eds string, seds string")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def normalized(text: Column) -> Column:
    """All symbols in braces: a stretch outside of braces is a symbol."""
    return F.regexp_replace(stripped(text), r"(^|\})([^{}]+)(?=\{|$)", "$1{$2}")


def eds_status(text: Column) -> Column:
    """OK, or what is wrong with the braces; braces do not nest."""
    t = normalized(text)
    return F.when(text.isNull(), "MISSING").when(t.rlike(r"^(?:\{[^{}]*\})*$"), "OK").when(t.rlike(r"\{[^}]*(?:\{|$)"), "MISSING_CLOSE").otherwise("MISSING_OPEN")


def seds_status(text: Column) -> Column:
    t = stripped(text)
    return F.when(t.isNull() | (t == ""), "EMPTY_SOURCES").when(~t.rlike(r"^(?:\{[^{}]*\})*$"), "BAD_BRACES").when(t.rlike(r"\{,*\}"), "EMPTY_SET").when(t.rlike(r"[^{},0-9]"), "BAD_CHARACTER").when(F.exists(F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int").isNull()), "BAD_NUMBER").otherwise("OK")


def source_sets(text: Column) -> Column:
    """Sorted distinct path ids, a set a string; empty tokens between commas count nothing."""
    sets = F.regexp_extract_all(stripped(text), F.lit(r"\{([^{}]*)\}"), F.lit(1))
    numbers = lambda s: F.transform(F.filter(F.split(s, ",", -1), lambda x: x != ""), lambda x: x.try_cast("int"))
    return F.transform(sets, lambda s: F.array_sort(F.array_distinct(numbers(s))))


def text_status(eds: Column, seds: Column) -> Column:
    """The status of an EDS and its source text (null: none) together, the count of sets
    included."""
    m = F.aggregate(F.regexp_extract_all(normalized(eds), F.lit(r"\{([^{}]*)\}"), F.lit(1)), F.lit(0), lambda n, x: n + F.size(F.split(x, ",", -1)))
    with_sources = F.when(seds_status(seds) != "OK", seds_status(seds)).when(F.size(source_sets(seds)) != m, "CARDINALITY").otherwise("OK")
    return F.when(eds_status(eds) != "OK", eds_status(eds)).when(seds.isNull(), "OK").otherwise(with_sources)


def validate(texts: DataFrame) -> DataFrame:
    """eds_id and status of EDS and source texts."""
    return texts.select("eds_id", text_status(F.col("eds"), F.col("seds")).alias("status"))


def load_sources(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """``texts`` (eds_id, eds) with the source texts (eds_id, seds) of the same id; a string
    without one raises when it is read, as a missing source file does."""
    seds = F.when(F.col("there"), F.col("seds")).otherwise(F.raise_error(F.concat(F.lit("no sources: "), F.col("eds_id"))))
    joined_rows = texts.select("eds_id", "eds").join(sources.select("eds_id", "seds", F.lit(True).alias("there")), "eds_id", "left")
    return joined_rows.select("eds_id", "eds", F.coalesce(seds, F.lit("")).alias("seds"))


def parse(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Symbols of (eds_id, eds[, seds]). Strict: a wrong text, or wrong sources, raise; else
    they have no rows."""
    has_sources = "seds" in texts.columns
    rows = texts if has_sources else texts.withColumn("seds", F.lit(None).cast("string"))
    found = F.regexp_extract_all(normalized(F.col("eds")), F.lit(r"\{([^{}]*)\}"), F.lit(1))
    status = text_status(F.col("eds"), F.col("seds"))
    wrong = F.raise_error(F.concat(F.lit("malformed EDS or sources ("), status, F.lit("): "), F.coalesce("eds_id", F.lit("null"))))
    rows = rows.withColumn("eds", F.when(status == "OK", F.col("eds")).otherwise(wrong)) if strict else rows.where(status == "OK")
    strings = F.transform(found, lambda body: F.split(body, ",", -1))
    none = F.lit(None).cast("array<int>")
    if not has_sources:
        alts = F.transform(strings, lambda x: F.transform(x, lambda s: F.struct(s.alias("s"), none.alias("src"))))
    else:
        # within the row: a whole text with each symbol would grow with the square of a string
        missing = F.raise_error(F.concat(F.lit("sources do not match strings: "), F.col("eds_id"))).cast("array<int>")
        of = lambda t, i: F.when(t["sets"].isNull(), none).otherwise(F.coalesce(F.get(t["sets"], i.cast("int")), missing))
        firsts = lambda t: F.filter(F.transform(F.flatten(F.transform(t["strings"], lambda x: F.transform(x, lambda _, i: i))), lambda k, i: F.when(k == 0, i)), lambda i: i.isNotNull())
        each = lambda t: F.zip_with(t["strings"], t["firsts"], lambda x, first: F.transform(x, lambda s, k: F.struct(s.alias("s"), of(t, first + k).alias("src"))))
        alts = bound(F.struct(strings.alias("strings"), source_sets(F.col("seds")).alias("sets")), lambda t: bound(F.struct(t["strings"].alias("strings"), t["sets"].alias("sets"), firsts(t).alias("firsts")), each))
    symbols = rows.select("eds_id", F.posexplode(alts).alias("pos", "alts"))
    return symbols.select("eds_id", F.col("pos").cast("long").alias("pos"), F.col("alts").cast(ALTS).alias("alts"))


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once a row: within a function over arrays Spark
    computes an expression anew for each element, columns of a select before it included."""
    return F.transform(F.array(value), then)[0]


def serialize(symbols: DataFrame, compact: bool = False) -> DataFrame:
    """(eds_id, eds). Compact drops the braces of symbols of one alternative; adjacent ones
    then read as one symbol."""
    full = F.concat(F.lit("{"), alts_text(F.col("alts")), F.lit("}"))
    text = F.when(F.size("alts") == 1, F.col("alts")[0]["s"]).otherwise(full) if compact else full
    return joined(symbols.select("eds_id", "pos", text.alias("t")), "eds")


def sources_text() -> Column:
    none = F.raise_error(F.concat(F.lit("no sources are loaded: "), F.col("eds_id")))
    return F.array_join(F.transform("alts", lambda x: F.when(x["src"].isNull(), none).otherwise(src_text(x["src"]))), "")


def serialize_sources(symbols: DataFrame) -> DataFrame:
    return joined(symbols.select("eds_id", "pos", sources_text().alias("t")), "seds")


def serialize_both(symbols: DataFrame) -> DataFrame:
    """(eds_id, eds, seds), the symbols read once."""
    full = F.concat(F.lit("{"), alts_text(F.col("alts")), F.lit("}"))
    rows = symbols.select("eds_id", F.struct("pos", full.alias("t"), sources_text().alias("u")).alias("x"))
    rows = rows.groupBy("eds_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("eds_id", *(F.array_join(F.transform("x", lambda v: v[c]), "").alias(n) for c, n in (("t", "eds"), ("u", "seds"))))  # noqa: B023


def joined(rows: DataFrame, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", "t")))
    return rows.groupBy("eds_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(name))


def save(symbols: DataFrame, path: str, compact: bool = False) -> None:
    """One line of text a row, in files under ``path`` by eds_id."""
    serialize(symbols, compact).withColumnRenamed("eds", "value").write.partitionBy("eds_id").text(path)


def save_sources(symbols: DataFrame, path: str) -> None:
    serialize_sources(symbols).withColumnRenamed("seds", "value").write.partitionBy("eds_id").text(path)
