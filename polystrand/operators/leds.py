"""Merging adjacent symbols, and transforms to a least context length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.algebra import ALTS, fold_product, product
from ..session import cut

#: Rounds, and alternatives of one merged symbol, that are tried at most: with sources those
#: that share a path, else all combinations.
ROUNDS, LARGEST = 10_000, 1 << 22


def in_order() -> WindowSpec:
    return Window.partitionBy("eds_id").orderBy("pos")


def whole() -> WindowSpec:
    return Window.partitionBy("eds_id")


def merged(symbols: DataFrame, group, linear: bool) -> DataFrame:
    """Symbols of one ``group`` become one; positions are dense again."""
    rows = symbols.withColumn("_g", group)
    size = F.exp(F.sum(F.log(F.size("alts").cast("double"))))
    parts = rows.groupBy("eds_id", "_g").agg(F.array_sort(F.collect_list(F.struct("pos", "alts"))).alias("parts"), size.alias("combinations"))
    large = F.raise_error(F.lit("a merge would have too many alternatives"))
    if linear:
        # shared paths filter at every step, so what counts is what each step leaves
        step = lambda acc, x: F.when(F.size(acc) > LARGEST, large.cast(ALTS)).otherwise(product(acc, x["alts"], True))
        rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
        alts = F.aggregate(rest, F.col("parts")[0]["alts"].cast(ALTS), step)
        empty = F.raise_error(F.lit("a merge results in an empty set")).cast(ALTS)
        parts = parts.withColumn("_alts", alts)
        alts = F.when((F.size("parts") > 1) & (F.size("_alts") == 0), empty).when(F.size("_alts") > LARGEST, large.cast(ALTS)).otherwise(F.col("_alts"))
    else:
        guard = F.when(F.col("combinations") > LARGEST, large.cast("array<struct<pos:bigint,alts:array<struct<s:string,src:array<int>>>>>")).otherwise(F.col("parts"))
        alts = fold_product(F.transform(guard, lambda p: p["alts"]), linear)
    out = parts.select("eds_id", "_g", alts.alias("alts"))
    return out.select("eds_id", (F.row_number().over(Window.partitionBy("eds_id").orderBy("_g")) - 1).cast("long").alias("pos"), "alts")


def merge_adjacent(symbols: DataFrame, p: int, q: int, linear: bool = False) -> DataFrame:
    """Symbols p and q = p + 1 as one."""
    if q != p + 1:
        raise ValueError("positions are not adjacent")
    if p < 0:
        raise IndexError("position out of range")
    short = F.max("pos").over(whole()) < q
    checked = symbols.withColumn("pos", F.when(short, F.raise_error(F.lit("position out of range")).cast("long")).otherwise(F.col("pos")))
    return merged(checked, F.when(F.col("pos") == q, p).otherwise(F.col("pos")), linear)


def candidates(symbols: DataFrame, least: int) -> DataFrame:
    """symbols with ``cand``: the symbol and the next one break the rule of context ``least``."""
    inner = (F.col("pos") > F.min("pos").over(whole())) & (F.col("pos") < F.max("pos").over(whole()))
    short = (F.size("alts") == 1) & inner & (F.length(F.col("alts")[0]["s"]) < least)
    rows = symbols.withColumn("_short", short).withColumn("_deg", F.size("alts") > 1)
    cand = F.lead("pos").over(in_order()).isNotNull() & (F.col("_short") | F.lead("_short").over(in_order()) | (F.col("_deg") & F.lead("_deg").over(in_order())))
    return rows.withColumn("cand", F.coalesce(cand, F.lit(False))).drop("_short", "_deg")


def is_leds(symbols: DataFrame, least: int) -> DataFrame:
    """eds_id, is_leds."""
    if least == 0:
        return symbols.select("eds_id").distinct().withColumn("is_leds", F.lit(True))
    rows = candidates(symbols, least)
    inner_short = (F.size("alts") == 1) & (F.col("pos") > F.min("pos").over(whole())) & (F.col("pos") < F.max("pos").over(whole())) & (F.length(F.col("alts")[0]["s"]) < least)
    rows = rows.withColumn("_bad", inner_short | F.col("cand"))
    return rows.groupBy("eds_id").agg((~F.bool_or("_bad")).alias("is_leds"))


def pairs(symbols: DataFrame, least: int) -> DataFrame:
    """symbols with ``pick``: the greedy left-to-right choice of independent candidate pairs,
    which is every second candidate of a run."""
    rows = candidates(symbols, least)
    rows = rows.withColumn("_run", F.sum((~F.col("cand")).cast("int")).over(in_order()))
    at = F.row_number().over(Window.partitionBy("eds_id", "_run", "cand").orderBy("pos"))
    return rows.withColumn("pick", F.col("cand") & (at % 2 == 1)).drop("_run")


def to_leds(symbols: DataFrame, least: int, linear: bool = False) -> DataFrame:
    """The transform to a least context. An EDS without adjacent symbols of one alternative
    (and, with sources, whose alternatives cover all paths of the EDS) is merged in one
    pass, run by run; the others in rounds of independent pairs until nothing is left."""
    if least <= 0:
        raise ValueError("the context length must be positive")
    if not linear:
        symbols = symbols.withColumn("alts", F.transform("alts", lambda x: F.struct(x["s"].alias("s"), F.lit(None).cast("array<int>").alias("src"))))
    else:
        symbols = cut(symbols.select("eds_id", "pos", "alts"))  # read twice
    rows = symbols.withColumn("_one", F.size("alts") == 1)
    fused = F.coalesce(F.col("_one") & F.lead("_one").over(in_order()), F.lit(False))
    if linear:
        union = F.array_sort(F.array_distinct(F.flatten(F.transform("alts", lambda x: x["src"]))))
        rows = rows.withColumn("_u", F.array_except(union, F.array(F.lit(0)))).withColumn("_any0", F.array_contains(union, 0))
        # counted once a string: as a window, each symbol would carry all paths of all symbols
        paths = rows.select("eds_id", F.explode("_u").alias("p")).distinct().groupBy("eds_id").agg(F.count("*").alias("_all"))
        rows = rows.join(paths.hint("merge"), "eds_id", "left").withColumn("_all", F.coalesce("_all", F.lit(0)))
        empty = F.exists("alts", lambda x: F.size(x["src"]) == 0)
        partial = F.when(F.col("_one"), ~F.col("_any0")).otherwise((F.size("_u") < F.col("_all")) | empty)
    else:
        partial = F.lit(False)
    rows = rows.withColumn("_f", fused | partial).withColumn("_slow", F.bool_or("_f").over(whole()))
    rows = cut(rows.select("eds_id", "pos", "alts", "_slow"))
    fast = candidates(rows.where("not _slow").drop("_slow"), least)
    edge = F.coalesce(F.lag("cand").over(in_order()), F.lit(False))
    fast = fast.withColumn("_g", F.sum((~edge).cast("int")).over(in_order()))
    out = merged(fast.select("eds_id", "pos", "alts", "_g"), F.col("_g"), linear)
    slow = rows.where("_slow").drop("_slow")
    for _ in range(ROUNDS):
        picked = cut(pairs(slow, least).select("eds_id", "pos", "alts", "pick"))
        if not picked.where("pick").limit(1).count():
            return out.unionByName(picked.drop("pick"))
        second = F.coalesce(F.lag("pick").over(in_order()), F.lit(False))
        slow = cut(merged(picked.withColumn("_to", F.col("pos") - second.cast("int")).drop("pick"), F.col("_to"), linear))
    raise RuntimeError("no fixpoint within the allowed rounds")
