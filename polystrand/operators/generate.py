"""Random strings and patterns, reproducible by seed: every choice is a hash of its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import ALTS
from .index import prefix_sums


def drawn(n: Column, *key) -> Column:
    """A number from 0 to n - 1, by hash of ``key``."""
    return F.pmod(F.xxhash64(*key), n.cast("long"))


def uniform(*key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def random_eds(spark: SparkSession, eds_id: str, length: int, variants: int, max_alts: int = 3, snp_ratio: float = 0.7, min_context: int = 0, alphabet: str = "ACGT", seed: int = 1, min_alts: int = 2, longest: int = 1) -> DataFrame:
    """Symbols of a random string over a base sequence of ``length``: ``variants`` places,
    drawn without return, or one in each of as many equal segments if ``min_context`` is
    given, become degenerate. Alternative 0 is the base letter; another is a different
    letter with ``snp_ratio``, else an insertion of 1 to ``longest`` letters or nothing. There
    are ``min_alts`` to ``max_alts`` of them. Path ids start at 1, each
    alternative has a path, and common symbols have the universal source."""
    if not 0 <= variants <= length or not 2 <= min_alts <= max_alts or longest < 1 or len(alphabet) < max_alts:
        raise ValueError("sizes do not fit")
    paths, s = max(max_alts, 3), F.lit(seed)
    letters = F.array(*map(F.lit, alphabet))
    letter = lambda i: F.element_at(letters, (i + 1).cast("int"))
    base = lambda at: drawn(F.lit(len(alphabet)), s, F.lit("base"), at)
    if min_context:
        step = length // max(variants, 1)
        room = max(1, min(step - 1, step - min_context))
        places = spark.range(variants).select((F.col("id") * step + drawn(F.lit(room), s, F.lit("place"), "id")).alias("at"))
    else:
        places = spark.range(length).select(F.col("id").alias("at")).orderBy(F.xxhash64(s, F.lit("place"), "id"), "at").limit(variants)
    number = min_alts + drawn(F.lit(max_alts - min_alts + 1), s, F.lit("alts"), "at")
    rows = places.withColumn("k", number)
    kind = lambda j: uniform(s, F.lit("kind"), "at", j)
    other = lambda j: letter(F.pmod(base(F.col("at")) + j, F.lit(len(alphabet))))
    more = lambda j: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda i: F.when(i <= drawn(F.lit(longest), s, F.lit("long"), "at", j), letter(drawn(F.lit(len(alphabet)), s, F.lit("more"), "at", j, i))).otherwise(""))
    inserted = lambda j: F.concat(other(j), F.array_join(more(j), "")) if longest > 1 else other(j)
    text = lambda j: F.when(j == 0, letter(base(F.col("at")))).when(kind(j) < snp_ratio, other(j)).when(kind(j) < (1 + snp_ratio) / 2, F.concat(letter(base(F.col("at"))), inserted(j))).otherwise("")
    # the first paths take one alternative each, the others draw
    taken = lambda p: F.when(p <= F.col("k"), p - 1).otherwise(drawn(F.col("k"), s, F.lit("path"), "at", p))
    sources = lambda j: F.filter(F.sequence(F.lit(1), F.lit(paths)), lambda p: taken(p) == j)
    alts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.struct(text(j).alias("s"), sources(j).alias("src"))).cast(ALTS)
    rows = rows.select("at", alts.alias("alts"))
    after = rows.select((F.col("at") + 1).alias("at"), F.lit(True).alias("after"))
    columns = spark.range(length).select(F.col("id").alias("at")).join(rows, "at", "left").join(after, "at", "left")
    # a new symbol starts at a variant and after one
    fresh = (F.col("alts").isNotNull() | F.col("after").isNotNull() | (F.col("at") == 0)).cast("int")
    columns = prefix_sums(columns.withColumn("eds_id", F.lit(eds_id)).withColumn("pos", F.col("at")).withColumn("fresh", fresh), before=F.col("fresh"))
    columns = columns.withColumn("pos", F.col("before") + F.col("fresh") - 1)
    common = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", letter(base(F.col("at"))).alias("c")))), lambda x: x["c"]), "")
    out = columns.groupBy("pos").agg(F.first("alts", ignorenulls=True).alias("alts"), common.alias("c"))
    plain = F.array(F.struct(F.col("c").alias("s"), F.array(F.lit(0)).alias("src"))).cast(ALTS)
    return out.select(F.lit(eds_id).alias("eds_id"), F.col("pos").cast("long").alias("pos"), F.coalesce("alts", plain).alias("alts"))


def generate_patterns(index: DataFrame, count: int, length: int, seed: int = 1, wrap: bool = True) -> DataFrame:
    """eds_id, pattern_id, pattern: ``count`` walks of ``length`` characters a string, from
    a drawn common position, with a drawn alternative a degenerate symbol. A walk that
    leaves the string goes on from its first symbols if ``wrap``, else it ends there."""
    total = index.groupBy("eds_id").agg(F.sum(F.when(F.col("size") == 1, F.col("first_len")).otherwise(0)).alias("total"), F.array_sort(F.collect_list(F.struct("pos", "size", "alts", "cum_common"))).alias("symbols"))
    rows = total.where("total > 0").withColumn("pattern_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    rows = rows.withColumn("start", drawn(F.col("total"), F.lit(seed), F.col("eds_id"), F.col("pattern_id")))

    def taken(x: Column) -> Column:
        alt = F.get(x["alts"], F.when(x["size"] == 1, F.lit(0)).otherwise(drawn(x["size"], F.lit(seed + 1), F.col("eds_id"), F.col("pattern_id"), x["pos"])).cast("int"))["s"]
        offset = F.when((x["size"] == 1) & (x["cum_common"] <= F.col("start")) & (F.col("start") < x["cum_common"] + F.length(alt)), F.col("start") - x["cum_common"]).otherwise(F.lit(0))
        return F.substring(alt, (offset + 1).cast("int"), F.length(alt))

    first = F.filter("symbols", lambda x: (x["size"] == 1) & (x["cum_common"] + F.length(x["alts"][0]["s"]) > F.col("start")))[0]["pos"]
    rows = rows.withColumn("first", first)
    ahead = F.array_join(F.transform(F.filter("symbols", lambda x: x["pos"] >= F.col("first")), taken), "")
    again = F.array_join(F.transform("symbols", lambda x: F.get(x["alts"], F.lit(0))["s"]), "")
    text = F.concat(ahead, F.repeat(again, F.ceil(F.lit(length) / F.greatest(F.length(again), F.lit(1))).cast("int"))) if wrap else ahead
    return rows.select("eds_id", "pattern_id", F.substring(text, 1, length).alias("pattern"))
