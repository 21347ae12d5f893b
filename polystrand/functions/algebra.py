"""Column expressions over alternatives: arrays of (s, src); src null means no sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALTS = "array<struct<s:string,src:array<int>>>"


def intersect(a: Column, b: Column) -> Column:
    """Paths in both sets; a set that holds 0 stands for all paths."""
    both, one, other = F.array_contains(a, 0) & F.array_contains(b, 0), F.array_contains(a, 0), F.array_contains(b, 0)
    return F.when(both, F.array(F.lit(0))).when(one, b).when(other, a).otherwise(F.array_intersect(a, b))


def product(a: Column, b: Column, linear: bool) -> Column:
    """All combinations in row-major order; if ``linear`` those that share a path."""

    def pair(x: Column, y: Column) -> Column:
        src = intersect(x["src"], y["src"]) if linear else F.lit(None).cast("array<int>")
        return F.struct(F.concat(x["s"], y["s"]).alias("s"), src.alias("src"))

    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y))))
    return (F.filter(pairs, lambda p: F.size(p["src"]) > 0) if linear else pairs).cast(ALTS)


def fold_product(symbols: Column, linear: bool) -> Column:
    """The product of an ordered, non-empty array of alternatives arrays."""
    rest = F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0)))
    return F.aggregate(rest, symbols[0].cast(ALTS), lambda acc, x: product(acc, x, linear))


def alts_text(alts: Column) -> Column:
    return F.array_join(F.transform(alts, lambda x: x["s"]), ",")


def src_text(src: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(src.cast("array<string>"), ","), F.lit("}"))
