"""Near-duplicate vectors by lattice hashing: random projections, decoded to points of the
E8 lattice in ``TABLES`` tables, with the nearest neighbouring cells probed, and cosines
verified.

A vector is filed in its own cell and its ``PROBES`` nearest neighbouring cells of each
table, within its label. Cells that hold one vector go before any vector moves. The others
meet in groups of bounded size: a cell is dealt to blocks, and each pair of blocks is a
group. A group counts each vector's links that no earlier table or cell has counted, and
names the least vector that links within the group reach, so no pair leaves it.

Equal vectors of one label are one class, linked to each other; counts are by members.

Defined cases: vectors null, zero or with null or non-finite components, or without a
label or an id, link with nothing and keep their row; vectors of different lengths do not link;
ties do not arise; repeated rows are members of one class; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, released, small_batches, staged, trimmed
from .graph import components
from .vectors import matrix, units, valid_vectors

TABLES, PROBES, SCALE, BLOCK = 8, 3, 1.2, 1024
#: Rows whose linked pairs are looked at together.
SLICE = 64
LIKE = 0.98


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight of 1/2 or -1/2
    with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1.0, -1.0):
            for b in (1.0, -1.0):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest whole vectors with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(1) % 2)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by 1/2."""
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 7) -> np.ndarray:
    """(row, table, 1 + probes) codes of the cells in which unit vectors are filed."""
    rng, around = np.random.default_rng(seed), minimal_vectors()
    factors = np.random.default_rng(88).integers(1, 1 << 62, 8, dtype=np.int64) | 1
    out = np.zeros((len(x), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        y = x @ rng.standard_normal((x.shape[1], 8)) * scale
        point = nearest_e8(y)
        near = np.argpartition(-((y - point) @ around.T), probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), dtype=np.int64)
        points = np.concatenate([point[:, None], point[:, None] + around[near]], axis=1)
        code = ((2 * points).astype(np.int64) * factors).sum(2)
        out[:, t] = (code ^ (code >> 29)) * 0x5851F42D4C957F2D + t
    return out


def filed(classes: DataFrame) -> DataFrame:
    """cls, label, dim and ``codes``: all cells of each class, table after table."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            dims = b.column(2).to_numpy()
            codes = np.zeros((len(b), TABLES * (1 + PROBES)), dtype=np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes[at] = cells(units(matrix(b.column(3).take(pa.array(at))))).reshape(len(at), -1)
            yield pa.record_batch([*b.columns[:3], pa.array(list(codes), pa.list_(pa.int64()))], names=["cls", "label", "dim", "codes"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cls", "label", "dim", "embedding").mapInArrow(lambda batches: trimmed(rows(batches)), f"cls long, label {label}, dim int, codes array<long>")


def group_links(table: pa.Table, like: float) -> pa.Table:
    """Of one group: cls, links not counted elsewhere (by members), least linked class."""
    cell, lo, hi = (table[c][0].as_py() for c in ("cell", "lo", "hi"))
    cls, weight, block = (table[c].to_numpy() for c in ("cls", "weight", "block"))
    codes = matrix_int(table["codes"])
    width = 1 + PROBES
    table_no = int(np.flatnonzero(codes[0] == cell)[0]) // width
    x = units(matrix(table["embedding"]))
    n = len(cls)
    links, least = np.zeros(n, dtype=np.int64), cls.copy()
    linked = np.zeros((n, n), dtype=bool)  # at most (2 * BLOCK) ** 2 bytes
    for start in range(0, n, 512):
        linked[start : start + 512] = x[start : start + 512] @ x.T >= like
    if lo != hi:
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    for start in range(0, n, SLICE):
        i, j = np.nonzero(linked[start : start + SLICE])
        if not len(i):
            continue
        i += start
        new = np.ones(len(i), dtype=bool)
        for t in range(table_no):
            # pairs that no earlier table has brought together
            left = np.flatnonzero(new)
            mine, yours = codes[i[left], t * width : (t + 1) * width], codes[j[left], t * width : (t + 1) * width]
            new[left] = ~(mine[:, :, None] == yours[:, None, :]).any((1, 2))
        i, j = i[new], j[new]
        mine, yours = (codes[k, table_no * width : (table_no + 1) * width] for k in (i, j))
        shared = (mine[:, :, None] == yours[:, None, :]).any(2)
        first = np.where(shared, mine, np.iinfo(np.int64).max).min(1) == cell
        links += np.bincount(i[first], weights=weight[j[first]], minlength=n).astype(np.int64)
    some = np.flatnonzero(linked.any(1))
    while len(some):
        before = least[some]
        for start in range(0, len(some), 256):
            own = some[start : start + 256]
            least[own] = np.minimum(least[own], np.where(linked[own], least[None, :], np.iinfo(np.int64).max).min(1))
        if (before == least[some]).all():
            break
    kept = (links > 0) | (least != cls)
    return pa.table([pa.array(cls[kept]), pa.array(links[kept]), pa.array(least[kept])], names=["cls", "links", "least"])


def matrix_int(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_duplicates(embeddings: DataFrame, like: float = LIKE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    small_batches(embeddings.sparkSession)
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = valid_vectors(every).where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("key", F.xxhash64("embedding"))
    classes = rows.groupBy("label", "key", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight"), F.first("dim").alias("dim"))
    classes = staged(classes, "classes")
    codes = staged(filed(classes), "cells")
    placed = codes.select("cls", F.xxhash64("label", "dim").alias("side"), "codes", F.explode(F.array_distinct("codes")).alias("cell"))
    # cells with one class go before any vector moves
    counts = placed.groupBy("side", "cell").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select("side", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = placed.join(counts, ["side", "cell"])
    shared = shared.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shared = shared.select("*", partner.alias("partner")).withColumn("lo", F.least("block", "partner")).withColumn("hi", F.greatest("block", "partner"))
    shared = shared.select("side", "cell", "lo", "hi", "block", "cls", "codes").join(classes.select("cls", "weight", "embedding"), "cls")
    found = shared.groupBy("side", "cell", "lo", "hi").applyInArrow(lambda t: released(group_links(t, like)), "cls long, links long, least long")
    found = staged(found.groupBy("cls", "least").agg(F.sum("links").alias("links")), "links")
    roots = components(found.where("least <> cls").select(F.col("cls").alias("a"), F.col("least").alias("b")))
    firsts = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    reached = roots.join(firsts, "root").select(F.col("node").alias("cls"), "component_id")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of = classes.join(sums, "cls", "left").join(reached, "cls", "left")
    of = of.select(F.col("label").alias("_label"), F.col("key").alias("_key"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "cls").alias("c"))
    # classes hold valid vectors with a label alone, so other rows find none
    keyed = every.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.xxhash64("embedding")))
    out = keyed.join(of, (F.col("key") == F.col("_key")) & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
