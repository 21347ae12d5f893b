"""Approximate nearest neighbours: a forest of random-projection trees, searched through a
shared priority queue, with exact reranking of the leaves' rows.

Trees are fitted on a sample of at most ``SAMPLE`` distinct vectors, chosen by a hash of the
id: each node cuts its rows at the median of a random projection. Every row is filed in one
leaf a tree. For a query one queue over all trees holds the nodes still to open, by the sum
of squared distances to the cuts on the way; it yields ``SHARE`` of all leaves, and more
until some tree's leaves hold ``k`` + 1 rows or all. Tables of at most ``LEAF_ROWS``
distinct vectors are one leaf. Leaf rows
and the queries that reached them meet in groups of bounded size (a leaf is dealt to blocks
of about ``BLOCK`` rows), which give each query's nearest by exact cosines.

Equal vectors are one class with its least ids: of a class no more than ``k`` + 1 members
can be among a query's ``k`` nearest, so this loses nothing.

Defined cases: vectors null, zero or with null or non-finite components take no part, nor
do rows without an id; vectors of each length are searched among themselves, each length
in a forest of its own; repeated rows count once; ties go to the smaller id; with fewer
than ``k`` candidates all are returned; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import matrix, units, valid_vectors

SAMPLE, TREES, LEAF_ROWS, SHARE, BLOCK = 65_536, 4, 1024, 0.4, 4096
DEEPEST, SALTS = 10, 16


class Forest:
    """Balanced binary trees as arrays: node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.depth, self.inner = depth, (1 << depth) - 1
        normals = rng.standard_normal((trees, self.inner, sample.shape[1]))
        self.normals = normals / np.linalg.norm(normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, self.inner))
        for t in range(trees):
            at = np.zeros(len(sample), dtype=np.int64)
            for level in range(depth):
                side = np.einsum("ij,ij->i", sample, self.normals[t][at])
                order = np.lexsort((side, at))
                nodes, firsts, sizes = np.unique(at[order], return_index=True, return_counts=True)
                self.cuts[t, nodes] = side[order][firsts + (sizes - 1) // 2]
                at = 2 * at + 1 + (side > self.cuts[t][at])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees."""
        out = np.zeros((len(rows), len(self.cuts)), dtype=np.int64)
        for t in range(len(self.cuts)):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", rows, self.normals[t][at]) > self.cuts[t][at])
            out[:, t] = at - self.inner + (t << self.depth)
        return out

    def search(self, queries: np.ndarray, visits: int, held: np.ndarray, enough: int) -> Iterator[list[int]]:
        """For each query the ``visits`` leaves that one queue over all trees yields, and
        more until those of one tree hold ``enough`` rows, by the rows ``held`` a leaf."""
        trees, inner = len(self.cuts), self.inner
        margins = np.einsum("qd,tnd->qtn", queries, self.normals, optimize=True) - self.cuts
        for own in margins.tolist():
            queue, found, reached = [(0.0, t, 0) for t in range(trees)], [], [0] * trees
            while queue and (len(found) < visits or max(reached) < enough):
                far, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append(node - inner + (t << self.depth))
                    reached[t] += int(held[found[-1]])
                    continue
                m = own[t][node]
                heapq.heappush(queue, (far, t, 2 * node + 1 + (m > 0)))
                heapq.heappush(queue, (far + m * m, t, 2 * node + 1 + (m <= 0)))
            yield found


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row a distinct vector: its least id ``cls``, its ``k`` + 1 least ids, the vector."""
    key = F.xxhash64("embedding")
    salted = Window.partitionBy("key", "embedding", "salt").orderBy("vec_id")
    few = rows.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    least = few.groupBy("key", "embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    return least.select(F.col("ids")[0].alias("cls"), "ids", "embedding")


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each length in a column of vectors, and the places of its rows."""
    lengths = pc.list_value_length(column).to_numpy()
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def nearest(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows by cosine of each row for
    which the column ``is_query`` of vec_id holds."""
    spark = embeddings.sparkSession
    rows = valid_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    rows = rows.where("vec_id is not null").select("vec_id", "embedding").distinct()
    classes = staged(classes_of(rows, k), "classes")
    counts = {r.dim: r.n for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()}
    # lengths of more than one leaf share the sample
    large = [dim for dim, n in counts.items() if n > LEAF_ROWS]
    samples = {}
    if large:
        bounds = F.create_map(*(F.lit(x) for dim in large for x in (dim, int((1 << 30) * min(1.0, SAMPLE / len(large) / counts[dim])))))
        place = F.pmod(F.xxhash64(F.lit(1), F.col("cls")), F.lit(1 << 30))
        sample = classes.where(place < bounds[F.size("embedding")]).orderBy("cls").select("embedding").toArrow()["embedding"].combine_chunks()
        samples = {dim: units(matrix(sample.take(pa.array(at)))) for dim, at in by_length(sample)}
    forests, firsts, visits, blocks, total = {}, {}, {}, {}, 0
    for dim, n in counts.items():
        depth = int(np.clip(np.ceil(np.log2(n / LEAF_ROWS)), 3, DEEPEST)) if n > LEAF_ROWS else 0
        trees = TREES if depth else 1
        forests[dim] = Forest(samples.get(dim, np.zeros((0, dim))), depth, trees)
        firsts[dim], total = total, total + (trees << depth)
        visits[dim] = max(1, round(SHARE * (trees << depth)))
        blocks[dim] = max(1, -(-n // ((1 << depth) * BLOCK)))
    forest = spark.sparkContext.broadcast(forests)
    element = classes.schema["embedding"].dataType.simpleString()
    schema = f"leaf long, block int, query long, cls long, ids array<long>, embedding {element}"
    names = ["leaf", "block", "query", "cls", "ids", "embedding"]

    def counted(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(total, dtype=np.int64)
        for b in batches:
            for dim, places in by_length(b.column(0)):
                leaves = forest.value[dim].leaves(units(matrix(b.column(0).take(pa.array(places)))))
                held += np.bincount(leaves.reshape(-1) + firsts[dim], minlength=total)
        leaf = np.flatnonzero(held)
        yield pa.record_batch([pa.array(leaf), pa.array(held[leaf])], names=["leaf", "n"])

    held = np.zeros(total, dtype=np.int64)
    for dim, n in counts.items():
        if dim not in large:
            held[firsts[dim]] = n
    if large:
        split = classes.where(F.size("embedding").isin(large)).select("embedding")
        sizes = split.mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
        held[sizes["leaf"].to_numpy()] = sizes["n"].to_numpy()

    def filed(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for dim, places in by_length(whole.column(2)):
                b = whole.take(pa.array(places))
                leaves = forest.value[dim].leaves(units(matrix(b.column(2)))) + firsts[dim]
                at = pa.array(np.repeat(np.arange(len(b)), leaves.shape[1]))
                cls = b.column(0).take(at)
                block = (cls.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(blocks[dim])
                yield pa.record_batch([pa.array(leaves.reshape(-1)), pa.array(block.astype(np.int32)), pa.nulls(len(at), pa.int64()), cls, b.column(1).take(at), b.column(2).take(at)], names=names)

    def asked(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for dim, places in by_length(whole.column(1)):
                n = blocks[dim]
                for lo in range(0, len(places), 512):
                    part = whole.take(pa.array(places[lo : lo + 512]))
                    found = list(forest.value[dim].search(units(matrix(part.column(1))), visits[dim], held[firsts[dim] :], min(k + 1, counts[dim])))
                    leaf = np.repeat(np.concatenate(found), n) + firsts[dim]
                    at = pa.array(np.repeat(np.arange(len(part)), [len(f) * n for f in found]))
                    block = np.tile(np.arange(n, dtype=np.int32), len(leaf) // n)
                    ids = pa.nulls(len(at), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(leaf), pa.array(block), part.column(0).take(at), pa.nulls(len(at), pa.int64()), ids, part.column(1).take(at)], names=names)

    def reranked(table: pa.Table) -> pa.Table:
        """The ``k`` + 1 classes nearest to each query of one group."""
        out = ([], [], [], [])
        is_row = table["query"].is_null()
        index, queries = table.filter(is_row), table.filter(pc.invert(is_row))
        if len(index) and len(queries):
            cls, ids, rows = index["cls"].to_numpy(), index["ids"].to_pylist(), units(matrix(index["embedding"]))
            for lo in range(0, len(queries), 256):
                part = queries.slice(lo, 256)
                cosines = units(matrix(part["embedding"])) @ rows.T
                for query, own in zip(part["query"].to_pylist(), cosines, strict=True):
                    best = np.lexsort((cls, -own))[: k + 1] if len(own) <= 64 else top(own, cls, k + 1)
                    for column, values in zip(out, ([query] * len(best), cls[best].tolist(), [ids[i] for i in best], own[best].tolist()), strict=True):
                        column += values
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query", "cls", "ids", "score"])

    index = classes.mapInArrow(filed, schema)
    queries = rows.where(is_query(F.col("vec_id"))).mapInArrow(asked, schema)
    found = index.unionByName(queries).groupBy("leaf", "block").applyInArrow(reranked, "query long, cls long, ids array<long>, score double")
    once = found.groupBy("query", "cls").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = once.select("query", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    least = np.partition(scores, -k)[-k]
    at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
