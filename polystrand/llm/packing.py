"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so documents of one length, and gaps of one
size in consecutive sequences, are kept as runs. A round range-sorts the runs of documents
and of gaps, and sweeps over both:

1. The successor of a length is the least gap that holds it; as many documents of the
   length as this gap holds go into one gap (a bundle).
2. Conflicts are resolved by rank: bundles in order of falling length are let in while there
   are more gaps that hold them than bundles before them. The others wait for a later round.
3. From the shortest length on, the bundles let in take the least gaps that hold them and
   that shorter ones have left, each the place that its rank has in the order of the gaps.
4. The gaps that remain are those of the next round; for documents that no gap holds,
   as many empty sequences are opened as their tokens fill.

A round admits documents of at least ``ADMIT`` times the length the one before it admitted,
so long ones find their places first. Each is one job, written to the shared folder and read
again; the driver only sees whether documents are left. As there are at most ``capacity``
lengths, the sweeps of a round see some thousand runs however large the corpus, so they are
one task of an executor, without a shuffle: only more lengths would call for more. Documents get their rank within their length by salted
counts and their place from the run that holds this rank.

Defined cases: null or empty text is the end id alone; equal rows are packed each, in any
order; documents of equal length are ranked by salt and key; rows without a doc_id have
their pieces too; very long texts are cut into pieces, and encoded whole; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import remove, shared_dir, small_batches, staged, trimmed

SALTS = 256
#: Runs that are sent to all executors; a larger plan is joined by a shuffle.
BROADCAST_RUNS = 500_000
#: The least length that a round admits, as a share of what the round before it admitted.
ADMIT = 0.9
#: Rows of the rounds: documents (d), gaps (g), places (p). ``size`` is a length or a gap;
#: ``first`` a rank of documents or a sequence; places are of ``n`` ranks, ``each`` to a sequence.
ROUND = "kind string, size long, first long, n long, each long, sequence long, offset long, least long, opened long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Ids of each document and the end id, cut into pieces of at most ``capacity``."""

    def rows(batches: Iterator[pa.RecordBatch]):
        own, end = encoder(path), np.array([end_id], dtype="<u4")
        for b in batches:
            out = ([], [], [], [], [])
            for doc, found in zip(b.column(0).to_pylist(), own.encode_many(b.column(1)), strict=True):
                ids = np.concatenate([found, end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    for column, x in zip(out, (doc, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: trimmed(rows(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], least: int) -> Iterator[tuple[tuple[int, int, int], int, int, int]]:
    """Runs of documents (length, first rank, n), longest first, against runs of gaps (size,
    first sequence, n), largest first. For each length that the round lets in: its run,
    documents of a bundle, and the places of its bundles among the gaps, shortest length first."""
    sizes = [-g[0] for g in gaps]
    ends = [0, *itertools.accumulate(g[2] for g in gaps)]
    let_in, taken = [], 0
    for run in docs:
        holding = bisect.bisect_right(sizes, -run[0])
        if run[0] < least or not holding:
            continue
        each = gaps[holding - 1][0] // run[0]
        bundles = min(-(-run[2] // each), ends[holding] - taken)
        if bundles:
            let_in.append((run, each, bundles, ends[holding]))
            taken += bundles
    free = ends[-1]
    for run, each, bundles, end in reversed(let_in):
        free = min(free, end) - bundles
        yield run, each, free, free + bundles


def best_fit_round(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], least: int, opened: int, capacity: int) -> tuple[list, list, list, int, int]:
    """One round over runs: the documents and the gaps that are left, the places given (length,
    first rank, n, each, sequence, offset), the least length to admit next, and the number of
    sequences opened so far."""
    docs, gaps = sorted(docs, reverse=True), sorted(gaps, key=lambda g: (-g[0], g[1]))
    least = min(least, docs[0][0]) if docs else 1
    ends, given, after, placed = [0, *itertools.accumulate(g[2] for g in gaps)], [], [], {}
    untouched = ends[-1]

    def keep(lo: int, hi: int) -> None:
        """Gaps at the places from lo to hi stay as they are."""
        k = bisect.bisect_right(ends, lo) - 1
        while lo < hi:
            end = min(hi, ends[k + 1])
            after.append((gaps[k][0], gaps[k][1] + lo - ends[k], end - lo))
            lo, k = end, k + 1

    for (length, rank, n), each, lo, hi in sweep(docs, gaps, least):
        keep(hi, untouched)
        untouched, done, at = lo, 0, bisect.bisect_right(ends, lo) - 1
        while lo < hi:
            size, first, _ = gaps[at]
            end = min(hi, ends[at + 1])
            put = min((end - lo) * each, n - done)
            full, rest = divmod(put, each)
            sequence = first + lo - ends[at]
            given.append((length, rank + done, put, each, sequence, capacity - size))
            after += [(size - each * length, sequence, full), (size - rest * length, sequence + full, int(rest > 0))]
            lo, done, at = end, done + put, at + 1
        placed[length] = done
    keep(0, untouched)
    homeless = sum(size * n for size, _, n in docs if size >= least and (not gaps or size > gaps[0][0]))
    left = [(size, rank + placed.get(size, 0), n - placed.get(size, 0)) for size, rank, n in docs if n > placed.get(size, 0)]
    if homeless:
        after.append((capacity, opened, -(-homeless // capacity)))
        opened -= -homeless // capacity
    # gaps that are shorter than all documents left are of no use; neighbours of a size are one run
    shortest, joined = (left[-1][0] if left else capacity + 1), []
    for size, first, n in sorted(g for g in after if g[2] and g[0] >= shortest):
        if joined and joined[-1][0] == size and joined[-1][1] + joined[-1][2] == first:
            joined[-1] = (size, joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((size, first, n))
    return left, joined, given, max(1, int(least * ADMIT)), opened


def next_round(state: DataFrame, capacity: int) -> DataFrame:
    """The rows (``ROUND``) that a round over ``state`` leaves, and the places that it gives."""

    def rows(batches: Iterator[pa.RecordBatch]):
        runs = {"d": [], "g": []}
        least, opened = capacity, 0
        for b in batches:
            for r in b.to_pylist():
                runs[r["kind"]].append((r["size"], r["first"], r["n"]))
                least, opened = r["least"], r["opened"]
        left, gaps, given, least, opened = best_fit_round(runs["d"], runs["g"], least, opened, capacity)
        out = [("d", *x, 0, 0, 0) for x in left] + [("g", *x, 0, 0, 0) for x in gaps] + [("p", *x) for x in given]
        columns = [*zip(*out, strict=True)] if out else [[]] * 7
        columns += [[least] * len(out), [opened] * len(out)]
        yield pa.record_batch([pa.array(x, pa.int64() if k else pa.string()) for k, x in enumerate(columns)], names=[x.split()[0] for x in ROUND.split(", ")])

    return state.mapInArrow(rows, ROUND)


def best_fit_rounds(lengths: DataFrame, capacity: int) -> tuple[DataFrame, str]:
    """Places (size, first, n, each, sequence, offset) of ``lengths`` (length, n): the n
    documents of a length (size) from rank ``first`` go to consecutive sequences, ``each``
    of them to one, the first of these at the offset. And the folder that holds them."""
    spark: SparkSession = lengths.sparkSession
    base = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    none = F.lit(0).cast("long")
    start = lengths.select(F.lit("d").alias("kind"), F.col("length").cast("long").alias("size"), none.alias("first"), F.col("n").cast("long").alias("n"), none.alias("each"), none.alias("sequence"), none.alias("offset"), F.lit(capacity).cast("long").alias("least"), none.alias("opened"))
    paths: list[str] = []
    rows = start.coalesce(1)
    while True:
        paths.append(f"{base}/{len(paths)}")
        seen = Observation()
        rows.observe(seen, F.count(F.when(F.col("kind") == "d", 1)).alias("left")).write.parquet(paths[-1])
        if not seen.get["left"]:
            return spark.read.schema(ROUND).parquet(*paths).where("kind = 'p'"), base
        rows = next_round(spark.read.schema(ROUND).parquet(paths[-1]).where("kind <> 'p'").coalesce(1), capacity)


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id and
    offset. ``pieces`` is read three times, so it should be a staged table."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    sizes = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = pieces.withColumn("_own", F.row_number().over(own) - 1).join(first, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_own") + F.col("_before"))
    places, folder = best_fit_rounds(sizes.groupBy("length").agg(F.sum("_n").alias("n")), capacity)
    plan = staged(places.select(F.col("size").alias("_length"), F.col("first").alias("_lo"), (F.col("first") + F.col("n")).alias("_hi"), F.col("each").alias("_each"), F.col("sequence").alias("_first"), F.col("offset").alias("_offset")).coalesce(1), "plan")
    remove(spark, folder)
    if plan.count() <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    placed = ranked.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _lo) div _each")).withColumn("offset", F.expr("_offset + (_rank - _lo) % _each * length"))
    return placed.drop("_salt", "_l", "_s", "_own", "_before", "_rank", "_length", "_lo", "_hi", "_each", "_first", "_offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(token_pieces(docs, path, capacity, end_id), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
