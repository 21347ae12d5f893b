"""Exact similarity of word shingles, for the near-duplicates of ``simhash``: shingle sets,
their Jaccard similarity, and the candidates that fingerprints can't reach.

A 64-bit fingerprint alone can't hold all pairs of a similarity: sets 0.8 alike differ in
about 10 bits with a wide spread, and a radius that holds them all has no selective
segments. So the pairs that fingerprints bring together are verified here, and the rest
are found by parts. Sets of n and m shingles that are ``like`` alike differ in no more than
D = (1 - like) / (1 + like) * (n + m) shingles. Where the range of hashes is cut into more
parts than that, most parts are equal in both, and of the parts that are not empty each
set's first D + 1, in one order for all, hold one of these: so documents meet at the hash of
a part's shingles. A part holds about four, so a passage that many documents share brings
few of them together, and parts that many documents have come last in the order: all parts
are filed, and a set drops those of over ``HEAVY`` documents if D + 1 others are left.
Classes of sizes (each 1 / ``like`` times the one before) say how many parts there are; a
document is filed at the level of its class, and at the next one if a partner can be there.
Levels of small sets have a part a shingle, those that are common in a sample last, which
decides the cost only. Pairs go whose sizes, or counts of shingles by the last bits of
their hashes, differ too much; the rest is verified on the whole sets.

Defined cases: words are lower-cased runs without white space; texts of fewer than ``width``
words are one shingle; null, empty and blank texts are copies of each other; rows without
a doc_id take no part; repeated rows are one node; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from itertools import accumulate
from math import ceil, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

WIDTH, LIKE, SEED = 5, 0.8, 42
#: Documents sampled for the order, copies there that make a shingle common, and common
#: shingles that are remembered at most.
SAMPLE, COMMON, REMEMBERED = 16_384, 3, 200_000
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Sets of levels up to this size have a part a shingle; counts by the last bits of hashes.
SMALL, COUNTS, HEAVY = 96, 128, 32
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """A key of the words of a text, and the distinct hashes of its shingles, both signed."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    key = int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))
    if not words:
        return key, np.zeros(0, dtype=np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[:-1]], ends[min(width, len(words)) - 1 :], strict=False)]
    return key, np.unique(np.array(hashes, dtype="<u8").view("<i8"))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of hashes: bits that over half of them have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Common shingles of a sample, the most common last."""

    def listed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for t in b.column(2):
                yield pa.record_batch([pa.array(shingle_set(t.as_py(), width)[1])], names=["s"])

    bound = int((1 << 30) * min(1.0, SAMPLE / max(rows.count(), 1)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < bound)
    counts = sample.mapInArrow(listed, "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    return counts.orderBy(F.desc("count"), "s").limit(REMEMBERED).select("s").toArrow()["s"].to_numpy()[::-1]


def class_bounds(like: float) -> list[int]:
    """The least size of each class: sizes of two classes that are not neighbours can't be
    ``like`` alike."""
    out, ratio = [1], min(like, 0.99)
    while out[-1] < 1 << 40:
        out.append(int(out[-1] / ratio + 1e-9) + 1)
    return out


@functools.cache
def parts_of(most: int, share: float) -> int:
    """As many parts as leave D + 12 of them with a shingle, for sets of ``most``."""
    parts, differ = 2 * share * most + 12, 2 * share * most
    while parts * (1 - exp(-most / parts)) < differ + 12:
        parts *= 1.03
    return ceil(parts)


def filings(n: int, like: float, bounds: list[int]) -> Iterator[tuple[int, int, int]]:
    """For a set of n: each level it is filed at, the level's number of parts (0: a part a
    shingle), and how many parts of the set are to be filed."""
    share, own = (1 - like) / (1 + like), bisect.bisect_right(bounds, n) - 1
    for level in (own, own + 1):
        most = bounds[level + 1] - 1
        partner = min(most, int(n / like + 1e-9))
        if partner >= bounds[level]:
            parts = parts_of(most, share) if most > SMALL else 0
            yield level, parts, int(share * (n + partner) + 1e-9) + 1


def part_hashes(s: np.ndarray, like: float, bounds: list[int], place: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[int]]:
    """The hashes of a set's parts a level, and how many of these may be dropped; under 0 if
    they are not enough. ``place``: of each shingle in the list of common ones, 0 if it is
    not there."""
    out, spare = [], []
    mixed = (s.view(np.uint64) + np.uint64(int(MIX[0]) * seed % (1 << 64))) * MIX[1]
    mixed ^= mixed >> np.uint64(29)
    for level, parts, filed in filings(len(s), like, bounds) if len(s) else ():
        if parts:
            index = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(index, kind="stable")
            found, starts = np.unique(index[order], return_index=True)
            hashes = np.add.reduceat(mixed[order] * MIX[0], starts) ^ found
        else:
            hashes = mixed[np.lexsort((s, place))[:filed]]
        hashes = (hashes + np.uint64(level)) * MIX[1]
        out.append((hashes ^ (hashes >> np.uint64(31))).view(np.int64))
        spare.append(len(hashes) - filed)
    return out, spare


def filed_parts(rows: DataFrame, width: int, like: float, seed: int = 0) -> DataFrame:
    """doc_id, h, key, n (distinct shingles), fp (their fingerprint), ``counts`` of their last
    bits and which of these are odd, and ``parts`` and how many are ``spare`` at each level, of each row (doc_id, h, text)."""
    common, bounds = common_shingles(rows, width), class_bounds(like)
    order = np.argsort(common)
    held = rows.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def marked(batches: Iterator[pa.RecordBatch]):
        known, places = held.value
        for b in batches:
            out = ([], [], [], [], [], [], [], [])
            for t in b.column(2):
                key, s = shingle_set(t.as_py(), width)
                place = np.zeros(len(s), dtype=np.int64)
                if len(known) and len(s) <= 2 * SMALL / like:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    place = np.where(known[at] == s, places[at], 0)
                parts, spare = part_hashes(s, like, bounds, place, seed)
                counts = np.minimum(np.bincount(s & (COUNTS - 1), minlength=COUNTS), 127).astype(np.int8)
                odd = np.packbits(counts & 1, bitorder="little").view("<i8").tolist()
                for column, x in zip(out, (key, len(s), majority(s), counts, *odd, parts, spare), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()))
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "h", "key", "n", "fp", "counts", "odd0", "odd1", "parts", "spare"])

    return rows.mapInArrow(lambda batches: trimmed(marked(batches)), "doc_id long, h long, key long, n long, fp long, counts array<tinyint>, odd0 long, odd1 long, parts array<array<long>>, spare array<int>")


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, h, key and the whole shingle set of each row (doc_id, h, text)."""

    def marked(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                keys, sets = zip(*(shingle_set(t.as_py(), width) for t in part.column(2)), strict=True)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "h", "key", "set"])

    return rows.mapInArrow(lambda batches: trimmed(marked(batches)), "doc_id long, h long, key long, set array<long>")


def alike(n: Column, m: Column, like: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(n, m) / F.greatest(n, m) >= like


def differ(like: float) -> Column:
    """The shingles in which sets a and b can differ at most."""
    return (1 - like) / (1 + like) * (F.col("a_n") + F.col("b_n")) + 1e-6


def parity_alike(like: float) -> Column:
    """Whether sets a and b of these sizes and parities of counts can have the similarity:
    they differ in a shingle at least for each count that is odd in one of them alone."""
    odd = F.bit_count(F.col("a_odd0").bitwiseXOR(F.col("b_odd0"))) + F.bit_count(F.col("a_odd1").bitwiseXOR(F.col("b_odd1")))
    return alike(F.col("a_n"), F.col("b_n"), like) & (odd <= differ(like))


def counts_alike(like: float) -> Column:
    """Whether sets a and b of these counts can have the similarity: they differ in at least as
    many shingles as their counts do."""
    gap = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda n, x: n + x)
    return gap <= differ(like)


def possible(pairs: DataFrame, nodes: DataFrame, like: float) -> DataFrame:
    """Of ``pairs`` (a, b) those that can have the similarity by sizes and counts."""
    of = lambda x: nodes.select(F.col("key").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "counts")))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where(alike(F.col("a_n"), F.col("b_n"), like))
    return met.where(counts_alike(like)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the similarity."""
    one, other = (sets.select(F.col("key").alias(x), F.col("set").alias(f"{x}_set")) for x in "ab")
    met = pairs.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("a_set", "b_set")))
    return met.where(F.col("both") / (F.size("a_set") + F.size("b_set") - F.col("both")) >= like).select("a", "b")
