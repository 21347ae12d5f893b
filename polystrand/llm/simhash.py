"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in two segments of 32; two link at ``RADIUS`` = 3 or fewer
differing bits. Documents of one fingerprint are one node, so copies cost a row. A link of
up to 3 bits has at most one differing bit in one of the segments, so both segment tables
are probed with the ball of radius 1 around each segment:

* matches whose other segment is equal need no verification. All fingerprints that meet at
  such a point (at most 65 do) are joined to the least of them, without pairs, which makes
  a group of near copies one component;
* all other matches, of different components, are fetched and their complete distance is
  verified. Of a pair only the side with the bit set needs to probe, with that bit
  cleared. Whatever the first step has joined, this finds every link that is left.

``near_duplicates`` is the digest of 3-word shingles; ``keep_first`` takes any width of shingle
and a least similarity of the shingle sets, which verifies the links of fingerprints
exactly and adds those that no fingerprint can reach (see ``shingles``).

Defined cases: null, empty and blank texts have the fingerprint zero and link like any
other; repeated rows share their fingerprint; texts of any length are read whole; other
columns of any name take no part; an empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, settled, small_batches, spread, staged, trimmed
from .graph import components
from .shingles import HEAVY, LIKE, WIDTH, counts_alike, filed_parts, majority, parity_alike, possible, verified, whole_sets

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Rows of a number that are sent to all executors at most.
BROADCAST_ROWS = 1_000_000
#: Keys of one block of a large meeting.
BLOCK = 512


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], dtype="<u8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed long) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: trimmed(rows(batches)), "doc_id long, fp long")


def named(rows: DataFrame, roots: DataFrame, column: str = "c") -> DataFrame:
    """``rows`` with ``column`` replaced by its root, where it has one."""
    to = roots.select(F.col("node").alias(column), "root")
    return rows.join(spread(to), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links of up to 2 bits: each fingerprint and the least one that shares a point, which is
    a ball of radius 1 in one segment and the other segment as it is."""
    bits = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    points = nodes.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(b) for b in bits))).alias("point"))
    least = points.withColumn("least", F.min("fp").over(Window.partitionBy("point")))
    return least.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def far_matches(nodes: DataFrame) -> DataFrame:
    """Links of up to 3 bits between fingerprints of different components: fp and c of one
    (pfp, pc) and of the other."""
    mask = F.lit((1 << 32) - 1)
    segments = F.array(F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(mask).alias("v")), F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("v")))
    table = nodes.select("fp", "c", F.explode(segments).alias("at")).select("fp", "c", "at.s", "at.v")
    cleared = F.filter(F.array(*(F.lit(1 << i) for i in range(32))), lambda b: F.col("v").bitwiseAND(b) != 0)
    ball = F.concat(F.array("v"), F.transform(cleared, lambda b: F.col("v").bitwiseXOR(b)))
    probes = table.select(F.col("fp").alias("pfp"), F.col("c").alias("pc"), "s", F.explode(ball).alias("v"))
    buckets = table.groupBy("s", "v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    # a probe goes on only if its bucket holds another component
    hits = probes.join(spread(buckets), ["s", "v"]).where("lo <> pc or hi <> pc").select("s", "v", "pfp", "pc")
    return hits.join(spread(table), ["s", "v"]).where((F.col("c") != F.col("pc")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))) <= RADIUS))


def far_links(nodes: DataFrame) -> DataFrame:
    """The same links as pairs of components."""
    return far_matches(nodes).select(F.col("pc").alias("a"), F.col("c").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: the least doc_id that
    links reach."""
    found = staged(fingerprints(docs), "fingerprints")
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    near = components(near_links(nodes))
    once = staged(named(nodes.select("fp", F.col("fp").alias("c")), near), "once")
    far = components(far_links(once))
    roots = named(once, far).join(spread(nodes), "fp")
    firsts = roots.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = staged(roots.join(spread(firsts), "c").select("fp", "component_id"), "classes")
    discard(near, far, once, nodes)
    return found.join(spread(classes), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def close_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that fingerprints bring together: of ``nodes`` (key, fp) those with
    one fingerprint, or linked ones. Each is to be verified."""
    marks = staged(nodes.groupBy("fp").agg(F.min("key").alias("rep")), "marks")
    same = nodes.join(spread(marks), "fp").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    near = staged(near_links(marks.select("fp")), "near")
    roots = components(near)
    far = far_matches(named(marks.select("fp", F.col("fp").alias("c")), roots)).select(F.col("pfp").alias("a"), F.col("fp").alias("b"))
    rep = lambda x: marks.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_rep"))
    linked = near.unionByName(far).join(spread(rep("a")), "a").join(spread(rep("b")), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    out = staged(same.unionByName(linked).where("a <> b"), "pairs")
    discard(marks, near, roots)
    return out


def among(rows: DataFrame, few: DataFrame, *on: str) -> DataFrame:
    """The ``rows`` whose columns ``on`` are in the staged ``few``, which all executors get if they
    are not many: as one hash a row, which the driver holds in a third of the memory. A row
    that has another's hash may come too, and does no harm: it meets its own key, or goes
    when the whole columns are compared."""
    if few.count() > BROADCAST_ROWS:
        return rows.join(few.select(*on), list(on), "left_semi")
    name = free_name(rows, "hash")
    return rows.withColumn(name, F.xxhash64(*on)).join(F.broadcast(few.select(F.xxhash64(*on).alias(name))), name, "left_semi").drop(name)


def similar(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, like: float) -> tuple[DataFrame, DataFrame]:
    """Of staged ``pairs`` (a, b) of keys those whose texts have the similarity, and the sets
    that were read for it: of these texts alone."""
    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = staged(nodes.join(spread(asked), "key").select("doc_id", "h", "key"), "wanted")
    # few documents are asked for: so texts move only if there are many
    sets = whole_sets(among(rows, wanted, "doc_id", "h"), width)
    # one doc_id may have a text twice
    sets = staged(sets.join(spread(wanted), ["doc_id", "h", "key"], "left_semi").dropDuplicates(["key"]).select("key", "set"), "sets")
    links = staged(verified(pairs, sets, like), "links")
    discard(pairs, wanted)
    return links, sets


def sided(rows: DataFrame, x: str, *on: str) -> DataFrame:
    """``rows`` as side ``x`` of a join on the columns ``on``."""
    return rows.select(*on, *(F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in on))


def apart() -> Column:
    """Whether keys a and b are of different components; of a pair in one order alone."""
    return (F.col("a_key") < F.col("b_key")) & (F.col("a_c") != F.col("b_c"))


def crowds(heavy: DataFrame) -> DataFrame:
    """Where the keys of ``heavy`` (s, key) meet if they share an s: ``whole`` and ``at`` of each
    meeting, the ``hub`` and ``size`` of it, and each key that comes.

    Copies of one text that differ here and there share many parts, so they would meet again
    and again. The key of a part with the most heavy parts, which is the least changed copy
    as a rule, is the part's hub: all that meet it at any of its parts come once to one
    meeting, where that is no more work than a meeting a part."""
    heavy = staged(heavy, "heavy")
    weights = heavy.groupBy("key").agg(F.count("*").alias("w"))
    hubs = staged(heavy.join(spread(weights), "key").groupBy("s").agg(F.max(F.struct("w", "key"))["key"].alias("hub"), F.count("*").alias("met")), "hubs")
    sizes = heavy.join(spread(hubs), "s").select("hub", "key").distinct().groupBy("hub").agg(F.count("*").alias("n"))
    work = hubs.groupBy("hub").agg(F.sum(F.col("met") * F.col("met")).alias("work"))
    whole = F.col("n") * F.col("n") <= F.col("work")
    # a row a part here, as a hub may have most of the keys
    at = hubs.join(spread(sizes.join(spread(work), "hub")), "hub").select("s", whole.alias("whole"), F.when(whole, F.col("hub")).otherwise(F.col("s")).alias("at"), "hub", F.when(whole, F.col("n")).otherwise(F.col("met")).alias("size"))
    at = heavy.join(spread(at), "s").select("whole", "at", "hub", "size", "key")
    out = staged(at.distinct(), "meetings")
    discard(heavy, hubs)
    return out


def crowd_pairs(met: DataFrame, like: float) -> DataFrame:
    """Pairs (a, b) of keys of different components that come to one meeting and can have the
    similarity by sizes, parities and counts, compared as they meet. One side of a large
    meeting is dealt in blocks, so that no task has it all."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    here = ("whole", "at", "block")
    one = sided(met.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).drop("size"), "a", *here)
    other = sided(met.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("size"), "b", *here)
    return one.join(other, list(here)).where(apart() & parity_alike(like) & counts_alike(like)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def similar_groups(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """doc_id and h (of the text, where one doc_id has several) of each distinct text's first
    row, and those of the first row that its links reach, ``first``: texts link where their
    shingle sets are ``like`` alike. First is the least doc_id, then the least h."""
    if not 0.75 <= like <= 1:
        raise ValueError("the similarity must be 0.75 to 1")
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    for seed in itertools.count():
        found = staged(filed_parts(rows, width, like, seed), "parts")
        if not found.where(F.exists("spare", lambda x: x < 0)).limit(1).count():
            break
        discard(found)  # by bad luck a document has too few parts that are not empty: others
    first = F.min(F.struct("doc_id", "h"))
    once = (F.max(c).alias(c) for c in ("n", "fp", "counts", "odd0", "odd1"))  # the same for all rows of a key
    nodes = staged(found.groupBy("key").agg(first.alias("first"), *once).select("key", "n", "fp", "counts", "odd0", "odd1", "first.*"), "nodes")
    settled(docs.sparkSession)
    close = close_pairs(nodes.select("key", "fp"))
    # of the documents that meet at a part, each is held against three hubs, or that of a crowd
    # (their parts are by far the largest table here, so they move only if there are many)
    entries = among(found, nodes, "doc_id", "h", "key").select("key", F.posexplode(F.arrays_zip("parts", "spare")).alias("level", "x"))
    entries = entries.select("key", F.explode("x.parts").alias("s"), (2 * F.col("x.spare") + F.col("level")).alias("spare"))
    settled(docs.sparkSession)
    bucket = Window.partitionBy("s")
    hub = F.struct(F.xxhash64(F.lit(1), "key").alias("h"), "key")
    every = entries.withColumn("lo", F.min("key").over(bucket)).withColumn("hi", F.max("key").over(bucket)).where("lo <> hi")
    every = staged(every.withColumn("mid", F.min(hub).over(bucket)["key"]).withColumn("heavy", F.count("*").over(bucket) > HEAVY), "hits")
    discard(found)
    settled(docs.sparkSession)
    # parts that very many have go where enough others are left
    excess = every.where("heavy").groupBy("key", "spare").agg(F.count("*").alias("c")).where("c <= spare div 2").select("key", "spare")
    light = every.where("not heavy").select("s", "key", "lo", "mid", "hi")
    full = crowds(every.where("heavy").join(excess, ["key", "spare"], "left_anti").select("s", "key"))
    spokes = light.select("key", F.explode(F.array_distinct(F.array("lo", "mid", "hi"))).alias("to"))
    spokes = spokes.unionByName(full.select("key", F.col("hub").alias("to"))).where("key <> to")
    pairs = spokes.select(F.col("key").alias("a"), F.col("to").alias("b")).unionByName(close)
    pairs = possible(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, like)
    links, sets = similar(staged(pairs, "pairs"), rows, nodes, width, like)
    near = components(links)
    settled(docs.sparkSession)
    # then documents of different components against each other
    once = named(light.select("s", "key", F.col("key").alias("c")), near)
    once = staged(once.withColumn("lo", F.min("c").over(bucket)).withColumn("hi", F.max("c").over(bucket)).where("lo <> hi").select("s", "key", "c"), "once")
    across = sided(once, "a", "s").join(sided(once, "b", "s"), "s").where(apart()).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    met = named(full.select("whole", "at", "size", "key", F.col("key").alias("c")), near)
    met = staged(met.join(spread(nodes.select("key", "n", "counts", "odd0", "odd1")), "key"), "met")
    across = across.unionByName(crowd_pairs(met, like))
    across = possible(across.distinct(), nodes, like)
    across = staged(across, "pairs")
    settled(docs.sparkSession)
    more, more_sets = similar(across, rows, nodes, width, like)
    far = components(named(named(more, near, "a"), near, "b"))
    roots = named(named(nodes.withColumn("c", F.col("key")), near), far)
    firsts = roots.groupBy("c").agg(first.alias("first"))
    out = staged(roots.join(spread(firsts), "c").select("doc_id", "h", "first"), "copies")
    settled(docs.sparkSession)
    discard(nodes, close, every, full, met, sets, links, near, once, more, more_sets, far)
    return out


def keep_first(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """One row of each group of similar texts: the one with the least doc_id. Rows that
    repeat its doc_id and text are the same document; a doc_id with several texts is a
    document a text. Rows without a doc_id can't stand for a group and all stay."""
    kept = similar_groups(docs, width, like).where(F.struct("doc_id", "h") == F.col("first")).select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"))
    h = free_name(docs, "h")
    rows = docs.where(docs["doc_id"].isNotNull()).withColumn(h, F.xxhash64(docs["text"].cast("string")))
    rows = rows.join(spread(kept), (rows["doc_id"].cast("long") == kept["kept_id"]) & (rows[h] == kept["kept_h"]), "left_semi")
    return rows.dropDuplicates(["doc_id", h]).drop(h).unionByName(docs.where(docs["doc_id"].isNull()))
