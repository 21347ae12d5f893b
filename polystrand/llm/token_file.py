"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A block holds the ids of whole documents. Its ids are dealt to parallel lanes (lane j has
the j-th stretch of the block); all lanes take one step at a time as array operations,
share one model, and have a range coder each. The model starts anew in each block:

* order 0: counts of all ids seen, renewed every few steps;
* order 1 and order 2: for a context of one or two ids, the id that came next and how
  often in a row that was right.

The code interval of a step mixes the three: a part for the order-2 prediction, a part for
the order-1 prediction, the rest by order-0 counts; the parts' weights adapt to how often
each was right at this pair of confidences. All arithmetic is in whole numbers, so any
machine decodes what any other encoded. A block ends with the CRC-32 of its ids, and
decoding checks it: a damaged block raises ``ValueError`` and touches no other block.

Defined cases: null or empty text is its end id alone; ids must be below the vocabulary
size; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CHUNK, LATIN_END_POINT, byte_letters
from .common import shuffle_partitions, small_batches, staged, trimmed
from .pieces import SLICE, PieceTable, buffers

HEADER = struct.Struct("<4sIIII")
MAGIC = b"CMR1"
LANES, LEAST_STEPS, REFRESH = 4096, 64, 8
SLOT_BITS = 18
STEP, LEVEL_BITS = 24, 2
LEVELS = 1 << LEVEL_BITS
KINDS = 2 * LEVELS * LEVELS
PREVIOUS_FACTOR, ID_FACTOR = np.int32(7919), np.int32(31337)
TOP_SHIFT, TOP, BOTTOM, WORD = np.uint64(48), np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)
ONE, LOW_WORD = np.uint64(1), np.uint64(0xFFFF)
BOTTOM_MASK = np.uint64((1 << 32) - 1)
#: Pieces that go to the library as one text, and that are remembered.
JOINED, REMEMBERED = 64, 1_400_000
#: Latin words that are remembered, each of at most ``JOINED`` letters.
REMEMBERED_WORDS = 400_000
#: The words that the library's byte-level pattern makes of Latin text.
SPACES = " \t\n\r\f\v\x85\xa0"
LATIN = {c: "".join(ch for ch in map(chr, range(0x30, LATIN_END_POINT)) if unicodedata.category(ch)[0] == c) for c in "LN"}
LATIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN['L']}]+| ?[{LATIN['N']}]+| ?[^{SPACES}{LATIN['L']}{LATIN['N']}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN_END_POINT - 1)}]")
#: Ids after which a block is closed at the next document.
BLOCK_IDS = 1 << 20


class Mixer:
    """The model that encoder and decoder run in step."""

    def __init__(self, vocab: int, lanes: int, steps: int):
        self.vocab = vocab
        # of 32 bits while all counts together fit, as these are read at random
        small = vocab + STEP * lanes * steps < 1 << 31
        self.cumulative = np.arange(vocab + 1, dtype=np.int32 if small else np.int64)
        self.counts = np.ones(vocab, dtype=np.int64)
        self.total = vocab
        self.seen: list[np.ndarray] = []
        # an entry holds the id that came next, times LEVELS, and how sure it is
        self.after1, self.after2 = np.zeros(vocab, dtype=np.int32), np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.right2, self.right1, self.wrong = (np.full(KINDS, x, dtype=np.int64) for x in (2, 2, 16))
        self.last = np.zeros(lanes, dtype=np.int32)
        self.previous, self.slot = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each lane the order-2 and order-1 ids, and the ends of their parts."""
        self.entry2, self.entry1 = self.after2.take(self.slot), self.after1.take(self.previous)
        self.id2, self.id1 = self.entry2 >> LEVEL_BITS, self.entry1 >> LEVEL_BITS
        self.kind = ((self.entry2 & (LEVELS - 1)) * LEVELS + (self.entry1 & (LEVELS - 1))) * 2 + (self.id2 == self.id1)
        part2, part1 = (np.minimum(self.total * x // self.wrong, 32 * self.total) + 1 for x in (self.right2, self.right1))
        return self.id2, self.id1, part2.take(self.kind), (part2 + part1).take(self.kind)

    def learn(self, ids: np.ndarray, was2: np.ndarray, was1: np.ndarray) -> None:
        """``was2``: the order-2 id was right; ``was1``: the order-1 id was."""
        outcome = self.kind + KINDS * (2 - np.maximum(2 * was2.view(np.int8), was1.view(np.int8)))
        of = 2 * np.bincount(outcome, minlength=3 * KINDS)
        self.right2 += of[:KINDS]
        self.right1 += of[KINDS : 2 * KINDS]
        self.wrong += of[2 * KINDS :]
        fresh = ids << LEVEL_BITS
        for table, at, entry, was in ((self.after2, self.slot, self.entry2, was2), (self.after1, self.previous, self.entry1, was1)):
            sure = entry & (LEVELS - 1)
            table[at] = np.where(was, entry + (sure < LEVELS - 1), np.where(sure > 0, entry - 1, fresh))
        # the factors wrap at 32 bits; places are of 64, which arrays take as they are
        self.slot = ((self.last * PREVIOUS_FACTOR + ids * ID_FACTOR) >> 5 & ((1 << SLOT_BITS) - 1)).astype(np.int64)
        self.last, self.previous = ids, ids.astype(np.int64)
        self.seen.append(ids)
        if len(self.seen) == REFRESH:
            self.counts += STEP * np.bincount(np.concatenate(self.seen), minlength=self.vocab)
            np.cumsum(self.counts, dtype=self.cumulative.dtype, out=self.cumulative[1:])
            self.total = int(self.cumulative[-1])
            self.seen = []


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes and steps for a block of ``n`` ids."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def settle(low: np.ndarray, span: np.ndarray) -> Iterator[np.ndarray]:
    """Yields the lanes whose top word is due, and shifts them afterwards, until every
    lane has room for another step."""
    lanes = None
    while True:
        a, b = (low, span) if lanes is None else (low[lanes], span[lanes])
        same = (a ^ (a + b)) < TOP
        short = ~same & (b < BOTTOM)
        due = np.flatnonzero(same | short)
        if not len(due):
            return
        if short.any():
            where = np.flatnonzero(short)
            at = where if lanes is None else lanes[where]
            span[at] = (~low[at] + ONE) & BOTTOM_MASK
        lanes = due if lanes is None else lanes[due]
        yield lanes
        if a is low:  # all lanes: shifts of 16 or none
            by = (same | short) * WORD
            low <<= by
            span <<= by
        else:
            low[lanes] = low.take(lanes) << WORD
            span[lanes] = span.take(lanes) << WORD


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """The block of ``ids`` (unsigned 32-bit, each below ``vocab``)."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError("an id is outside the vocabulary")
    n = len(ids)
    lanes, steps = lanes_of(n)
    # the last lane's missing ids are zeros, which decoding drops
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixer(vocab, lanes, steps)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    words, owners = [], []
    for now in grid:
        id2, id1, part2, rest = model.predict()
        is2, is1 = now == id2, now == id1
        start = np.where(is2, 0, np.where(is1, part2, rest + model.cumulative.take(now)))
        width = np.where(is2, part2, np.where(is1, rest - part2, model.counts.take(now)))
        span //= (rest + model.total).view(np.uint64)
        low += start.view(np.uint64) * span
        span *= width.view(np.uint64)
        for due in settle(low, span):
            words.append((low[due] >> TOP_SHIFT).astype("<u2"))
            owners.append(due)
        model.learn(now, is2, is1)
    for _ in range(4):
        words.append((low >> TOP_SHIFT).astype("<u2"))
        owners.append(np.arange(lanes))
        low <<= WORD
    owner, word = np.concatenate(owners), np.concatenate(words)
    order = np.argsort(owner.astype(np.uint16), kind="stable")  # of 16 bits: a radix sort
    sizes = np.bincount(owner, minlength=lanes).astype("<u4")
    body = zlib.compress(sizes.tobytes(), 1)
    return HEADER.pack(MAGIC, n, vocab, len(body), zlib.crc32(ids.tobytes())) + body + word[order].tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ``ValueError`` if it is damaged."""
    try:
        magic, n, vocab, size, crc = HEADER.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block")
        lanes, steps = lanes_of(n)
        sizes = np.frombuffer(zlib.decompress(block[HEADER.size : HEADER.size + size]), dtype="<u4").astype(np.int64)
        words = np.frombuffer(block[HEADER.size + size :], dtype="<u2")
        if len(sizes) != lanes or sizes.sum() != len(words):
            raise ValueError("a block's lanes are cut short")
        ids = decode_lanes(words, sizes, vocab, steps)[:n]
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"a damaged block: {e}") from e
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def decode_lanes(words: np.ndarray, sizes: np.ndarray, vocab: int, steps: int) -> np.ndarray:
    lanes = len(sizes)
    model = Mixer(vocab, lanes, steps)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    at = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, dtype=np.uint64)
    for k in range(4):
        code = (code << WORD) | words[at + k]
    at += 4
    grid = np.zeros((steps, lanes), dtype="<u4")
    for t in range(steps):
        id2, id1, part2, rest = model.predict()
        parts = rest + model.total
        span //= parts.view(np.uint64)
        value = np.minimum(((code - low) // span).view(np.int64), parts - 1)
        now = np.where(value < part2, id2, id1)
        open_ = np.flatnonzero(value >= rest)
        # about in the order of values the search is quicker, and of 16 bits it is a radix sort
        count = (value.take(open_) - rest.take(open_)).astype(model.cumulative.dtype)
        order = np.argsort((count >> max(model.total.bit_length() - 16, 0)).astype(np.uint16), kind="stable")
        now[open_.take(order)] = model.cumulative.searchsorted(count.take(order), side="right") - 1
        is2, is1 = now == id2, now == id1
        start = np.where(is2, 0, np.where(is1, part2, rest + model.cumulative.take(now)))
        width = np.where(is2, part2, np.where(is1, rest - part2, model.counts.take(now)))
        low += start.view(np.uint64) * span
        span *= width.view(np.uint64)
        for due in settle(low, span):
            place = at.take(due)
            code[due] = (code.take(due) << WORD) | words.take(place, mode="clip")
            at[due] = place + 1
        grid[t] = now
        model.learn(now, is2, is1)
    return np.ascontiguousarray(grid.T).reshape(-1)


class PieceEncoder(PieceTable):
    """The tokenizers library over pieces: with a byte-level vocabulary a text splits for
    certain before each blank that a visible character follows, so pieces are encoded
    once and put together by number. Latin pieces are split into the library's words by its
    own pattern, and its model encodes each distinct word; the library takes other pieces in
    batches. Texts with other white space or an added token after a blank go through the
    library whole."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        named = {**self.library.get_vocab(with_added_tokens=True)}
        self.bytes_of = np.zeros(max(named.values()) + 1, dtype=np.int64)
        for token, i in named.items():  # each letter of a token is a byte
            self.bytes_of[i] = len(token)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.model, self.letters, self.words = self.library.model, {**dict(enumerate(byte_letters())), 0xFF: " "}, {}
        # first letters that a piece to be joined may not have, or may not always
        self.doubtful = {"", *(c for c in map(chr, range(0x110000)) if c.isspace()), *(a[:1] for a in self.added)}
        super().__init__(limit)

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids that the library's model gives each word, as bytes."""
        # a byte that no text holds parts the words, and becomes the blank that no letter is
        joined = "\udcff".join(words).encode("utf-8", "surrogateescape").decode("latin-1")
        found = [[t.id for t in self.model.tokenize(w)] for w in joined.translate(self.letters).split(" ")]
        ends = np.cumsum([4 * len(ids) for ids in found]).tolist()
        raw = array("I", chain.from_iterable(found)).tobytes()
        return (raw[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def encode_latin(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_pieces``, for Latin pieces without an added token. A blank is the first
        letter of a piece's first word, and nowhere else."""
        found = LATIN_WORDS.findall(" " + " ".join(pieces))
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        fresh = [*set(found).difference(self.words)]
        if fresh:
            self.words.update(zip(fresh, self.encode_words(fresh), strict=True))
        raw = [*map(self.words.__getitem__, found)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        last = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))[1:] - 1
        for w in filter(lambda w: len(w) > JOINED, fresh):
            del self.words[w]
        return np.frombuffer(b"".join(raw), dtype="<u4"), np.cumsum(sizes)[np.append(last, len(raw) - 1)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, a blank before each, end to end, and where each piece's end.
        Pieces are joined to texts of ``JOINED``, as the library spends much on each text;
        the ids fall to pieces by the bytes that they stand for."""
        whole = [f" {p}" for p in pieces]
        texts = ["".join(whole[i : i + JOINED]) for i in range(0, len(whole), JOINED)]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype="<u4", count=sum(map(len, found)))
        lengths = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in whole), np.int64, len(whole))
        return ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths)) + 1

    def learn(self, first: int, pieces: list[str], begins: np.ndarray) -> None:
        """Stores the ids of ``pieces``, numbered from ``first`` on; ``begins``: the piece
        stands at a text's start, without a blank."""
        odd = np.array([p[:1] in self.doubtful for p in pieces], dtype=bool) & ~begins
        for k in np.flatnonzero(odd).tolist():
            odd[k] = not pieces[k] or pieces[k][0].isspace() or pieces[k].startswith(self.added)
        latin = np.array([p.isascii() or not BEYOND_LATIN.search(p) for p in pieces], dtype=bool)
        for a in self.added:
            latin &= np.array([a not in p for p in pieces], dtype=bool)
        sizes = np.zeros(len(pieces), dtype=np.int64)
        places = np.zeros(len(pieces), dtype=np.int64)
        starting = [e.ids for e in self.library.encode_batch_fast([pieces[k] for k in np.flatnonzero(begins).tolist()], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(starting), "<u4", count=sum(map(len, starting)))
        sizes[begins] = [*map(len, starting)]
        places[begins] = np.cumsum(sizes[begins]) - sizes[begins]
        for kind, encode in ((latin, self.encode_latin), (~latin, self.encode_pieces)):
            own = np.flatnonzero(kind & ~odd & ~begins)
            if len(own):
                others, ends = encode([pieces[k] for k in own.tolist()])
                sizes[own] = np.diff(ends, prepend=0)
                places[own] = len(ids) + ends - sizes[own]
                ids = np.concatenate([ids, others])
        self.store(first, ids, places, sizes, odd)

    def encode_many(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit integers."""
        texts, bounds, letters = buffers(texts)
        at = 0
        while at < len(texts):
            # whole texts of CHUNK bytes or so
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK)))
            end = min(end, len(texts))
            own = bounds[at : end + 1] - bounds[at] + 8
            data = np.zeros(own[-1] + 24, dtype=np.uint8)
            data[8 : own[-1]] = letters[bounds[at] : bounds[end]]
            # a piece starts with each text and after each blank
            blanks = np.flatnonzero(data[: own[-1]] == 32)
            counts = np.diff(np.searchsorted(blanks, own)) + 1
            first = np.cumsum(counts) - counts
            starts = np.empty(len(blanks) + len(counts), dtype=np.int64)
            begins = np.zeros(len(starts), dtype=bool)
            begins[first] = True
            starts[begins], starts[~begins] = own[:-1], blanks + 1
            ends = np.empty_like(starts)
            last = np.zeros(len(starts), dtype=bool)
            last[first + counts - 1] = True
            ends[last], ends[~last] = own[1:], blanks
            ids, sizes, odd = [], [], []
            for k in range(0, len(starts), SLICE):
                part = slice(k, k + SLICE)
                numbers = self.numbered(data, starts[part], ends[part], begins[part])
                ids.append(self.gather(numbers))
                sizes.append(self.rows["size"][numbers])
                odd.append(self.rows["odd"][numbers])
            ids, n = np.concatenate(ids), np.add.reduceat(np.concatenate(sizes), first)
            whole = np.logical_or.reduceat(np.concatenate(odd), first)
            cuts = np.cumsum(n)
            for k, (b, size) in enumerate(zip(cuts.tolist(), n.tolist(), strict=True)):
                if whole[k]:
                    yield np.array(self.library.encode(texts[at + k].as_py(), add_special_tokens=False).ids, dtype="<u4")
                else:
                    yield ids[b - size : b]
            at = end


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker, whatever the number of its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocab: int, end_id: int) -> DataFrame:
    """Writes the ids of every document and its end id, in ascending doc_id order, as blocks
    in the shared folder, and returns the table of blocks that was read back from there.
    The part number and the ids before a block within its part say where the block stands."""

    def rows(batches: Iterator[pa.RecordBatch]):
        own = piece_encoder(path)
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4")
        block = base = n = 0
        found, keys, lengths = [], [], []

        def closed():
            nonlocal block, base, n, found, keys, lengths
            payload = encode_block(np.concatenate(found), vocab)
            row = [[part], [block], [base], [n], [keys], [lengths], [payload]]
            block, base, n, found, keys, lengths = block + 1, base + n, 0, [], [], []
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, BLOCK_TYPES, strict=True)], names=BLOCK_COLUMNS)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), own.encode_many(b.column(1)), strict=True):
                keys.append(key)
                lengths.append(len(ids) + 1)
                found += [ids, end]
                n += len(ids) + 1
                if n >= BLOCK_IDS:
                    yield closed()
        if keys:
            yield closed()

    schema = "part int, block int, base long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    small_batches(docs.sparkSession)
    return staged(ordered.mapInArrow(lambda batches: trimmed(rows(batches)), schema), "tokens")


BLOCK_COLUMNS = ["part", "block", "base", "n_ids", "doc_ids", "lengths", "payload"]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def read_tokens(blocks: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of a table of blocks: doc_id, start (ids before it in the whole file)
    and ``ids``; with ``digest`` n_tokens and the CRC-32 of the ids in their place."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rows_of = blocks.join(F.broadcast(starts), F.col("part") == F.col("_part"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start, keys, lengths, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = decode_block(payload)
                lengths = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = [pa.array(keys, pa.int64()), pa.array(start + ends - lengths)]
                if digest:
                    yield pa.record_batch([*out, pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.record_batch([*out, pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return rows_of.select(F.col("_start") + F.col("base"), "doc_ids", "lengths", "payload").mapInArrow(rows, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<long>"))
