"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can be merged by nothing, so a text
may be cut between its two bytes whatever stands around it. The encoder cuts every word
at such pairs, merges each fragment on its own and puts the ids one after another.
Fragments, words and white-space-delimited pieces repeat, and each level is remembered
in a table of bounded size.

Defined cases: null or empty text has no ids and decodes to the empty text; strings of
added tokens in a text become their ids, as in the library; ids outside the vocabulary
raise ``KeyError`` on decoding; whole texts of any length are read, in slices of about
``CHUNK`` bytes of several texts; equal ranks merge from the left; repeated rows and rows
without a doc_id give a row each; other columns of any name take no part; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, trimmed
from .pieces import SLICE, PieceTable, buffers

REMEMBERED = 400_000
#: Characters that are encoded at once, and the longest fragment merged by matrix.
CHUNK, WIDE = 1_000_000, 40
#: Below this point a piece is Latin: its case and word ends need no table of the library.
#: (White space here is what the library takes for it.)
LATIN_END_POINT = 0x180
LATIN_END = chr(LATIN_END_POINT)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: the byte's own
    character if it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


SPACE = regex.compile(r"[^\S\x1c-\x1f]+")
#: Which bytes are white space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class ForcedBoundaryBPE:
    """Encoder and decoder for a vocabulary file in the tokenizers library's JSON format,
    with the normaliser NFC + lower case + white space and word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.numbers = {c: b for b, c in enumerate(self.letters)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.added}.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the same pattern over Latin letters alone, and a blank between two pieces
        latin = {c: "".join(ch for ch in map(chr, range(0x30, LATIN_END_POINT)) if unicodedata.category(ch)[0] == c) for c in "LN"}
        own = split["pattern"]["Regex"].replace("\\s", r" \t\n\r\f\v\x85\xa0")
        for c in "LN":
            own = own.replace(f"\\p{{{c}}}", latin[c])
        self.latin = re.compile(f"{own}| ")
        self.specials = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None
        inside = set()
        for token in self.vocab:
            plain = token.removesuffix(self.end) if self.end else token
            inside.update(zip(plain, plain[1:], strict=False))
        self.inside = inside
        self.library = Tokenizer.from_file(path)
        self.tables()
        self.table = WordTable(self.encode_pieces)

    def tables(self) -> None:
        """Symbols and merges as arrays. Symbols 0 to 255 of ``plain`` and ``final`` are
        bytes within a word and at its end; ``firm[a, b]``: the pair is inside a token."""
        self.plain = np.array([self.vocab[c] for c in self.letters], dtype=np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in self.letters], dtype=np.int64)
        self.firm = np.zeros((256, 256), dtype=bool)
        for a, b in self.inside:
            if a in self.numbers and b in self.numbers:
                self.firm[self.numbers[a], self.numbers[b]] = True
        keys = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in self.ranks], dtype=np.int64)
        self.pair_rank = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_rank]
        self.merged = np.array([self.vocab[a + b] for a, b in self.ranks], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or the number of merges if there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], len(self.merged))

    def merge_equal(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges fragments of one length, a row each: the symbols left and their number."""
        n, width = symbols.shape
        out, sizes = np.zeros((n, width), dtype=np.int64), np.zeros(n, dtype=np.int64)
        rows, never = np.arange(n), len(self.merged)
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while True:
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), never)
            ends = best == never
            if ends.any():
                out[rows[ends], :width], sizes[rows[ends]] = symbols[ends], width
                keep = ~ends
                rows, symbols, ranks, at, best = rows[keep], symbols[keep], ranks[keep], at[keep], best[keep]
            if not len(rows):
                return out, sizes
            each, width = np.arange(len(rows)), width - 1
            columns = np.arange(width)
            symbols = np.where(columns > at[:, None], symbols[:, 1:], symbols[:, :-1])
            symbols[each, at] = self.merged[best]
            if width > 1:
                ranks = np.where(columns[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < width - 1)
                    r, c = each[ok], near[ok]
                    ranks[r, c] = self.rank(symbols[r, c], symbols[r, c + 1])

    def cut(self, data: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
        """Where fragments start in words' bytes laid end to end: at each word, and
        wherever a pair of bytes is inside no token."""
        starts = np.ones(len(data), dtype=bool)
        starts[1:] = ~self.firm[data[:-1], data[1:]]
        starts[word_starts] = True
        return np.flatnonzero(starts)

    def merge_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words laid end to end, and the number of each word's ids."""
        if not len(lengths):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        ends = np.cumsum(lengths)
        symbols = self.plain[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        starts = self.cut(data, ends - lengths)
        sizes = np.diff(np.append(starts, len(data)))
        left, kept = np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=bool)
        for size in np.unique(sizes):
            own = starts[sizes == size]
            if size == 1:
                left[own], kept[own] = symbols[own], True
            elif size <= WIDE:
                out, n = self.merge_equal(symbols[own[:, None] + np.arange(size)])
                where = np.arange(size) < n[:, None]
                at = (own[:, None] + np.arange(size))[where]
                left[at], kept[at] = out[where], True
            else:
                for start in own:
                    ids = self.merge_long(symbols[start : start + size].tolist())
                    left[start : start + len(ids)], kept[start : start + len(ids)] = ids, True
        counts = np.add.reduceat(kept.astype(np.int64), ends - lengths)
        return left[kept].astype("<u4"), counts

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over a linked list: n log n for a long fragment."""
        names = [self.tokens[i] for i in ids]
        n, ranks = len(names), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(names, names[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if names[i] else -1
            if j < 0 or names[i] != a or names[j] != b:
                continue
            names[i], names[j], after[i] = a + b, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((names[x], names[y]))) is not None:
                    heapq.heappush(heap, (r, x, names[x], names[y]))
        return [self.vocab[p] for p in names if p]

    def words_of(self, piece: str) -> list[bytes]:
        """The words of a piece in any script, by the library's own Unicode tables."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes([self.numbers[c] for c in w]) for w, _ in found]

    def latin_words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of Latin pieces laid end to end, and the number of each piece's words."""
        plain = " ".join(pieces)
        plain = plain.lower() if plain.isascii() else unicodedata.normalize("NFC", plain).lower()
        found = self.latin.findall(plain)
        blanks = np.flatnonzero(np.fromiter((w == " " for w in found), bool, len(found)))
        counts = np.diff(np.concatenate([[-1], blanks, [len(found)]])) - 1
        return [w for w in found if w != " "], counts

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of texts without white space inside, as bytes of 32-bit integers."""
        out: dict[str, bytes] = {}
        latin, other = [], []
        for p in pieces:
            if "<" in p and self.specials and self.specials.search(p):
                out[p] = self.encode_special(p)
            else:
                (latin if p.isascii() or max(p) < LATIN_END else other).append(p)
        if latin:
            words, counts = self.latin_words(latin)
            text = "".join(words)
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            sizes = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64)
            starts = np.cumsum([0, *map(len, words)])[:-1]
            self.put(out, latin, counts, text.encode(), np.add.reduceat(sizes, starts))
        if other:
            found = [self.words_of(p) for p in other]
            words = [w for ws in found for w in ws]
            self.put(out, other, np.array([*map(len, found)]), b"".join(words), np.array([*map(len, words)], dtype=np.int64))
        return [out[p] for p in pieces]

    def put(self, out: dict[str, bytes], pieces: list[str], counts: np.ndarray, data: bytes, lengths: np.ndarray) -> None:
        """Encodes pieces of ``counts`` words each, with the words' bytes in ``data``."""
        ids, n = self.merge_words(np.frombuffer(data, dtype=np.uint8), lengths)
        ends = (np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])] * 4).tolist()
        raw = ids.tobytes()
        out.update((p, raw[a:b]) for p, a, b in zip(pieces, ends, ends[1:], strict=False))

    def encode_special(self, piece: str) -> bytes:
        """Ids of a piece with added tokens in it."""
        out = b""
        for part in self.specials.split(piece):
            if part in self.added:
                out += np.array([self.added[part]], dtype="<u4").tobytes()
            elif part:
                out += self.encode_pieces([part])[0]
        return out

    def encode_many(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit integers."""
        texts, bounds, letters = buffers(texts)
        at = 0
        while at < len(texts):
            # whole texts of CHUNK bytes or so
            end = min(max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK))), len(texts))
            own = bounds[at : end + 1] - bounds[at] + 8
            data = np.full(own[-1] + 24, 32, dtype=np.uint8)
            data[8 : own[-1]] = letters[bounds[at] : bounds[end]]
            # pieces lie between white space and at the ends of texts
            solid = ~BLANK[data]
            solid[:8] = solid[own[-1] :] = False
            starts = solid.copy()
            starts[1:] &= ~solid[:-1]
            starts[own[:-1]] |= solid[own[:-1]]
            starts = np.flatnonzero(starts)
            ends = solid.copy()
            ends[:-1] &= ~solid[1:]
            ends[own[1:] - 1] |= solid[own[1:] - 1]
            ends = np.flatnonzero(ends) + 1
            ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(1, dtype=np.int64)]
            for k in range(0, len(starts), SLICE):
                part = slice(k, k + SLICE)
                numbers = self.table.numbered(data, starts[part], ends[part], np.zeros(len(starts[part]), dtype=bool))
                ids.append(self.table.gather(numbers))
                sizes.append(self.table.rows["size"][numbers])
            ids, before = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
            cuts = before[np.searchsorted(starts, own)].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b]
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids) -> str:
        """The text of ids: tokens joined by blanks, or bytes for byte-level vocabularies."""
        tokens = [self.tokens[i] for i in ids]
        if not self.byte_level:
            return " ".join(tokens)
        return bytes(self.numbers[c] for c in "".join(tokens)).decode("utf-8", "replace")


class WordTable(PieceTable):
    """Pieces between ASCII white space; other white space is split here."""

    def __init__(self, encode_pieces, limit: int = REMEMBERED):
        super().__init__(limit)
        self.encode_pieces = encode_pieces

    def learn(self, first: int, pieces: list[str], begins: np.ndarray) -> None:
        parts = [[p] if p.isascii() or not SPACE.search(p) else [x for x in SPACE.split(p) if x] for p in pieces]
        flat = [x for ps in parts for x in ps]
        raw = self.encode_pieces(flat) if flat else []
        ends = np.cumsum([0, *map(len, raw)]) // 4
        cuts = ends[np.cumsum([0, *map(len, parts)])]
        self.store(first, np.frombuffer(b"".join(raw), dtype="<u4"), cuts[:-1], np.diff(cuts), False)


_ENCODERS: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryBPE(path)
    return _ENCODERS[path]


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of its ids and digests of the ids and of the text that
    decoding them gives. Null text: as the empty text. Repeated rows: a row each."""

    def rows(batches: Iterator[pa.RecordBatch]):
        own = encoder(path)
        decimal = {i: str(i) for i in own.tokens}
        for b in batches:
            counts, of_ids, of_text = [], [], []
            for found in own.encode_many(b.column(1)):
                ids = found.tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: trimmed(rows(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
