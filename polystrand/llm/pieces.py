"""Pieces of texts that are encoded once and put together by number.

Pieces of up to 16 bytes are looked up in arrays, by open addressing: two words hold a
piece's bytes, so that equal keys are equal pieces. Longer ones are in a dictionary. At
most about ``limit`` pieces are remembered; beyond that, or after ``HEAVY`` bytes of new
long ones, the half that was asked for most since the last time stays, but no piece of
over ``WIDE`` ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pieces that are looked up at once, and what a remembered piece is. Its key: the first
#: and the second eight bytes, its length (FIRST more at the start of a text, or LONG).
SLICE, FIRST, LONG = 1 << 17, 32, 255
HEAVY, WIDE = 1 << 25, 256
PIECE = np.dtype([("low", "<u8"), ("high", "<u8"), ("length", "u1"), ("odd", "?"), ("start", "<i8"), ("size", "<i8"), ("asked", "<i8")], align=True)
KEY = ("low", "high", "length")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: The bytes of a word that belong to a piece of 0 to 8 bytes.
PART = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class PieceTable:
    """The ids of pieces; ``learn`` of a subclass makes them and calls ``store``."""

    def __init__(self, limit: int):
        self.limit, self.known, self.long, self.heavy = limit, 0, {}, 0
        self.slots = np.full(1 << (2 * (limit + SLICE)).bit_length(), -1, dtype=np.int32)
        self.shift = np.uint64(65 - len(self.slots).bit_length())
        # piece k: its key (two words of bytes; length, and FIRST at a text's start), the
        # place of its ids, whether its text needs the library, how often it was asked for
        self.rows = np.zeros(limit + SLICE, dtype=PIECE)
        self.ids, self.filled = np.zeros(1 << 16, dtype="<u4"), 0

    def learn(self, first: int, pieces: list[str], begins: np.ndarray) -> None:
        """Stores the ids of ``pieces``, numbered from ``first`` on."""
        raise NotImplementedError

    def store(self, first: int, ids: np.ndarray, places: np.ndarray, sizes: np.ndarray, odd) -> None:
        """``ids`` of pieces numbered from ``first`` on: ``sizes`` of them at ``places``."""
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(self.filled // 2 + 2 * len(ids), dtype="<u4")])
        self.ids[self.filled : self.filled + len(ids)] = ids
        rows = self.rows[first : first + len(sizes)]
        rows["start"], rows["size"], rows["odd"], rows["asked"] = self.filled + places, sizes, odd, 0
        self.filled += len(ids)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``; new ones get the next numbers, and only their key is set."""
        spread = (keys["low"] * MIX[0]) ^ (keys["high"] * MIX[1]) ^ (keys["length"].astype(np.uint64) * MIX[2])
        spread ^= spread >> np.uint64(29)
        at = ((spread * MIX[0]) >> self.shift).view(np.int64)
        numbers = self.slots.take(at)
        rest = np.flatnonzero((numbers < 0) | ~same_key(self.rows, numbers, keys, slice(None)))
        while len(rest):
            # the last to write itself into an empty slot has it
            own = at[rest]
            free = self.slots[own] < 0
            bids, owners = rest[free], own[free]
            self.slots[owners] = -2 - bids
            won = self.slots[owners] == -2 - bids
            new = self.known + np.arange(won.sum(), dtype=np.int32)
            self.slots[owners[won]] = new
            for field in KEY:
                self.rows[field][new] = keys[field][bids[won]]
            self.known += len(new)
            numbers[rest] = self.slots[own]
            rest = rest[~same_key(self.rows, numbers[rest], keys, rest)]
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
        return numbers

    def forget(self) -> None:
        """Keeps the half of ``limit`` that was asked for most, no wide piece among them."""
        keep = np.sort(np.argsort(-self.rows["asked"][: self.known], kind="stable")[: self.limit // 2])
        keep = keep[self.rows["size"][keep] <= WIDE]
        ids, rows = self.gather(keep), self.rows[keep]
        renamed = np.full(self.known, -1, dtype=np.int64)
        renamed[keep] = np.arange(len(keep))
        self.long = {p: n for p, k in self.long.items() if (n := int(renamed[k])) >= 0}
        self.ids, self.filled, self.known, self.heavy = ids, len(ids), 0, 0
        self.slots.fill(-1)
        short = np.flatnonzero(rows["length"] != LONG)
        numbers = self.place(rows[short])  # each key is new, and gets a number of its own
        order = np.empty(len(keep), dtype=np.int64)
        order[short] = numbers
        rest = np.flatnonzero(rows["length"] == LONG)
        order[rest] = self.known + np.arange(len(rest))
        self.known = len(keep)
        self.long = {p: int(order[n]) for p, n in self.long.items()}
        rows["start"], rows["asked"] = np.cumsum(rows["size"]) - rows["size"], 0
        self.rows[order] = rows

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces end to end."""
        sizes = self.rows["size"][numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.rows["start"][numbers] - ends + sizes, sizes) + np.arange(sizes.sum())]

    def numbered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The numbers of at most ``SLICE`` pieces of ``data`` (eight spare bytes at its
        ends), which are known afterwards."""
        if self.known > self.limit or self.heavy > HEAVY:
            self.forget()
        first, lengths = self.known, ends - starts
        numbers = np.empty(len(starts), dtype=np.int64)
        brief = lengths <= 16
        at, size = (starts, lengths) if brief.all() else (starts[brief], lengths[brief])
        keys = np.empty(len(at), dtype=PIECE[list(KEY)])
        words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        keys["low"] = words[at] & PART[np.minimum(size, 8)]
        keys["high"] = words[at + 8] & PART[np.maximum(size - 8, 0)]
        keys["length"] = size + FIRST * begins[brief]
        numbers[brief] = self.place(keys)
        fresh = np.zeros(self.known - first, dtype=np.int64)
        where = np.flatnonzero(brief)
        late = where[numbers[where] >= first]
        fresh[numbers[late] - first] = late
        base = starts[0]  # the pieces stand in order
        letters = data[base : ends[-1]].tobytes()
        pieces = [letters[a:b] for a, b in zip((starts[fresh] - base).tolist(), (ends[fresh] - base).tolist(), strict=True)]
        new = [begins[fresh]]
        for k in np.flatnonzero(~brief).tolist():
            piece = (letters[starts[k] - base : ends[k] - base], bool(begins[k]))
            if piece not in self.long:
                self.long[piece] = self.known
                self.rows["length"][self.known] = LONG
                self.known += 1
                self.heavy += len(piece[0])
                pieces.append(piece[0])
                new.append(np.array([piece[1]]))
            numbers[k] = self.long[piece]
        if pieces:
            self.learn(first, [p.decode() for p in pieces], np.concatenate(new))
        np.add.at(self.rows["asked"], numbers, 1)
        return numbers


def same_key(rows: np.ndarray, numbers: np.ndarray, keys: np.ndarray, at) -> np.ndarray:
    """Whether rows ``numbers`` have the keys at ``at``."""
    return np.logical_and.reduce([rows[field][numbers] == keys[field][at] for field in KEY])


def buffers(texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts (null: empty), where each starts and the last ends, and their bytes."""
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("").cast(pa.large_string())
    if not len(texts):
        return texts, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return texts, bounds, np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
