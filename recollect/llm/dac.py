"""Directly addressable codes for arrays of ids: one byte of an id per level, a bitmap of the ids that go on to the
next level, and a rank directory over the bitmap, so that any id or range is read without decoding what is before it.

Layout, little-endian: magic, level count (uint32), id count (uint64); then per level its length (uint64), its bytes,
its continuation bitmap (bit i of byte i // 8), and the rank directory (uint64 set bits before each run of RUN bits).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
RUN = 512
_HEAD = struct.Struct("<4sIQ")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint64)
    levels: list[bytes] = []
    rest = ids
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        per_run = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(more), RUN)) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(per_run)]).astype("<u8")[:-1] if len(more) else per_run
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.astype("<u8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint64(8)
    return _HEAD.pack(MAGIC, len(levels), len(ids)) + b"".join(levels)


class Reader:
    """Random access to the ids in encoded bytes."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a directly addressable code")
        at, self.levels = _HEAD.size, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at + n)
            ranks = np.frombuffer(data, "<u8", (n + RUN - 1) // RUN, at + n + len(bitmap))
            at += n + len(bitmap) + 8 * len(ranks)
            self.levels.append((chunk, bitmap, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Continued ids before place i of the level."""
        _, bitmap, ranks = self.levels[level]
        if i >= 8 * len(bitmap):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        run = i // RUN
        whole = bitmap[run * RUN // 8 : i // 8]
        return int(ranks[run]) + int(_POPCOUNT[whole].sum()) + int(_POPCOUNT[bitmap[i // 8] & ((1 << (i % 8)) - 1)])

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not (bitmap[i // 8] >> (i % 8)) & 1:
                return value
            i, shift = self._rank(level, i), shift + 8
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] as uint32."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            if stop <= start:
                break
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            if not bits.any():
                break
            start = self._rank(level, start)
            stop = start + int(bits.sum())
            where = where[bits]
        return out
