"""Words and word shingles as 64-bit numbers, for whole Arrow batches of texts at a time.

A word is a run of anything but ASCII white space, with A-Z lower-cased. Its hash is a polynomial over random byte
values modulo 2 ** 64, read off running sums of the batch's bytes, so that no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes hashed at a time, and bytes of texts taken from a batch at a time.
BLOCK, PIECE_BYTES = 1 << 18, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(5).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_VALUE[65:91] = _VALUE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([pow(int(_BASE), i + 3, 1 << 64) for i in range(SHINGLE)], np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, starts and ends of the words in data, where a text begins at each place of breaks."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    first[at] |= inside[at]
    last[at - 1] |= inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(BLOCK)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[: len(data)])])
    return (sums[ends] - sums[starts]) * inverse[starts], starts, ends


def pieces(batch: pa.RecordBatch, column: int = 1, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some rows whose texts come to about `most` bytes, a longer text alone: what is made of the
    texts of a whole batch is many times their size."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        base = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, starts, ends) for a column of texts (string or binary): all words' hashes in order, the number
    of words in each row, and the words' places in bytes from their row's start. Nulls have no words.

    Bytes are summed in blocks of fixed size; a word that reaches over a block's end goes on in the next one, so a text
    without white space takes no more memory than others."""
    column = column.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    for at in range(low, high, BLOCK):
        piece = data[at : min(at + BLOCK, high)]
        begins, until = np.searchsorted(offsets, (at, at + len(piece)))
        sums, s, e = _block(piece, offsets[begins:until] - at)
        goes_on = len(s) and s[0] == 0 and parts and parts[-1][2][-1] == at and (begins == len(offsets) or offsets[begins] != at)
        if goes_on:
            before, since, end = parts[-1]
            before[-1:] += sums[:1] * np.array([pow(int(_BASE), at - int(since[-1]), 1 << 64)], np.uint64)
            end[-1] = at + e[0]
            sums, s, e = sums[1:], s[1:], e[1:]
        if len(s):
            parts.append((sums, s + at, e + at))
    sums, starts, ends = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    counts = np.diff(np.searchsorted(starts, offsets))
    base = np.repeat(offsets[:-1], counts)
    return mix64(sums), counts, starts - base, ends - base


def grams(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A number for every run of n hashes, in order; none if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size] * _PLACES[0]
    for i in range(1, n):
        out += hashes[i : i + size] * _PLACES[i]
    return mix64(out)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's distinct n-word shingles, sorted; with fewer words the whole sequence as one; none without words."""
    hashes, counts, _, _ = word_hashes(column)
    every = grams(hashes, n)
    at = 0
    for count in counts.tolist():
        if count >= n:
            found = np.sort(every[at : at + count - n + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif count:
            yield grams(hashes[at : at + count], count) ^ np.uint64(count)
        else:
            yield np.zeros(0, np.uint64)
        at += count
