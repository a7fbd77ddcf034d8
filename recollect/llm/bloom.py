"""Two Bloom filters in one pass: which hashes may have been seen at least twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .worker import frugal
from .workspace import materialize, small_batches

#: log2 of the filters' cells, least and most (2 ** 28: 32 MB each), cells a sighting, hash functions, log2 of the
#: cells in a slice.
LEAST_BITS, MOST_BITS, CELLS_EACH, PROBES, SLICE_BITS = 22, 28, 8, 2, 17
_SLICE_BYTES = 1 << (SLICE_BITS - 3)


def cell_bits(sightings: int) -> int:
    """The filter's size for about so many sightings. Beyond what MOST_BITS serves more of what was seen once passes."""
    return min(max((CELLS_EACH * max(sightings, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [(hashes >> np.uint64(i * 32)) & low for i in range(PROBES)]


def _byte_bit(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (cells >> np.uint64(3)).astype(np.int64), np.left_shift(1, (cells & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


def test(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    hit = np.ones(len(hashes), bool)
    for cells in _cells(hashes, len(bits).bit_length() + 2):
        byte, bit = _byte_bit(cells)
        hit &= bits[byte] & bit > 0
    return hit


def seen_twice(frame: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int = MOST_BITS - 1) -> np.ndarray:
    """The packed filter of what two sightings set: hashes_of gives a batch's hashes, one per sighting; bits is the log2
    of its cells.

    Each task marks cells seen once and cells seen again; the arrays merge slice by slice, where a cell that two tasks
    saw counts as seen again. Nothing seen twice is missed; a small share of what was seen once passes too, and most of
    it where the corpus outgrows the filter, so callers confirm exactly. An empty frame gives an empty filter.
    """

    @frugal
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        for batch in batches:
            for cells in _cells(hashes_of(batch), bits):
                at, n = np.unique(cells, return_counts=True)
                byte, bit = _byte_bit(at)
                again = (n > 1) | (once[byte] & bit > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        for k in range(1 << (bits - SLICE_BITS)):
            part = slice(k * _SLICE_BYTES, (k + 1) * _SLICE_BYTES)
            if once[part].any():
                packed = [pa.array([pa.compress(x[part].tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *packed], ["slice", "once", "twice"])

    @frugal
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slice, so that one slice is held at a time, however many tasks sent it."""
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["slice", "twice"])

        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(pa.decompress(x, _SLICE_BYTES, "zstd", asbytes=True), np.uint8) for x in (a, b))
                if k != current:
                    if current is not None:
                        yield done()
                    current, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if current is not None:
            yield done()

    marked = frame.mapInArrow(mark, "slice int, once binary, twice binary")
    merged = marked.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    # written first: rows are fetched partition by partition, which must find the exchange's work done
    merged = materialize(merged, "filter")
    with small_batches(frame.sparkSession):
        for row in merged.toLocalIterator():
            out[row["slice"] * _SLICE_BYTES : (row["slice"] + 1) * _SLICE_BYTES] = np.frombuffer(row["twice"], np.uint8)
    return out
