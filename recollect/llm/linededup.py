"""Line dedup over a whole corpus: two Bloom filters find the lines that may repeat, and only those are confirmed.

First pass: every task sets cells of two bit arrays, one for keys seen once and one for keys seen again, and the
tasks' arrays merge slice by slice (a cell set in two tasks counts as seen again). Second pass: keys whose cells are
all seen again are suspects; each task counts the documents they stand in and the counts are summed by a 16-byte
digest. Third pass: the lines with confirmed keys go. A Bloom filter has no false negatives, so no repeat is missed,
and the exact counts undo its false positives.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .words import pieces
from .workspace import materialize

#: Most confirmed keys that are broadcast (16 bytes each); beyond, they are joined.
BROADCAST_KEYS = 2_000_000
#: Bytes of a line, about: the filters are sized by it, and nothing else depends on it.
LINE_BYTES = 32
#: Suspects a task counts before it passes its counts on.
COUNTED = 300_000


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in text.lower().split(b"\n")]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in pieces(batch, column))


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """(key, doc, line): the digests of the keys of at least min_chars code points found in at least min_docs rows of
    docs; with keep_first doc and line are the smallest id and place of a sighting, else null."""

    def keys_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
        """Every key once per row."""
        return [k for part in pieces(batch, column) for text in part.column(column) for k in set(line_keys(text.as_py())) if _chars(k) >= min_chars]

    # lines are taken to be as long as a short sentence; the sum reads the texts' lengths only
    n_bytes = docs.select(F.octet_length(text_col).cast("long").alias("n")).agg(F.sum("n"), F.count("*")).first()
    size = bloom.cell_bits((n_bytes[0] or 0) // LINE_BYTES + n_bytes[1])
    filter_bits = docs.sparkSession.sparkContext.broadcast(bloom.seen_twice(_texts(docs, text_col), lambda batch: _hashes(keys_of(batch, 0)), size))
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("doc", pa.int64()), ("line", pa.int64())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        counts: Counter = Counter()
        firsts: dict[bytes, tuple] = {}

        def flush() -> pa.RecordBatch:
            doc, line = ([firsts.get(k, (None, None))[i] for k in counts] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(map(_digest, counts), pa.binary()), pa.array(counts.values(), pa.int64()), pa.array(doc, pa.int64()), pa.array(line, pa.int64())], schema=schema)

        for batch in _pieces(batches, 1):
            found = keys_of(batch, 1)
            hit = bloom.test(bits, _hashes(found))
            counts.update([found[i] for i in np.flatnonzero(hit)])
            if keep_first:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for place, k in enumerate(line_keys(text.as_py())):
                        if doc is not None and k in counts and firsts.get(k, (doc + 1, 0)) > (doc, place):
                            firsts[k] = (doc, place)
            if len(counts) > COUNTED:
                yield flush()
                counts.clear()
                firsts.clear()
        if counts:
            yield flush()

    named = F.col(id_col).cast("long") if keep_first else F.lit(None).cast("long")
    rows = docs.select(named.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(suspects, "key binary, n long, doc long, line long").groupBy("key")
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "line"))).alias("first")
    return found.agg(F.sum("n").alias("n"), first).where(F.col("n") >= min_docs).select("key", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"))


class _Keys:
    """Confirmed keys as sorted 128-bit numbers in two columns, and where the first sighting of each is."""

    def __init__(self, digests: list[bytes], doc: np.ndarray, line: np.ndarray):
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.high, self.low, self.doc, self.line = halves[order, 0], halves[order, 1], doc[order], line[order]
        #: keys that share their first half, at most
        self.run = int(np.unique(self.high, return_counts=True)[1].max(initial=1))

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Each digest's place among the keys, or -1."""
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        out = np.full(len(halves), -1)
        first = np.searchsorted(self.high, halves[:, 0])
        for at in (first + k for k in range(self.run)):
            some = np.flatnonzero(at < len(self.high))
            some = some[(self.high[at[some]] == halves[some, 0]) & (self.low[at[some]] == halves[some, 1])]
            out[some] = at[some]
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of docs with its repeated lines gone, the others joined by line breaks.

    A row counts as a document of its own, so repeated rows count each; a key counts once in a row. Null and empty
    texts are one empty line, which has no key long enough and stays. Texts and lines of any length are whole. An empty
    table gives no rows. With keep_first (ids must be whole numbers) the first occurrence of each key stays, that of
    the smallest doc_id and line: rows that repeat the doc_id keep it too, and rows with a null one have no firsts. Up
    to broadcast_keys confirmed keys are sent to every task; beyond that they are joined to the suspects' texts by
    digest, and the results are the same.
    """
    keys = materialize(repeated_keys(docs, min_docs, min_chars, id_col, text_col, keep_first), "repeated-lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_lines long, n_dropped long"
    if keys.count() <= broadcast_keys:
        held = keys.toPandas()
        places = [held[c].astype("Int64").fillna(-1).to_numpy(np.int64) for c in ("doc", "line")]
        known = docs.sparkSession.sparkContext.broadcast(_Keys([bytes(k) for k in held["key"]], *places))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, 1):
                yield _drop(batch, [known.value] * batch.num_rows, keep_first)

        return rows.mapInArrow(drop, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            sent = [(hashlib.sha256(t).digest(), k) for t in set(batch.column(1).to_pylist()) for k in {_digest(x) for x in line_keys(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sent], pa.binary()), pa.array([b for _, b in sent], pa.binary())], ["digest", "key"])

    # equal texts have equal repeated lines, so the verdict goes by the text's digest, and copies are one before the exchange
    verdicts = rows.mapInArrow(listed, "digest binary, key binary").distinct().join(keys, "key").groupBy("digest").agg(F.collect_list(F.struct("key", "doc", "line")).alias("keys"))
    held = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).join(verdicts, "digest", "left").select("doc_id", "text", "keys")

    def drop_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            own = [k or [] for k in batch.column(2).to_pylist()]
            yield _drop(batch, [_Keys([x["key"] for x in k], *(np.array([-1 if x[c] is None else x[c] for x in k], np.int64) for c in ("doc", "line"))) for k in own], keep_first)

    return held.mapInArrow(drop_listed, schema)


def _drop(batch: pa.RecordBatch, known: list[_Keys], keep_first: bool) -> pa.RecordBatch:
    kept, n_lines, n_dropped = [], [], []
    for doc, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), known, strict=True):
        lines = text.as_py().split(b"\n")
        stay = lines
        if len(keys.high):
            at = keys.find([_digest(k) for k in line_keys(text.as_py())])
            gone = at >= 0
            if keep_first and doc is not None:
                gone &= (keys.doc[at] != doc) | (keys.line[at] != np.arange(len(lines)))
            stay = [line for line, g in zip(lines, gone.tolist(), strict=True) if not g] if gone.any() else lines
        kept.append(b"\n".join(stay))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
    texts = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])
