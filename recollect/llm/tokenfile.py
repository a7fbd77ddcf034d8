"""Token ids of whole documents in one global order, written as directly addressable codes and read back."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .words import pieces
from .worker import frugal, held
from .workspace import new_path, small_batches

#: A segment is closed once it holds so many ids, so it has at most these and one document's.
SEGMENT_IDS = 1 << 18
#: Entries of a worker's cache unless told otherwise, and most characters of one.
CACHE_ROWS, CACHED_CHARS = 700_000, 64


#: What the word-by-word way relies on: white space becomes one space and belongs to no piece.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(tokenizer) -> bool:
    """Whether a text's ids are those of its words in turn, as far as the tokenizer's own description tells."""
    told = json.loads(tokenizer.to_str())
    normal, cut = told["normalizer"] or {}, told["pre_tokenizer"] or {}
    steps = cut.get("pretokenizers", [])
    splits = [s.get("pattern", {}).get("Regex") == _PIECES and s.get("behavior") == "Removed" and s.get("invert") for s in steps[:1]]
    plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
    return normal.get("normalizers") == _NORMAL and splits == [True] and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and plain


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Ids(dict):
    """Word to its ids as little-endian uint32 bytes.

    The tokenizer replaces white space and never joins over it, and its normal form composes nothing with a space or
    line break, so a text's ids are those of its words in turn. A tokenizer that does not say so of itself is given
    whole texts."""

    def __init__(self, tokenizer, by_words: bool, most: int):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer, self.by_words, self.most = tokenizer, by_words, most
        if not self.by_words:
            return
        self.normal, self.model = tokenizer.normalizer.normalize_str, tokenizer.model.tokenize
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _ids(self, word: str) -> bytes:
        """A run of letters is one piece to the tokenizer, and a stop or comma after it another, so these go to its
        model alone, in lower case; all else goes to the whole tokenizer."""
        if word[-1:] in (".", ",") and word[:-1].isalpha() and (word.isascii() or self.normal(word[:-1]).isalpha()):
            return self[word[:-1]] + self[word[-1]]
        if word.isalpha() and (lower := word.lower() if word.isascii() else self.normal(word)).isalpha():
            if lower != word:
                return self[lower]
            return _bytes([t.id for t in self.model(word if word.isascii() else self.letters(word)[0][0])])
        return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self._ids(word)
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _load(path: str, most: int, by_words: bool | None = None) -> _Ids:
    """by_words is read off the description unless it is given: parsing that again in every worker is memory for nothing."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return _Ids(tokenizer, _by_words(tokenizer) if by_words is None else by_words, most)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, cache_rows: int = CACHE_ROWS) -> DataFrame:
    """(doc_id, n, ids): ids as an encoded array of their own, so that the exchange moves about two bytes an id. A worker
    remembers the ids of cache_rows words at most: fewer take less memory and more time, and give the same ids."""
    by_words = _load(tokenizer_path, cache_rows).by_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = held(f"ids {cache_rows} {tokenizer_path}", lambda: _load(tokenizer_path, cache_rows, by_words)), np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in pieces(whole)):
            made = [np.frombuffer((words.encode(t.as_py()) if t.is_valid else b"") + end, "<u4") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array([_pack(x) for x in made], pa.binary())], ["doc_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary")


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; the first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", -1, 1).astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text", cache_rows: int = CACHE_ROWS) -> None:
    """Write `out`: segments(task, segment, first, doc_ids, lengths, code) and tasks(task, offset).

    Ids run in ascending doc_id order, null ids first, rows with one doc_id in an order fixed by their ids. Each
    document ends with end_id; null and empty texts are the end alone. The documents are dealt out by quantiles of
    doc_id, encoded once before the exchange; each task writes its run of segments with places relative to its own
    start, and a row per task says where that start lies.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    edges = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / tasks for i in range(1, tasks)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    coded = encode_documents(docs, tokenizer_path, end_id, id_col, text_col, cache_rows)
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<long>"), lambda e: e < F.col("doc_id"))), F.lit(0))
    dealt = coded.withColumn("task", F.when(F.col("doc_id").isNull(), 0).otherwise(place)).repartitionById(len(edges) + 1, F.col("task"))
    ordered = dealt.sortWithinPartitions("task", F.col("doc_id").asc_nulls_first(), "n", "ids")

    @frugal
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, number, held, current = 0, 0, 0, [], None

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            row = {"task": [current], "segment": [number], "first": [first], "doc_ids": [[d for d, _ in held]], "lengths": [[len(x) for _, x in held]], "code": [dac.encode(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=_SEGMENTS)

        for batch in batches:
            for task, doc_id, ids in zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (task != current or at - first >= SEGMENT_IDS):
                    yield close()
                    number, held, first = number + 1, [], at
                if task != current:
                    current, at, first, number = task, 0, 0, 0
                held.append((doc_id, _unpack(ids)))
                at += len(held[-1][1])
        if held:
            yield close()

    schema = "task int, segment int, first long, doc_ids array<long>, lengths array<long>, code binary"
    with small_batches(spark, maxBytesPerBatch="1048576"):
        ordered.mapInArrow(segments, schema).write.parquet(f"{out}/segments")
    sums = spark.read.schema(schema).parquet(f"{out}/segments").select("task", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("task").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")).write.parquet(f"{out}/tasks")


_SEGMENTS = pa.schema([("task", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("code", pa.binary())])


def token_at(spark: SparkSession, out: str, place: int) -> int | None:
    """The id at a place of the whole file, counted from 0, or None beyond its end: only the segment that holds it is
    taken, and in it one byte a level is read."""
    segments, tasks = spark.read.parquet(f"{out}/segments"), spark.read.parquet(f"{out}/tasks")
    start, n = F.col("offset") + F.col("first"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    row = segments.join(tasks, "task").where((start <= place) & (start + n > place)).select(start.alias("start"), "code").first()
    return None if row is None else int(dac.Reader(row["code"])[place - row["start"]])


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; a segment is read in one range, and its documents are cut out of it.

    A worker lets go of what it encoded with and holds one segment at a time, of batches of about a megabyte."""
    schema = "task int, segment int, first long, doc_ids array<long>, lengths array<long>, code binary"
    segments = spark.read.schema(schema).parquet(f"{out}/segments")
    placed = segments.join(spark.read.schema("task int, offset long").parquet(f"{out}/tasks"), "task").select((F.col("offset") + F.col("first")).alias("start"), "doc_ids", "lengths", "code")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            start, doc_ids, lengths = row.column(0)[0].as_py(), row.column(1).flatten(), row.column(2).flatten().to_numpy()
            reader = dac.Reader(row.column(3)[0].as_py())
            ends = np.cumsum(lengths)
            ids = memoryview(reader.range(0, reader.n).astype("<u4").tobytes())
            sums = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    # a batch of segments is sized by what is set when it is read
    path = new_path(spark, "token-rows")
    with small_batches(spark, maxBytesPerBatch="1048576"):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_rows: int = CACHE_ROWS) -> DataFrame:
    """Write the ids of docs into a new place of the shared folder and read them back, a row per document."""
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, end_id, out, id_col, text_col, cache_rows)
    return read_tokens(docs.sparkSession, out)
