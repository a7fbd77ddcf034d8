"""Token counts of whole texts with a SentencePiece BPE model, by two tiers of pre-token lengths on the map side.

A pre-token is a run of spaces (U+2581 counts as one, as the model writes spaces so) and what follows it up to the
next space. No piece of the vocabulary holds a space after another character, so no merge crosses into the next
pre-token and a text's count is the sum of its pre-tokens' counts; this is checked on the vocabulary at the start.
Tier one is a broadcast table of frequent pre-tokens, taken from a sample; tier two is a bounded cache in each worker,
which encodes a miss once. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces
from .worker import held

SPACE = "▁"
#: Most entries of the broadcast table, most characters of an entry, and entries of a worker's cache.
TABLE_ROWS, TABLE_CHARS, CACHE_ROWS = 32_768, 48, 400_000
#: Texts, about, that propose the table, and the seed of their choice.
SAMPLE_ROWS, SAMPLE_SEED = 20_000, 11
#: Distinct pre-tokens a task counts before it forgets the rarest.
COUNTED = 200_000
_PRE = re.compile(r"\n[^ \n]*| *[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a non-empty text. A line break belongs to no piece either, so a word is also cut before it.

    The model writes one space before the text, so a pre-token stands for itself with a space before it; '' is a lone
    space, and one that starts with a line break has no space before it."""
    text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return [m if m[0] == "\n" else m[1:] for m in _PRE.findall(" " + text)]


def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def _check(model) -> None:
    crossing = [p for p in map(model.id_to_piece, range(model.vocab_size())) if SPACE in p.lstrip(SPACE)]
    crossing += [p for p in map(model.id_to_piece, range(model.vocab_size())) if "\n" in p]
    if crossing:
        raise ValueError(f"pieces such as {crossing[0]!r} reach over a space or line break: counts by pre-token would be wrong")


def pre_token_length(model, word: str) -> int:
    if not word:
        return 1
    return len(model.encode(word)) - (word[0] == "\n")


class _Lengths(dict):
    """Pre-token to token count; a miss is encoded and kept, up to CACHE_ROWS at a time."""

    def __init__(self, model, table: dict[str, int]):
        super().__init__(table)
        self.model, self.table = model, table

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ROWS + len(self.table):
            self.clear()
            self.update(self.table)
        n = pre_token_length(self.model, word)
        if len(word) <= 4 * TABLE_CHARS:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def frequent_pre_tokens(docs: DataFrame, text_col: str) -> list[str]:
    """The TABLE_ROWS most frequent pre-tokens of a seeded sample of about SAMPLE_ROWS texts, ties by the word.

    Every task reports its own most frequent ones and the driver adds them up, with no exchange; what all tasks report
    together is at most about twice the table, and a few for each partition that has a row in the sample."""
    rows = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    sample = rows.sample(fraction=share, seed=SAMPLE_SEED) if share < 1 else rows
    each = 2 * TABLE_ROWS // max(sample.rdd.getNumPartitions(), 1) + 64

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in (part for whole in batches for part in pieces(whole, 0)):
            for text in batch.column(0):
                if text.as_py():
                    seen.update(pre_tokens(text.as_py()))
            if len(seen) > 2 * COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED)))
        top = [(w, n) for w, n in seen.most_common(each) if len(w) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for r in sample.mapInArrow(propose, "word string, n long").collect():
        total[r["word"]] += r["n"]
    return sorted(total, key=lambda w: (-total[w], w))[:TABLE_ROWS]


def pack(table: dict[str, int]) -> bytes:
    """The table as it is broadcast: one Arrow batch of words and one-byte or two-byte lengths."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.uint16())], ["word", "n"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, int]:
    words, n = pa.ipc.open_stream(data).read_all().columns
    return dict(zip(words.to_pylist(), n.to_pylist(), strict=True))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of docs.

    Null and empty texts have no bytes and no tokens; texts of any length are counted whole; repeated rows count each
    for themselves; an empty table gives no rows. The count is what the library gives for the whole text: no begin,
    end or added special tokens, and strings such as </s> are ordinary text. A sample proposes the broadcast table; which
    words it holds changes speed alone.
    """
    model = load(model_path)
    _check(model)
    packed = pack({w: pre_token_length(model, w) for w in frequent_pre_tokens(docs, text_col)})
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    table_id = hashlib.sha256(packed).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = held(f"lengths {model_path} {table_id}", lambda: _Lengths(load(model_path), unpack(shared.value)))
        for batch in (part for whole in batches for part in pieces(whole)):
            n = [lengths.count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
