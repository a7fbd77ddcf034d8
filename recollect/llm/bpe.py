"""Byte-pair encoding by dynamic programming over prefixes, and its decoding.

Of every prefix of a pre-token the encoding ends in one token only. It is found among the vocabulary's tokens that end
there, which an automaton gives for all places in one pass: the one that may follow the last token of what comes before
it. Two tokens may follow each other if merging their bytes in the order of ranks would never join across the border.
The ids are read back from the last prefix. The time is linear in a pre-token's length, however long it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces
from .worker import held, trim

#: Entries of a worker's caches of pre-tokens and of pairs of tokens, and most characters of a pre-token kept.
CACHE_ROWS, PAIR_ROWS, CACHED_CHARS = 300_000, 200_000, 48
#: A space that text follows, and what makes other spaces likely.
_CUT, _ODD, _BETWEEN = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)"), re.compile(r"\S (?=\S)")
#: Characters of a text that are encoded at a time, and bytes of texts.
SEGMENT, BATCH_BYTES = 1 << 20, 2 << 20
NEVER = 1 << 62
# How byte-level vocabularies cut a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, to the byte: printable Latin-1 stands for itself, the
    rest takes the letters from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What encoding needs of a tokenizer's file: tokens as bytes, merge ranks, and the edges of each token.

    A tokenizer that does more than byte-level pieces (a normal form, prefixes, dropout) is refused."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = told["normalizer"] is None and told["post_processor"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in told["added_tokens"]):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        of = model["vocab"]
        self.rank = {(of[a], of[b]): r for r, (a, b) in enumerate(pairs)}
        self.halves = {of[a + b]: (of[a], of[b]) for a, b in reversed(pairs)}
        self.born = {t: self.rank[pair] for t, pair in self.halves.items()}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile(PRE_TOKENS).findall
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda text: [text]
        self.edges = lru_cache(None)(self._edges)
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        made: set[int] = set()
        for i in sorted(of.values(), key=lambda i: self.born.get(i, -1)):
            # what the merges never make of its own bytes ends no encoding
            if len(self.bytes[i]) == 1 or (i in self.halves and made.issuperset(self.halves[i]) and self.may_follow(*self.halves[i], whole=True)):
                made.add(i)
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()

    def _edges(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The tokens that stand at a token's left (0) or right (1) edge while it is merged, from the byte up, each with
        the rank of the merge that uses it up."""
        out, used = [(token, NEVER)], NEVER
        while token in self.halves:
            used, token = self.born[token], self.halves[token][side]
            out.append((token, used))
        return tuple(reversed(out))

    def may_follow(self, left: int, right: int, whole: bool = False) -> bool:
        """Whether left and right stay apart when their bytes are merged. whole: whether they stay apart until they are
        both done, so that merging them gives their sum.

        The tokens at the border change at known ranks. A pair at the border would be joined if its rank comes before
        either of its tokens is used up on its own side; of equal ranks, the pair further left is joined first."""
        a, b = self.edges(left, 1), self.edges(right, 0)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            done = x_used == NEVER and y_used == NEVER
            if done and whole:
                return True
            r = self.rank.get((x, y))
            if r is not None and r < x_used and r <= y_used:
                return False
            if done:
                return True
            if x_used <= y_used:
                i += 1
            if y_used <= x_used:
                j += 1

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a pre-token's bytes."""
        text = piece.decode("latin-1")
        last, size = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if length < end:
                if before < 0:
                    continue
                pair = before << 32 | token
                if (fit := fits.get(pair)) is None:
                    if len(fits) >= PAIR_ROWS:
                        fits.clear()
                    fit = fits[pair] = self.may_follow(before, token)
                if not fit:
                    continue
            last[end], size[end] = token, length
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


def _key(piece: str) -> str:
    """Where a pre-token's ids are kept."""
    return piece[1:] if piece[0] == " " and not piece[1:2].isspace() and len(piece) > 1 else "\n" + piece


class _Codes(dict):
    """A run of characters after a space, up to the next space that text follows, to the ids of the space and the run as
    little-endian uint32 bytes.

    No pre-token goes on over a space that text follows, so a text may be cut there. A pre-token without a space before
    it stands behind a line break, which no run begins with. Entries live in two generations: what is used again while
    the younger fills up stays."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary, self.older = Vocabulary(path), {}

    def __missing__(self, run: str) -> bytes:
        if run[0] != "\n":
            if run[-1] in ".," and run[:-1].isalpha():
                return self[run[:-1]] + self["\n" + run[-1]]
            if not run.isalpha() and len(cut := self.vocabulary.cut(" " + run)) > 1:
                return b"".join(map(self.__getitem__, map(_key, cut)))
        ids = self.older.get(run)
        if ids is None:
            ids = self.vocabulary.encode((run[1:] if run[0] == "\n" else " " + run).encode())
            ids = pack(f"<{len(ids)}I", *ids)
        if len(run) <= CACHED_CHARS:
            if len(self) >= CACHE_ROWS // 2:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens, cut by the pattern."""
        return b"".join(map(self.__getitem__, map(_key, self.vocabulary.cut(text))))

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.vocabulary.split(text):
            if part in self.vocabulary.added:
                out.append(pack("<I", self.vocabulary.added[part]))
            elif part:
                first, *runs = _CUT.split(part) if _ODD.search(part) else part.split(" ")
                out.append(self.plain(first))
                out += map(self.__getitem__, runs)
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Runs of texts with plain spaces are looked up once for all texts together."""
        made: list[list[bytes]] = [[] for _ in texts]
        rows, rests = [], []
        for row, text in enumerate(texts):
            for part in _segments(text or ""):
                if _ODD.search(part) or any(t in part for t in self.vocabulary.added):
                    made[row].append(self.encode(part))
                    continue
                first, space, rest = part.partition(" ")
                made[row].append(self.plain(first))
                if space:
                    rows.append((row, len(made[row])))
                    made[row].append(b"")
                    rests.append(rest)
        runs = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        told = pc.dictionary_encode(runs.flatten())
        ids = [self[run] for run in told.dictionary.to_pylist()]
        taken = _lists(ids).take(told.indices)
        ends = taken.offsets.to_numpy()[np.asarray(runs.offsets)] if rests else []
        flat = taken.flatten().to_numpy().astype("<u4")
        for k, (row, at) in enumerate(rows):
            made[row][at] = flat[ends[k] : ends[k + 1]].tobytes()
        return [b"".join(m) for m in made]


def _segments(text: str) -> Iterator[str]:
    """A text in parts of about SEGMENT characters, cut before a single space between others."""
    at = 0
    while len(text) - at > 2 * SEGMENT:
        cut = _BETWEEN.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:] if at else text


def _lists(made: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in made)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32), pa.int32()))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), a row per row of docs: the ids that the tokenizers library gives for the whole text with
    add_special_tokens=False and neither truncation nor padding.

    Null and empty texts have no ids; added tokens such as <|endoftext|> inside a text are one id, as the library has it;
    texts of any length are encoded whole; repeated rows each get theirs; an empty table gives no rows; other columns
    are not read. Nothing is exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = held(f"bpe {tokenizer_path}", lambda: _Codes(tokenizer_path))
        for batch in (part for whole in batches for part in pieces(whole, 1, BATCH_BYTES)):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(codes.encode_all(batch.column(1).to_pylist()))], ["doc_id", "ids"])
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _table(path: str) -> pa.Array:
    """Every id's bytes, and none for the place after the last."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    letters = byte_letters()
    found = {i: bytes(letters[c] for c in token) for token, i in told["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    return pa.array([found.get(i, b"") for i in range(max(found) + 1)] + [b""], pa.large_binary())


def decode_documents(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """coded with `text`: the bytes of the ids one after another, as the library's decode with
    skip_special_tokens=False gives them; what is no valid UTF-8 becomes U+FFFD; null ids give null, no ids an empty text;
    ids that the vocabulary lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(f"bpe bytes {tokenizer_path}", lambda: _table(tokenizer_path))
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            ids = lists.flatten().fill_null(-1).to_numpy()
            taken = table.take(pa.array(np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1)))
            places = np.frombuffer(taken.buffers()[1], np.int64) if len(taken) else np.zeros(1, np.int64)
            data = memoryview(taken.buffers()[2] or b"")
            ends = places[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])].tolist()
            text = [bytes(data[a:b]).decode("utf-8", "replace") if there else None for a, b, there in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, "text"])

    names = [id_col, ids_col]
    rows = coded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, text string")
