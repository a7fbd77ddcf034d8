"""Text expressions: search terms, keys, excerpts, screening."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts written without spaces, whose runs are also cut into pairs of characters (fixed values).
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"
TOKEN, LATIN = r"[\p{L}\p{N}_./:-]+", r"[a-z0-9_./:-]+"


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pairs_of(run: Column) -> Column:
    """All pairs of neighbouring characters, in one walk over the characters."""
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))


def search_terms(text: Column) -> Column:
    """Every sighting of a search term: tokens of two characters or more; inside a token its Latin runs and its CJK runs
    where they differ from it; and the pairs of every CJK run. Null gives an empty array."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    tokens, plain = (F.filter(_runs(lower, p), lambda t: F.length(t) >= 2) for p in (TOKEN, LATIN))

    def within(t: Column) -> Column:
        part = lambda r: (F.length(r) >= 2) & (r != t)
        cjk = _runs(t, CJK)
        every = F.concat(F.array(t), F.filter(_runs(t, LATIN), part), F.filter(cjk, part), F.flatten(F.transform(cjk, pairs_of)))
        # a token that is one Latin run has no other parts
        return F.when(t.rlike(f"^{LATIN}$"), F.array(t)).otherwise(every)

    # nor has any token of a text of ASCII characters, where the two patterns find the same
    return F.when(text.rlike(r"^\p{ASCII}*$"), plain).otherwise(F.flatten(F.transform(tokens, within)))


def normal_query(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case. (Compatibility forms stay: Spark has no such normaliser.)"""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def statement_key(text: Column) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}\p{S}]+", "")


def excerpt(text: Column, limit: int, marker: str = " ... ") -> Column:
    """The text, or its head and tail around a marker, limit characters in all."""
    head = (limit - len(marker)) // 2
    tail = limit - len(marker) - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def token_estimate(text: Column) -> Column:
    """Tokens by bytes: a quarter, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,4}\s+(.+?)\s*#*\s*$"), F.lit(1))


def strip_tagged(text: Column, tag: str) -> Column:
    """Text without what stands between the tags, after an unclosed one, and stray closing ones."""
    paired = F.regexp_replace(text, f"(?is)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(paired, f"(?is)<{tag}>.*$", ""), f"(?i)</{tag}>", "")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest of a text or bytes, as lower-case hex; null stays null. Keys of more than 64 bytes are hashed first."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
