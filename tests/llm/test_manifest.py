"""Manifests, source divergence and byte-pair encoding against plain versions on small rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import bpe, divergence, merkle
from recollect.llm.queries import BYTE_BPE, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, path string, n int, digest string, x_now string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "t", 1, "p", 2, "d", "x") for i, t, lang, s, n in rows], SCHEMA).repartition(3)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Levels of digests from the leaves to the root, and each leaf's siblings on the way."""
    levels, proofs = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        runs = [levels[-1][k : k + arity] for k in range(0, len(levels[-1]), arity)]
        for i, proof in enumerate(proofs):
            at = i // arity ** (len(levels) - 1)
            proof += [d for k, d in enumerate(runs[at // arity]) if k != at % arity]
        levels.append([digest(*r) for r in runs])
    return levels[-1][0], proofs


@pytest.mark.parametrize(("arity", "band"), [(2, 4096), (3, 9), (2, 4)])
def test_manifest_by_hand(spark, monkeypatch, arity, band):
    monkeypatch.setattr(merkle, "BAND_NODES", band)
    rng = random.Random(arity)
    rows = [(i, rng.choice([None, "", "x" * rng.randrange(50), "é\n"]), rng.choice(["a", "a", "a", "b", None]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(150)]
    rows += [(7, "same", "a", "s", 1)] * 5 + [(None, "null id", "a", None, None), (None, None, None, None, None), (300, "y" * 200_000, "c", "s", 9), (301, "v", "", "s", 2**63 - 1)]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, (r[0], r[3], r[2], r[4], r[1])))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, g or ""))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, *plain_tree([leaf(r) for r in own], arity)
    root, above = plain_tree([trees[g][1] for g in names], arity)
    want = sorted((str(r[0]), leaf(r), trees[g][1], root, "".join(trees[g][2][k] + above[names.index(g)])) for g in names for k, r in enumerate(trees[g][0]))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    docs = rows_of(spark, rows)
    made = merkle.manifest(docs, fields, extra={"now": F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest(F.lit("altered")))}, arity=arity)
    checked = merkle.folded(made.withColumn("now", F.coalesce("now", "digest")), "now", arity).collect()
    got = sorted((str(r["id"]), bytes(r["digest"]).hex(), bytes(r["subroot"]).hex(), bytes(r["root"]).hex(), bytes(r["path"]).hex()) for r in checked)
    assert got == want
    assert all((r["folded_root"] == r["root"]) == (r["id"] is None or r["id"] % 2 == 1) for r in checked)


def test_manifest_of_nothing_and_of_one(spark):
    fields = [F.col("doc_id"), F.col("text")]
    docs = rows_of(spark, [(1, "one", "a", "s", 1)])
    assert merkle.manifest(docs.limit(0), fields).count() == 0
    (row,) = merkle.folded(merkle.manifest(docs, fields), "digest").collect()
    assert row["digest"] == row["subroot"] == row["root"] == row["folded_root"] and bytes(row["path"]) == b""


def plain_audit(rows, least, k):
    count, within = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang or "", source or ""].update(found)
        within[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in count}:
        kept = {t for t, n in within[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (la, s), c in count.items() if la == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        p = lambda c, t: 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = sorted(((-sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in groups.items() if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p(c, t), p(whole, t)), t) for t in c if p(c, t) > p(whole, t)), key=lambda x: (x[0], x[1].encode()))[:k]
            out += [(lang, s, part, item, -v, n + 1) for part, found in (("pair", pairs), ("term", terms)) for n, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_by_hand(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART", 64)
    monkeypatch.setattr(divergence, "HELD", 40)
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}" for i in range(60)] + ["A", "ß", "İ"]
    rows = []
    for i in range(240):
        source = rng.choice(["s1", "s2", "s3", None, "a-longer-name"])
        words = rng.choices(vocabulary, weights=[1 + (hash_of(source) + 7 * k) % 11 for k in range(len(vocabulary))], k=rng.randrange(40))
        rows.append((i, rng.choice([" ", "1", "\n--"]).join(words), rng.choice(["en", "en", None]), source, 1))
    rows += [(500, None, "en", "silent", 1), (501, "", "xx", "alone", 1), (502, "few words here", "xx", "other", 1), (503, "wa " * 5000, "en", "s1", 1)] + [rows[3]] * 4
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(rows_of(spark, rows)).collect())
    assert got == plain_audit(rows, 10, 10)
    assert {r[4] for r in got if r[0] == "xx"} == {0}
    assert divergence.audit(rows_of(spark, []).where("false")).count() == 0


def hash_of(source):
    return sum(map(ord, source or ""))


def test_search_stops_only_when_the_rest_is_below(spark):
    """Ties at the k-th value lie in several buckets: the item's bytes decide."""
    rows = [("en", "s", f"t{i:03}", 1 + i % 40, 1000 + 10 * (i % 40), 1000) for i in range(400)] + [("en", "s", f"u{i}", 500, 1000 + 390, 1000) for i in range(12)]
    frame = spark.createDataFrame(rows, "lang string, source string, term string, c long, p long, q long")
    got = [(r["item"], r["value"], r["rank"]) for r in divergence.top_terms(frame, 15).orderBy("rank").collect()]
    want = sorted(((r[2], (r[4] - r[5]) ** 2 // (r[4] + r[5])) for r in rows if r[4] > r[5]), key=lambda x: (-x[1], x[0]))[:15]
    assert [g[:2] for g in got] == want and [g[2] for g in got] == list(range(1, 16))


ODD = ["a", "b", "e", "the", " ", "  ", "\n", "\t", "é", "中", "👍", "<|endoftext|>", "<|", "'s", "'LL", "1", "22", "_", "-", "=", "\x00", "\x1c", "\x85", "　", "\xa0", " \n", "aaaa", "ing", " th", "ABC", ".", ",", "word.", "İ"]


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    tok, codes, rng = Tokenizer.from_file(path), bpe._Codes(path), random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(50))) for _ in range(4000)] + ["".join(rng.choices("abcdeth", k=rng.randrange(60))) for _ in range(2000)]
    texts += ["a" * n for n in range(1, 120)] + ["=" * n for n in range(1, 90)] + ["\n" * n + " " * n for n in range(20)] + ["x" * 50_000 + " end"]
    for text in texts:
        assert np.frombuffer(codes.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]


def test_tokens_end_prefixes_uniquely():
    """Every prefix's ids, from its back-pointers, are those of merging it alone."""
    vocabulary = bpe.Vocabulary(tokenizer_path(BYTE_BPE))

    def merged(data):
        ids = [vocabulary_byte(vocabulary, b) for b in data]
        while len(ids) > 1:
            r, at = min((vocabulary.rank.get(p, bpe.NEVER), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == bpe.NEVER:
                break
            pair = ids[at], ids[at + 1]
            ids[at : at + 2] = [next(t for t, h in vocabulary.halves.items() if h == pair)]
        return ids

    rng = random.Random(3)
    for _ in range(15):
        data = "".join(rng.choices(["the", "ing", "er", "a", "n", "é", "zz"], k=4)).encode()
        for end in range(1, len(data) + 1):
            assert vocabulary.encode(data[:end]) == merged(data[:end])


def vocabulary_byte(vocabulary, b):
    return next(i for i, t in vocabulary.bytes.items() if t == bytes([b]))


def test_documents_go_round(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ROWS", 8)
    path = tokenizer_path(BYTE_BPE)
    rows = [(1, None, None, None, 1), (2, "", "a", "s", 1), (None, "null id", "a", "s", 1), (3, "Same  text.\n", "a", "s", 1), (3, "Same  text.\n", "a", "s", 1), (4, "long " * 40_000, "a", "s", 1), (5, "<|endoftext|>x", "a", "s", 1)]
    coded = bpe.encode_documents(rows_of(spark, rows), path)
    got = bpe.decode_documents(coded, path).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert bpe.encode_documents(rows_of(spark, rows).limit(0), path).count() == 0
    broken = spark.createDataFrame([(1, [len(bpe.byte_letters()), 10**6]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] is None for r in bpe.decode_documents(broken, path).collect()} == {1: False, 2: True}
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(tokenizer_path("word_bpe_49k.json"))
