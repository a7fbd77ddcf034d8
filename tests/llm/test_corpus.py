"""The corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables and
clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import ann, bloom, chat, dac, decontaminate, jaccard, linededup, mix, quality, shard, tokencount, tokenfile, words
from recollect.llm.components import components
from recollect.llm.queries import PIECE_BPE, WORD_BPE, tokenizer_path
from recollect.llm.workspace import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, `group` string, key string, task int"
LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"base{i}" for i in range(60))
TEXTS = [None, "", "   \n\t", "one", "a b c", BASE, BASE, BASE.replace("base59", "other"), BASE.upper(), LONG, LONG + " end", "x\ny\nx", "é▁ ü</s> <|endoftext|>", "tail  spaces  ", " lead"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i % 4], 1, 0.5, 1, "g", "k", 0) for i, t in enumerate(TEXTS)]
    rows += [(4, "a b c", None, None, None, None, None, None, None, None), (None, "null id", None, "s1", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    texts = [t if t is None else t.encode() for t in TEXTS]
    hashes, counts, starts, ends = words.word_hashes(pa.array(texts, pa.binary()))
    at, known = 0, {}
    for text, n in zip(texts, counts, strict=True):
        expect = (text or b"").lower().split()
        assert len(expect) == n
        for k, w in enumerate(expect):
            assert text[starts[at + k] : ends[at + k]].lower() == w
            assert known.setdefault(w, hashes[at + k]) == hashes[at + k]
        at += n
    assert len(set(known.values())) == len(known)


def test_dac_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = rng.integers(0, 1 << 22, n)
        reader = dac.Reader(dac.encode(ids))
        assert [reader[i] for i in range(n)] == ids.tolist()
        assert reader.range(n // 3, n).tolist() == ids[n // 3 :].tolist()


def test_token_file(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    got = sorted((tuple(r) for r in tokenfile.token_file(docs, tokenizer_path(WORD_BPE)).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc_id, start, n, crc), (want_id, text) in zip(got, rows, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert doc_id == want_id and start == at
        if doc_id != 4:  # repeated ids lie in an order fixed by their tokens
            assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert tokenfile.token_file(empty, tokenizer_path(WORD_BPE)).count() == 0
    out = new_path(spark, "tokens")
    tokenfile.write_tokens(docs, tokenizer_path(WORD_BPE), 2, out)
    places = {t: (start, n) for _, start, n, _ in got for t in (start, start + n - 1)}
    for place, (start, n) in list(places.items())[-6:]:
        if place == start + n - 1:
            assert tokenfile.token_at(spark, out, place) == 2
    assert tokenfile.token_at(spark, out, at) is None


def test_another_tokenizer_gets_whole_texts(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r["ids_crc32"] for r in tokenfile.token_file(docs, path).collect()) == want


def test_token_counts(docs, empty):
    model = tokencount.load(tokenizer_path(PIECE_BPE))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs, tokenizer_path(PIECE_BPE)).collect())
    want = []
    for r in docs.collect():
        n = len(model.encode(r["text"] or ""))
        want.append((r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 4096))
    assert got == sorted(want)
    assert tokencount.count_tokens(empty, tokenizer_path(PIECE_BPE)).count() == 0


def test_line_dedup_both_ways(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    seen = {}
    for i, (_, t) in enumerate(rows):
        for k in {line.encode().strip().lower() for line in t.split("\n")} - {b""}:
            seen.setdefault(k, set()).add(i)
    gone = {k for k, v in seen.items() if len(v) >= 2}
    want = sorted(("\n".join(x for x in t.split("\n") if x.encode().strip().lower() not in gone), t.count("\n") + 1) for _, t in rows)
    first = {}
    for i, (doc, t) in enumerate(rows):
        for place, line in enumerate(t.split("\n")):
            k = line.encode().strip().lower()
            if k in gone and doc is not None:
                first[k] = min(first.get(k, (doc, place)), (doc, place))
    stays = sorted("\n".join(x for p, x in enumerate(t.split("\n")) if (k := x.encode().strip().lower()) not in gone or first.get(k) == (d, p)) for d, t in rows)
    for most in (1000, 0):
        got = linededup.dedup_lines(docs, min_docs=2, broadcast_keys=most).collect()
        assert sorted((r["text"], r["n_lines"]) for r in got) == want
        assert sorted(r["text"] for r in linededup.dedup_lines(docs, min_docs=2, broadcast_keys=most, keep_first=True).collect()) == stays
    assert linededup.dedup_lines(empty).count() == 0


def test_words_go_on_over_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array([b"ab cd" * 40, b"x" * 300, None, b"", b" tail ", b"ab", b"cd e"], pa.binary())
    whole = words.word_hashes(texts)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(words, "BLOCK", block)
        assert all((a == b).all() for a, b in zip(words.word_hashes(texts), whole, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), texts], ["i", "t"])
    assert [i for p in words.pieces(batch, 1, 100) for i in p.column(0).to_pylist()] == list(range(7))


def test_twice_filter_misses_no_repeat(spark):
    rows = spark.range(20_000, numPartitions=5).select((F.col("id") % 15_000).alias("h"))
    hashes_of = lambda b: words.mix64(b.column(0).to_numpy().astype(np.uint64))
    bits = bloom.seen_twice(rows, hashes_of)
    every = words.mix64(np.arange(15_000, dtype=np.uint64))
    hit = bloom.test(bits, every)
    assert hit[:5000].all() and hit[5000:].mean() < 0.05


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 10), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7}


def jaccard_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard_components(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(100, 220):
        w = list(base)
        for k in rng.integers(0, 40, rng.integers(0, 4)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == jaccard_by_hand(rows)
    assert {r["component_id"] for r in jaccard.jaccard_components(docs).where("doc_id IS NULL").collect()} == {None}
    assert jaccard.jaccard_components(empty).count() == 0


def test_decontamination_finds_exact_and_edited(spark, empty):
    item = " ".join(f"item{i}" for i in range(40))
    edited = item.split()
    for i in (5, 13, 22, 31):
        edited[i] = "changed"
    rows = [(1, LONG + " " + item + " " + LONG), (2, "start " + " ".join(edited)), (3, LONG), (4, " ".join(item.split()[:8])), (5, None), (6, ""), (1, "again " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(0, item), (0, item), (1, None), (2, "Too  short"), (3, "")], "item_id long, text string")
    rows += [(7, "this is too short of words"), (8, "\ttoo SHORT ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, tests).collect()}
    assert set(got) == {(1, 0), (2, 0), (8, 2)} and got[1, 0] == 1.0 and 0.8 < got[2, 0] < 1
    assert decontaminate.contaminated(empty, tests).count() == 0
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0


@pytest.mark.parametrize("block", [128, 7])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    """A family of near copies, exact copies, repeated rows and doc_ids with two texts: rows against rows by hand."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(7)
    base, other = ([f"{x}{i}" for i in range(60)] for x in "tu")
    rows = [(500, " ".join(base)), (500, " ".join(other)), (600, " ".join(base)), (600, " ".join(base)), (None, " ".join(base)), (700, None), (701, "")]
    rows += [(900, " ".join([*other[:-1], "end"])), (901, " ".join([*base[:-1], "end"]))]
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) if t and i is not None else frozenset() for i, t in rows]

    def similar(x, y):
        return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)

    near = [[m for m, y in enumerate(sets) if m != k and similar(x, y)] for k, x in enumerate(sets)]
    name = [i for i, _ in rows]
    for _ in rows:
        name = [name[k] if not near[k] else min(name[k], *(name[m] for m in near[k])) for k in range(len(rows))]
    want = sorted((str(i), len(near[k]), str(name[k])) for k, (i, _) in enumerate(rows))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("copied", [False, True])
def test_decontamination_finds_every_few_words_changed(spark, copied):
    """Items of 16 to 59 words with every fourth, fifth or sixth word changed, with and without exact copies elsewhere."""
    policy = decontaminate.AlignPolicy()
    items = {n: [f"i{n}_{k}" for k in range(n)] for n in range(16, 60)}
    texts, want = {}, {}
    for n, item in items.items():
        for step in (4, 5, 6):
            for at in range(step):
                doc_id = len(texts)
                texts[doc_id] = [f"c{doc_id}_{k}" if k % step == at else w for k, w in enumerate(item)]
                number = {w: k + 1 for k, w in enumerate({*item, *texts[doc_id]})}
                a, b = (np.array([number[w] for w in x], np.uint64) for x in (texts[doc_id], item))
                want[doc_id, n] = decontaminate.align([a], [b], policy)[0] / (policy.match * n)
    assert min(want.values()) >= policy.threshold
    rows = [(i, "before " + " ".join(t) + " after") for i, t in texts.items()]
    if copied:
        rows += [(10_000 + 100 * n + k, " ".join(item)) for n, item in items.items() for k in range(3)]
        want |= {(10_000 + 100 * n + k, n): 1.0 for n in items for k in range(3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, tests).collect()}
    assert got == pytest.approx(want)


def test_alignment_by_hand():
    policy = decontaminate.AlignPolicy()

    def plain(a, b):
        h, best = np.zeros((len(b) + 1, len(a) + 1), int), 0
        for i in range(len(b)):
            for j in range(len(a)):
                h[i + 1, j + 1] = max(0, h[i, j] + (policy.match if a[j] == b[i] else policy.mismatch), h[i, j + 1] + policy.gap, h[i + 1, j] + policy.gap)
                best = max(best, h[i + 1, j + 1])
        return best

    rng = np.random.default_rng(2)
    a, b = ([rng.integers(1, 5, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)] for _ in range(2))
    assert decontaminate.align(a, b, policy).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_quality_learns_and_ignores_held_out(spark, empty):
    rows = [(i, " ".join(f"clean{(i * 7 + k) % 90} word" for k in range(30)) if i % 2 else "BUY!! " * 40) for i in range(600)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(5, None), (7777, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 602
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert quality.score_documents(empty.select("doc_id", "text"), labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_pool_adjacent():
    got = quality.pool_adjacent(np.array([0.1, 0.4, 0.2, 0.9]), np.array([1.0, 1, 3, 1]))
    assert np.allclose(got, [0.1, 0.25, 0.25, 0.9])


def test_shards(docs, empty):
    got = hashed = shard.hilbert_shards(docs, 5).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(hashed)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode()) + 8 for r in docs.collect())
    assert shard.hilbert_shards(docs.limit(3), 24).count() == 3
    assert shard.hilbert_shards(empty).count() == 0


def test_curve_visits_neighbours(spark):
    cells = sorted(shard.curve(spark).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in cells] == list(range(4096))
    assert all(abs(a["a"] - b["a"]) + abs(a["b"] - b["b"]) + abs(a["c"] - b["c"]) == 1 for a, b in zip(cells, cells[1:], strict=False))


def test_mix(spark, docs, empty):
    got = mix.mix(docs)[1].collect()
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(tuple, mix.mix(docs.repartition(7))[1].collect()), key=str) == sorted(map(tuple, got), key=str)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    report = mix.mix(many)[1].groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 5 for r in report)
    assert mix.mixed_documents(many).agg(F.sum(mix.word_count(F.col("text")))).first()[0] == sum(r["t"] for r in report)
    assert mix.mix(empty)[1].count() == 0 and mix.mixed_documents(empty).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<~/s> <~~|end|>", "<|next|><|turn|>x<|text|>", "<<SYS>>[~INST]", "", None, "plain\n\nlines", "<" * 5 + "s>", "|end|>"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "sy<|text|>s"][(c + t) % 5], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(7)] + [(None, 0, "user", "x"), (1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[300:320] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    assert set(got) == set(range(0, 700, 100))
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        assert list(found) and sorted(found) == list(range(1, 11))
        hit += len({v for v, _ in found.values()} & set(order))
        assert all(abs(s - d[v]) < 1e-9 for v, s in found.values())
    assert hit >= 0.9 * 70
    assert [got[0][k][0] for k in range(1, 11)] == list(range(300, 310))
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 5, 9)")).collect()
    assert len(few) == 2
    other = spark.createDataFrame([(2000 + i, [float(i), 1.0]) for i in range(0, 120, 20)], "vec_id long, embedding array<double>")
    both = [r for r in ann.nearest(df.unionByName(other)).orderBy("rank").collect() if r["query_id"] >= 2000]
    assert [r["vec_id"] for r in both if r["query_id"] == 2000] == [2020, 2040, 2060, 2080, 2100]
    assert [r["vec_id"] for r in both if r["query_id"] == 2100] == [2080, 2060, 2040, 2020, 2000]


def test_neighbours_of_repeated_rows(spark):
    """A query and a neighbour that are repeated 12 times, and an id with 12 vectors, count once each."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    x[[1, 2]] = x[0] + 0.01, x[0] + 0.02
    rows = [(i, v) for i, v in enumerate(x)] + [(i, x[i]) for i in (0, 1) for _ in range(11)] + [(k, x[0] + 0.03 + j / 1000) for k in (3, 100) for j in range(12)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100}
    for q, found in got.items():
        best = {}
        for a in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - a) ** 2).sum())))
        assert len(found) == len({v for v, _ in found}) == 10
        assert [v for v, _ in found][:3] == sorted(best, key=best.get)[:3]
        assert all(abs(s - best[v]) < 1e-9 for v, s in found)


def test_token_cache_size_changes_no_ids(spark):
    docs = spark.createDataFrame([(i, f"Words {i % 7}, of a small cache: w{i}a w{i}b, words.") for i in range(60)] + [(90, None), (91, "")], "doc_id long, text string")
    rows = lambda **more: sorted(map(tuple, tokenfile.token_file(docs, tokenizer_path(WORD_BPE), **more).collect()))
    assert rows(cache_rows=3) == rows()


def test_tokens_are_read_while_batches_are_small(spark):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(20)], "doc_id long, text string")
    got = tokenfile.token_file(docs, tokenizer_path(WORD_BPE))
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.count() == 20
