"""Readers of files, and candidate rules on nulls and planted cases."""

import hashlib

from pyspark.sql import functions as F

from recollect.operators import candidates
from recollect.sources import files


def test_diagnostics_skip_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1, "stage": "x"}\nnot json\n{"v": 2, "stage": "y", "ms": 3}\n{"v": "z"}\n\n{"v": 4')
    rows = files.diagnostics(spark, str(tmp_path), "v int, stage string, ms int").collect()
    assert sorted(map(tuple, rows)) == [(1, "x", None), (2, "y", 3)]
    assert files.diagnostics(spark, str(tmp_path), "v int, stage string, ms int").count() == 2


def test_memories_and_catalog(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    texts = {
        "a.md": "---\nid: a\nkind: rule\n---\nBody\n# One\n",
        "deep/b.md": "---\r\nid: b\r\nkind: note\r\n---\r\ntext",
        "deep/a.md": "---\nid: a\nkind: rule\n---\n",
        "c.md": "---\nid: x\nkind: rule\n---\nb",
        "d.md": "---\nid: d\n---\nb",
        "e.md": "---\nid: e\nkind: r\nother: 1\n---\nb",
        "f.md": "no front",
        "g.md": "---\nid: g\nid: g\nkind: r\n---\nb",
        "h.md": "",
        "skip.txt": "x",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {r["path"].split(f"{tmp_path.name}/")[-1]: r for r in files.catalog(files.memories(spark, str(tmp_path), ("id", "kind"))).collect()}
    want = {"a.md": "duplicate_id", "deep/a.md": "duplicate_id", "deep/b.md": None, "c.md": "wrong_name", "d.md": "missing_field", "e.md": "unknown_field", "f.md": "no_front_matter", "g.md": "repeated_field"}  # h.md is empty
    assert {k: r["fault"] for k, r in got.items()} == want
    assert (got["deep/b.md"]["id"], got["deep/b.md"]["kind"], got["deep/b.md"]["body"]) == ("b", "note", "text")
    docs = {r["path"].split("/")[-1]: r for r in files.documents(spark, str(tmp_path)).where("path not like '%deep%'").collect()}
    assert docs["a.md"]["headings"] == ["One"]
    assert docs["f.md"]["content_hash"] == hashlib.sha256(b"no front").hexdigest()


def test_inbox_takes_files_in_bounded_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"id": {i}}}\n')
    stream = files.inbox(spark, str(tmp_path / "in"), "id long", max_files=2)
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(sum(seen, [])) == [0, 1, 2, 3, 4]
    assert max(map(len, seen)) <= 2


def test_evidence_shape_with_nulls(spark):
    names = "echo boolean, truncated boolean, integrity string, evidence_class string, content_hash string, human_id string, human_revision string, human_hash string, source string, file_hash string, file_path string, repo_revision string, repo_root string, command string, cwd string, exit_code int, result_hash string"
    h = "a" * 64
    rows = [
        (False, False, "intact", "explicit_user_statement", h, *[None] * 12),
        (None, False, "intact", "explicit_user_statement", h, *[None] * 12),
        (False, False, "intact", None, h, *[None] * 12),
        (False, False, "intact", "human_memory_reference", None, "m", None, h, "m:", *[None] * 8),
        (False, False, "intact", "code_or_configuration", *[None] * 5, h, "/a", None, "/r", *[None] * 4),
        (False, False, "intact", "code_or_configuration", *[None] * 5, h, "/a", "b" * 64, "/r", *[None] * 4),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, names).select(candidates.eligible_shape()).collect()]
    assert got == [True, False, False, False, False, True]


def test_clamp_keeps_rows_without_evidence(spark):
    outputs = spark.createDataFrame([(1, "long_term", None), (2, "long_term", []), (3, "long_term", ["a"]), (4, "long_term", ["b"]), (5, None, ["a"])], "id long, decision string, evidence array<string>")
    inputs = spark.createDataFrame([("project_phase", ["a"]), ("long_term", ["a", "a"]), ("no_memory", ["b"]), ("no_memory", None)], "decision string, evidence array<string>")
    got = sorted((r["id"], r["decision"], r["clamped"]) for r in candidates.clamp_retention(outputs, inputs).collect())
    assert got == [(1, "long_term", False), (2, "long_term", False), (3, "project_phase", True), (5, None, False)]


def test_prompt_history_shares(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([("s", 1, long), ("s", 2, None), ("s", 3, "  "), ("s", 4, "short one"), ("t", 1, "x")], "session string, ordinal long, text string")
    got = {(r["session"], r["ordinal"], r["back"]): r["text"].split() for r in candidates.prompt_history(rows).collect()}
    assert {k: len(v) for k, v in got.items()} == {("s", 1, 0): 256, ("s", 4, 0): 2, ("s", 4, 1): 86, ("t", 1, 0): 1}
    assert got[("s", 4, 1)][:2] == ["w0", "w1"] and got[("s", 4, 1)][43] == "…" and got[("s", 4, 1)][-1] == "w299"


def test_purge_reasons(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, true, null, false, timestamp'2024-01-31 05:00:00'), (2, false, null, true, timestamp'2024-01-31'), (3, false, timestamp'2024-02-01', true, null), (4, null, null, null, timestamp'2024-01-31 05:00:00'), (5, false, null, false, null), (6, false, null, false, timestamp'2024-01-31') AS t(id, retain_forever, purge_after, pinned, archived_at)")
    none = spark.createDataFrame([], "id int")
    conflicts = spark.createDataFrame([(9, [6, 6])], "id int, others array<int>")
    got = {r["id"]: (str(r["purge_at"]), r["reason"]) for r in candidates.purge_eligibility(rows, none, none, conflicts).collect()}
    assert got == {1: ("None", "retain_forever"), 2: ("None", "pinned"), 3: ("2024-02-01 00:00:00", None), 4: ("2024-04-30 05:00:00", None), 5: ("None", "undated"), 6: ("None", "open_conflict")}
    assert rows.where(F.col("retain_forever")).count() == 1
