import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from shelfspark.schemas import DIALOGUE
from shelfspark.sources import batches as B
from shelfspark.sources import files as A
from shelfspark.sources import store
from shelfspark.sources.json_array import read_json_array

NASTY = ["plain", "a } b { c", 'say "hi"', "back\\slash", "tab\t\n line", '\\"}{\\', "[1, 2] ]", "é漢 }", "", "}" * 9, '"', "\\", None]


def array_file(tmp_path, n, seed, **kw):
    r = random.Random(seed)
    rows = [{"role": r.choice(["user", "assistant"]), "content": r.choice(NASTY), "code_executed": r.choice(NASTY), "timestamp": f"t{i}"} for i in range(n)]
    p = tmp_path / f"log{seed}.json"
    p.write_text(json.dumps(rows, **kw), encoding="utf-8")
    return str(p), rows


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_array_in_byte_ranges_equals_the_records(spark, tmp_path, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for seed, kw in ((1, {}), (2, {"indent": 2, "ensure_ascii": False}), (3, {"separators": (",", ":")})):
            path, rows = array_file(tmp_path, 60, seed, **kw)
            if size == 64:
                assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
            got = sorted(read_json_array(spark, path, DIALOGUE).collect(), key=lambda r: r["position"])
            assert [r["position"] for r in got] == list(range(60))
            assert [{k: r[k] for k in rows[0]} for r in got] == rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ["", "[]", "[ ]\n", "{not json", '[{"role": "user"}', '[{"role": "us}]', '{"role": "user"}', "[{]}"])
def test_array_empty_or_broken(spark, tmp_path, text):
    p = tmp_path / "x.json"
    p.write_text(text)
    assert read_json_array(spark, str(p), DIALOGUE).count() == 0


def log_rows(spark, tag, n):
    return spark.createDataFrame([("user", f"{tag}{i}", None, "t", i) for i in range(n)], "role string, content string, code_executed string, timestamp string, position long")


def contents(spark, path):
    rows = sorted(A.read_dialogue(spark, path).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [r["content"] for r in rows]


def test_concurrent_appends_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: A.append_dialogue(log_rows(spark, f"w{k}-", 3), path), range(4)))
    got = contents(spark, path)
    assert sorted(got) == sorted(f"w{k}-{i}" for k in range(4) for i in range(3))
    assert all([c for c in got if c.startswith(f"w{k}-")] == [f"w{k}-{i}" for i in range(3)] for k in range(4))


def test_repeated_batch_is_ignored_also_after_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    for ident in ("1_a", "2_b", "1_a"):
        A.append_dialogue(log_rows(spark, ident, 2), path, batch_id=ident)
    want = ["1_a0", "1_a1", "2_b0", "2_b1"]
    assert contents(spark, path) == want
    assert A.compact_dialogue(spark, path) and not A.compact_dialogue(spark, path)
    A.append_dialogue(log_rows(spark, "x", 2), path, batch_id="2_b")
    assert contents(spark, path) == want
    A.append_dialogue(log_rows(spark, "late", 1), path, batch_id="1_z")  # began before, committed after
    assert contents(spark, path) == ["1_a0", "1_a1", "late0", "2_b0", "2_b1"]
    assert A.compact_dialogue(spark, path) and contents(spark, path) == ["1_a0", "1_a1", "late0", "2_b0", "2_b1"]
    with pytest.raises(ValueError):
        B.append_batch(log_rows(spark, "x", 1), path, "json", "a/b")


def test_array_log_is_kept_until_its_batch_is_committed(spark, tmp_path, monkeypatch):
    path, rows = array_file(tmp_path, 5, 9)
    want = [r["content"] for r in rows]
    with monkeypatch.context() as m:
        m.setattr(B._Folder, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            A.append_dialogue(log_rows(spark, "n", 2), path)
    assert contents(spark, path) == want  # the crash left staged files only
    A.append_dialogue(log_rows(spark, "n", 2), path)
    A.append_dialogue(log_rows(spark, "m", 1), path)
    assert contents(spark, path) == [*want, "n0", "n1", "m0"]
    assert json.loads((tmp_path / "log9.json").read_text(encoding="utf-8")) == rows


def test_append_plan_reads_nothing_of_the_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    A.append_dialogue(log_rows(spark, "a", 2), path)
    monkeypatch.setattr(A, "read_batches", None)
    monkeypatch.setattr(B, "read_batches", None)
    A.append_dialogue(log_rows(spark, "b", 2), path)
    monkeypatch.undo()
    assert len(contents(spark, path)) == 4


def test_concurrent_runs_and_compaction(spark, tmp_path):
    path = str(tmp_path / "runs")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: store.log_run(spark, path, "exp", f"m{k}", {"k": k}, {"f1": k / 8}, f"/m{k}"), range(4)))
    assert sorted(r["run_id"] for r in store.read_runs(spark, path).collect()) == sorted(ids)
    before = store.latest_run(store.read_runs(spark, path), "exp").first()
    assert store.compact_runs(spark, path)
    assert store.read_runs(spark, path).inputFiles() and all("/snapshot=" in f for f in store.read_runs(spark, path).inputFiles())
    assert store.latest_run(store.read_runs(spark, path), "exp").first() == before
    last = store.log_run(spark, path, "exp", "m9", {}, {}, "/m9")
    assert store.log_run(spark, path, "exp", "again", {}, {}, "/m", run_id=last) == last
    latest = store.latest_run(store.read_runs(spark, path), "exp").first()
    assert latest["run_id"] == last and latest["name"] == "m9" and store.read_runs(spark, path).count() == 5
    assert store.read_runs(spark, path).where(F.col("params")["k"] == "2").count() == 1
