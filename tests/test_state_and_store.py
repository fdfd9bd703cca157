"""Stateful streams against their batch forms, and the bucketed atlas."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cavitas.operators import store, tables
from cavitas.streaming import jobs, state


def feed(spark, rows, schema, folder, columns):
    """A stream over files of rows that are added to a folder in the order of their names."""
    folder.mkdir(exist_ok=True)

    def add(n: int, some) -> None:
        spark.createDataFrame(some, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000)).coalesce(1).write.parquet(str(folder / f"b{n:03d}"))
        for f in (folder / f"b{n:03d}").glob("*.parquet"):
            f.rename(folder / f"b{n:03d}.parquet")

    kinds = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000)).schema
    return add, spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def bag(df) -> list:
    return sorted(map(repr, map(tuple, df.collect())))


REQUESTS = [(k, k % 3, float(t)) for k, t in enumerate([0, 1, 1, 2, 2, 3, 10, 10, 11, 12, 40, 41, 41, 61, 62, 63, 64, 70, 70, 70, 119, 121, 122, 123, 200, 201, 202, 203, 3000, 3001, 3002, 3003, 3003, 3004])]


def test_the_limiter_on_a_stream_equals_the_batch_form_also_after_a_restart(spark, tmp_path):
    schema = "job_id long, client long, ts double"
    add, stream = feed(spark, REQUESTS, schema, tmp_path / "in", None)
    run = lambda: state.each_step(stream, lambda s: state.limited(s, 2, 60.0, "1 minute"), "limiter", str(tmp_path / "check"), str(tmp_path / "out"))
    for n in range(3):
        add(n, REQUESTS[n * 6 : n * 6 + 6])
    run()
    for n in range(3, 6):
        add(n, REQUESTS[n * 6 : n * 6 + 6])
    found = run()  # a new query that goes on from the checkpoint
    every = spark.createDataFrame(REQUESTS, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000))
    want = jobs.rate_limited(every, 2, 60.0)
    assert bag(found) == bag(want) and {r["allowed"] for r in want.collect()} == {True, False}


def test_the_window_holds_as_many_times_as_the_limit():
    window = state.Window(2, 10.0)
    assert [window.allow(t) for t in (0.0, 1.0, 9.0, 10.0, 10.5, 11.0)] == [(True, 0.0), (True, 0.0), (False, 1.0), (True, 0.0), (False, 0.5), (True, 0.0)]
    assert len(window.accepted) == 2


SUBMISSIONS = [(1, "a", "scan", "p", 0.0), (2, "a", "scan", "p", 10.0), (3, "a", "scan", "q", 20.0), (4, "b", "scan", "p", 25.0), (5, "a", "dock", "p", 30.0), (6, "b", "scan", "p", 99.0), (7, "a", "scan", "q", 100.0), (8, "a", "scan", "p", 101.0), (9, "a", "scan", "q", 150.0), (10, "c", "scan", None, 151.0), (11, "c", "scan", None, 152.0), (12, "a", "scan", "z", 900.0), (13, "b", "scan", "z", 900.0)]
OUTCOMES = {1: ("new", 1), 2: ("reused", 1), 3: ("conflict", 1), 4: ("new", 4), 5: ("conflict", 1), 6: ("reused", 4), 7: ("new", 7), 8: ("conflict", 7), 9: ("reused", 7), 10: ("new", 10), 11: ("reused", 10), 12: ("new", 12), 13: ("new", 13)}


def test_submissions_are_new_reused_or_in_conflict_until_they_expire(spark, tmp_path):
    schema = "job_id long, key string, job_type string, payload string, ts double"
    every = spark.createDataFrame(SUBMISSIONS, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000))
    batch = state.outcomes(every, 100.0)
    assert {r["job_id"]: (r["outcome"], r["held_by"]) for r in batch.collect()} == OUTCOMES
    add, stream = feed(spark, SUBMISSIONS, schema, tmp_path / "in", None)
    run = lambda: state.each_step(stream, lambda s: state.submitted(s, 100.0, "30 seconds"), "submissions", str(tmp_path / "check"), str(tmp_path / "out"))
    add(0, SUBMISSIONS[:5])
    add(1, SUBMISSIONS[5:7])
    run()
    add(2, SUBMISSIONS[7:11])
    add(3, SUBMISSIONS[11:])
    assert bag(run()) == bag(batch)


STEPS = [(1, 0.0, "queued"), (2, 1.0, "queued"), (1, 2.0, "queued"), (1, 3.0, "running"), (2, 4.0, "failed"), (1, 5.0, "running"), (3, 6.0, "paused"), (1, 7.0, "succeeded"), (2, 8.0, "running"), (1, 9.0, "queued"), (3, 10.0, "running")]


def test_progress_on_a_stream_equals_the_batch_form(spark, tmp_path):
    schema = "job_id long, ts double, status string"
    every = spark.createDataFrame(STEPS, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000))
    batch = state.progress(every)
    assert {(r["job_id"], r["before"], r["status"], r["progress_pct"]) for r in batch.collect()} == {(1, None, "queued", 0), (1, "queued", "running", 50), (1, "running", "succeeded", 100), (2, None, "queued", 0), (2, "queued", "failed", 100), (3, None, "paused", None), (3, "paused", "running", 50)}
    add, stream = feed(spark, STEPS, schema, tmp_path / "in", None)
    run = lambda: state.each_step(stream, state.progress_feed, "progress", str(tmp_path / "check"), str(tmp_path / "out"))
    add(0, STEPS[:4])
    add(1, STEPS[4:6])
    run()
    add(2, STEPS[6:])
    assert bag(run()) == bag(batch)


def files(root: Path) -> dict[str, float]:
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in (root / "data").rglob("*.parquet")}


def rows_of(spark, ids, score, seq):
    return spark.createDataFrame([(i, k, score) for i in ids for k in (1, 2)], "pdb_id string, pocket_id long, bio_score double").withColumn("ingest_seq", F.lit(seq).cast("long"))


def test_commits_rewrite_the_buckets_they_touch_and_show_all_tables_at_once(spark, tmp_path, monkeypatch):
    atlas = store.Atlas(spark, str(tmp_path / "atlas"), buckets=16, slices=2)
    assert atlas.read("pockets") is None and atlas.lookup("pockets", "P1") is None
    ids = [f"P{k}" for k in range(40)]
    proteins = lambda some, top: spark.createDataFrame([(i, top) for i in some], "pdb_id string, top double").withColumns({"ingest_seq": F.lit(1).cast("long"), "created_at": F.current_timestamp()})
    atlas.commit({"proteins": proteins(ids, 0.5), "pockets": rows_of(spark, ids, 0.5, 1)}, batch=0)
    before, born = files(tmp_path / "atlas"), {r["pdb_id"]: r["created_at"] for r in atlas.read("proteins").collect()}
    time.sleep(0.01)
    atlas.commit({"proteins": proteins(["P7"], 0.9), "pockets": rows_of(spark, ["P7"], 0.9, 2)}, batch=1)
    after = files(tmp_path / "atlas")
    assert before.items() <= after.items()  # no file was touched, new ones came
    moved = {b for t in ("proteins", "pockets") for b, f in atlas.manifest()["tables"][t]["buckets"].items() if f != atlas.manifest(1)["tables"][t]["buckets"][b]}
    assert len(moved) == 1
    now = {(r["pdb_id"], r["pocket_id"]): r["bio_score"] for r in atlas.read("pockets").collect()}
    assert len(now) == 80 and {k for k, v in now.items() if v == 0.9} == {("P7", 1), ("P7", 2)}
    assert atlas.read("pockets", 1).where("bio_score = 0.9").isEmpty()  # a reader of the version before sees that
    assert {r["pdb_id"]: r["created_at"] for r in atlas.read("proteins").collect()} == born
    assert atlas.commit({"pockets": rows_of(spark, ["P8"], 0.1, 9)}, batch=1) == 2 and atlas.versions() == [1, 2]  # a repeated batch
    # proteins fail to be written: pockets of the same commit do not appear
    bad = proteins(["P9"], 0.1).withColumn("top", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        atlas.commit({"pockets": rows_of(spark, ["P9"], 0.1, 3), "proteins": bad}, batch=2)
    assert atlas.versions() == [1, 2] and atlas.read("pockets").where("bio_score = 0.1").isEmpty()
    other = store.Atlas(spark, str(tmp_path / "atlas"))
    monkeypatch.setattr(other, "manifest", lambda version=None, old=atlas.manifest(1): old)
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit({"pockets": rows_of(spark, ["P9"], 0.2, 3)})
    assert atlas.buckets == other.buckets == 16


def test_lookups_read_their_buckets_and_push_the_id_down(spark, tmp_path):
    atlas = store.Atlas(spark, str(tmp_path / "atlas"), buckets=16)
    atlas.commit({"pockets": rows_of(spark, [f"P{k}" for k in range(200)], 0.5, 1)})
    found = atlas.lookup("pockets", " p17 ")
    assert sorted((r["pdb_id"], r["pocket_id"]) for r in found.collect()) == [("P17", 1), ("P17", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pdb_id), EqualTo(pdb_id,P17)]" in plan and "Exchange" not in plan and "Window" not in plan
    assert len(found.inputFiles()) * 8 <= len(atlas.read("pockets").inputFiles())
    assert atlas.lookup("pockets").isEmpty() and atlas.lookup("pockets", "NONE").isEmpty()
    assert atlas.lookup("pockets", "P1", "P2").count() == 4


def report(pdb_id: str, score: float, seconds: float = 1.0, **extra) -> str:
    return json.dumps({"pdb_id": pdb_id, "n_frames": 2, "runtime_seconds": seconds, "cavities": [{"id": 5, "bio_score": score, "volume": 100.0, "center": [1, 2, 3]}], **extra})


def test_the_last_report_wins_inside_a_batch_and_proteins_come_along(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, (name, pdb_id, score) in enumerate([("a", "1abc", 0.9), ("z", "1abc", 0.4), ("b", "1abc", 0.2), ("c", "2xyz", 0.3), ("d", "2xyz", 0.3)]):
        (source / f"{name}.json").write_text(report(pdb_id, score if name != "d" else 0.35))
        at = 1_700_000_000 + (n if name not in "cd" else 50)  # c and d have the same time: the greater name is the later
        os.utime(source / f"{name}.json", (at, at))
    atlas = store.Atlas(spark, str(tmp_path / "atlas"), buckets=8)
    ingest = lambda: jobs.ingest_reports(spark, str(source), atlas, str(tmp_path / "check"))
    ingest()
    scores = lambda: {(r["pdb_id"], r["pocket_id"]): r["bio_score"] for r in atlas.read("pockets").collect()}
    assert scores() == {("1ABC", 5): 0.2, ("2XYZ", 5): 0.35}
    assert {r["pdb_id"]: r["top_bio_score"] for r in atlas.read("proteins").collect()} == {"1ABC": 0.2, "2XYZ": 0.35}
    (source / "e.json").write_text("\n".join([report("1abc", 0.1), report("1abc", 0.15), report("3new", 0.5, 2.5)]))
    ingest()
    ingest()
    assert scores() == {("1ABC", 5): 0.15, ("2XYZ", 5): 0.35, ("3NEW", 5): 0.5} and atlas.versions() == [1, 2]
    cases = spark.createDataFrame([("1abc",), ("3NEW",), ("4gon",)], "pdb_id string")
    assert tuple(jobs.crawl_progress(cases, atlas).first()) == (3, 2, 1, 8, 9.5)
    plain = tables.Dataset(spark, str(tmp_path / "plain"))
    jobs.ingest_reports(spark, str(source), plain, str(tmp_path / "check2"))
    assert {r["pdb_id"]: r["bio_score"] for r in plain.read().collect()} == {"1ABC": 0.15, "2XYZ": 0.35, "3NEW": 0.5}
