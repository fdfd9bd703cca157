"""Readers, sinks and streams over files written by the tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cavitas.operators import tables
from cavitas.sources import readers
from cavitas.streaming import jobs

PDB = """MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00           C
HETATM    3  C1  LIG     2       1.000   2.000   3.000  1.00  0.00           C
HETATM    4  O   HOH A   3       bad     2.000   3.000  1.00  0.00           O
ENDMDL
MODEL        2
ATOM      1  CA  GLY A   1       0.000   0.000   0.000  1.00  0.00           C
ENDMDL
"""


def test_structure_scan(spark, tmp_path):
    (tmp_path / "1abc.pdb").write_text(PDB)
    atoms = readers.structures(spark, str(tmp_path))
    rows = atoms.orderBy("serial").collect()
    assert [r["serial"] for r in rows] == [1, 2, 3] and rows[0]["pdb_id"] == "1ABC" and rows[2]["chain_id"] == "A"
    assert readers.select_atoms(atoms, "ca").count() == 1 and readers.select_atoms(atoms, "ligand").count() == 1
    assert readers.pose_atoms(spark, str(tmp_path), 1).first()["res_name"] == "GLY"
    assert readers.pose_atoms(spark, str(tmp_path), 9).count() == 3


def test_tool_text(spark, tmp_path):
    (tmp_path / "info.txt").write_text("Pocket 1 :\n\tScore :\t0.61\n\tVolume :\t512.5\n\nPocket 2 :\n\tScore :\t0.2\n\tVolume :\t99\n")
    rows = {(r["pocket_id"], r["key"]): r["value"] for r in readers.tool_info(spark, str(tmp_path)).collect()}
    assert rows[(1, "Volume")] == 512.5 and rows[(2, "Score")] == 0.2
    blocks = readers.tool_blocks(spark.read.text(str(tmp_path), wholetext=True)).collect()
    assert [(b["pocket_id"], b["volume"]) for b in blocks] == [(1, 512.5), (2, 99.0)]
    lines = spark.createDataFrame([("   1       -7.2      0.000      0.000",), ("-----+----",)], "value string")
    assert readers.pose_table(lines).first()["affinity"] == -7.2


def test_reports_stream_and_upsert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    report = lambda s: json.dumps({"pdb_id": " 1abc ", "n_frames": 2, "cavities": [{"id": 5, "bio_score": s, "volume": 100.0, "center": [1, 2, 3]}, {"bio_score": 0.1}]})
    (source / "a.json").write_text(report(0.5))
    store = tables.Dataset(spark, str(tmp_path / "pockets"))
    jobs.ingest_reports(spark, str(source), store, str(tmp_path / "check"))
    (source / "b.json").write_text(report(0.9))
    jobs.ingest_reports(spark, str(source), store, str(tmp_path / "check"))
    got = {r["pocket_id"]: r["bio_score"] for r in store.read().collect()}
    assert got == {5: 0.9, 1: 0.1}
    versions = store.versions()
    jobs.ingest_reports(spark, str(source), store, str(tmp_path / "check"))
    assert store.versions() == versions  # nothing new, nothing written


def test_streaming_counts_and_feed(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00", "queued", 1.0), (2, 7, "2024-01-01 00:01:00", "queued", 2.0), (3, 7, "2024-01-01 00:02:00", "failed", 3.0)], "job_id long, client long, ts string, status string, latency double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "jobs"))
    counts = jobs.run_available(jobs.status_counts(stream), "status_counts", "complete", str(tmp_path / "c1"))
    assert {r["status"]: r["n"] for r in counts.collect()} == {"queued": 2, "failed": 1}
    feed = jobs.run_available(jobs.status_feed(stream), "status_feed", "append", str(tmp_path / "c2"))
    assert [(r["before"], r["status"]) for r in feed.collect()] == [(None, "queued"), ("queued", "failed")]
    limited = {r["job_id"]: r["allowed"] for r in jobs.rate_limited(rows, 1, 90.0).collect()}
    assert limited == {1: True, 2: False, 3: True}


def test_crawl_log_and_manifest(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"pdb_id": "1ABC", "status": "success"}\nnot json\n')
    log = readers.crawl_log(spark, str(tmp_path / "log.jsonl"))
    log.cache()
    assert readers.log_quality(log).first()["parse_errors"] == 1
    now = tables.file_manifest(spark, str(tmp_path))
    assert {r["check"]: r["pass"] for r in tables.verified(now, now).collect()} == {"none_missing": True, "hashes_equal": True}
