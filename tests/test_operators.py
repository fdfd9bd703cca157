"""Operators against hand-made rows and plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import atlas, ensemble, geometry, graph, matching, ml, spatial, stats, tables, validation


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_scalars(spark):
    row = spark.range(1)
    lit = F.lit
    assert [one(row, S.normalize_volume(lit(float(v)))) for v in (50, 80, 1290, 2500, 9999)] == [0, 0, 0.5, 1, 1]
    assert [one(row, S.normalize_volume(lit(v))) for v in (float("nan"), float("inf"), -5.0)] == [0, 0, 0]
    assert [one(row, S.box_size(lit(r))) for r in (8.5, 3.0, 20.0)] == [23, 20, 30]
    assert one(row, S.distance([lit(0), lit(0), lit(0)], [lit(3), lit(4), lit(0)])) == 5
    assert [one(row, S.interaction_type(lit(a), lit(b), lit(d))) for a, b, d in (("N", "O", 3.0), ("C", "C", 3.8), ("C", "N", 3.0))] == ["hbond", "hydrophobic", "vdw"]
    assert one(row, S.parse_center(lit("[1.5, -2, 3]"))) == [1.5, -2, 3]
    assert one(row, S.parse_center(lit("1,2"))) is None
    assert [one(row, S.label_policy(lit(s), lit(d))) for s, d in ((0.8, True), (0.8, False), (0.2, True), (0.5, True))] == [1, -1, 0, -1]
    same = F.array(*map(lit, (0.2, 0.4, 0.6)))
    assert one(row, S.similarity(same, same)) > 0.95
    assert one(row, S.novelty(lit(0.5), lit(0.5), lit(0.5), lit(4.0))) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        S.weights_of({"volume": 0.9})


def test_zero_centers_and_metadata(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, '{"a": "1"}'), (0.0, 0.0, 0.0, "junk"), (1.0, 0.0, 0.0, None)], "center_x double, center_y double, center_z double, metadata_json string")
    found = [r["metadata_json"] for r in atlas.flag_zero_centers(rows).collect()]
    assert '"center_valid":"false"' in found[0] and '"a":"1"' in found[0]
    assert "legacy_metadata_raw" in found[1] and found[2] is None


def test_grid_join_equals_loop(spark):
    rng = random.Random(3)
    points = [("A" if i % 2 else "B", i, *(rng.uniform(-20, 20) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(points, "pdb_id string, res_id int, x double, y double, z double")
    want = {(p[1], q[1]) for p in points for q in points if p[0] == q[0] and p[1] != q[1] and math.dist(p[2:], q[2:]) < 8}
    got = {(r["src"], r["dst"]) for r in graph.contacts(df).collect()}
    assert got == want


def test_greedy_and_maximum_matching(spark):
    rng = random.Random(5)
    pairs = [(f"p{g}", a, b, 1.0, 1.0, round(rng.uniform(0, 8), 3)) for g in range(8) for a in range(1, 7) for b in range(1, 7) if rng.random() < 0.4]
    df = spark.createDataFrame(pairs, "pdb_id string, a int, b int, va double, vb double, d double")
    got = {r["pdb_id"]: [(m["a"], m["b"]) for m in r["matches"]] for r in matching.greedy(df).collect()}
    most = {r["pdb_id"]: r["size"] for r in matching.most_matches(df).collect()}
    for g in {p[0] for p in pairs}:
        used, want = set(), []
        for a in range(1, 7):
            free = sorted((d, b) for p, x, b, _, _, d in pairs if p == g and x == a and b not in used)
            if free:
                used.add(free[0][1])
                want.append((a, free[0][1]))
        assert got[g] == want and most[g] >= len(want)


def test_consensus_and_persistence(spark):
    rows = [("P", f, k, 0.6 + 0.01 * f, 400.0, True, float(k * 20) + 0.1 * f, 0.0, 0.0) for f in range(1, 4) for k in (0, 1) if not (k == 1 and f == 3)]
    df = spark.createDataFrame(rows, "pdb_id string, frame int, pocket_id long, bio_score double, volume double, druggable boolean, center_x double, center_y double, center_z double")
    found = ensemble.consensus(df, min_support=3).collect()
    assert len(found) == 1 and found[0]["support_frames"] == 3 and found[0]["volume_cv"] == 0 and found[0]["center_stability"] < 0.5
    hits = spark.createDataFrame([("P", 1, f) for f in (1, 2, 4)], "pdb_id string, pocket_id int, frame int")
    frames = spark.createDataFrame([("P", f) for f in range(1, 6)], "pdb_id string, frame int")
    r = ensemble.persistence(hits, frames).first()
    assert (r["hit_count"], r["first"], r["last"], r["span"], r["longest"], r["flicker"]) == (3, 0, 3, 4, 2, 1)
    assert r["persistence_score"] == pytest.approx(0.5 * 3 / 5 + 0.3 * 2 / 5 + 0.2 * (1 - 1 / 3), abs=1e-4)


def test_round_robin_equals_loop(spark):
    import hashlib

    cases = [(f"{k:04d}", "abc"[k % 7 % 3]) for k in range(30)]
    got = [r["pdb_id"] for r in validation.round_robin(spark.createDataFrame(cases, "pdb_id string, pocket_type string"), 9, "s").collect()]
    by_type = {}
    for i, t in cases:
        by_type.setdefault(t, []).append(i)
    queues = {t: sorted(ids, key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest()) for t, ids in by_type.items()}
    want, turn = [], 0
    while len(want) < 9:
        for t in sorted(queues, key=lambda t: (len(by_type[t]), t)):
            if turn < len(queues[t]) and len(want) < 9:
                want.append(queues[t][turn])
        turn += 1
    assert got == want


def test_split_leaves_no_leak(spark):
    rows = spark.createDataFrame([(f"{k % 40:04d}", k) for k in range(200)], "pdb_id string, pocket_id int")
    parts = validation.split(rows)
    assert validation.leaks(parts).count() == 0
    sizes = {r["split"]: r["n"] for r in parts.select("pdb_id", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 28, "val": 6, "test": 6}


def test_upsert_cascade_dataset(spark, tmp_path):
    old = spark.createDataFrame([("A", 1, 0.5, 1, "t1"), ("B", 1, 0.6, 1, "t1")], "pdb_id string, pocket_id int, bio_score double, ingest_seq long, created_at string")
    new = spark.createDataFrame([("A", 1, 0.9, 2, "t2"), ("C", 1, 0.1, 2, "t2")], old.schema)
    got = {r["pdb_id"]: (r["bio_score"], r["created_at"]) for r in tables.upserted(old, new, tables.KEYS["pockets"]).collect()}
    assert got == {"A": (0.9, "t1"), "B": (0.6, "t1"), "C": (0.1, "t2")}
    store = tables.Dataset(spark, str(tmp_path / "pockets"))
    assert store.read() is None
    store.upsert(old, tables.KEYS["pockets"])
    store.upsert(new, tables.KEYS["pockets"])
    assert store.versions() == [1, 2] and store.read().count() == 3
    left, counts = tables.cascade({"pockets": store.read()}, spark.createDataFrame([("A",)], "pdb_id string"), ["pdb_id"])
    assert counts.first()["deleted"] == 1 and left["pockets"].count() == 2


def test_statistics(spark):
    pairs = spark.createDataFrame([("only_a",)] * 5 + [("both",)] * 3, "outcome string")
    r = stats.mcnemar(pairs).first()
    assert (r["n10"], r["n01"], r["p_exact"]) == (5, 0, 0.0625)
    many = spark.createDataFrame([("only_a",)] * 700 + [("only_b",)] * 650, "outcome string")
    assert 0.1 < stats.mcnemar(many).first()["p_exact"] < 0.3
    assert stats.t_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-5)
    values = spark.createDataFrame([(float(k % 2), k) for k in range(40)], "m double, k int")
    r = stats.bootstrap(values, "k", lambda: F.avg("m"), b=500).first()
    assert r["estimate"] == 0.5 and 0.2 < r["low"] < 0.5 < r["high"] < 0.8


def test_complete_linkage(spark):
    rows = spark.createDataFrame([("P", k, float(x), 0.0, 0.0) for k, x in enumerate((0, 2, 20, 21.5, 40))], "pdb_id string, ordinal int, x double, y double, z double")
    got = [r["cavity_id"] for r in geometry.merged(rows).orderBy("ordinal").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 2), (1, 0.8, 3), (0, 0.1, 4)], "y_true int, y_proba double, doc_id int")
    r = ml.ranking(rows).first()
    assert r["roc_auc"] == pytest.approx(0.875) and r["average_precision"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert ml.ranking(rows.where("y_true = 1")).first()["roc_auc"] is None


def test_neighbourhood_without_residues(spark):
    cavity = spark.createDataFrame([("P", 1, 0.0, 0.0, 0.0)], "pdb_id string, cavity_id int, center_x double, center_y double, center_z double")
    residues = spark.createDataFrame([("P", 1, "LEU", 50.0, 0.0, 0.0)], "pdb_id string, res_id int, res_name string, x double, y double, z double")
    r = spatial.neighbourhood(cavity, residues).first()
    assert (r["hydrophobic_ratio"], r["polar_atoms"], r["druggable"]) == (0, 0, False)


def test_shape_scores_of_hand_computed_cavities(spark):
    """A cube of atoms around the origin: one cavity at its centre, one near a face, one of the eight corners of a small cube."""
    from cavitas.operators import geometry

    atoms = spark.createDataFrame([("A", x * 10.0, y * 10.0, z * 10.0) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], "pdb_id string, x double, y double, z double")
    small = [("A", 3, 4.0 * x, 4.0 * y, 4.0 * z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    vertices = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0), ("A", 2, 8.0, 0.0, 0.0), *small], "pdb_id string, cavity_id int, x double, y double, z double")
    rows = [("A", 1, 0.0, 0.0, 0.0, 1, 3.0, 0.0, 113.0), ("A", 2, 8.0, 0.0, 0.0, 2, 2.0, 4.0, 67.0), ("A", 3, 2.0, 2.0, 2.0, 8, 1.0, 3.5, 32.0)]
    cavities = spark.createDataFrame(rows, "pdb_id string, cavity_id int, center_x double, center_y double, center_z double, merged_vertices int, radius_clear double, radius_geom double, volume double")
    got = {r["cavity_id"]: r for r in geometry.shape_scores(cavities, vertices, atoms).collect()}
    assert [got[k]["enclosure_score"] for k in (1, 2)] == [0.5, 0.5] and got[3]["enclosure_score"] == 32 / 64
    raw = 1 - 8 / 300**0.5  # the true distance to the face is 2; few directions can only give more
    assert got[1]["depth_score"] == 1 and raw * 2 / 5 - 1e-9 <= got[2]["depth_score"] < raw
    assert abs(got[3]["depth_score"] - (1 - 12**0.5 / 300**0.5)) < 0.01


def test_chains_of_residues_are_one_cluster(spark):
    """Longer than any fixed number of rounds of one step each would reach."""
    from cavitas.operators import graph

    rows = [("A", k, 5.0 * k, 0.0, 0.0, 1.0) for k in range(1, 301)] + [("A", 500 + k, 5.0 * k, 90.0, 0.0, 1.0) for k in range(1, 6)] + [("B", 1, 0.0, 0.0, 0.0, 1.0)]
    got = graph.clusters(spark.createDataFrame(rows, "pdb_id string, res_id int, x double, y double, z double, score double")).collect()
    assert sorted((r["pdb_id"], r["label"], r["n"]) for r in got) == [("A", 2, 300), ("A", 502, 5)]


def test_exports_have_their_columns(spark, tmp_path):
    from cavitas.operators import tables

    row = ("P1", 1, 1, 0.9, 500.0, True, "high", 0.4, 0.5, 0.6, "default", 1.0, 2.0, 3.0)
    names = "pdb_id string, pocket_id long, rank int, bio_score double, volume double, druggable boolean, druggability_class string, hydrophobic_ratio double, enclosure_score double, depth_score double, profile_used string, center_x double, center_y double, center_z double"
    pockets = spark.createDataFrame([row, ("P2", *row[1:3], 0.1, *row[4:])], names)
    assert tables.elite_csv(pockets, str(tmp_path / "elite")) == 1
    tables.search_csv(pockets, str(tmp_path / "search"))
    head = lambda name: next((tmp_path / name).glob("*.csv")).read_text().splitlines()[0]
    assert head("elite") == "pdb_id,pocket_id,rank,bio_score,volume,druggability_class,hydrophobic_ratio,enclosure_score,depth_score"
    assert head("search") == "pdb_id,pocket_id,rank,bio_score,volume,druggability_class,druggable,hydrophobic_ratio,enclosure_score,depth_score,profile_used"


def test_nearest_rank_and_crawl_summary(spark):
    from cavitas.operators import matching, validation

    rows = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate((5, 5, 1, 2, 9, 9, 9, 3, 4, 7))] + [(0, None)], "k int, v double")
    v = sorted((5, 5, 1, 2, 9, 9, 9, 3, 4, 7))
    assert matching.nearest_rank(rows, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()[:] == tuple(float(v[round(9 * p)]) for p in (0.1, 0.5, 0.9))
    by = {r["k"]: r["b"] for r in matching.nearest_rank(rows, "v", {"b": 0.5}, "k").collect()}
    assert by == {0: 5.0, 1: 5.0} and matching.nearest_rank(rows.where("false"), "v", {"b": 0.5}).count() == 0
    log = spark.createDataFrame([(f"P{k:03}", "error" if k % 3 else "success", 1.0) for k in range(90)], "pdb_id string, status string, runtime double")
    got = validation.crawl_summary(log).first()
    assert got["total"] == 90 and got["error"] == 60 and got["first_failures"] == [f"P{k:03}" for k in range(90) if k % 3][:50]
