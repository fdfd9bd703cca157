"""Structures by frame, complete linkage, and consensus over all frames."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavitas.operators import ensemble, geometry


def all_pairs(xyz: np.ndarray, limit: float) -> np.ndarray:
    """Complete linkage on the whole matrix: the first of the least distances, row by row, each time."""
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    own = np.arange(len(xyz))
    while len(xyz) > 1:
        i, j = divmod(int(d.argmin()), len(xyz))
        if not d[i, j] <= limit:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = d[i, i] = np.inf
        own[own == j] = i
    return own


@pytest.mark.parametrize("limit", [0.5, 2.0, 3.5, 5.0, 40.0])
def test_linkage_equals_that_on_all_pairs(limit):
    rng = np.random.default_rng(5)
    sets = [rng.random((n, 3)) * 12 for n in (1, 2, 30, 150)]
    sets += [np.unique(rng.integers(0, 6, (n, 3)), axis=0) * 2.0 for n in (20, 120)]  # many equal distances
    sets += [np.repeat(rng.random((9, 3)), 3, axis=0) * 6]  # repeated points
    for xyz in sets:
        rng.shuffle(xyz)
        assert geometry.linkage(xyz, limit).tolist() == all_pairs(xyz, limit).tolist()


def test_fifty_thousand_voids_of_one_structure():
    rng = np.random.default_rng(6)
    xyz = rng.random((50_000, 3)) * 230
    began = time.time()
    own = geometry.linkage(xyz, 4.0)
    assert time.time() - began < 120  # the matrix of all pairs would take 20 GB
    for c in np.unique(own)[:300]:
        part = xyz[own == c]
        assert np.sqrt(((part[:, None] - part[None]) ** 2).sum(axis=2)).max() <= 4.0


def test_memory_of_linkage_grows_with_the_pairs_within_the_limit():
    rng = np.random.default_rng(6)
    peaks = []
    for n in (1000, 4000):
        xyz = rng.random((n, 3)) * (n / 1000) ** (1 / 3) * 60
        tracemalloc.start()
        geometry.linkage(xyz, 4.0)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 7 * peaks[0] < 4000 * 4000 * 8


POCKET = "pdb_id string, frame int, pocket_id long, bio_score double, volume double, druggable boolean, center_x double, center_y double, center_z double"


def test_consensus_divides_by_all_frames_analysed(spark):
    pockets = spark.createDataFrame([("P", f, 1, 0.6, 100.0, True, 1.0, 1.0, 1.0) for f in (1, 2)], POCKET)
    frames = spark.createDataFrame([("P", f) for f in range(1, 9)] + [("Q", 1)], "pdb_id string, frame int")
    near = ensemble.consensus(pockets, frames=frames).first()
    assert near["support_ratio"] == 0.25 and near["consensus_score"] == round(0.65 * 0.6 + 0.25 * 2 / 8 + 0.1, 4)
    assert ensemble.consensus(pockets).first()["support_ratio"] == 1.0
    invalid = pockets.unionByName(spark.createDataFrame([("P", 3, 1, 0.9, 50.0, False, float("nan"), 0.0, 0.0)], POCKET))
    assert ensemble.consensus(invalid).first()["support_ratio"] == 0.6667  # a frame whose pockets have no centre counts


def structure(name: str, n: int = 60, seed: int = 1):
    rng = np.random.default_rng(seed)
    flat = rng.normal(size=(n, 3))
    shell = flat / np.linalg.norm(flat, axis=1)[:, None] * 8
    names = ("LEU", "VAL", "SER", "ALA")
    return [(name, k + 1, names[k % 4], "C", *map(float, p)) for k, p in enumerate(shell)]


def test_frames_go_through_cavities_consensus_and_persistence_in_one_run(spark):
    rows = structure("A") + structure("B", seed=2)
    atoms = spark.createDataFrame(rows, "pdb_id string, res_id int, res_name string, element string, x double, y double, z double")
    modes = atoms.select("pdb_id", "res_id", F.lit(1).alias("mode"), F.lit(0.05).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    frames = ensemble.generated(atoms, modes, n=4, amplitudes=(2.0,)).drop("mode", "amplitude").join(atoms.select("pdb_id", "res_id", "res_name", "element"), ["pdb_id", "res_id"])
    bad = frames.withColumn("x", F.when((F.col("pdb_id") == "B") & (F.col("frame") == 3), float("nan")).otherwise(F.col("x")))
    few = bad.where("not (pdb_id = 'B' and frame = 2 and res_id > 10)")
    got = ensemble.run(few, mapper=lambda df: df.withColumn("meta_file", F.concat("pdb_id", F.lit("_"), "frame")), least=50, k=16)
    assert got.cavities.inputFiles()  # stored: counts, consensus and persistence read them
    frame = {(r["pdb_id"], r["frame"]): r for r in got.frames.collect()}
    assert {k: r["error"] for k, r in frame.items()} == {("A", f): None for f in range(4)} | {("B", 0): None, ("B", 1): None, ("B", 2): "too_few", ("B", 3): "bad_number"}
    assert all(r["meta_file"] == f"{k[0]}_{k[1]}" for k, r in frame.items())
    found = {}
    for r in got.cavities.collect():
        found.setdefault((r["pdb_id"], r["frame"]), []).append(r)
    assert set(found) == {k for k, r in frame.items() if r["error"] is None} and all(frame[k]["n_pockets"] == len(v) for k, v in found.items())
    assert all(frame[k]["n_pockets"] is None for k in (("B", 2), ("B", 3)))
    # each frame alone gives what it gives among others
    alone = geometry.cavities(few.where("pdb_id = 'A' and frame = 1").drop("frame"), k=16)
    key = lambda r: (round(r["center_x"], 6), round(r["volume"], 4), r["merged_vertices"], r["bio_score"], round(r["sphericity"], 6))
    assert sorted(map(key, alone.collect())) == sorted(map(key, found["A", 1]))
    clusters = got.consensus.collect()
    assert "A" in {r["pdb_id"] for r in clusters} <= {"A", "B"}
    for r in clusters:
        assert r["support_ratio"] == round(r["support_frames"] / (4 if r["pdb_id"] == "A" else 2), 4)
    assert {(r["pdb_id"], r["pocket_id"]) for r in got.persistence.collect()} == {(r["pdb_id"], r["cluster"]) for r in clusters}


def test_sphericity_of_cavities_follows_their_vertices(spark):
    rng = np.random.default_rng(9)
    clouds = {1: rng.normal(size=(40, 3)), 2: rng.normal(size=(40, 3)) * (9, 1, 1), 3: rng.normal(size=(3, 3))}
    rows = [("A", c, *map(float, p)) for c, xyz in clouds.items() for p in xyz]
    got = {r["cavity_id"]: r["sphericity"] for r in geometry.sphericity(spark.createDataFrame(rows, "pdb_id string, cavity_id int, x double, y double, z double")).collect()}
    for c, xyz in clouds.items():
        low = np.linalg.eigvalsh(np.cov(xyz.T))
        assert got[c] == pytest.approx(0.6 if len(xyz) < 4 else (low[0] + low[1]) / 2 / low[2], abs=1e-5)
    assert got[2] < 0.1 < got[1]
