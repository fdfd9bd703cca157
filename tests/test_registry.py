"""Every registered query with SQL gives the same rows as its SQL does on DuckDB."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
from cavitas.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


def plain(x):
    if x is None or x != x:
        return None
    return f"{round(float(x), 5) + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = registry.queries()[name](spark, DATA)
    want = tables.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted(tuple(plain(x) or "" for x in r) for r in found)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


class Few(registry.Carriers):
    """Three of the structures."""

    @property
    def atoms(self):
        return super().atoms.where("pdb_id in ('E1', 'E2', 'E3')")


def test_voids_of_the_production_lattice_merge(spark):
    few = Few(spark, DATA)
    atoms = {}
    for r in few.atoms.collect():
        atoms.setdefault(r["pdb_id"], []).append((r["x"], r["y"], r["z"]))
    want = set()
    for key, rows in atoms.items():
        xyz = np.asarray(rows)
        low, size = xyz.min(axis=0), np.floor(np.ptp(xyz, axis=0) / 2).astype(int) + 1
        at = np.stack(np.meshgrid(*map(np.arange, size), indexing="ij"), axis=-1)
        near = np.sqrt(((low + at * 2.0)[..., None, :] - xyz) ** 2 @ np.ones(3)).min(axis=-1)
        clear = np.pad(np.where(near <= 12, near, -1), 1, constant_values=-1)
        around = np.max([np.roll(clear, d, axis=a) for a in range(3) for d in (1, -1)], axis=0)[1:-1, 1:-1, 1:-1]
        want |= {(key, *np.round(low + p * 2.0, 3)) for p in at[(near <= 12) & (near >= around)]}
    got = registry.QUERIES["void_lattice"](few).collect()
    assert {(r["pdb_id"], *np.round((r["x"], r["y"], r["z"]), 3)) for r in got} == want and len(got) == len(want)
    assert max(r["merged_vertices"] for r in registry.QUERIES["cavity_pipeline"](few).collect()) > 1


def test_train_rf_trains_a_forest(spark, monkeypatch):
    fitted, own = [], registry.ml.train
    monkeypatch.setattr(registry.ml, "train", lambda *a, **k: fitted.append(own(*a, **k)) or fitted[-1])
    assert registry.QUERIES["train_rf"](registry.Carriers(spark, DATA)).count() == 1
    assert [type(m).__name__ for m in fitted] == ["RandomForestClassificationModel"] and fitted[0].getNumTrees == 50


def test_intervals_rest_on_the_operators_own_draws(spark, monkeypatch):
    made, own = [], registry.stats.draws
    monkeypatch.setattr(registry.stats, "draws", lambda spark, b, n, seed: made.append(b) or own(spark, b, n, seed))
    few = registry.Carriers(spark, DATA)
    for name in ("bootstrap_recall_ci", "fpr_interval"):
        assert registry.QUERIES[name](few).first()["n"] > 0
    assert made == [3000, 3000]
    assert registry.QUERIES["permutation_test"](few).first()["draws"] == 1000


def test_message_passing_reports_the_best_twenty(spark):
    """Each structure has 21 residues; all but the last of them are reported."""
    got = registry.QUERIES["message_passing"](Few(spark, DATA)).collect()
    assert sorted((r["pdb_id"], r["rank"]) for r in got) == [(f"E{k}", n) for k in (1, 2, 3) for n in range(1, 21)]
