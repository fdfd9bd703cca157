"""Small groups share their calls, and neighbour searches and hulls make few rows of one."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cavitas.operators import geometry, spatial
from cavitas.operators.groups import map_keys


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_come_whole_and_in_order_whatever_the_batches(spark):
    sizes = {("a", 1): 1, ("a", 2): 9, ("b", 1): 3, ("c", 1): 20, ("d", 1): 1, ("d", 2): 4}
    rows = spark.createDataFrame([(*k, n) for k, size in sizes.items() for n in range(size)], "k string, j int, n int").repartition(5)

    def run(table: pa.Table, bounds: list[int]) -> pa.Table:
        found = [(table["k"][a].as_py(), table["j"][a].as_py(), table["n"][a:b].to_pylist()) for a, b in pairwise(bounds)]
        return pa.table({"k": [f[0] for f in found], "j": pa.array([f[1] for f in found], pa.int32()), "n": pa.array([f[2] for f in found], pa.list_(pa.int32())), "keys": pa.array([len(found)] * len(found), pa.int32())})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for size in (1, 3, 4, 1000):
            spark.conf.set(name, size)
            got = map_keys(rows, ("k", "j"), [F.col("n").desc()], run, "k string, j int, n array<int>, keys int").collect()
            assert sorted((r["k"], r["j"], r["n"]) for r in got) == sorted((*k, list(range(n))[::-1]) for k, n in sizes.items())
    finally:
        spark.conf.set(name, old)
    one = map_keys(rows.coalesce(1), ("k", "j"), ["n"], run, "k string, j int, n array<int>, keys int")
    assert max(r["keys"] for r in one.collect()) > 1
    assert map_keys(rows.where("false"), ("k", "j"), ["n"], run, "k string, j int, n array<int>, keys int").count() == 0


def test_neighbour_searches_repeat_a_row_eight_times_at_most(spark):
    xyz = np.random.default_rng(4).integers(-12, 12, (120, 3)) * 0.5
    rows = spark.createDataFrame([("A", k, *map(float, p)) for k, p in enumerate(xyz)], "pdb_id string, res_id int, x double, y double, z double")
    assert spatial.around(rows, 6.0, 3.0).groupBy("res_id").count().agg(F.max("count")).first()[0] <= 27
    assert spatial.around(rows.where("x % 6 <> 3 and y % 6 <> 3 and z % 6 <> 3 and x % 6 <> -3 and y % 6 <> -3 and z % 6 <> -3"), 6.0, 3.0).groupBy("res_id").count().agg(F.max("count")).first()[0] == 8
    d = np.sqrt(((xyz[:, None] - xyz) ** 2).sum(axis=2))
    for radius in (2.5, 3.0, 7.0):
        for strict, near in ((True, d < radius), (False, d <= radius)):
            got = {(r["a_res_id"], r["b_res_id"]) for r in spatial.pairs(rows, radius, "res_id", strict=strict).collect()}
            assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}


def test_hulls_are_summed_up_without_a_row_for_each_direction(spark):
    xyz = np.random.default_rng(5).normal(size=(90, 3))
    rows = spark.createDataFrame([("AB"[k % 2], k, *map(float, p)) for k, p in enumerate(xyz)], "pdb_id string, res_id int, x double, y double, z double")
    hull = geometry.support(rows, 16)
    assert "Generate" not in plan(hull)
    along = xyz @ np.asarray(geometry.directions(16)).T
    got = {r["pdb_id"]: r["h"] for r in hull.collect()}
    assert all(np.allclose(got["AB"[k]], along[k::2].max(axis=0)) for k in range(2))
    gaps = {r["res_id"]: r["to_surface"] for r in geometry.buried(rows, hull, 16).collect()}
    assert all(np.isclose(gaps[k], (along[k % 2 :: 2].max(axis=0) - along[k]).min()) for k in range(90))


def test_a_lattice_gives_the_voids_of_the_clearances_asked_for(spark):
    rows = spark.createDataFrame([("A", k, *map(float, p)) for k, p in enumerate(np.random.default_rng(6).normal(size=(40, 3)) * 9)], "pdb_id string, res_id int, x double, y double, z double")
    key = lambda found: sorted((r["x"], r["y"], r["z"], r["clearance"]) for r in found)
    whole = geometry.lattice_voids(rows).collect()
    some = geometry.lattice_voids(rows, within=(4.0, 9.0)).collect()
    assert 0 < len(some) < len(whole) and key(some) == key(r for r in whole if 4.0 <= r["clearance"] <= 9.0)
