"""What a step brings to the driver, to one task or to one row does not grow with the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cavitas.operators import atlas, ensemble, geometry, graph, ml, spatial, store
from cavitas.plans.carriers import Carriers
from cavitas.plans.registry import QUERIES
from cavitas.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n: int = 60):
    return spark.range(n).selectExpr("'A' as pdb_id", "cast(id as int) as res_id", "cast(id % 7 as double) * 3 as x", "cast(id % 5 as double) * 3 as y", "cast(id as double) as z")


def test_neighbour_searches_bring_no_rows_of_cells_to_the_driver(spark):
    rows = points(spark)
    centers = rows.select("pdb_id", "res_id", *(rows[a].alias(f"c{a}") for a in "xyz"))
    near = spatial.nearest_within(centers, spatial.renamed(rows, "a_"), 9.0, "pdb_id", ["res_id"], ["cx", "cy", "cz"], ["a_x", "a_y", "a_z"], ["a_res_id"], "a_res_id")
    for found in (graph.contacts(rows), near):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_small_scores_in_tool_files_keep_their_exponent(spark, tmp_path):
    (tmp_path / "one").write_text("Pocket 7 :\n\tScore : \t1.0E-4\n\tDruggability Score : 2.5e-05\n\tVolume : \t81.0125\n")
    info = {r["key"]: r["value"] for r in readers.tool_info(spark, str(tmp_path)).collect()}
    assert info == {"Score": 1e-4, "Druggability Score": 2.5e-5, "Volume": 81.0125}
    row = readers.tool_pockets(spark, str(tmp_path)).drop("file").first()
    assert row.asDict() == {"pocket_id": 7, "druggability_score": 2.5e-5, "volume": 81.0125, "score": 1e-4}


def test_void_lattices_do_not_depend_on_blocks_and_shuffle_atoms_alone(spark):
    rows = points(spark, 40)
    xyz = np.asarray([r[-3:] for r in rows.collect()])
    size = np.floor(np.ptp(xyz, axis=0) / 2).astype(int) + 1
    at = np.stack(np.meshgrid(*map(np.arange, size), indexing="ij"), axis=-1)
    near = np.sqrt((((xyz.min(axis=0) + at * 2.0)[..., None, :] - xyz) ** 2).sum(axis=-1)).min(axis=-1)
    clear = np.pad(np.where(near <= 5, near, -1), 1, constant_values=-1)
    around = np.max([np.roll(clear, d, axis=a) for a in range(3) for d in (1, -1)], axis=0)[1:-1, 1:-1, 1:-1]
    want = [tuple(xyz.min(axis=0) + p * 2.0) for p in at[(near <= 5) & (near >= around)]]
    for block in (3, 4, 32):
        found = geometry.lattice_voids(rows, 2.0, 5.0, block)
        assert [tuple(r[2:5]) for r in found.orderBy("ordinal").collect()] == want
        assert "Join" not in plan(found)


def test_consensus_is_worked_out_by_more_than_one_task(spark):
    rows = spark.range(400).selectExpr("concat('P', cast(id % 50 as string)) as pdb_id", "cast(id % 4 as int) as frame", "id as pocket_id", "cast(0.5 as double) as bio_score", "cast(id % 9 as double) as volume", "true as druggable", *(f"cast(id % {n} as double) as center_{a}" for n, a in ((5, "x"), (7, "y"), (3, "z"))))
    found = ensemble.consensus(rows.union(rows.limit(0)), min_support=1)
    tasks = found.groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 4


def test_a_calibration_runs_its_models_once_and_fits_points_of_scores(spark, monkeypatch):
    seen, own = [], ml.stored
    monkeypatch.setattr(ml, "stored", lambda df, name: seen.append(own(df, name)) or seen[-1])
    rows = spark.range(900).selectExpr("concat('P', cast(id % 30 as string)) as pdb_id", "cast(id % 10 as double) as a", "cast(id % 10 >= 5 as int) as y_true")
    model = ml.calibrated(rows, ("a",), "logistic")
    assert seen[0].agg(F.sum("weight")).first()[0] == 900 and seen[0].count() == seen[0].select("y_proba").distinct().count()
    assert list(model.predictions)[0] == 0.0 and list(model.predictions)[-1] == 1.0


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ml, "TASK_ROWS", 10)
    fitted = []
    monkeypatch.setattr(ml, "estimator", lambda kind, seed: type("E", (), {"fit": lambda self, df: fitted.append(df)})())
    ml.train(spark.range(100).coalesce(1).selectExpr("cast(id as double) as a", "cast(id % 2 as int) as y_true"), ("a",))
    assert fitted[0].rdd.getNumPartitions() >= 8


def test_lines_of_one_file_come_from_many_tasks_in_their_order(spark, tmp_path):
    (tmp_path / "one").write_text("".join(f"Pocket {k} :\r\n\tScore : \t{k}.5\r\n\tVolume : \t{k}\r\n" for k in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        ordered = [r["value"] for r in rows.orderBy("line_no").collect()]
        assert ordered[:3] == ["Pocket 0 :", "\tScore : \t0.5", "\tVolume : \t0"] and ordered[-1] == "\tVolume : \t499"
        found = {r["pocket_id"]: (r["score"], r["volume"]) for r in readers.tool_pockets(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {k: (k + 0.5, float(k)) for k in range(500)}


def test_a_first_commit_reads_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).selectExpr("concat('P', cast(id % 5 as string)) as pdb_id", "id as pocket_id", "1L as ingest_seq").mapInArrow(count, "pdb_id string, pocket_id long, ingest_seq long")
    made = store.Atlas(spark, str(tmp_path / "atlas"))
    made.commit({"pockets": rows})
    assert seen.value == 40 and made.read("pockets").count() == 40
    made.commit({"pockets": rows.withColumn("ingest_seq", F.lit(2).cast("long")).where("pdb_id = 'P3'")})
    assert sorted(r[0] for r in made.read("pockets").where("ingest_seq = 2").select("pdb_id").distinct().collect()) == ["P3"] and made.read("pockets").count() == 40


def test_structures_lie_in_as_many_files_as_tasks_and_read_as_single_files_do(spark, tmp_path, monkeypatch):
    vectors = spark.range(300).selectExpr("id as vec_id", "transform(sequence(1, 64), k -> cast((id * k % 17) / 20 as float)) as embedding", "cast(id % 10 as int) as label")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("structure_files", "pose_models"):
        monkeypatch.setattr(Carriers, "scratch", lambda self, _, name=name: str(tmp_path / name))
        assert QUERIES[name](Carriers(spark, str(tmp_path))).count() == 300
        assert len(list((tmp_path / name).rglob("*.txt"))) <= 16


def test_archives_of_structures_equal_single_files(spark, tmp_path):
    atom = "{:<6}{:5d}  CA  {:>3} A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    line = lambda k, record="ATOM": atom.format(record, k, "GLY", k, k / 2, 1.0, 2.0)
    texts = {
        "AB1": f"REMARK x\n{line(1)}\nMODEL 1\n{line(2)}\r\n{line(3, 'HETATM')}\nENDMDL\nMODEL 2\n{line(4)}\nENDMDL",
        "AB2": f"{line(5)}\n{line(6)}\nATOM  bad",
        "AB3": f"MODEL 1\nENDMDL\n\n  MODEL 2\n{line(7)}\nENDMDL\nMODEL 3\n{line(8)}\nMODEL\n{line(9)}",
    }
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    for name, text in texts.items():
        (tmp_path / "one" / f"{name}.pdb").write_bytes(text.encode())
    whole = "".join(f"{'HEADER':<62}{name.lower()}\n{text}{readers.END}" for name, text in texts.items())
    (tmp_path / "many" / "all.pdb").write_bytes(whole.encode())
    bag = lambda df: sorted((r["res_id"], r["record"], r["x"]) for r in df.collect())
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    for first in (True, False):
        assert bag(readers.archived_structures(spark, many, first)) == bag(readers.structures(spark, one, first))
    for k in range(4):
        assert bag(readers.archived_poses(spark, many, k)) == bag(readers.pose_atoms(spark, one, k))
    assert {r[0] for r in readers.archived(spark, many).select("pdb_id").collect()} == set(texts)


def test_tool_blocks_are_read_without_an_array_of_their_lines(spark):
    """Blocks with odd line ends, keys without colons, several colons, and no number."""
    blocks = {
        1: ("Pocket 1 :\n\tScore : \t1.5\n\tVolume : \t2\n", (1, 1.5, 2.0)),
        2: ("Pocket 2:\r\n Score:1e-4\r\n Volume : a:b: 7\r\nScore : 9\r\n", (2, 1e-4, 7.0)),
        3: ("head\nPocket  3 \nDruggability Score : 4\nScore\nScore : 1\nVolume : 1", None),
        4: ("Pocket x :\nScore : 1\nVolume : 1", None),
        5: ("Pocket 5 :\nVolume score : 3\nVolume : -1.25\r\nScore :2\r", (5, 2.0, -1.25)),
        6: ("Pocket 6\nScore : 1\nVolume :", None),
    }
    found = readers.tool_blocks(spark.createDataFrame([(k, text) for k, (text, _) in blocks.items()], "k int, value string"))
    assert {r["k"]: tuple(r)[1:] for r in found.collect()} == {k: want for k, (_, want) in blocks.items() if want}
    assert "lambda" not in plan(found)


def test_middle_rows_are_sorted_once_and_dealt_by_their_number(spark, monkeypatch):
    """One sort of a group's rows for place and size; more rows, more tasks, which Spark does not join again."""
    c = Carriers(spark, "/root/testdata/sf0.001")
    few = QUERIES["middle_pick"](c)
    assert plan(few).count("Window [") == 2 and plan(few).count("Sort [") == 2  # one of each numbers the pockets
    monkeypatch.setattr(atlas, "TASK_ROWS", 200, raising=False)
    many = QUERIES["middle_pick"](c)
    assert many.rdd.getNumPartitions() == -(-c.table("lineitem").count() // 200)
    assert sorted(many.collect()) == sorted(few.collect())


def test_clusters_search_for_neighbours_once(spark, monkeypatch):
    seen, own = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: seen.append(1) or own(*a, **k))
    found = graph.clusters(points(spark).withColumn("score", F.col("z")), 9.0)
    assert len(seen) == 1 and "_cell" not in plan(found) and "Generate" not in plan(found)
    assert found.agg(F.sum("n")).first()[0] > 0
