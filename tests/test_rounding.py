"""Scores that lie on a rounding step but for their last bit round as in the SQL."""

from __future__ import annotations

import pytest

duckdb = pytest.importorskip("duckdb")
from cavitas.plans import registry  # noqa: E402

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"


@pytest.mark.parametrize("name", ["pocket_similarity_topk", "typed_view", "run_reports"])
def test_steps_of_rounding_are_those_of_the_sql(spark, tmp_path, name):
    """The first row's score is 0.54985, and the SQL puts the second before it; the third is 0.02825 from the second."""
    rows = [(1, 42, 1, 1, 1.0, 40290.96, 0.09, 0.04, "N"), (2, 42, 1, 1, 1.0, 40296.0, 0.09, 0.04, "N"), (3, 42, 2, 1, 1.0, 41663.3, 0.09, 0.04, "N"), (4, 7, 2, 1, 9.0, 5000.0, 0.02, 0.01, "R")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        want = db.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_a_pocket_without_parts_has_no_cosine(spark, tmp_path):
    """As in the reference; the SQL's cosine is NaN there, and it puts that pocket first."""
    rows = [(1, 42, 1, 1, 9.0, 40290.0, 0.09, 0.04, "N"), (2, 42, 2, 1, 8.0, 41663.3, 0.09, 0.04, "N"), (3, 100, 2, 1, 1.0, 1000.0, 0.0, 0.0, "A")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["pocket_similarity_topk"](spark, str(tmp_path)).collect()
    assert [(r["pdb_id"], r["pocket_id"]) for r in got] == [("P000002", 1), ("P000002", 2)]
    assert got[1]["cosine"] == 0.0 and got[1]["composite"] == 0.1533
