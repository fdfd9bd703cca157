"""The consensus of frames takes every pocket of every frame."""

from __future__ import annotations

import numpy as np

from cavitas.operators import ensemble
from cavitas.plans import registry

POCKET = "pdb_id string, frame int, pocket_id long, bio_score double, volume double, druggable boolean, center_x double, center_y double, center_z double"


def test_no_pocket_of_a_frame_is_dropped(spark):
    rows = [("P", f, k, 0.9 - 0.001 * k, 100.0, False, 20.0 * k, 0.0, 0.0) for f in (1, 2) for k in range(120)]
    found = ensemble.consensus(spark.createDataFrame(rows, POCKET)).collect()
    assert sorted(r["pocket_id"] for r in found) == list(range(120)) and all(r["support_frames"] == 2 for r in found)
    assert [r["rank"] for r in sorted(found, key=lambda r: r["pocket_id"])] == list(range(1, 121))
    assert "frame_rank <= " not in registry.ORACLES["frame_consensus"]


def test_clusters_by_cells_are_those_by_all_means():
    for seed, reach in ((1, 0.0), (2, 0.7), (3, 4.0), (4, 25.0)):
        points = np.random.default_rng(seed).integers(-20, 20, (400, 3)) * 0.5
        means, sizes, want = [], [], []
        for p in points:
            d = [np.sqrt(((m - p) ** 2).sum()) for m in means]
            at = int(np.argmin(d)) if d and min(d) <= reach else len(d)
            if at == len(d):
                means.append(np.zeros(3))
                sizes.append(0)
            means[at] = (means[at] * sizes[at] + p) / (sizes[at] + 1)
            sizes[at] += 1
            want.append(at)
        assert ensemble.leaders(points, reach).tolist() == want
