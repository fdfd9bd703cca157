"""Geometry re-aimed as jobs over all structures: voids, hulls by support functions, cavities, network matrices."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import spatial
from cavitas.operators.groups import map_keys
from cavitas.operators.spatial import AXES
from cavitas.session import stored


def directions(k: int) -> list[tuple[float, float, float]]:
    """k unit vectors spread evenly by the golden angle."""
    i = np.arange(k) + 0.5
    z = 1 - 2 * i / k
    turn = np.pi * (1 + 5**0.5) * i
    flat = np.sqrt(1 - z * z)
    return list(zip((flat * np.cos(turn)).tolist(), (flat * np.sin(turn)).tolist(), z.tolist(), strict=True))


def _dots(k: int) -> list[Column]:
    return [F.col("x") * a + F.col("y") * b + F.col("z") * c for a, b, c in directions(k)]


def _gap(k: int) -> Column:
    """The least distance of a point from the extents h."""
    return F.least(*(F.col("h")[n] - d for n, d in enumerate(_dots(k)))) if k > 1 else F.col("h")[0] - _dots(1)[0]


def support(points: DataFrame, k: int = 64, key: tuple[str, ...] = ("pdb_id",)) -> DataFrame:
    """h: per structure the largest extent in each of k directions.

    The hull is described from outside, so depths are over-estimated for finite k.
    """
    return points.groupBy(*key).agg(F.array(*map(F.max, _dots(k))).alias("h"))


def buried(points: DataFrame, hull: DataFrame, k: int = 64, key: str = "pdb_id") -> DataFrame:
    """Each point with its distance to the hull; inside it is not negative."""
    rows = points.join(hull, key).withColumn("to_surface", _gap(k)).drop("h")
    return rows.withColumn("inside", F.col("to_surface") >= 0)


def hull_volume(points: DataFrame, step: float = 1.0, k: int = 64, key: tuple[str, ...] = ("pdb_id", "cavity_id")) -> DataFrame:
    """Number of lattice points inside the hull times the cell's volume."""
    box = points.groupBy(*key).agg(*(f(c).alias(f"{n}{c}") for c in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = box.join(support(points, k, key), list(key))  # one row per key; the lattice comes after, where it is counted
    for c in AXES:
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(f"hi{c}") - F.col(f"lo{c}")) / step) - 1, F.lit(0))))
        rows = rows.withColumn("_i", steps).withColumn(c, F.col(f"lo{c}") + (F.col("_i") + 0.5) * step).drop("_i")
    inside = rows.where(_gap(k) >= 0)
    return box.select(*key).join(inside.groupBy(*key).agg((F.count("*") * step**3).alias("hull_volume")), list(key), "left").fillna(0.0, ["hull_volume"])


def sphericity(points: DataFrame, key: tuple[str, ...] = ("pdb_id", "cavity_id")) -> DataFrame:
    """mean of the two smaller variances over the largest; 0.6 below four vertices or without spread.

    The eigenvalues of the 3x3 covariance come in closed form.
    """
    var = lambda a, b: F.covar_samp(a, b)
    m = points.groupBy(*key).agg(F.count("*").alias("n"), *(var(a, b).alias(f"c{a}{b}") for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))))
    c = F.col
    q = (c("cxx") + c("cyy") + c("czz")) / 3.0
    p2 = (c("cxx") - q) * (c("cxx") - q) + (c("cyy") - q) * (c("cyy") - q) + (c("czz") - q) * (c("czz") - q) + (c("cxy") * c("cxy") + c("cxz") * c("cxz") + c("cyz") * c("cyz")) * 2.0
    p = F.sqrt(p2 / 6.0)
    b = {k: (c(f"c{k}") - (q if k[0] == k[1] else F.lit(0.0))) / p for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    phi = F.acos(S.clamp(det / 2.0, -1.0, 1.0)) / 3.0
    e1 = q + p * 2.0 * F.cos(phi)
    e3 = q + p * 2.0 * F.cos(phi + 2 * np.pi / 3)
    e2 = q * 3.0 - e1 - e3
    value = F.when((c("n") < 4) | (p2 < 1e-24), 0.6).otherwise((F.greatest(e2, F.lit(0.0)) + F.greatest(e3, F.lit(0.0))) / (e1 * 2.0))
    return m.select(*key, F.round(value, 6).alias("sphericity"))


#: Lattice points along each side of the blocks in which clearances are computed.
BLOCK = 32


def lattice_voids(atoms: DataFrame, step: float = 2.0, reach: float = 12.0, block: int = BLOCK, within: tuple[float, float] = (0.0, np.inf)) -> DataFrame:
    """Lattice points of every structure's box with their clearance, those of locally largest clearance.

    Points beyond the reach of every atom are no voids, and voids whose clearance is not within the limits are not given. Each atom goes to the blocks of the lattice that it reaches; a block
    computes the clearances of its points and of those next to it, so that its own can be compared, and lattice points are never shuffled.
    """
    whole = W.partitionBy("pdb_id")
    rows = atoms.select("pdb_id", *AXES, *(F.min(c).over(whole).alias(f"lo{c}") for c in AXES), *(F.max(c).over(whole).alias(f"hi{c}") for c in AXES)).dropna(subset=AXES)
    for k, c in enumerate(AXES):
        at = lambda x, c=c: F.floor((x - F.col(f"lo{c}")) / step)
        rows = rows.withColumn(f"n{k}", at(F.col(f"hi{c}")).cast("int"))
        # one point more at both ends than the atom reaches, and the points next to a block
        first, last = F.floor((at(F.col(c) - reach) - 2) / block), F.floor((at(F.col(c) + reach) + 2) / block)
        rows = rows.withColumn(f"b{k}", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.floor(F.col(f"n{k}") / block)).cast("int"))))

    def voids(first: dict, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The voids of one block: places in the lattice, coordinates, clearances. first: the block, and its structure's box."""
        begin = [first[f"b{k}"] * block for k in range(3)]
        start = [max(b - 1, 0) for b in begin]
        stop = [min(b + block + 1, first[f"n{k}"] + 1) for k, b in enumerate(begin)]
        at = [first[f"lo{c}"] + np.arange(i, j) * step for c, i, j in zip(AXES, start, stop, strict=True)]
        low = [np.searchsorted(x, points[:, k] - (reach + step)).tolist() for k, x in enumerate(at)]
        high = [np.searchsorted(x, points[:, k] + (reach + step)).tolist() for k, x in enumerate(at)]
        apart = [np.square(x - points[:, k, None]) for k, x in enumerate(at)]
        best = np.full([len(x) for x in at], np.inf)
        for dx, dy, dz, i, j, u, v, m, n in zip(*apart, low[0], high[0], low[1], high[1], low[2], high[2], strict=True):
            part = best[i:j, u:v, m:n]
            np.minimum(part, (dx[i:j, None] + dy[u:v])[:, :, None] + dz[m:n], out=part)
        best = np.sqrt(best)
        clear = np.pad(np.where(best <= reach, best, -1.0), 1, constant_values=-1.0)
        # a point is kept unless one of its six neighbours has a larger clearance
        other = np.maximum(clear[2:, 1:-1, 1:-1], clear[:-2, 1:-1, 1:-1])
        for part in (clear[1:-1, 2:, 1:-1], clear[1:-1, :-2, 1:-1], clear[1:-1, 1:-1, 2:], clear[1:-1, 1:-1, :-2]):
            np.maximum(other, part, out=other)
        clear = clear[1:-1, 1:-1, 1:-1]
        kept = np.nonzero((clear >= within[0]) & (clear <= within[1]) & (clear >= other))
        index = [i + s for i, s in zip(kept, start, strict=True)]
        own = np.all([(i >= b) & (i < b + block) for i, b in zip(index, begin, strict=True)], axis=0)
        return [i[own] for i in index], [x[i[own]] for x, i in zip(at, kept, strict=True)], clear[kept][own]

    def run(rows: pa.Table, bounds: list[int]) -> pa.Table:
        points = np.stack([rows[c].to_numpy() for c in AXES], axis=1)
        firsts = rows.drop_columns([*AXES, "place"]).take(pa.array(bounds[:-1])).to_pylist()
        found = [voids(first, points[a:b]) for first, (a, b) in zip(firsts, pairwise(bounds), strict=True)]
        names = pa.array([first["pdb_id"] for first in firsts], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(f[2]) for f in found])))
        columns = {f"i{k}": pa.array(np.concatenate([f[0][k] for f in found]).astype(np.int32)) for k in range(3)}
        columns |= {c: pa.array(np.concatenate([f[1][k] for f in found])) for k, c in enumerate(AXES)}
        return pa.table({"pdb_id": names} | columns | {"clearance": pa.array(np.concatenate([f[2] for f in found]))})

    kept = map_keys(rows, ("pdb_id", "b0", "b1", "b2"), list(AXES), run, "pdb_id string, i0 int, i1 int, i2 int, x double, y double, z double, clearance double")
    ordinal = F.row_number().over(W.partitionBy("pdb_id").orderBy("i0", "i1", "i2"))
    return kept.select("pdb_id", ordinal.alias("ordinal"), *AXES, F.round("clearance", 4).alias("clearance"), F.round(S.sphere_volume("clearance"), 4).alias("volume"))


#: Points up to which all their distances are worked out at once.
FEW = 256


def _pairs_within(xyz: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of points no further apart than the limit, with their distance."""
    if len(xyz) <= FEW:
        d = np.sqrt(((xyz[:, None] - xyz) ** 2).sum(axis=2))
        near = np.nonzero(np.triu(d <= limit, 1))
        yield from zip(*(x.tolist() for x in near), d[near].tolist(), strict=True)
        return
    cells: dict[tuple[int, ...], list[int]] = {}
    places = [tuple(c) for c in np.floor(xyz / (limit * 1.000001)).astype(int).tolist()] if limit > 0 else [tuple(p) for p in xyz.tolist()]
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)] if limit > 0 else [(0, 0, 0)]
    for i, at in enumerate(places):  # points before i are in the cells already
        others = [j for a, b, c in steps for j in cells.get((at[0] + a, at[1] + b, at[2] + c), ())]
        if others:
            d = np.sqrt(((xyz[others] - xyz[i]) ** 2).sum(axis=1))
            yield from ((j, i, x) for j, x in zip(others, d.tolist(), strict=True) if x <= limit)
        cells.setdefault(at, []).append(i)


def linkage(xyz: np.ndarray, limit: float) -> np.ndarray:
    """The cluster of each point by complete linkage up to a limit, named by its first point.

    Always the two closest clusters join, of equal ones those of the smallest names. Only clusters of which every pair of points is within the limit
    can ever join, so each holds its distances to those alone: pairs come from cells of the limit's size, and a joined cluster keeps the
    neighbours that both parts had. Memory is that of the pairs within the limit.
    """
    n = len(xyz)
    own = np.arange(n)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in _pairs_within(xyz, limit):
        near[i][j] = near[j][i] = x
    heap = [(d, i, j) for i in range(n) for j, d in near[i].items() if i < j]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        d, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and near[i].get(j) == d):
            continue
        alive[j] = False
        own[own == j] = i
        both = near[i].keys() & near[j].keys()
        for k in near[j]:
            near[k].pop(j, None)
        for k in [k for k in near[i] if k not in both]:
            near[k].pop(i, None)
        near[i] = {k: max(near[i][k], near[j][k]) for k in both}
        near[j] = {}
        for k, x in near[i].items():
            near[k][i] = x
            heapq.heappush(heap, (x, *sorted((i, k))))
    return own


def merged(voids: DataFrame, threshold: float | str = 3.0) -> DataFrame:
    """Voids of one structure joined by complete linkage: cavity_id per void.

    threshold: a number, or the name of a column with each structure's own. A structure is one group, which holds its pairs of
    voids within the threshold.
    """

    def run(rows: pa.Table, bounds: list[int]) -> pa.Table:
        points = np.stack([rows[a].to_numpy() for a in AXES], axis=1).astype(float)
        limits = rows["_t"].to_pylist()
        # a cluster has its first point's name
        numbers = [np.unique(linkage(points[a:b], float(limits[a])), return_inverse=True)[1] + 1 for a, b in pairwise(bounds)]
        return rows.drop_columns(["_t", "place"]).append_column("cavity_id", pa.array(np.concatenate(numbers).astype(np.int32)))

    rows = voids.withColumn("_t", F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold)))
    schema = ", ".join(f"`{c}` {t}" for c, t in voids.dtypes) + ", cavity_id int"
    return map_keys(rows, ("pdb_id",), ["ordinal"], run, schema)


def unmerged(voids: DataFrame) -> DataFrame:
    """P10: every void as a cavity of its own."""
    own = voids.withColumnsRenamed({a: f"center_{a}" for a in AXES} | {"clearance": "radius_clear"})
    return own.withColumns({"cavity_id": F.col("ordinal"), "merged_vertices": F.lit(1), "radius_geom": F.lit(0.0)})


def network_blocks(atoms: DataFrame, cutoff: float = 15.0, gamma: float = 1.0) -> DataFrame:
    """Elastic-network matrix entries (pdb_id, i, j, a, b, value), 3x3 blocks of residues i and j."""
    near = spatial.pairs(atoms.select("pdb_id", "res_id", *AXES), cutoff, "res_id")
    diff = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in AXES}
    entries = F.array(*(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), (diff[c] * diff[e] / (F.col("dist") * F.col("dist")) * -gamma).alias("value")) for p, c in enumerate(AXES) for q, e in enumerate(AXES)))
    off = near.select("pdb_id", F.col("a_res_id").alias("i"), F.col("b_res_id").alias("j"), F.explode(entries).alias("e")).select("pdb_id", "i", "j", "e.*")
    diagonal = off.groupBy("pdb_id", "i", "a", "b").agg((-F.sum("value")).alias("value"))
    return off.unionByName(diagonal.select("pdb_id", "i", F.col("i").alias("j"), "a", "b", "value"))


def network_checks(blocks: DataFrame) -> DataFrame:
    """Per structure the largest asymmetry, row-sum error and number of entries."""
    other = blocks.select("pdb_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("other"))
    gap = blocks.join(other, ["pdb_id", "i", "j", "a", "b"], "left").groupBy("pdb_id").agg(F.round(F.max(F.abs(F.col("value") - F.coalesce("other", F.lit(0.0)))), 6).alias("asymmetry"), F.count("*").alias("entries"))
    rows = blocks.groupBy("pdb_id", "i", "a", "b").agg(F.sum("value").alias("s")).groupBy("pdb_id").agg(F.round(F.max(F.abs("s")), 6).alias("row_sum_error"))
    return gap.join(rows, "pdb_id")


def mode_checks(modes: DataFrame) -> DataFrame:
    """Modes whose eigenvalues are negative or do not ascend. modes: pdb_id, mode, eigenvalue."""
    before = F.lag("eigenvalue").over(W.partitionBy("pdb_id").orderBy("mode"))
    return modes.withColumn("ok", (F.col("eigenvalue") >= -1e-6) & F.coalesce(F.col("eigenvalue") >= before - 1e-9, F.lit(True)))


def cavities(atoms: DataFrame, step: float = 2.0, k: int = 64, min_volume: float = 60.0, merge: float = 3.0) -> DataFrame:
    """Voids, merged into cavities with their properties and sphericity (F07), scored and ranked, for all structures at once.

    atoms: pdb_id, res_id, res_name, element and coordinates. The merged voids and their
    properties, from which several properties follow each, are stored once.
    """
    from cavitas.operators import atlas

    sizes = atlas.thresholds(atoms.groupBy("pdb_id").agg(F.count("*").alias("n_atoms")), min_volume=min_volume)
    # clearances a little beyond those that `voids` lets pass, so that it decides
    found = lattice_voids(atoms, step, within=(2.4, (5001 * 0.75 / np.pi) ** (1 / 3))).join(sizes.select("pdb_id", "clearance_max", "volume_min", "n_atoms"), "pdb_id")
    found = buried(atlas.voids(found.where("volume >= volume_min")), support(atoms, k), k).where("inside")
    n = found.withColumn("n_voids", F.count("*").over(W.partitionBy("pdb_id")))
    own = stored(merged(atlas.thresholds(n, n_voids="n_voids", merge=merge), "merge_threshold"), "merged_voids")
    properties = stored(spatial.cavity_properties(own, atoms.withColumn("serial", F.col("res_id"))).where(F.col("volume") <= 5000), "cavity_properties")
    hood = spatial.neighbourhood(properties, atoms).drop("n_residues")
    rows = properties.join(hood, ["pdb_id", "cavity_id"]).join(sphericity(own), ["pdb_id", "cavity_id"])
    return atlas.ranked(atlas.scored(shape_scores(rows, own, atoms, k)), tie="cavity_id")


#: Parts a structure's name from its frame in a key.
FRAME = "\u0001"


def cavities_by_frame(atoms: DataFrame, least: int = 50, most: int = 100_000, **settings) -> tuple[DataFrame, DataFrame]:
    """The cavities of every frame of every structure, and pdb_id, frame and error of all frames.

    atoms: those of `cavities`, and frame. A frame is a structure of its own in every step; frames that P06 does not admit
    have the reason as their error and no cavities.
    """
    from cavitas.operators import atlas

    keyed = atoms.withColumn("pdb_id", F.concat("pdb_id", F.lit(FRAME), F.col("frame").cast("string")))
    kind = dict(atoms.dtypes)["frame"]
    apart = {"frame": F.substring_index("pdb_id", FRAME, -1).cast(kind), "pdb_id": F.substring_index("pdb_id", FRAME, 1)}
    tested = atlas.admitted(keyed, least, most).select("pdb_id", F.col("reason").alias("error"))
    good = stored(keyed.drop("frame").join(tested.where("error is null").select("pdb_id"), "pdb_id", "left_semi"), "admitted")
    found = cavities(good, **settings)
    return found.withColumns(apart), tested.withColumns(apart).select("pdb_id", "frame", "error")


def shape_scores(cavities: DataFrame, vertices: DataFrame, atoms: DataFrame, k: int = 64) -> DataFrame:
    """enclosure by the hull of a cavity's vertices, depth by its centre's place between the structure's centroid and its hull.

    A hull without a lattice point counts as none.
    """
    key = ["pdb_id", "cavity_id"]
    whole = atoms.groupBy("pdb_id").agg(*(F.avg(a).alias(f"mid_{a}") for a in AXES))
    mid = [f"mid_{a}" for a in AXES]
    reach = atoms.join(whole, "pdb_id").groupBy("pdb_id", *mid).agg(F.max(S.distance(AXES, mid)).alias("reach"))
    centers = cavities.select(*key, *(F.col(f"center_{a}").alias(a) for a in AXES))
    surface = buried(centers, support(atoms, k), k).select(*key, F.abs("to_surface").alias("to_surface"))
    large = vertices.join(cavities.where("merged_vertices >= 4").select(*key), key, "left_semi").select(*key, *AXES)
    hulls = hull_volume(large, k=k).select(*key, F.when(F.col("hull_volume") > 0, F.col("hull_volume")).alias("hull_volume"))
    rows = cavities.join(reach, "pdb_id").join(surface, key).join(hulls, key, "left")
    rows = rows.withColumn("enclosure_score", S.enclosure("merged_vertices", "radius_clear", "radius_geom", "volume", "hull_volume"))
    rows = rows.withColumn("depth_score", S.depth(S.distance([f"center_{a}" for a in AXES], mid), "reach", "to_surface"))
    return rows.drop(*mid, "reach", "to_surface", "hull_volume")
