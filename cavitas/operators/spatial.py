"""Spatial joins by grid cells: every neighbour search is an equi-join on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.functions import scalars as S

AXES = ("x", "y", "z")


def cells(rows: DataFrame, size: float, axes=AXES, name: str = "cell") -> DataFrame:
    """Each row with the cell it lies in."""
    return rows.withColumn(name, F.struct(*(F.floor(F.col(a) / size).alias(f"c{k}") for k, a in enumerate(axes))))


def around(rows: DataFrame, size: float, radius: float, axes=AXES, name: str = "cell") -> DataFrame:
    """Each row once for each cell that its ball's box meets: eight where a cell is as wide as the ball."""
    reach = radius * 1.000001  # more than rounding takes off a distance
    for k, a in enumerate(axes):
        rows = rows.withColumn(f"_c{k}", F.explode(F.sequence(F.floor((F.col(a) - reach) / size), F.floor((F.col(a) + reach) / size))))
    return rows.withColumn(name, F.struct(*(F.col(f"_c{k}").alias(f"c{k}") for k in range(len(axes))))).drop(*(f"_c{k}" for k in range(len(axes))))


def within(left: DataFrame, right: DataFrame, radius: float, key: str = "pdb_id", how: str = "inner", left_axes=AXES, right_axes=AXES) -> DataFrame:
    """Pairs of one key no further apart than radius; the columns of both sides must differ but for the key.

    The right side, which should be the smaller, is repeated to the cells that its balls meet. Spark takes it for as small as it was before that,
    so the join is told to sort and merge: a broadcast would bring eight rows for each of its rows to the driver.
    """
    size = radius * 2.0
    a = cells(left, size, left_axes, "_cell").alias("a")
    b = around(right, size, radius, right_axes, "_cell").withColumnRenamed(key, "_key").alias("b").hint("merge")
    d = S.distance([f"a.{x}" for x in left_axes], [f"b.{x}" for x in right_axes])
    on = (F.col(f"a.{key}") == F.col("b._key")) & (F.col("a._cell") == F.col("b._cell")) & (d <= radius)
    return a.join(b, on, how).withColumn("dist", d).drop("_cell", "_key")


def renamed(rows: DataFrame, prefix: str, keep: tuple[str, ...] = ("pdb_id",)) -> DataFrame:
    return rows.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in rows.columns))


def pairs(points: DataFrame, radius: float, ordinal: str, key: str = "pdb_id", strict: bool = True) -> DataFrame:
    """Pairs of points of one key closer than radius, both ways round, no point with itself."""
    a, b = renamed(points, "a_", (key,)), renamed(points, "b_", (key,))
    found = within(a, b, radius, key, left_axes=("a_x", "a_y", "a_z"), right_axes=("b_x", "b_y", "b_z"))
    found = found.where(F.col(f"a_{ordinal}") != F.col(f"b_{ordinal}"))
    return found.where(F.col("dist") < radius) if strict else found


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: list[str], right_axes, left_axes, take: list[str], tie: str, how: str = "left") -> DataFrame:
    """Each left row with its key's nearest right row (ties to the smaller `tie`): take columns and dist.

    Meant for groups of a structure's size on the right: a top list, known sites, ligands.
    """
    d = S.distance(left_axes, right_axes)
    other = right.select(F.col(key).alias("_key"), *dict.fromkeys([*right_axes, *take, tie]))
    joined = left.join(other, F.col(key) == F.col("_key"), how).withColumn("_d", d)
    best = F.min_by(F.struct(*take, F.col("_d").alias("dist")), F.when(F.col("_d").isNotNull(), F.struct("_d", tie)))
    return joined.groupBy(key, *left_id).agg(best.alias("_best")).select(key, *left_id, "_best.*")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, key: str, left_id: list[str], left_axes, right_axes, take: list[str], tie: str) -> DataFrame:
    """J04 for atom-scale inputs: the nearest row no further away than radius, by cells."""
    found = within(left, right, radius, key, "left", left_axes, right_axes)
    best = F.min_by(F.struct(*take, "dist"), F.when(F.col("dist").isNotNull(), F.struct("dist", tie)))
    return found.groupBy(key, *left_id).agg(best.alias("_best")).select(key, *left_id, "_best.*")


def interactions(receptor: DataFrame, ligand: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Atom contacts closer than the cutoff, with their kind."""
    a, b = renamed(receptor, "p_"), renamed(ligand, "l_")
    found = within(a, b, cutoff, left_axes=("p_x", "p_y", "p_z"), right_axes=("l_x", "l_y", "l_z")).where(F.col("dist") < cutoff)
    return found.withColumn("kind", S.interaction_type("p_element", "l_element", "dist"))


def interaction_report(contacts: DataFrame) -> DataFrame:
    """Counts by kind and the sorted residues touched."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    residues = F.array_sort(F.collect_set(F.concat("p_res_name", F.col("p_res_id").cast("string"))))
    return contacts.groupBy("pdb_id").agg(n("hbond"), n("vdw"), n("hydrophobic"), residues.alias("residues"))


def similar(query: DataFrame, candidates: DataFrame, top_n: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """The candidates most like one query pocket, by score components."""
    parts = F.array("volume_score", "hydrophobicity_score", "enclosure_score", "depth_score", F.lit(0.0) + F.col("sphericity"))
    q = F.broadcast(query.limit(1).select(F.col("pdb_id").alias("q_pdb"), F.col("pocket_id").alias("q_pocket"), parts.alias("q")))  # one row
    rows = candidates.withColumn("v", parts).crossJoin(q).where(~((F.col("pdb_id") == F.col("q_pdb")) & (F.col("pocket_id") == F.col("q_pocket"))))
    rows = rows.select("pdb_id", "pocket_id", *(S.rounded(f("v", "q"), 4).alias(f.__name__) for f in (S.composite, S.cosine, S.euclid)))
    return rows.where(F.col("composite") >= min_similarity).orderBy(F.col("composite").desc(), "pdb_id", "pocket_id").limit(top_n)


def compare_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of two proteins' pockets, which share a pair id, with their similarity."""
    parts = F.array("volume_score", "hydrophobicity_score", "enclosure_score", "depth_score", "sphericity")
    left = a.select("pair", F.col("pocket_id").alias("a_id"), parts.alias("va"))
    right = b.select("pair", F.col("pocket_id").alias("b_id"), parts.alias("vb"))
    return left.join(right, "pair").select("pair", "a_id", "b_id", S.similarity("va", "vb").alias("composite"))


def displaced(atoms: DataFrame, template: DataFrame, frame: DataFrame, residue: tuple[str, ...] = ("pdb_id", "chain_id", "res_id", "ins_code", "res_name")) -> DataFrame:
    """All atoms moved by their residue's alpha-carbon shift; unmatched residues stay."""
    first = lambda df, p: df.groupBy(*residue).agg(*(F.first(a).alias(f"{p}{a}") for a in AXES))
    shift = first(template, "t_").join(first(frame, "f_"), list(residue)).select(*residue, *((F.col(f"f_{a}") - F.col(f"t_{a}")).alias(f"d{a}") for a in AXES))
    moved = atoms.join(shift, list(residue), "left").withColumn("moved", F.col("dx").isNotNull())
    return moved.withColumns({a: F.col(a) + F.coalesce(F.col(f"d{a}"), F.lit(0.0)) for a in AXES}).drop("dx", "dy", "dz")


def cavity_properties(vertices: DataFrame, atoms: DataFrame, reach: float = 15.0) -> DataFrame:
    """Centroid, vertex radius, clearance and volume of every cavity (pdb_id, cavity_id)."""
    key = ["pdb_id", "cavity_id"]
    center = vertices.groupBy(*key).agg(*(F.avg(a).alias(f"center_{a}") for a in AXES), F.count("*").alias("merged_vertices"), F.sum("volume").alias("void_volume"))
    spread = vertices.join(center, key).groupBy(*key).agg(F.max(S.distance(AXES, [f"center_{a}" for a in AXES])).alias("radius_geom"))
    clear = nearest_within(center, renamed(atoms.select("pdb_id", "serial", *AXES), "atom_"), reach, "pdb_id", ["cavity_id"], [f"center_{a}" for a in AXES], ["atom_x", "atom_y", "atom_z"], ["atom_serial"], "atom_serial")
    rows = center.join(spread, key).join(clear.select(*key, F.col("dist").alias("radius_clear")), key, "left")
    rows = rows.withColumn("radius_geom", F.when(F.col("merged_vertices") == 1, 0.0).otherwise(F.col("radius_geom")))
    return rows.withColumn("volume", S.sphere_volume(F.coalesce("radius_clear", F.lit(0.0))) * F.col("merged_vertices"))


def neighbourhood(cavities: DataFrame, residues: DataFrame, radius: float = 6.0) -> DataFrame:
    """Share of hydrophobic residues and number of polar ones around each cavity, and whether it can be drugged."""
    other = renamed(residues.select("pdb_id", "res_id", "res_name", *AXES), "r_")
    near = within(cavities, other, radius, "pdb_id", "left", [f"center_{a}" for a in AXES], ["r_x", "r_y", "r_z"])
    name = F.col("r_res_name")
    rows = near.groupBy("pdb_id", "cavity_id").agg(F.coalesce(F.avg(F.when(name.isNotNull(), name.isin(*S.HYDROPHOBIC).cast("int"))), F.lit(0.0)).alias("hydrophobic_ratio"), F.count_if(name.isin(*S.POLAR, *S.CHARGED)).alias("polar_atoms"), F.count("r_res_id").alias("n_residues"))
    return rows.withColumn("druggable", (F.col("n_residues") > 0) & (F.col("hydrophobic_ratio") > 0.3) & (F.col("polar_atoms") < 6))

