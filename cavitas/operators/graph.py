"""Residue contact graphs of all structures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import spatial
from cavitas.operators.atlas import by, desc
from cavitas.operators.spatial import AXES
from cavitas.session import shared_folder, stored

FEATURES = ("hydrophobicity", "is_hydrophobic", "is_polar", "is_charged", "relative_position", "contact_count", "avg_contact_dist", "local_density", "exposure")


def contacts(residues: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Directed edges src, dst between residues closer than the cutoff."""
    found = spatial.pairs(residues.select("pdb_id", "res_id", *AXES), cutoff, "res_id")
    return found.select("pdb_id", F.col("a_res_id").alias("src"), F.col("b_res_id").alias("dst"), "dist")


def node_features(residues: DataFrame, cutoff: float = 8.0, far: float = 15.0) -> DataFrame:
    """Nine features of every residue."""
    near = F.col("dist") < cutoff
    per = contacts(residues, far).groupBy("pdb_id", F.col("src").alias("res_id")).agg(F.count_if(near).alias("n_near"), F.avg(F.when(near, F.col("dist"))).alias("avg_near"), F.count_if(F.col("dist") > cutoff).alias("n_far"))
    group = W.partitionBy("pdb_id")
    rows = residues.select("pdb_id", "res_id", F.upper("res_name").alias("res_name"), F.count("*").over(group).alias("n"), (F.row_number().over(by("res_id", partition="pdb_id")) - 1).alias("i")).join(per, ["pdb_id", "res_id"], "left")
    flag = lambda names: F.col("res_name").isin(*names).cast("double")
    near_n, n = F.coalesce("n_near", F.lit(0)), F.greatest(F.col("n"), F.lit(1))
    each = [
        S.hydropathy("res_name") / 4.5,
        flag(S.HYDROPHOBIC),
        flag(S.POLAR),
        flag(S.CHARGED),
        F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)),
        near_n / n,
        F.coalesce(F.col("avg_near") / cutoff, F.lit(1.0)),
        near_n / 20.0,
        F.lit(1.0) - F.coalesce("n_far", F.lit(0)) / n,
    ]
    return rows.select("pdb_id", "res_id", "res_name", *(c.alias(name) for name, c in zip(FEATURES, each, strict=True)))


def passed(nodes: DataFrame, edges: DataFrame, passes: int = 3, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Half of a node's own features and half of its neighbours' mean, several times over; no neighbours count as 0."""
    links = edges.select("pdb_id", "src", "dst")
    for _ in range(passes):
        other = nodes.select("pdb_id", F.col("res_id").alias("dst"), *features)
        mean = links.join(other, ["pdb_id", "dst"]).groupBy("pdb_id", F.col("src").alias("res_id")).agg(*(F.avg(f).alias(f"m_{f}") for f in features))
        joined = nodes.join(mean, ["pdb_id", "res_id"], "left")
        nodes = joined.withColumns({f: F.col(f) * 0.5 + F.coalesce(f"m_{f}", F.lit(0.0)) * 0.5 for f in features}).drop(*(f"m_{f}" for f in features))
    return nodes


def pocket_residues(nodes: DataFrame, top_k: int = 20) -> DataFrame:
    """Residues by a score of their passed-on features, the best top_k of each structure."""
    c = F.col
    score = F.greatest(F.lit(0.0), c("hydrophobicity")) * 0.3 + c("is_hydrophobic") * 0.2 + (F.lit(1.0) - c("exposure")) * 0.2 + c("local_density") * 0.15 + c("contact_count") * 0.15
    rows = nodes.withColumn("pocket_score", F.round(score, 4))
    rows = rows.withColumn("rank", F.row_number().over(by(desc("pocket_score"), "res_id", partition="pdb_id")))
    return rows.where(F.col("rank") <= top_k).select("pdb_id", "res_id", "res_name", "pocket_score", "rank")


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least node of each component within structures.

    Minima spread to neighbours, and each label then becomes its node's own label, so chains take
    rounds by the logarithm of their length. Labels only fall, so it ends; every round cuts its lineage.
    """
    labels = nodes.select("pdb_id", "res_id", F.col("res_id").alias("label")).checkpoint()
    while True:
        offered = edges.join(labels.withColumnRenamed("res_id", "src"), ["pdb_id", "src"]).groupBy("pdb_id", F.col("dst").alias("res_id")).agg(F.min("label").alias("offer"))
        new = labels.join(offered, ["pdb_id", "res_id"], "left").select("pdb_id", "res_id", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved")).checkpoint()
        if new.where("moved").isEmpty():
            return new.drop("moved")
        further = new.select("pdb_id", F.col("res_id").alias("label"), F.col("label").alias("next"))
        labels = new.join(further, ["pdb_id", "label"]).select("pdb_id", "res_id", F.col("next").alias("label"))


def clusters(residues: DataFrame, eps: float = 6.0, least: int = 3, score: str = "score") -> DataFrame:
    """Density clusters: cores by neighbours including themselves, their components, borders to the least label; noise goes.

    Neighbours are searched for once.
    """
    spark = residues.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    found = spatial.pairs(residues.select("pdb_id", "res_id", *AXES), eps, "res_id", strict=False)
    # stored, as every round of the labels and the borders read them
    edges = stored(found.select("pdb_id", F.col("a_res_id").alias("src"), F.col("b_res_id").alias("dst")), "edges")
    cores = edges.groupBy("pdb_id", F.col("src").alias("res_id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("pdb_id", "res_id")
    inner = stored(edges.join(cores.withColumnRenamed("res_id", "src"), ["pdb_id", "src"], "left_semi").join(cores.withColumnRenamed("res_id", "dst"), ["pdb_id", "dst"], "left_semi"), "inner_edges")
    labels = _labels(cores, inner)
    border = edges.join(labels.withColumnRenamed("res_id", "src"), ["pdb_id", "src"]).join(cores.withColumnRenamed("res_id", "dst"), ["pdb_id", "dst"], "left_anti").groupBy("pdb_id", F.col("dst").alias("res_id")).agg(F.min("label").alias("label"))
    rows = labels.unionByName(border).join(residues, ["pdb_id", "res_id"])
    center = rows.groupBy("pdb_id", "label").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in AXES), F.avg(score).alias("avg_score"), F.max(score).alias("max_score"))
    radius = rows.join(center, ["pdb_id", "label"]).groupBy("pdb_id", "label").agg(F.max(S.distance(AXES, ("cx", "cy", "cz"))).alias("radius"))
    return center.join(radius, ["pdb_id", "label"]).select("pdb_id", "label", "n", *(F.round(f"c{a}", 4).alias(f"center_{a}") for a in AXES), F.round("radius", 4).alias("radius"), F.round("avg_score", 4).alias("avg_score"), F.round("max_score", 4).alias("max_score"))
