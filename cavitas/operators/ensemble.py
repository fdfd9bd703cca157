"""Many frames of one structure: consensus, persistence, frame choice and frame generation."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import geometry
from cavitas.operators.atlas import CENTER, by, desc
from cavitas.operators.groups import map_keys
from cavitas.session import stored

CONSENSUS = "pdb_id string, cluster int, center_x double, center_y double, center_z double, pocket_id long, bio_score double, druggable boolean, support_frames int, support_ratio double, center_stability double, volume_mean double, volume_std double, volume_cv double, consensus_score double, frame_hits array<int>, rank int"


def half_up(x: float, places: int = 4) -> float:
    """Rounds a number that is not negative, ties up: what the order of summing does to its last bits does not show."""
    return round(x * (1 + 1e-12), places)


def leaders(points: np.ndarray, reach: float) -> np.ndarray:
    """The cluster of each point, in their order: that of the nearest running mean within reach, else a new one.

    A cluster is listed in its mean's cell of the reach's size and those around, so a point meets the means near it alone.
    """
    side = reach * 1.000001 or 1.0
    near: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    around = lambda i, j, k: [near[a, b, c] for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for c in (k - 1, k, k + 1)]
    means, sizes, homes, own = [], [], [], []
    for x, y, z in points.tolist():
        best, at = reach, -1
        for k in near[math.floor(x / side), math.floor(y / side), math.floor(z / side)]:
            mx, my, mz = means[k]
            dx, dy, dz = mx - x, my - y, mz - z
            d = math.sqrt(dx * dx + dy * dy + dz * dz)
            if d < best or (d == best and (at < 0 or k < at)):
                best, at = d, k
        if at < 0:
            at = len(means)
            means.append((x, y, z))
            sizes.append(1)
            homes.append(None)
        else:
            (mx, my, mz), m = means[at], sizes[at]
            means[at] = mx, my, mz = (mx * m + x) / (m + 1), (my * m + y) / (m + 1), (mz * m + z) / (m + 1)
            sizes[at] = m + 1
            x, y, z = mx, my, mz
        home = (math.floor(x / side), math.floor(y / side), math.floor(z / side))
        if home != homes[at]:
            for cell in around(*homes[at]) if homes[at] else ():
                cell.discard(at)
            for cell in around(*home):
                cell.add(at)
            homes[at] = home
        own.append(at)
    return np.asarray(own, int)


def consensus(pockets: DataFrame, min_support: int = 2, reach: float = 6.0, stability_max: float = 4.0, cv_max: float = 0.35, with_all: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """All pockets of all frames joined into clusters in frame order, then scored and ranked per structure.

    Each pocket joins the nearest cluster whose running mean is within reach, else it starts one.
    One structure's pockets are worked through at once. frames: pdb_id and frame of all frames that were analysed, those without a
    pocket, too; without it the frames are those that `pockets` names, whether their pockets have a centre or not.
    """
    names = [f.split()[0] for f in CONSENSUS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, CONSENSUS.split(", "), strict=True)])

    def clusters(part: dict[str, list], points: np.ndarray) -> list[tuple]:
        """One structure's rows, in the order of frames and scores."""
        n_frames, pdb_id = part["n_frames"][0], part["pdb_id"][0]
        own = leaders(points, reach)
        sizes = np.bincount(own)
        centers = np.stack([np.bincount(own, x) / sizes for x in points.T], axis=1)
        stability = (np.bincount(own, np.sqrt(((points - centers[own]) ** 2).sum(axis=1))) / sizes).tolist()
        centers = centers.tolist()
        order = np.argsort(own, kind="stable").tolist()  # by clusters, and in each by frames
        ends = np.cumsum(sizes).tolist()
        scores, frame_of, volume_of, druggable, ids = ([part[c][i] for i in order] for c in ("bio_score", "frame", "volume", "druggable", "pocket_id"))
        rows = []
        for c, (first, last) in enumerate(zip([0, *ends], ends, strict=False)):
            hits = list(dict.fromkeys(frame_of[first:last]))
            support = len(hits)
            if support < min_support and not with_all:
                continue
            n = last - first
            volumes = [math.nan if v is None else v for v in volume_of[first:last]]
            mean = math.fsum(volumes) / n  # whatever the order
            std = math.sqrt(math.fsum((v - mean) ** 2 for v in volumes) / n)
            cv = std / mean if mean > 1e-8 else float("inf")
            steady = 0.5 * max(0.0, 1 - stability[c] / stability_max) + 0.5 * max(0.0, 1 - cv / cv_max)
            known = [s for s in scores[first:last] if s is not None and s == s]
            top = max(known, default=math.nan)
            score = half_up(0.65 * (math.fsum(known) / len(known) if known else math.nan) + 0.25 * support / n_frames + 0.10 * steady)
            best = first + (scores[first:last].index(top) if known else 0)
            rows.append((pdb_id, c, *centers[c], ids[best], top, any(druggable[first:last]), support, *map(half_up, (support / n_frames, stability[c], mean, std, cv)), score, hits))
        rows.sort(key=lambda r: (r[-2] != r[-2], -r[-2], -r[6], -r[8], r[1]))
        return [(*r, at + 1) for at, r in enumerate(rows)]

    def run(rows: pa.Table, bounds: list[int]) -> pa.Table:
        points = np.stack([rows[c].to_numpy() for c in CENTER], axis=1)
        lists = {c: rows[c].to_pylist() for c in ("pdb_id", "n_frames", "bio_score", "frame", "volume", "druggable", "pocket_id")}
        found = [r for a, b in pairwise(bounds) for r in clusters({c: x[a:b] for c, x in lists.items()}, points[a:b])]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema) if found else schema.empty_table()

    total = (pockets if frames is None else frames).groupBy("pdb_id").agg(F.count_distinct("frame").alias("n_frames"))
    rows = pockets.where(S.valid_center(F.array(*CENTER))).select("pdb_id", "frame", "pocket_id", "bio_score", "volume", "druggable", *CENTER)
    # few bytes but much work a structure: by its bytes alone, Spark would give them all to one task
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "pdb_id").join(total, "pdb_id")
    return map_keys(rows, ("pdb_id",), ["frame", desc("bio_score"), "pocket_id"], run, CONSENSUS)


def consensus_stats(rows: DataFrame) -> DataFrame:
    """W07."""
    return rows.groupBy("pdb_id").agg(F.count("*").alias("consensus_clusters"), F.round(F.avg("support_frames"), 3).alias("avg_support_frames"), F.round(F.avg("center_stability"), 3).alias("avg_center_stability"), F.round(F.avg("volume_cv"), 3).alias("avg_volume_cv"))


def persistence(hits: DataFrame, frames: DataFrame, key: tuple[str, ...] = ("pdb_id", "pocket_id")) -> DataFrame:
    """Hits, first, last, span, longest run, flicker and score of each pocket's presence over the frames.

    hits: key and frame; frames: pdb_id and frame, one row each. Runs are islands of frame numbers.
    """
    order = frames.withColumn("idx", F.row_number().over(by("frame", partition="pdb_id")) - 1)
    total = frames.groupBy("pdb_id").agg(F.count("*").alias("total"))
    at = hits.select(*key, "frame").distinct().join(order, ["pdb_id", "frame"])
    island = F.col("idx") - F.row_number().over(by("idx", partition=list(key)))
    runs = at.withColumn("island", island).groupBy(*key, "island").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    rows = runs.groupBy(*key).agg(F.sum("n").alias("hit_count"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.max("n").alias("longest"), (F.count("*") - 1).alias("flicker")).join(total, "pdb_id")
    score = F.col("hit_count") / F.col("total") * 0.5 + F.col("longest") / F.col("total") * 0.3 + (F.lit(1.0) - F.least(F.lit(1.0), F.col("flicker") / F.col("hit_count"))) * 0.2
    return rows.select(*key, "hit_count", "first", "last", (F.col("last") - F.col("first") + 1).alias("span"), "longest", "flicker", F.round(score, 4).alias("persistence_score"))


def persistence_summary(rows: DataFrame) -> DataFrame:
    """W09."""
    return rows.groupBy("pdb_id").agg(F.count("*").alias("n_pockets"), F.round(F.avg("persistence_score"), 4).alias("avg_persistence"), F.max("persistence_score").alias("max_persistence"))


#: Limits of the refined ranking.
STABILITY_MAX, CV_MAX, MIN_FRAMES = 2.0, 0.20, 2


def rescue(rows: DataFrame) -> DataFrame:
    """High-class pockets that five limits let pass as druggable."""
    ok = (F.col("druggability_class") == "high") & (F.col("bio_score") >= 0.75) & (F.coalesce("support_frames", F.lit(0)) >= 4) & (F.coalesce("center_stability", F.lit(999.0)) <= 0.35) & (F.coalesce("volume_cv", F.lit(999.0)) <= 0.25) & (F.coalesce("hydrophobic_ratio", F.lit(0.0)) >= 0.45)
    return rows.withColumn("rescued", ok & ~F.col("druggable")).withColumn("druggable", F.col("druggable") | F.col("rescued"))


def refined_rank(rows: DataFrame) -> DataFrame:
    """Rank by a score normalised within the structure; pockets that fail the filter go unless all fail."""
    group = W.partitionBy("pdb_id")
    low, high = F.min("bio_score").over(group), F.max("bio_score").over(group)
    bio = F.when(F.abs(high - low) < 1e-12, 0.5).otherwise((F.col("bio_score") - low) / (high - low))
    support = F.coalesce("support_frames", F.lit(0))
    share = F.least(F.lit(1.0), support / F.greatest(F.max(support).over(group), F.lit(1)))
    cls = F.col("druggability_class")
    drug = F.when(cls == "high", 1.0).when(cls == "medium", 0.6).when(cls == "low", 0.3).when(F.col("druggable"), 1.0).otherwise(0.0)
    stability, cv = F.coalesce("center_stability", F.lit(STABILITY_MAX)), F.coalesce("volume_cv", F.lit(CV_MAX))
    score = bio * 0.35 + share * 0.25 + drug * 0.15 + (F.lit(1.0) - S.clamp(stability / STABILITY_MAX)) * 0.15 + (F.lit(1.0) - S.clamp(cv / CV_MAX)) * 0.10
    ok = (support >= MIN_FRAMES) & (stability <= STABILITY_MAX) & (cv <= CV_MAX)
    rows = rows.withColumns({"rank_score": F.round(score, 6), "passes": ok})
    rows = rows.withColumn("_any", F.bool_or("passes").over(group)).where(F.col("passes") | ~F.col("_any")).drop("_any")
    return rows.withColumn("refined_rank", F.row_number().over(by(desc("rank_score"), desc("bio_score"), desc("support_frames"), "pocket_id", partition="pdb_id")))


def frame_rmsd(atoms: DataFrame) -> DataFrame:
    """Displacement of every frame from the first, by residue; frames of another size give their index."""
    first = F.min("frame").over(W.partitionBy("pdb_id"))
    rows = atoms.withColumn("first", first)
    zero = rows.where("frame = first").select("pdb_id", "res_id", *(F.col(c).alias(f"{c}0") for c in "xyz"))
    n0 = zero.groupBy("pdb_id").agg(F.count("*").alias("n0"))
    d2 = sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0))
    per = atoms.join(zero, ["pdb_id", "res_id"], "left").groupBy("pdb_id", "frame").agg(F.count("*").alias("n"), F.count("x0").alias("m"), F.sqrt(F.avg(d2)).alias("rmsd")).join(n0, "pdb_id")
    index = F.row_number().over(by("frame", partition="pdb_id")) - 1
    return per.withColumn("index", index).select("pdb_id", "frame", F.round(F.when((F.col("n") == F.col("n0")) & (F.col("m") == F.col("n0")), F.col("rmsd")).otherwise(F.col("index").cast("double")), 4).alias("rmsd"))


def even_frames(frames: DataFrame, k: int) -> DataFrame:
    """Frame int(i (n - 1) / (k - 1)) for i below k, of each structure."""
    rows = frames.withColumns({"idx": F.row_number().over(by("frame", partition="pdb_id")) - 1, "n": F.count("*").over(W.partitionBy("pdb_id"))})
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, k - 1)).cast("int"))
    return rows.where((F.col("n") <= k) | F.array_contains(at, F.col("idx").cast("int"))).select("pdb_id", "frame")


def frame_subset(rmsd: DataFrame, k: int, mode: str = "motion") -> DataFrame:
    """All frames, k even ones, or those of most motion (70 %) with first, middle and last, filled up evenly."""
    if mode == "all":
        return rmsd.select("pdb_id", "frame")
    if mode == "even":
        return even_frames(rmsd.select("pdb_id", "frame"), k)
    group = W.partitionBy("pdb_id")
    rows = rmsd.withColumns({"idx": F.row_number().over(by("frame", partition="pdb_id")) - 1, "n": F.count("*").over(group), "motion": F.row_number().over(by(desc("rmsd"), "frame", partition="pdb_id"))})
    anchor = (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1) | (F.col("idx") == F.floor(F.col("n") / 2))
    spread = F.pmod(F.col("idx") * k, F.col("n"))  # even filling: small remainders are k even places
    order = F.when(anchor, 0).when(F.col("motion") <= int(k * 0.7), 1).otherwise(2)
    return rows.withColumn("pick", F.row_number().over(by(order, F.when(order == 1, F.col("motion")).otherwise(spread), "frame", partition="pdb_id"))).where(F.col("pick") <= k).select("pdb_id", "frame")


def subset_diagnostics(rmsd: DataFrame, chosen: DataFrame) -> DataFrame:
    """A31."""
    rows = rmsd.join(chosen.withColumn("chosen", F.lit(True)), ["pdb_id", "frame"], "left")
    own = F.when(F.col("chosen"), F.col("rmsd"))
    return rows.groupBy("pdb_id").agg(F.count("chosen").alias("n_chosen"), F.round(F.avg(own), 4).alias("avg_chosen"), F.round(F.avg("rmsd"), 4).alias("avg_all"), F.round(F.max(own), 4).alias("max_chosen"), F.round(F.max("rmsd"), 4).alias("max_all"))


def generated(atoms: DataFrame, modes: DataFrame, n: int = 10, amplitudes: tuple[float, ...] = (2.0, 3.0, 5.0)) -> DataFrame:
    """N frames along every mode for every amplitude; frames are keyed by amplitude, mode and index."""
    rows = atoms.join(modes, ["pdb_id", "res_id"])
    rows = rows.withColumn("amplitude", F.explode(F.array(*map(F.lit, amplitudes)))).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    swing = F.col("amplitude") * F.sin(F.col("frame") * (2 * np.pi / n))
    return rows.select("pdb_id", "res_id", "mode", "amplitude", "frame", *((F.col(c) + swing * F.col(f"d{c}")).alias(c) for c in "xyz"))


def frame_statistics(pockets: DataFrame, frames: DataFrame) -> DataFrame:
    """Of every frame the number of pockets and of druggable ones, and its error where it has one.

    frames: pdb_id, frame and error, null for frames that could be analysed.
    """
    counts = pockets.groupBy("pdb_id", "frame").agg(F.count("*").alias("n_pockets"), F.count_if("druggable").alias("n_druggable"))
    rows = frames.join(counts, ["pdb_id", "frame"], "left").fillna(0, ["n_pockets", "n_druggable"])
    good = F.col("error").isNull()
    return rows.select("pdb_id", "frame", *(F.when(good, F.col(c)).alias(c) for c in ("n_pockets", "n_druggable")), "error")


@dataclass(frozen=True)
class Run:
    """What an ensemble run gives: cavities by frame, the frames with counts and errors, consensus clusters, and their persistence."""

    cavities: DataFrame
    frames: DataFrame
    consensus: DataFrame
    persistence: DataFrame


def run(frames: DataFrame, mapper: Callable[[DataFrame], DataFrame] | None = None, least: int = 50, min_support: int = 2, **settings) -> Run:
    """Frames of any number of structures through cavities, consensus and persistence, in one job.

    frames: pdb_id, frame, res_id, res_name, element and coordinates. mapper: a caller's transformation of them, which may
    add columns that hold for a whole frame and begin with meta_; they come along in `frames`. A frame that fails is a row with its error. The cavities are
    stored once.
    """
    rows = frames if mapper is None else frames.transform(mapper)
    meta = [c for c in rows.columns if c.startswith("meta_")]
    found, state = geometry.cavities_by_frame(rows.drop(*meta), least=least, **settings)
    found = stored(found.withColumnRenamed("cavity_id", "pocket_id").withColumn("pocket_id", F.col("pocket_id").cast("long")), "cavities")
    counts = frame_statistics(found, state)
    if meta:
        counts = counts.join(rows.groupBy("pdb_id", "frame").agg(*(F.first(c, ignorenulls=True).alias(c) for c in meta)), ["pdb_id", "frame"], "left")
    analysed = state.where("error is null").select("pdb_id", "frame")
    clusters = consensus(found, min_support=min_support, frames=analysed)
    hits = clusters.select("pdb_id", F.col("cluster").alias("pocket_id"), F.explode("frame_hits").alias("frame"))
    return Run(found, counts, clusters, persistence(hits, analysed))


def docking_consistency(rows: DataFrame) -> DataFrame:
    """Per pocket the share of frames that dock, mean and spread of affinity, stability."""
    ok = F.col("affinity").isNotNull()
    share = F.avg(ok.cast("double"))
    return rows.groupBy("pdb_id", "pocket_id").agg(F.count("*").alias("docks"), F.count_if(ok).alias("successes"), F.round(share, 4).alias("success_share"), F.round(F.avg("affinity"), 4).alias("avg_affinity"), F.round(F.stddev_pop("affinity"), 4).alias("std_affinity"), F.least(F.lit(0.0), F.min("affinity")).alias("best_affinity"), (share >= 0.6).alias("stable"))
