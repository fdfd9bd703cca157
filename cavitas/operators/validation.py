"""Recall and false-positive validation, sweeps, holdouts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import ordered
from cavitas.operators.atlas import by, desc


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """A share, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


def recall_summary(results: DataFrame, *keys: str, errors_miss: bool = False) -> DataFrame:
    """Cases, hits, recall, precision, F1 and mean distance, per keys.

    results: matched, best_distance and, if some cases failed, error. Failed cases
    are left out, or count as misses.
    """
    ok = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    rows = results if errors_miss else results.where(ok)
    hit = F.count_if(F.col("matched") & ok)
    found = F.count_if(F.col("best_distance").isNotNull())
    recall, precision = rate(hit, F.count("*")), rate(hit, found)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(F.count("*").alias("cases"), hit.alias("hits"), recall.alias("recall"), precision.alias("precision"), rate(hit * 2.0, found + F.count("*")).alias("f1"), F.round(F.avg("best_distance"), 4).alias("avg_distance"))


def grid(rows: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once for each value of a short, given list."""
    return rows.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))


def tolerance_sweep(results: DataFrame, tolerances: Sequence[float], *keys: str) -> DataFrame:
    """Recall per tolerance (and keys)."""
    rows = grid(results, "tolerance", tolerances).withColumn("hit", F.coalesce(F.col("best_distance") <= F.col("tolerance"), F.lit(False)))
    near = (F.col("best_distance") > F.col("tolerance")) & (F.col("best_distance") <= F.col("tolerance") + 2)
    return rows.groupBy("tolerance", *keys).agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"), rate(F.count_if("hit"), F.count("*")).alias("recall"), F.round(F.avg(F.when(F.col("hit"), F.col("best_distance"))), 4).alias("avg_distance"), F.count_if(near).alias("near_misses"))


def recall_delta(sweeps: DataFrame, a: str, b: str) -> DataFrame:
    """Recall of two runs per tolerance. sweeps: run, tolerance, recall."""
    return sweeps.groupBy("tolerance").pivot("run", [a, b]).agg(F.first("recall")).withColumn("delta", F.round(F.col(b) - F.col(a), 4))


def top_n_sweep(results: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Hits whose rank is within n, or unknown."""
    rows = grid(results, "top_n", ns).withColumn("top_n", F.col("top_n").cast("int"))
    hit = F.count_if(F.col("matched") & (F.col("rank").isNull() | (F.col("rank") <= F.col("top_n"))))
    note = F.when(F.count_if(F.col("matched") & F.col("rank").isNull()) > 0, "approximate").otherwise("exact")
    return rows.groupBy("top_n").agg(F.count("*").alias("cases"), hit.alias("hits"), rate(hit, F.count("*")).alias("recall"), note.alias("note"))


def min_volume_sweep(rows: DataFrame, volumes: Sequence[float], column: str = "volume") -> DataFrame:
    """Detected, not detected and unavailable per volume floor."""
    v = F.col(column)
    known = F.count_if(v.isNotNull())
    found = F.count_if(v >= F.col("min_volume"))
    return grid(rows, "min_volume", volumes).groupBy("min_volume").agg(found.alias("detected"), F.count_if(v < F.col("min_volume")).alias("not_detected"), F.count_if(v.isNull()).alias("unavailable"), rate(found, known).alias("rate"))


def threshold_sweep(row: DataFrame, metric: str, limits: Sequence[float]) -> DataFrame:
    """One rate against several limits, with the margin."""
    rows = grid(row, "threshold", limits)
    return rows.select("threshold", metric, F.round(F.col("threshold") - F.col(metric), 4).alias("margin"), (F.col(metric) <= F.col("threshold")).alias("passes"))


#: Weights of the four kinds of evidence for a candidate.
EVIDENCE = {"known_match": 0.2, "ligand_nearby": 0.3, "tool_match": 0.3, "docking_validated": 0.2}


def candidates(pockets: DataFrame, top_n: int = 20) -> DataFrame:
    """A17's input: the best top_n of each protein are judged, by their rank."""
    return pockets.where(F.col("rank") <= top_n)


def evidence_status(rows: DataFrame, threshold: float = 0.3, min_sources: int = 2) -> DataFrame:
    """Weighted evidence, then supported, unsupported or unknown with a reason.

    rows: the four flags, sources (how many kinds of evidence there is data for) and center_ok.
    """
    flags = [F.coalesce(F.col(k), F.lit(False)).cast("int") * w for k, w in EVIDENCE.items()]
    weight = F.round(sum(flags[1:], flags[0]), 4)
    status = F.when(~F.col("center_ok"), "unknown").when(weight >= threshold, "supported").when(F.col("sources") < min_sources, "unknown").otherwise("unsupported")
    reason = F.when(~F.col("center_ok"), "center_missing").when(F.col("sources") == 0, "no_evidence_sources").when(F.col("sources") < min_sources, "low_evidence_coverage")
    rows = rows.withColumns({"evidence_weight": weight, "status": status})
    return rows.withColumn("unknown_reason", F.when(F.col("status") == "unknown", reason))


def fpr_summary(rows: DataFrame) -> DataFrame:
    """False-positive rates (unknown ones left out, or counted), and what evidence there was."""
    n = lambda k: F.count_if(F.col("status") == k)
    kinds = [F.count_if(F.coalesce(F.col(k), F.lit(False))).alias(k) for k in EVIDENCE]
    return rows.agg(
        F.count("*").alias("candidates"),
        *(n(k).alias(k) for k in ("supported", "unsupported", "unknown")),
        rate(n("unsupported"), n("supported") + n("unsupported")).alias("fpr_conservative"),
        rate(n("unsupported") + n("unknown"), F.count("*")).alias("fpr_strict"),
        rate(n("unknown"), F.count("*")).alias("unknown_rate"),
        *kinds,
    )


def review(rows: DataFrame, n: int = 20, threshold: float = 0.3) -> DataFrame:
    """The n best-scored unsupported candidates, borderline ones marked."""
    top = rows.where("status = 'unsupported'").orderBy(desc("bio_score"), "pdb_id", "pocket_id").limit(n)
    return top.select("pdb_id", "pocket_id", "bio_score", "evidence_weight", F.when(F.col("evidence_weight") >= threshold - 0.1, "borderline").otherwise("likely_false_positive").alias("verdict"))


def snapshot_match(snapshots: DataFrame, reference: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Each snapshot's cavity nearest to the reference centre; volume 0 beyond the tolerance."""
    d = S.distance(("center_x", "center_y", "center_z"), ("ref_x", "ref_y", "ref_z"))
    rows = snapshots.join(reference, "pdb_id").withColumn("d", d)
    best = rows.groupBy("pdb_id", "frame").agg(F.min_by(F.struct("pocket_id", "volume", "d"), F.struct("d", "pocket_id")).alias("b"))
    return best.select("pdb_id", "frame", F.col("b.pocket_id").alias("pocket_id"), F.round("b.d", 4).alias("distance"), F.when(F.col("b.d") <= tolerance, F.col("b.volume")).otherwise(0.0).alias("matched_volume"))


def snapshot_summary(matches: DataFrame, opened: float = 100.0) -> DataFrame:
    """Volume and distance statistics, the open fraction and a three-way status."""
    share = rate(F.count_if(F.col("matched_volume") >= opened), F.count("*"))
    rows = matches.groupBy("pdb_id").agg(F.count("*").alias("snapshots"), F.round(F.avg("matched_volume"), 2).alias("avg_volume"), F.round(F.max("matched_volume"), 2).alias("max_volume"), share.alias("open_fraction"), F.round(F.min("distance"), 4).alias("min_distance"))
    return rows.withColumn("status", F.when(F.col("open_fraction") >= 0.5, "open").when(F.col("open_fraction") > 0, "transient").otherwise("closed"))


def clearance_volume(frames: DataFrame, stride: int = 1) -> DataFrame:
    """Volume of the free sphere at a fixed point, every stride-th frame. frames: atoms with px, py, pz."""
    d = S.distance(("x", "y", "z"), ("px", "py", "pz"))
    near = frames.where(F.col("frame") % stride == 0).groupBy("pdb_id", "frame").agg(F.min(d).alias("clearance"))
    return near.withColumn("volume", F.round(S.sphere_volume("clearance"), 4))


def crawl_summary(log: DataFrame) -> DataFrame:
    """Totals, shares, throughput and the first failures."""
    n = lambda k: F.count_if(F.col("status") == k)
    first = log.where("status <> 'success'").select("pdb_id").orderBy("pdb_id").limit(50).agg(F.array_sort(F.collect_list("pdb_id")).alias("first_failures"))
    totals = log.agg(F.count("*").alias("total"), n("success").alias("success"), n("error").alias("error"), n("timeout").alias("timeout"), rate(n("success") * 100, F.count("*"), 2).alias("success_pct"), F.round(F.sum("runtime"), 4).alias("runtime"))
    return totals.crossJoin(first)  # one row each


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Counts by status, queue depth, mean and p95 latency of finished jobs."""
    n = lambda k: F.count_if(F.col("status") == k).alias(k)
    done = F.when(F.col("status").isin("succeeded", "failed"), F.col("latency"))
    head = jobs.agg(F.count("*").alias("submitted"), n("succeeded"), n("failed"), n("running"), n("queued"), F.round(F.avg(done), 4).alias("avg_latency"))
    return head.crossJoin(p95_latency(jobs))  # one row each


def p95_latency(jobs: DataFrame) -> DataFrame:
    """sorted[int(0.95 (n - 1))] of the finished jobs' latencies, through counts per distinct value."""
    done = jobs.where(F.col("status").isin("succeeded", "failed") & F.col("latency").isNotNull())
    counts = done.groupBy("latency").agg(F.count("*").alias("n"))
    upto = ordered.running(counts, "latency", ordered.size_bucket(F.col("latency")), {"upto": "n"})
    total = counts.agg(F.sum("n").alias("total"))
    return upto.crossJoin(total).where(F.col("upto") > F.floor((F.col("total") - 1) * 0.95)).agg(F.round(F.min("latency"), 4).alias("p95_latency"))  # one row


def step_summary(steps: DataFrame) -> DataFrame:
    """Each step's time, its share of all time, and whether it is the bottleneck."""
    rows = steps.groupBy("step").agg(F.sum("seconds").alias("seconds"))
    everything = W.partitionBy()
    rows = rows.withColumn("share_pct", F.round(F.try_divide(F.col("seconds") * 100, F.sum("seconds").over(everything)), 2))
    return rows.withColumn("bottleneck", F.col("step") == F.max_by("step", F.struct("seconds", "step")).over(everything))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """A32, A36, H: metric rows (metric, value) against (metric, threshold, direction); all_pass on every row."""
    rows = metrics.join(F.broadcast(limits), "metric")  # a handful of gates
    ok = F.when(F.col("direction") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.withColumn("passes", F.coalesce(ok, F.lit(False))).withColumn("all_pass", F.bool_and("passes").over(W.partitionBy()))


def feasible(upper: DataFrame, target: float) -> DataFrame:
    """Can the target be met at the upper bound at all?"""
    return upper.withColumns({"target": F.lit(target), "feasible": F.col("upper_bound") >= target})


def config_drift(runs: DataFrame, tolerance: float = 8.0, top_n: int = 20, druggable: bool = True) -> DataFrame:
    """P20: runs whose parameters are not the canonical ones."""
    return runs.withColumn("canonical", (F.col("tolerance") == tolerance) & (F.col("top_n") == top_n) & (F.col("druggable_only") == druggable))


def hash_order(id_: Column | str, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.upper(S.col(id_))).cast("binary"), 256)


def hash_sample(ids: DataFrame, k: int, seed: str, column: str = "pdb_id", exclude: DataFrame | None = None) -> DataFrame:
    """K ids in the order of their seeded hashes, excluded ones left out."""
    ids = ids.select(column).distinct()
    ids = ids if exclude is None else ids.join(exclude.select(column).distinct(), column, "left_anti")
    return ids.orderBy(hash_order(column, seed), column).limit(k)


def round_robin(cases: DataFrame, k: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """K cases, one of each type in turn, rare types first; sizes count before the exclusion."""
    rows = cases.withColumn("type_size", F.count("*").over(W.partitionBy("pocket_type")))
    rows = rows if exclude is None else rows.join(exclude.select("pdb_id").distinct(), "pdb_id", "left_anti")
    rows = rows.withColumn("turn", F.row_number().over(by(hash_order("pdb_id", seed), "pdb_id", partition="pocket_type")))
    return rows.orderBy("turn", "type_size", "pocket_type").limit(k)


def split(rows: DataFrame, seed: str = "split", train: float = 0.7, val: float = 0.15, key: str = "pdb_id") -> DataFrame:
    """Whole proteins to train, val and test by hash order, floor sizes.

    The ids are numbered within 256 ranges of the hash, so no task sees them all.
    """
    ids = rows.select(key).distinct().withColumn("_h", hash_order(key, seed)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    counts = ids.groupBy("_b").agg(F.count("*").alias("_n"))  # 256 rows at most
    before = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    at = F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    n_train, n_val = F.floor(F.col("_total") * train), F.floor(F.col("_total") * val)
    which = ids.join(F.broadcast(before), "_b").withColumn("split", F.when(at <= n_train, "train").when(at <= n_train + n_val, "val").otherwise("test"))
    return rows.join(which.select(key, "split"), key)


def leaks(parts: DataFrame, key: str = "pdb_id") -> DataFrame:
    """Ids that appear in more than one split, with the splits."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return rows.where(F.size("splits") > 1)


def near_misses(results: DataFrame, tolerance: float = 8.0, reach: float = 4.0) -> DataFrame:
    """Missed cases by how far they missed."""
    gap = F.round(F.col("best_distance") - tolerance, 4)
    kind = F.when(F.col("best_distance").isNull(), "no_pocket").when(gap <= 1, "marginal").when(gap <= reach, "near").otherwise("far")
    return results.where(~F.col("matched")).select("pdb_id", "pocket_type", "best_distance", gap.alias("gap"), kind.alias("category"))


def changes(single: DataFrame, multi: DataFrame) -> DataFrame:
    """How each case fares from single to multi."""
    rows = single.select("pdb_id", F.col("matched").alias("single"), F.col("best_distance").alias("d1")).join(multi.select("pdb_id", F.col("matched").alias("multi"), F.col("best_distance").alias("d2")), "pdb_id")
    return rows.select("pdb_id", "single", "multi", F.round(F.col("d2") - F.col("d1"), 4).alias("change"), (~F.col("single") & F.col("multi")).alias("improved"), (F.col("single") & ~F.col("multi")).alias("regressed"))


def best_trial(trials: DataFrame, keys: Sequence[str], stop_at: float = 0.22) -> DataFrame:
    """The best trial by several keys, its gain over the first, and whether to stop."""
    order = F.struct(*keys, -F.col("trial"))
    one = trials.agg(F.max_by(F.struct("trial", "recall"), order).alias("best"), F.min_by("recall", "trial").alias("first_recall"))
    return one.select(F.col("best.trial").alias("trial"), F.col("best.recall").alias("recall"), F.round(F.col("best.recall") - F.col("first_recall"), 4).alias("gain"), (F.col("best.recall") >= stop_at).alias("stop"))


def better_row(rows: DataFrame, key: str = "pdb_id") -> DataFrame:
    """Per case the row that matches, or comes nearest."""
    order = F.struct(F.col("matched").cast("int"), -F.coalesce("best_distance", F.lit(1e9)), -F.col("pass_id"))
    return rows.groupBy(key).agg(F.max_by(F.struct("pass_id", "matched", "best_distance"), order).alias("b")).select(key, "b.*")


def widened(base: DataFrame, extra: DataFrame, missed: DataFrame) -> DataFrame:
    """Base rows and, for missed cases alone, the rows of further passes."""
    return base.unionByName(extra.join(missed.select("pdb_id").distinct(), "pdb_id", "left_semi"), allowMissingColumns=True)


def trial_grid(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """Every case under every trial's settings. specs: the few trials."""
    return cases.crossJoin(F.broadcast(specs))


def guard(ids: DataFrame, results: DataFrame) -> DataFrame:
    """Do all of the listed ids stay hits?"""
    rows = ids.join(results.select("pdb_id", "matched"), "pdb_id", "left")
    return rows.agg(F.count("*").alias("guarded"), F.count_if(F.col("matched")).alias("hits"), F.coalesce(F.bool_and(F.coalesce("matched", F.lit(False))), F.lit(True)).alias("holds"))


def pilot(rows: DataFrame, n: int = 25) -> DataFrame:
    """The n cases with the largest drop, by several keys."""
    return rows.orderBy(desc("drop"), desc("near"), F.col("matched").asc(), "n_pockets", "pdb_id").limit(n)


def sources_of(sets: dict[str, DataFrame], key: str = "pdb_id") -> DataFrame:
    """The union of several id sets, each id with its sources."""
    rows = None
    for name, ids in sets.items():
        part = ids.select(S.norm_id(key).alias(key), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def case_subset(cases: DataFrame, types: Sequence[str]) -> DataFrame:
    """The cases of some types."""
    return cases.where(F.col("pocket_type").isin(*types))


def as_results(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Run rows in the validation's columns, name, type, centre and radius from the case table or defaults."""
    info = cases.select("pdb_id", "name", "pocket_type", "x", "y", "z", "radius")
    rows = runs.select("pdb_id", "matched", "best_distance").join(info, "pdb_id", "left")
    defaults = {"name": F.col("pdb_id"), "pocket_type": F.lit("unknown"), "x": F.lit(0.0), "y": F.lit(0.0), "z": F.lit(0.0), "radius": F.lit(8.0)}
    return rows.select("pdb_id", *(F.coalesce(c, d).alias(c) for c, d in defaults.items()), F.coalesce("matched", F.lit(False)).alias("matched"), "best_distance")
