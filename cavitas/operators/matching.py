"""Matching predicted pockets with known sites and between detection tools."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import ordered
from cavitas.operators.atlas import CENTER, ranked

SITE = ("x", "y", "z")


def known_hits(known: DataFrame, pockets: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Each known site's best pocket by a distance that good scores shorten."""
    other = pockets.select(F.col("pdb_id").alias("_pdb"), "pocket_id", "bio_score", *CENTER)
    d = S.distance(SITE, CENTER)
    eff = d * F.when(F.col("bio_score") >= 0.55, 0.85).when(F.col("bio_score") >= 0.30, 0.92).otherwise(1.0)
    rows = known.join(other, F.col("pdb_id") == F.col("_pdb"), "left").withColumns({"d": d, "eff": eff})
    best = F.min_by(F.struct("pocket_id", "bio_score", "d", "eff"), F.when(F.col("eff").isNotNull(), F.struct("eff", "pocket_id")))
    found = rows.groupBy("pdb_id", "pocket_type", *SITE).agg(best.alias("b"), F.count("pocket_id").alias("n_pockets"))
    return found.select("pdb_id", "pocket_type", F.col("b.pocket_id").alias("pocket_id"), F.round("b.d", 4).alias("distance"), F.coalesce(F.col("b.eff") <= tolerance, F.lit(False)).alias("hit"), "n_pockets")


def site_match(known: DataFrame, pockets: DataFrame, tolerance: float = 8.0, top_n: int = 20, druggable_only: bool = True) -> DataFrame:
    """The best of the top_n pockets by plain distance; the cut comes before the druggable filter."""
    top = pockets.where(F.col("rank") <= top_n)
    top = top.where("druggable") if druggable_only else top
    other = top.select(F.col("pdb_id").alias("_pdb"), "pocket_id", "rank", "bio_score", *CENTER)
    rows = known.join(other, F.col("pdb_id") == F.col("_pdb"), "left").withColumn("d", S.distance(SITE, CENTER))
    best = F.min_by(F.struct("pocket_id", "rank", "bio_score", "d"), F.when(F.col("d").isNotNull(), F.struct("d", "rank")))
    found = rows.groupBy("pdb_id", "pocket_type", *SITE).agg(best.alias("b"))
    return found.select("pdb_id", "pocket_type", F.col("b.pocket_id").alias("pocket_id"), F.col("b.rank").alias("rank"), F.col("b.bio_score").alias("bio_score"), F.round("b.d", 4).alias("best_distance"), F.coalesce(F.col("b.d") <= tolerance, F.lit(False)).alias("matched"))


def tool_lists(pockets: DataFrame, tool: str, top_n: int = 20) -> DataFrame:
    """One tool's largest pockets of each protein, numbered."""
    return ranked(pockets.where(F.col("tool") == tool).drop("rank"), top_n, score="volume").select("pdb_id", "pocket_id", F.col("rank").alias("ord"), "volume", *CENTER)


def candidate_pairs(a: DataFrame, b: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Pairs of the two tools' lists (both numbered per protein) with distance; lists are top lists, so small."""
    left = a.select("pdb_id", F.col("ord").alias("a"), F.col("volume").alias("va"), *(F.col(c).alias(f"a_{c}") for c in CENTER))
    right = b.select("pdb_id", F.col("ord").alias("b"), F.col("volume").alias("vb"), *(F.col(c).alias(f"b_{c}") for c in CENTER))
    d = S.distance([f"a_{c}" for c in CENTER], [f"b_{c}" for c in CENTER])
    return left.join(right, "pdb_id").select("pdb_id", "a", "b", "va", "vb", d.alias("d")).where(F.col("d") <= tolerance)


def greedy(pairs: DataFrame, gate: Column | None = None) -> DataFrame:
    """In the order of a, each takes its nearest free b; one row per protein with the matched pairs."""
    pairs = pairs if gate is None else pairs.where(gate)
    options = pairs.groupBy("pdb_id", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "b"))), lambda x: x["b"]).alias("bs"))
    lists = options.groupBy("pdb_id").agg(F.array_sort(F.collect_list(F.struct("a", "bs"))).alias("rows"))
    start = F.array().cast("array<struct<a:int,b:int>>")

    def step(done: Column, row: Column) -> Column:
        free = F.filter(row["bs"], lambda b: ~F.exists(done, lambda m: m["b"] == b))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(row["a"].cast("int").alias("a"), F.element_at(free, 1).cast("int").alias("b"))))).otherwise(done)

    return lists.select("pdb_id", F.aggregate("rows", start, step).alias("matches"))


def most_matches(pairs: DataFrame) -> DataFrame:
    """Size of a largest one-to-one matching per protein, by augmenting paths over its top lists."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        options = group.groupby("a")["b"].apply(list).to_dict()
        taken: dict[int, int] = {}

        def place(a: int, seen: set[int]) -> bool:
            for b in options[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in taken or place(taken[b], seen):
                        taken[b] = a
                        return True
            return False

        return pd.DataFrame({"pdb_id": [group["pdb_id"].iloc[0]], "size": [sum(place(a, set()) for a in sorted(options))]})

    return pairs.select("pdb_id", "a", "b").groupBy("pdb_id").applyInPandas(run, "pdb_id string, size int")


def overlap(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """Per protein matched, unique to each and Dice; proteins of either tool."""
    na = a.groupBy("pdb_id").agg(F.count("*").alias("n_a"))
    nb = b.groupBy("pdb_id").agg(F.count("*").alias("n_b"))
    rows = na.join(nb, "pdb_id", "full").join(matches.select("pdb_id", F.size("matches").alias("matched")), "pdb_id", "left")
    rows = rows.select("pdb_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "matched")))
    dice = F.when(F.col("n_a") + F.col("n_b") > 0, F.round(F.col("matched") * 2.0 / (F.col("n_a") + F.col("n_b")), 4)).otherwise(0.0)
    return rows.withColumns({"unique_a": F.col("n_a") - F.col("matched"), "unique_b": F.col("n_b") - F.col("matched"), "dice": dice})


def global_overlap(per: DataFrame) -> DataFrame:
    """A13, Q17 over all proteins."""
    s = lambda c: F.sum(c)
    return per.agg(s("matched").alias("matched"), s("unique_a").alias("unique_a"), s("unique_b").alias("unique_b"), F.round(F.try_divide(s("matched") * 2.0, s("n_a") + s("n_b")), 4).alias("dice"), F.round(F.try_divide(s("unique_a") * 100.0, s("n_a")), 2).alias("unique_a_pct"))


def diagnostics(a: DataFrame, b: DataFrame, tolerance: float = 8.0, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Why a tool's pockets stay unmatched: none near, or volumes too low, too high or missing (the majority)."""
    near = candidate_pairs(a, b, tolerance)
    ratio = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("va") / F.col("vb"))
    per = near.groupBy("pdb_id", "a").agg(F.count_if(ratio.between(low, high)).alias("ok"), F.count_if(ratio < low).alias("lo"), F.count_if(ratio > high).alias("hi"), F.count_if(ratio.isNull()).alias("missing"))
    rows = a.select("pdb_id", F.col("ord").alias("a")).join(per, ["pdb_id", "a"], "left")
    reason = F.when(F.col("ok").isNull(), "distance").when(F.col("ok") > 0, "pass").when((F.col("lo") >= F.col("hi")) & (F.col("lo") >= F.col("missing")), "volume_low").when(F.col("hi") >= F.col("missing"), "volume_high").otherwise("volume_missing")
    n = lambda k: F.count_if(F.col("reason") == k).alias(k)
    return rows.withColumn("reason", reason).groupBy("pdb_id").agg(*map(n, ("pass", "distance", "volume_low", "volume_high", "volume_missing")))


def nearest_stats(a: DataFrame, b: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Least and median distance of each pocket's nearest of the other tool, and how many are within the tolerance."""
    pairs = candidate_pairs(a, b, float("inf")).groupBy("pdb_id", "a").agg(F.min("d").alias("d"))
    return pairs.groupBy("pdb_id").agg(F.round(F.min("d"), 4).alias("min_nearest"), F.round(F.percentile("d", 0.5), 4).alias("median_nearest"), F.count_if(F.col("d") <= tolerance).alias("within"))


#: Ratio windows of the configurations.
WINDOWS = ((0.5, 2.0), (0.4, 2.5), (0.33, 3.0), (0.25, 4.0), (0.2, 5.0))


def config_overlap(pairs: DataFrame, n_total: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """How many of tool a's pockets have a partner, per window of volume ratios, and the best window.

    n_total: one row with n, the number of pockets of both tools.
    """
    spark = pairs.sparkSession
    grid = F.broadcast(spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(WINDOWS)], "config int, low double, high double"))  # fixed
    vb = transform(F.col("vb")) if transform else F.col("vb")
    ok = (F.col("va") > 0) & (vb > 0) & (F.col("va") / vb).between(F.col("low"), F.col("high"))
    hits = pairs.crossJoin(grid).where(ok).select("config", "pdb_id", "a").distinct().groupBy("config").agg(F.count("*").alias("hits"))
    rows = grid.join(hits, "config", "left").crossJoin(n_total)  # one row
    rows = rows.select("config", "low", "high", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("hits", F.lit(0)) * 2.0 / F.col("n"), 4).alias("overlap"))
    return rows.withColumn("best", F.col("config") == F.min_by("config", F.struct(-F.col("overlap"), "config")).over(W.partitionBy()))


def repaired(bad: DataFrame, by_id: DataFrame, by_rank: DataFrame, computed: DataFrame) -> DataFrame:
    """Zero centres replaced by those of the same id, else rank, else recomputed, else flagged."""
    rows, sources = bad, (("by_id", by_id, ["pdb_id", "pocket_id"]), ("by_rank", by_rank, ["pdb_id", "rank"]), ("computed", computed, ["pdb_id", "pocket_id"]))
    for name, other, key in sources:
        rows = rows.join(other.groupBy(*key).agg(F.first(F.struct(*CENTER)).alias(name)), key, "left")
    zero = S.zero_center(*CENTER)
    source = F.when(~zero, "kept")
    for name, *_ in sources:
        source = source.when(F.col(name).isNotNull(), name)
    new = F.coalesce(*(F.col(n) for n, *_ in sources))
    rows = rows.withColumn("center_source", source.otherwise("missing"))
    return rows.withColumns({c: F.when(zero, F.coalesce(new[c], F.col(c))).otherwise(F.col(c)) for c in CENTER}).drop(*(n for n, *_ in sources))


def repair_accounting(rows: DataFrame) -> DataFrame:
    """A34."""
    n = lambda k: F.count_if(F.col("center_source") == k).alias(k)
    fixed = F.count_if(F.col("center_source").isin("by_id", "by_rank", "computed"))
    zero = F.count_if(F.col("center_source") != "kept")
    return rows.agg(*map(n, ("kept", "by_id", "by_rank", "computed", "missing")), F.round(F.try_divide(fixed * 100.0, zero), 2).alias("recovered_pct"))


def with_docking(pockets: DataFrame, docking: DataFrame) -> DataFrame:
    """Whether any of a pocket's docking rows is validated."""
    seen = docking.groupBy("pdb_id", "pocket_id").agg(F.bool_or("validated").alias("docked"))
    return pockets.join(seen, ["pdb_id", "pocket_id"], "left").withColumn("docked", F.coalesce("docked", F.lit(False)))


def paired(a: DataFrame, b: DataFrame, key: str = "pdb_id", flag: str = "matched") -> DataFrame:
    """Two runs' outcomes side by side."""
    rows = a.select(key, F.col(flag).alias("a")).join(b.select(key, F.col(flag).alias("b")), key)
    return rows.withColumn("outcome", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither"))


def pairing_summary(pairs: DataFrame) -> DataFrame:
    """The four outcomes, and complementarity as the share that only one finds."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    lone = F.count_if(F.col("outcome").isin("only_a", "only_b"))
    return pairs.agg(*map(n, ("both", "only_a", "only_b", "neither")), F.round(F.try_divide(lone * 100.0, F.count("*")), 2).alias("complementarity_pct"))


def impact(outcomes: DataFrame) -> DataFrame:
    """One row per case, a column per configuration, and whether the refined one loses a hit."""
    rows = outcomes.groupBy("pdb_id").pivot("config", ["legacy", "refined"]).agg(F.bool_or("matched"))
    return rows.withColumns({"regressed": F.col("legacy") & ~F.col("refined"), "improved": ~F.col("legacy") & F.col("refined")})


def calibrated(values: DataFrame, source: DataFrame, target: DataFrame, least: int = 10, boost_max: float = 0.0, boost_power: float = 1.0) -> DataFrame:
    """Volumes mapped to the same quantile of the target's volumes, per protein.

    The rank is the number of source volumes below; with fewer than `least` volumes on a side
    a volume stays as it is. boost_max raises the volumes of low ranks.
    """
    own = source.groupBy("pdb_id").agg(F.array_sort(F.collect_list("volume")).alias("src"))
    aim = target.groupBy("pdb_id").agg(F.array_sort(F.collect_list("volume")).alias("dst"))
    rows = values.join(own, "pdb_id", "left").join(aim, "pdb_id", "left")
    below = F.size(F.filter("src", lambda x: x < F.col("volume")))
    share = below / F.greatest(F.size("src") - 1, F.lit(1))
    at = F.least(F.bround(share * (F.size("dst") - 1)).cast("int"), F.size("dst") - 1)
    ready = (F.size("src") >= least) & (F.size("dst") >= least)
    return rows.withColumn("calibrated", F.when(F.coalesce(ready, F.lit(False)), F.try_element_at("dst", at + 1) * (F.lit(1.0) + F.pow(F.lit(1.0) - F.least(F.lit(1.0), share), boost_power) * max(0.0, boost_max))).otherwise(F.col("volume"))).drop("src", "dst")


def nearest_rank(rows: DataFrame, column: str, shares: dict[str, float], key: str | None = None) -> DataFrame:
    """Nearest-rank percentiles, sorted[round((n - 1) p)], rounding half to even."""
    group = [key] if key else []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    if key:
        counts = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(key).orderBy(column)))
    else:
        counts = ordered.running(counts, column, ordered.size_bucket(F.col(column)), {"_upto": "_n"})
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_total")).where("_total > 0")  # one row, or one for each key
    joined = counts.join(total, key) if key else counts.join(F.broadcast(total))
    pick = lambda p: F.min(F.when(F.col("_upto") > F.bround((F.col("_total") - 1) * p), F.col(column)))
    found = joined.groupBy(*group).agg(F.count("*").alias("_n"), *(F.round(pick(p), 4).alias(n) for n, p in shares.items()))
    return found.where("_n > 0").drop("_n")
