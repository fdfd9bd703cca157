"""Atlas queries, predicates and rollups: one job over all proteins each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S

CENTER = ("center_x", "center_y", "center_z")
#: Rows that a task sorts at once, about, where rows are dealt by their number.
TASK_ROWS = 1 << 20

def by(*keys: Column | str, partition: str | list[str] | None = None) -> W:
    w = W.partitionBy(partition) if partition else W.partitionBy()
    return w.orderBy(*keys)


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def desc_number(c: str) -> Column:
    """Falling numbers, those that are NaN or missing last."""
    return F.nanvl(F.col(c), F.lit(None).cast("double")).desc_nulls_last()


def mean_of_places(column: str, places: int = 4, result: int = 6) -> Column:
    """The mean of non-negative numbers of so many decimal places, rounded half up: added up as integers, so that no order of summing matters."""
    whole = f"sum(cast(round(`{column}` * {10**places}) as bigint)) * {2 * 10 ** (result - places)} + count(`{column}`)"
    return F.expr(f"cast(({whole}) div nullif(2 * count(`{column}`), 0) as double)") / 10.0**result


def scored(pockets: DataFrame, profile="default") -> DataFrame:
    """component scores, bio_score and class of every cavity."""
    metrics = [S.normalize_volume("volume"), S.normalize_hydrophobicity("hydrophobic_ratio"), S.clamp(F.col("enclosure_score")), S.clamp(F.col("depth_score"))]
    rows = pockets.withColumns({"volume_score": metrics[0], "hydrophobicity_score": metrics[1], "bio_score": S.bio_score(*metrics, profile=profile)})
    return rows.withColumns({"druggability_class": S.druggability_class("bio_score"), "profile_used": F.lit(profile if isinstance(profile, str) else "custom")})


def ranked(pockets: DataFrame, top_n: int | None = None, score: str = "bio_score", key: str = "pdb_id", tie: str = "pocket_id") -> DataFrame:
    """Rank by score within each protein, ties by id; the first top_n of each if given."""
    rows = pockets.withColumn("rank", F.row_number().over(by(desc_number(score), tie, partition=key)))
    return rows if top_n is None else rows.where(F.col("rank") <= top_n)


def elite_of_each(pockets: DataFrame, min_score: float, top_n: int) -> DataFrame:
    """Rank, then the floor, then the first top_n."""
    rows = ranked(pockets).where(F.col("bio_score") >= min_score)
    return rows.withColumn("n", F.row_number().over(by("rank", partition="pdb_id"))).where(F.col("n") <= top_n).drop("n")


def lookup(table: DataFrame, pdb_id: str, pocket_id: int | None = None) -> DataFrame:
    """Q01, Q02: one protein's rows, in the order of their ranks if they have any."""
    rows = table.where(F.col("pdb_id") == pdb_id.strip().upper())
    rows = rows if pocket_id is None else rows.where(F.col("pocket_id") == pocket_id)
    return rows.orderBy("rank", "pocket_id") if "rank" in rows.columns else rows


def page(rows: DataFrame, limit: int, offset: int, *order: Column | str) -> DataFrame:
    """One page of the rows in the given order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def score_range(pockets: DataFrame, low: float, high: float, limit: int = 100, offset: int = 0) -> DataFrame:
    """Q03."""
    return page(pockets.where(F.col("bio_score").between(low, high)), limit, offset, desc("bio_score"), "pdb_id", "pocket_id")


def druggable(pockets: DataFrame, class_: str | None = None, min_volume: float = 0.0, limit: int = 1000) -> DataFrame:
    """Q04."""
    rows = pockets.where(F.col("druggable") & (F.col("volume") >= min_volume))
    rows = rows if class_ is None else rows.where(F.col("druggability_class") == class_)
    return page(rows, limit, 0, desc("bio_score"), "pdb_id", "pocket_id")


def elite(pockets: DataFrame, min_score: float = 0.6, min_volume: float = 100.0, limit: int = 1000) -> DataFrame:
    """Q05."""
    rows = pockets.where(F.col("druggable") & (F.col("bio_score") >= min_score) & (F.col("volume") >= min_volume))
    return page(rows, limit, 0, desc("bio_score"), "pdb_id", "pocket_id")


def search(pockets: DataFrame, *, pdb_id=None, min_score=None, max_score=None, min_volume=None, max_volume=None, druggable=None, class_=None, max_rank=None, order: str = "bio_score_desc", limit: int = 100, offset: int = 0) -> DataFrame:
    """Q06: any of eight conditions, an order from a fixed list, one page."""
    c = F.col
    wanted = [
        (pdb_id, lambda v: c("pdb_id") == v.strip().upper()),
        (min_score, lambda v: c("bio_score") >= v),
        (max_score, lambda v: c("bio_score") <= v),
        (min_volume, lambda v: c("volume") >= v),
        (max_volume, lambda v: c("volume") <= v),
        (druggable, lambda v: c("druggable") == v),
        (class_, lambda v: c("druggability_class") == v),
        (max_rank, lambda v: c("rank") <= v),
    ]
    for value, condition in wanted:
        if value is not None:
            pockets = pockets.where(condition(value))
    name, _, way = order.rpartition("_")
    key = name if name in ("bio_score", "volume", "rank", "pdb_id") and way in ("asc", "desc") else "bio_score"
    first = c(key).asc() if way == "asc" and key == name else desc(key)
    return page(pockets, limit, offset, first, "pdb_id", "pocket_id")


def proteins(pockets: DataFrame) -> DataFrame:
    """Per protein counts, best and mean score, mean volume and counts by class."""
    n = lambda cond: F.count_if(cond)
    c = F.col("druggability_class")
    return pockets.groupBy("pdb_id").agg(
        F.count("*").alias("total_cavities"),
        n(F.col("druggable")).alias("druggable_count"),
        n(c == "high").alias("high_score"),
        n(c == "medium").alias("medium_score"),
        n(c == "low").alias("low_score"),
        F.max("bio_score").alias("top_bio_score"),
        F.round(F.avg("bio_score"), 4).alias("avg_bio_score"),
        F.round(F.avg("volume"), 2).alias("avg_volume"),
    )


def statistics(pockets: DataFrame) -> DataFrame:
    """One row of counts and score statistics; the averages are null for an empty atlas."""
    return pockets.agg(
        F.count_distinct("pdb_id").alias("total_proteins"),
        F.count("*").alias("total_pockets"),
        F.count_if(F.col("druggable")).alias("druggable_pockets"),
        F.count_if(F.col("druggable") & (F.col("bio_score") >= 0.6)).alias("elite_pockets"),
        F.round(F.avg("bio_score"), 4).alias("avg_bio_score"),
        F.min("bio_score").alias("min_bio_score"),
        F.max("bio_score").alias("max_bio_score"),
        F.round(F.avg("volume"), 2).alias("avg_volume"),
    )


def class_distribution(pockets: DataFrame, column: str = "druggability_class") -> DataFrame:
    """A02."""
    return pockets.groupBy(column).agg(F.count("*").alias("n"))


def distribution_map(pockets: DataFrame, column: str = "druggability_class") -> DataFrame:
    """A02 as one map."""
    return class_distribution(pockets, column).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("distribution"))


def leaders(proteins_: DataFrame, n: int = 10) -> DataFrame:
    """Q08: proteins by best score."""
    return proteins_.orderBy(desc("top_bio_score"), "pdb_id").limit(n)


def overview(pockets: DataFrame, n: int = 8) -> DataFrame:
    """Q11: statistics, class map and leaders, as one row."""
    top = leaders(proteins(pockets), n).agg(F.array_sort(F.collect_list(F.struct((-F.col("top_bio_score")).alias("order"), "pdb_id", "top_bio_score"))).alias("leaders"))
    return statistics(pockets).crossJoin(distribution_map(pockets)).crossJoin(top)  # one row each


def best_of_each(pockets: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Q09: each protein's best pocket, else that of a fallback table."""
    pick = F.max_by(F.struct("pocket_id", "bio_score", *CENTER), F.struct("bio_score", -F.col("pocket_id")))
    best = pockets.groupBy("pdb_id").agg(pick.alias("best"))
    if fallback is None:
        return best.select("pdb_id", "best.*")
    other = fallback.groupBy("pdb_id").agg(pick.alias("other"))
    return best.join(other, "pdb_id", "full").select("pdb_id", F.coalesce("best", "other").alias("best")).select("pdb_id", "best.*")


def top_extract(pockets: DataFrame, top_n: int = 20, min_volume: float = 100.0) -> DataFrame:
    """Druggable pockets of some volume, the best top_n of each protein."""
    return ranked(pockets.where(F.col("druggable") & (F.col("volume") >= min_volume)), top_n)


def worth_storing(pockets: DataFrame, top_n: int = 50) -> DataFrame:
    """P14."""
    return pockets.where((F.col("rank") <= top_n) & (F.col("druggable") | F.col("druggability_class").isin("high", "medium")))


def histogram(pockets: DataFrame, column: str = "bio_score", low: float = 0.0, high: float = 1.0, bins: int = 20) -> DataFrame:
    """Q14: counts by bin; the upper end belongs to the last."""
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return pockets.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def contains_page(rows: DataFrame, text: str, page_no: int, size: int) -> DataFrame:
    """Q15: ids that contain the text, one page of them with the number of pages."""
    found = rows.where(F.col("pdb_id").contains(text.upper()))
    total = found.agg(F.ceil(F.count("*") / size).alias("pages"))
    return found.orderBy("pdb_id").offset((page_no - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows by their keys in parts of about TASK_ROWS of n rows, where the session's number of parts would leave more to one.

    By their bytes Spark would join small rows of many a part into one task, and a fixed number of parts grows with the table.
    """
    parts = -(-n // TASK_ROWS)
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if parts > 1 else rows


def middle_of_each(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The middle row of each group of the keys in the given order, of n rows in all; rows are sorted once."""
    group = by(order, partition=keys)
    size = F.count("*").over(group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    at = F.row_number().over(group) - 1
    return dealt(rows, n, *keys).withColumns({"_n": size, "_at": at}).where(F.col("_at") == F.floor(F.col("_n") / 2)).drop("_n", "_at")


def flag_zero_centers(rows: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """Rows centred on zero get three keys in their JSON metadata; other text is kept under a key of its own."""
    held = F.from_json(F.col(metadata), "map<string,string>")
    known = F.coalesce(held, F.when(F.col(metadata).isNotNull(), F.create_map(F.lit("legacy_metadata_raw"), F.col(metadata))), F.create_map().cast("map<string,string>"))
    extra = F.create_map(F.lit("center_valid"), F.lit("false"), F.lit("center_source"), F.lit("missing"), F.lit("needs_repair"), F.lit("true"))
    merged = F.map_concat(F.map_filter(known, lambda k, _: ~k.isin("center_valid", "center_source", "needs_repair")), extra)
    return rows.withColumn(metadata, F.when(S.zero_center(*CENTER), F.to_json(merged)).otherwise(F.col(metadata)))


def typed_view(rows: DataFrame) -> DataFrame:
    """What a client is shown: no nulls, flags as booleans, sphericity out of the JSON."""
    return rows.select("pdb_id", "pocket_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("bio_score", F.lit(0.0)).alias("bio_score"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce(F.col("druggable").cast("boolean"), F.lit(False)).alias("druggable"), S.json_number("metadata_json", "$.sphericity").alias("sphericity"))


def admitted(atoms: DataFrame, least: int = 50, most: int = 100_000, box: float = 1000.0) -> DataFrame:
    """Structures and the reason for which they are not admitted, null if they are."""
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1).otherwise(0) for c in "xyz"), F.lit(0))
    per = atoms.groupBy("pdb_id").agg(F.count("*").alias("n_atoms"), F.sum(bad).alias("n_bad"), *(F.round(F.max(c) - F.min(c), 4).alias(f"d{c}") for c in "xyz"))
    reason = F.when(F.col("n_atoms") < least, "too_few").when(F.col("n_atoms") > most, "too_many").when(F.col("n_bad") > 0, "bad_number").when(F.greatest("dx", "dy", "dz") > box, "box")
    return per.withColumn("reason", reason)


def thresholds(per: DataFrame, n: str = "n_atoms", n_voids: str | None = None, merge: float = 3.0, min_volume: float = 60.0) -> DataFrame:
    """Largest clearance and least volume by the number of atoms, merge distance by that of voids."""
    atoms = F.col(n)
    rows = per.withColumn("clearance_max", F.when(atoms > 2000, 12.0).when(atoms < 500, 9.0).otherwise(10.0))
    rows = rows.withColumn("volume_min", F.when(atoms < 300, min(min_volume, 40.0)).when(atoms > 3000, min_volume * 1.2).otherwise(min_volume))
    if n_voids is None:
        return rows
    v = F.col(n_voids)
    base = F.when(v > 200, merge + 1.5).when(v > 100, merge + 1.0).when(v < 10, max(2.5, merge - 0.5)).otherwise(merge)
    return rows.withColumn("merge_threshold", base + F.when(atoms > 2000, 0.5).otherwise(0.0))


def voids(rows: DataFrame, min_volume: float = 0.0, max_volume: float = 5000.0, low: float = 2.5, slack: float = 2.0) -> DataFrame:
    """Voids whose clearance is in the window, one for each rounded centre, by volume."""
    kept = rows.where(F.col("clearance").between(low, F.col("clearance_max") + slack) & F.col("volume").between(min_volume, max_volume))
    first = by((F.col("clearance") > F.col("clearance_max")).asc(), "ordinal", partition=["pdb_id", *(f"_{c}" for c in "xyz")])
    rounded = kept.withColumns({f"_{c}": F.round(c, 2) for c in "xyz"})
    return rounded.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_x", "_y", "_z").orderBy(desc("volume"), "pdb_id", "ordinal")


def chart_tables(pockets: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Q13, Q14: the tables behind the charts: mean score by rank, volume bins with scores, class counts, best proteins."""
    bin_ = F.floor(F.col("volume") / 250).cast("int")
    return {
        "score_by_rank": pockets.groupBy("rank").agg(mean_of_places("bio_score").alias("avg_score"), F.count("*").alias("n")),
        "volume_score": pockets.groupBy(bin_.alias("bin")).agg(mean_of_places("bio_score").alias("avg_score"), F.count("*").alias("n")),
        "classes": class_distribution(pockets),
        "best": leaders(pockets.groupBy("pdb_id").agg(F.max("bio_score").alias("top_bio_score")), n),
    }
