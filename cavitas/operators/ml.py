"""Feature tables, leakage-safe training sets, models and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import ordered
from cavitas.operators.validation import leaks, rate, split
from cavitas.session import stored

#: Names of the seventeen features.
GEOMETRIC = ("volume", "radius_geom", "radius_clear", "merged_vertices")
CHEMICAL = ("hydrophobic_ratio", "polar_atoms")
SCORES = ("volume_score", "hydrophobicity_score", "enclosure_score", "depth_score", "sphericity")
DYNAMICS = ("consensus_support_ratio", "consensus_center_stability", "consensus_volume_cv", "persistence_score", "persistence_consecutive_max", "persistence_flicker_count")
FEATURES = GEOMETRIC + CHEMICAL + SCORES + DYNAMICS


def features(pockets: DataFrame, names: tuple[str, ...] = FEATURES, keep: tuple[str, ...] = ("pdb_id", "pocket_id")) -> DataFrame:
    """The named features as finite doubles; columns that are missing are 0."""
    return pockets.select(*keep, *((S.safe_float(F.col(n)) if n in pockets.columns else F.lit(0.0)).alias(n) for n in names))


def summary(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Population statistics per feature."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("e")).select("e.*")
    return long.groupBy("feature").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"))


def normalised(rows: DataFrame, names: tuple[str, ...], fitted_on: DataFrame | None = None, method: str = "standard") -> DataFrame:
    """Features by the training rows' statistics; a feature without spread is divided by 1."""
    base = rows if fitted_on is None else fitted_on
    first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    stats = base.agg(*(first(n).alias(f"_a_{n}") for n in names), *(second(n).alias(f"_b_{n}") for n in names))
    wide = rows.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({n: (F.col(n) - F.col(f"_a_{n}")) / F.when(F.col(f"_b_{n}") > 1e-12, F.col(f"_b_{n}")).otherwise(1.0) for n in names}).select(*rows.columns)


def label_limits(rows: DataFrame, high: float = 0.75, low: float = 0.30) -> DataFrame:
    """Score percentiles by which labels are given."""
    return rows.agg(F.round(F.percentile("bio_score", high), 6).alias("positive_min"), F.round(F.percentile("bio_score", low), 6).alias("negative_max"))


def dataset(pockets: DataFrame, positive: float = 0.65, negative: float = 0.3, seed: str = "split") -> DataFrame:
    """Labelled rows (uncertain ones dropped), whole proteins split."""
    rows = pockets.withColumn("y_true", S.label_policy("bio_score", "druggable", positive, negative)).where("y_true >= 0")
    return split(rows, seed)


def manifest(rows: DataFrame) -> DataFrame:
    """Counts per split and a hash of the rows that does not depend on their order."""
    row_hash = F.xxhash64("pdb_id", "pocket_id", "y_true", "split")
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("y_true") == 1).alias("positives"), F.count_distinct("pdb_id").alias("proteins"), F.bit_xor(row_hash).alias("content_hash"))


def leakage(rows: DataFrame) -> DataFrame:
    """Number of proteins in more than one split."""
    return leaks(rows.select("pdb_id", "split")).agg(F.count("*").alias("leaked"))


def balanced(rows: DataFrame, label: str = "y_true") -> DataFrame:
    """Rows with weight n / (2 n_class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    return rows.join(F.broadcast(counts), label).withColumn("weight", F.col("_all") / (F.col("_n") * 2.0)).drop("_n", "_all")  # one row per class


def estimator(kind: str = "rf", seed: int = 42):
    """rf_held: the forest of rf; its growth holds each row's node in each tree, some 200 bytes a row, in place of walking down the trees at every level."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"labelCol": "y_true", "featuresCol": "features", "weightCol": "weight"}
    return {
        "rf": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common),
        "rf_held": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, cacheNodeIds=True, **common),
        "gbt": lambda: GBTClassifier(maxIter=20, maxDepth=5, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=50, **common),
    }[kind]()


def assembled(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep").transform(rows)


#: Rows that a task of a training holds, some 350 bytes each while a forest grows.
TASK_ROWS = 500_000
#: Rows, of few bytes but much work, from which all cores get a share.
WORK_ROWS = 20_000
#: Rows up to which a forest holds their nodes, too, and two models are trained at once.
HELD_ROWS = 20_000_000


def train(rows: DataFrame, names: tuple[str, ...], kind: str = "rf", seed: int = 42):
    """A fitted model; classes weigh the same.

    A trainer reads its rows many times and holds those of a task at once: where a task would have more than TASK_ROWS, or they are WORK_ROWS in all, they are dealt anew.
    """
    label = "y_true"
    columns = list(dict.fromkeys([*names, label]))
    some = balanced(rows).select(*columns, "weight")
    n = rows.count()
    tasks = -(-n // TASK_ROWS)
    if tasks > 1 or n >= WORK_ROWS:
        some = some.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism))
    return estimator("rf_held" if kind == "rf" and n <= HELD_ROWS else kind, seed).fit(assembled(some, names))


def _each(rows: DataFrame, work: Callable, of: Iterable) -> list:
    """work of each, two at once unless the rows are many: a training has many short steps that leave cores idle."""
    with ThreadPoolExecutor(2 if rows.count() <= HELD_ROWS else 1) as pool:
        return list(pool.map(work, of))


def predict(model, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with y_proba and y_pred."""
    from pyspark.ml.functions import vector_to_array

    found = model.transform(assembled(rows, names)).withColumn("y_proba", vector_to_array("probability")[1])
    return found.withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(rows: DataFrame, names: tuple[str, ...], kind: str = "rf", folds: int = 3):
    """Isotonic regression on scores that models without the row's fold give. Returns the fitted regression.

    Scores are rounded to four places, so it has 10001 boundaries at most.
    """
    from pyspark.ml.regression import IsotonicRegression

    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("pdb_id"), F.lit(folds)))
    scored = None
    for k in range(folds):
        part = predict(train(rows.where(F.col("_fold") != k), names, kind), rows.where(F.col("_fold") == k), names)
        part = part.groupBy(F.round("y_proba", 4).alias("y_proba")).agg(F.count("*").alias("n"), F.sum("y_true").alias("pos"))
        scored = part if scored is None else scored.unionByName(part)
    # rows of one score are one point of their mean and number to the regression; stored, so that it runs no models again
    per = scored.groupBy("y_proba").agg(F.sum("n").cast("double").alias("weight"), (F.sum("pos") / F.sum("n")).alias("y_true"))
    return IsotonicRegression(labelCol="y_true", featuresCol="y_proba", weightCol="weight").fit(stored(per, "scores"))


def importances(model, names: tuple[str, ...], spark) -> DataFrame:
    """M09."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return spark.createDataFrame(list(zip(names, map(float, values), strict=True)), "feature string, importance double")


def metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Confusion matrix, accuracy, precision, recall and F1; empty denominators give 0."""
    n = lambda y, p: F.count_if((F.col("y_true") == y) & (F.col("y_pred") == p))
    tp, fp, fn, tn = n(1, 1), n(0, 1), n(1, 0), n(0, 0)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, F.count("*"), 6).alias("accuracy"), rate(tp, tp + fp, 6).alias("precision"), rate(tp, tp + fn, 6).alias("recall"), rate(tp * 2.0, tp * 2 + fp + fn, 6).alias("f1"))


def ranking(rows: DataFrame) -> DataFrame:
    """ROC-AUC by rank sums with tied ranks averaged, and step-form average precision; null with one class.

    Both come from counts per distinct probability, so equal scores never need an order.
    """
    per = rows.groupBy("y_proba").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("pos"))
    at = ordered.share_bucket(F.col("y_proba"))
    per = ordered.running(per, "y_proba", at, {"upto": "n"})
    per = ordered.running(per, "y_proba", at, {"tp": "pos", "seen": "n"}, descending=True)
    per = per.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    one = per.agg(F.sum("pos").alias("p"), F.sum("n").alias("all"), F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"))
    p, q = F.col("p"), F.col("all") - F.col("p")
    both = (p > 0) & (q > 0)
    return one.select(F.when(both, F.round((F.col("r") - p * (p + 1) / 2.0) / (p * q), 6)).alias("roc_auc"), F.when(both, F.round(F.col("ap") / p, 6)).alias("average_precision"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins; probability 1 is in no bin."""
    own = rows.where((F.col("y_proba") >= 0) & (F.col("y_proba") < 1)).groupBy(F.floor(F.col("y_proba") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("y_true").cast("double")).alias("acc"), F.avg("y_proba").alias("conf"))
    total = rows.agg(F.count("*").alias("total"))
    return own.crossJoin(total).agg(F.round(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("conf"))), 6).alias("ece"))  # one row each


def at_k(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """Precision and recall among the k highest probabilities."""
    top = rows.orderBy(F.col("y_proba").desc(), tie).limit(k).agg(F.sum("y_true").alias("hits"), F.count("*").alias("k"))
    return top.crossJoin(rows.agg(F.sum("y_true").alias("positives"))).select("hits", "k", rate(F.col("hits"), F.col("k"), 6).alias("precision_at_k"), rate(F.col("hits"), F.col("positives"), 6).alias("recall_at_k"))  # one row each


def ablation(rows: DataFrame, test: DataFrame, names: tuple[str, ...], trainer: Callable | None = None) -> DataFrame:
    """F1 without each feature in turn, by the size of the change. A loop over features, not over data."""
    trainer = trainer or train
    f1 = lambda some: metrics(predict(trainer(rows, some), test, some)).first()["f1"]
    whole, *others = _each(rows, f1, [names, *(tuple(m for m in names if m != n) for n in names)])
    found = [(n, float(x), float(x - whole)) for n, x in zip(names, others, strict=True)]
    return rows.sparkSession.createDataFrame(found, "without string, f1 double, delta double").orderBy(F.abs("delta").desc(), "without")


def compared(rows: DataFrame, test: DataFrame, names: tuple[str, ...], kinds: tuple[str, ...] = ("rf", "gbt", "logistic")) -> DataFrame:
    """Models by average precision, the best marked."""
    ranked = lambda kind: ranking(predict(train(rows, names, kind), test, names)).first()
    found = [(kind, float(r["roc_auc"] or 0), float(r["average_precision"] or 0)) for kind, r in zip(kinds, _each(rows, ranked, kinds), strict=True)]
    table = rows.sparkSession.createDataFrame(found, "model string, roc_auc double, average_precision double")
    return table.withColumn("best", F.col("model") == F.max_by("model", F.struct("average_precision", "model")).over(W.partitionBy()))


def reranked(rows: DataFrame, score: str | Column = "y_proba") -> DataFrame:
    """W03."""
    w = W.partitionBy("pdb_id").orderBy(S.col(score).desc_nulls_last(), "pocket_id")
    return rows.withColumn("ml_rank", F.row_number().over(w))
