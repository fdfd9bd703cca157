"""Resampling and tests, as Spark aggregations; only one-row results meet Python."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.operators import ordered


#: Cells of fewer rows draw their weights from Poisson's distribution itself, larger ones from the normal one of the same mean and variance.
SMALL, TERMS = 12, 40


def poisson_table() -> list[list[float]]:
    """For means 1 to SMALL - 1 the probability of at most 0, 1, ... TERMS - 1."""
    each = [[math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(TERMS)] for m in range(1, SMALL)]
    return [list(accumulate(row)) for row in each]


def _uniform(digest: Column, first: int) -> Column:
    """A number in (0, 1) from eight hexadecimal digits."""
    return (F.conv(F.substring(digest, first, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def draws(cells: DataFrame, b: int, n: int, seed: int) -> DataFrame:
    """Each cell in each of b resamples of n rows: draw, and weight, how many rows the resample takes of the cell.

    cells: cell, its name, and size, how many rows have its values. Weights are Poisson draws, a hash of seed, n, draw and cell; so a
    resample has n rows on average, and the statistics have to be ratios of sums. No row is numbered and none is joined.
    """
    each = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:{n}:"), F.col("draw").cast("string"), F.lit(":"), F.col("cell")).cast("binary"), 256)
    each = each.withColumn("_u", F.struct(_uniform(digest, 1).alias("a"), _uniform(digest, 9).alias("b")))
    below = F.array(*(F.array(*map(F.lit, row)) for row in poisson_table()))
    small = F.size(F.filter(F.element_at(below, F.least("size", F.lit(SMALL - 1)).cast("int")), lambda c: F.col("_u.a") > c))
    size = F.col("size").cast("double")
    normal = F.round(size + F.sqrt(size) * F.sqrt(F.log("_u.a") * -2.0) * F.cos(F.col("_u.b") * (2 * math.pi)))
    return each.withColumn("weight", F.when(F.col("size") < SMALL, small.cast("double")).otherwise(F.greatest(F.lit(0.0), normal))).drop("_u")


@dataclass(frozen=True)
class Ratio:
    """A statistic that follows from sums over the rows: formula gets the sums of `parts` by name."""

    parts: dict[str, Column]
    formula: Callable[[dict[str, Column]], Column]

    def of(self, weight: Column | None = None) -> Column:
        sums = {k: F.sum(c if weight is None else c * weight) for k, c in self.parts.items()}
        return self.formula(sums)


def mean_of(column: str) -> Ratio:
    return Ratio({"x": F.col(column), "n": F.lit(1.0)}, lambda t: F.try_divide(t["x"], t["n"]))


def ratio_of(above: str, below: str) -> Ratio:
    return Ratio({"a": F.col(above), "b": F.col(below)}, lambda t: F.try_divide(t["a"], t["b"]))


def bootstrap(rows: DataFrame, key: str, statistic: Ratio | Callable[[], Column], b: int = 3000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The statistic, and its percentile interval over b resamples of the rows.

    Of a Ratio, rows of equal values are one cell, so b resamples of any number of rows cost b times the distinct values; sums are
    kept per draw in each task, and b rows a task are shuffled. Any other aggregate that does not change when all rows are doubled takes each row as a
    cell of its own, named by its key. One number goes to the driver, that of the rows.
    """
    n = rows.count()
    own = rows.agg((statistic.of() if isinstance(statistic, Ratio) else statistic()).alias("estimate"))
    if not n:
        return own.select("estimate", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("n"))
    if isinstance(statistic, Ratio):
        values = [c.alias(k) for k, c in statistic.parts.items()]
        names = list(statistic.parts)
        cells = rows.select(*values).groupBy(*names).agg(F.count("*").alias("size")).withColumn("cell", F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in names)))
        drawn = draws(cells, b, n, seed)
        each = drawn.groupBy("draw").agg(Ratio({k: F.col(k) for k in names}, statistic.formula).of(F.col("weight")).alias("s"))
    else:
        cells = rows.withColumns({"cell": F.col(key).cast("string"), "size": F.lit(1)})
        drawn = draws(cells, b, n, seed).where("weight > 0")
        each = drawn.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).groupBy("draw").agg(statistic().alias("s"))
    tail = (1 - level) / 2
    ci = each.agg(F.percentile("s", tail).alias("low"), F.percentile("s", 1 - tail).alias("high"))
    return own.crossJoin(ci).select(F.round("estimate", 4).alias("estimate"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.lit(n).cast("long").alias("n"))  # one row each


def dice() -> Column:
    """X02's ratio of sums over proteins; `ratio_of` with doubled matches is its form for resampling."""
    return F.sum("matched") * 2.0 / (F.sum("n_a") + F.sum("n_b"))


def overlap_stats(per: DataFrame) -> DataFrame:
    """Mean and global Dice, proteins with any match, and Cohen's d against 0."""
    return per.agg(F.round(F.avg("dice"), 4).alias("mean_dice"), F.round(dice(), 4).alias("global_dice"), F.count_if(F.col("dice") > 0).alias("nonzero"), F.count("*").alias("n"), F.round(F.try_divide(F.avg("dice"), F.stddev_samp("dice")), 4).alias("cohens_d"))


def recall_stats(results: DataFrame) -> DataFrame:
    """Recall, and mean distances of matched and unmatched cases."""
    mean = lambda c: F.round(F.avg(F.when(c, F.col("best_distance"))), 4)
    return results.agg(F.count("*").alias("n"), F.count_if("matched").alias("hits"), F.round(F.avg(F.col("matched").cast("double")), 4).alias("recall"), mean(F.col("matched")).alias("matched_distance"), mean(~F.col("matched")).alias("unmatched_distance"))


def wilcoxon(rows: DataFrame, column: str, mu: float = 0.0) -> DataFrame:
    """One-sided signed-rank test by the normal approximation with tie correction; null under ten differences.

    Ranks come from counts per distinct size, so ties get their average rank.
    """
    d = rows.select((F.col(column) - mu).alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    upto = ordered.running(sizes, "a", ordered.size_bucket(F.col("a")), {"upto": "t"})
    ranks = upto.withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0)
    one = ranks.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (n * 2 + 1) / 24 - F.col("ties") / 48)
    return one.select("n", F.round("w", 4).alias("w_plus"), F.when(n >= 10, F.round(z, 4)).alias("z"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            total *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    half = 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_test(rows: DataFrame, column: str, mu: float = 0.0) -> DataFrame:
    """One-sided one-sample t test."""
    one = rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    one = one.withColumn("t", F.when((F.col("n") > 1) & (F.col("sd") > 0), (F.col("mean") - mu) / (F.col("sd") / F.sqrt("n"))))
    p = F.pandas_udf(lambda t, n: pd.Series([t_tail(a, b - 1) if a == a and a is not None else None for a, b in zip(t, n, strict=True)]), "double")
    return one.select("n", F.round("mean", 4).alias("mean"), F.round("t", 4).alias("t"), F.round(p("t", "n"), 6).alias("p"))


def permutation(per: DataFrame, b: int = 1000, seed: int = 42) -> DataFrame:
    """Label-swap test of the global Dice; as a swap leaves both sums' total as it is, every draw equals the observed value.

    Coins are hashes of draw and protein; each task adds up its proteins' sums for every draw.
    """
    coin = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), "pdb_id").cast("binary"), 256), 1, 1) < "8"
    rows = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("swap", coin)
    sums = {"p": F.sum(F.when(F.col("swap"), F.col("n_b")).otherwise(F.col("n_a"))), "q": F.sum(F.when(F.col("swap"), F.col("n_a")).otherwise(F.col("n_b")))}
    each = rows.groupBy("draw").agg((F.sum("matched") * 2.0 / (sums["p"] + sums["q"])).alias("s"))
    return each.crossJoin(F.broadcast(per.agg(dice().alias("observed")))).agg(F.round(F.first("observed"), 4).alias("observed"), F.count("*").alias("draws"), F.round(F.avg((F.col("s") >= F.col("observed") - 1e-12).cast("double")), 4).alias("p"))  # one row


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts, exact two-sided binomial p, and the corrected chi-squared value; p is 1 without discordance."""
    one = pairs.agg(F.count_if(F.col("outcome") == "only_a").alias("n10"), F.count_if(F.col("outcome") == "only_b").alias("n01"))
    n, k = F.col("n10") + F.col("n01"), F.least("n10", "n01")
    # the terms C(n, i) / 2**n in logarithms, so that large n stays finite
    logs = F.transform(F.sequence(F.lit(0), k), lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) - n * math.log(2)))
    p = F.least(F.lit(1.0), F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) * 2.0)
    chi = F.try_divide(F.pow(F.greatest(F.abs(F.col("n10") - F.col("n01")) - 1, F.lit(0)), 2), n.cast("double"))
    return one.select("n10", "n01", F.round(F.when(n == 0, 1.0).otherwise(p), 6).alias("p_exact"), F.round(F.coalesce(chi, F.lit(0.0)), 4).alias("chi2"), F.when(n == 0, "none").otherwise("exact_binomial").alias("method"))


def _log_factorial(n: Column) -> Column:
    """ln n!: a sum of logarithms up to 50, Stirling's series above."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(50)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    large = x * F.log(x) - x + F.log(x * (2 * math.pi)) * 0.5 + F.lit(1.0) / (x * 12.0) - F.lit(1.0) / (x * x * x * 360.0)
    return F.when(n <= 50, small).otherwise(large)


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """X11: each test against alpha over their number."""
    limit = F.lit(alpha) / F.count("*").over(W.partitionBy())
    rows = tests.withColumn("threshold", F.round(limit, 6))
    return rows.withColumn("significant", F.coalesce(F.col("p") < F.col("threshold"), F.lit(False)))


def fpr_stats(rows: DataFrame, b: int = 3000, seed: int = 42) -> DataFrame:
    """The false-positive rate of judged candidates with its interval. rows: pdb_id, pocket_id, status."""
    judged = rows.where("status <> 'unknown'").select(F.concat_ws(":", "pdb_id", F.col("pocket_id").cast("string")).alias("key"), (F.col("status") == "unsupported").cast("double").alias("wrong"))
    return bootstrap(judged, "key", mean_of("wrong"), b, seed=seed)
