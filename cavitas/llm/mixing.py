"""Operator 2, mixing sources to target weights by systematic sampling.

Every document of a source is expected target / size-of-source times. The
documents of a source are put in the order of their sizes, ties by a hash of
the id; a prefix sum of the expected copies plus one random offset per source
then emits a document once for each integer boundary it crosses. In this order
the words taken stay within about one document of the target.

The prefix sum is spread out: rows are range-partitioned by (source, size,
hash), written once, numbered within their partitions, and only the counts per
(partition, source) are summed up globally. A hot source spans many partitions.

Edge cases: a null text has size 0; a null source is a source of its own, the
last in order; sources without a word have target 0 and give nothing; repeated
rows each count. The same rows give the same mix in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.llm.shared import apart, stored

#: Copies of one document at most; a target stops at so many times its source.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def size_of(text: str = "text") -> Column:
    """Number of words: a word starts at each other byte that follows the start or white space."""
    blank = r"[\x20\x09-\x0D]"
    starts = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"[^\x20\x09-\x0D]+{blank}*", "w")
    return F.length(F.regexp_replace(starts, rf"^{blank}+", "")).cast("long")


def fraction(x: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the MD5 of x as text."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, none above most times its source.

    sizes: one row per source. Weights repeat in the order of the source names.
    Filling up by weight caps the sources in the order of cap / weight: the
    first that stays below its cap sets the level for it and all after it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    capped = F.coalesce(F.sum(F.col("source_size") * most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) - capped) / rest
    found = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("source_size") * most, F.struct(F.col("source_size") / F.col("w"), F.coalesce(F.col("source").isNull(), F.lit(True)), "source", "level"))).over(every)
    target = F.least(first["level"] * F.col("w"), (F.col("source_size") * most).cast("double"))
    return found.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def copies_of(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, size, source, source_size, target and copies for every row of docs."""
    spark = docs.sparkSession
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = stored(docs.select("doc_id", *keep, "source", size_of().alias("size")), "sizes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = narrow.withColumn("tie", F.md5(F.concat(F.lit(f"{seed}:"), id_text).cast("binary")))
    ranged = keyed.repartitionByRange(parts, "source", "size", "tie", "doc_id").sortWithinPartitions("source", "size", "tie", "doc_id")
    ranged = stored(ranged.select("doc_id", *keep, "source", "size", F.monotonically_increasing_id().alias("at")), "ranged")
    ranged = ranged.withColumn("part", F.shiftrightunsigned("at", 33))
    counts = ranged.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("size"))
    # one row per partition and source, so as many as partitions plus sources
    counts = stored(counts, "counts")
    before = F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    goals = targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    offset = fraction(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(goals.alias("g"), F.expr("c.source <=> g.source")).selectExpr("c.part", "c.source", "first - before as shift", "source_size", "target").withColumn("offset", offset)
    rows = ranged.alias("r").join(starts.alias("s"), F.expr("r.part = s.part and r.source <=> s.source"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.expr("at - shift").cast("double")
    copies = F.floor(each * (rank + 1) + F.col("offset")) - F.floor(each * rank + F.col("offset"))
    return rows.select("doc_id", *keep, "size", "r.source", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each document."""
    return copies_of(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    own, back = apart(docs, "row", "copies", "copy")
    rows = stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    taken = copies_of(rows, keep=("row",)).where("copies > 0").select("row", "copies")
    repeated = rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*own.columns).withColumnsRenamed(back)


#: The same in DuckDB's SQL, for documents.
SQL = r"""
with d as (
  select doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from s
), l as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as level from w
), f as (
  select level from l where level * w <= source_size * 3 order by source_size / w, source nulls last limit 1
), g as (
  select source, source_size, coalesce(least((select level from f) * w, (source_size * 3)::double), 0) as target,
    ('0x' || substr(md5('mix:' || coalesce('=' || source, '')), 1, 8))::bigint / 4294967296.0::double as u from l
), r as (
  select d.doc_id, d.size, g.source_size, g.target, g.u, case when g.source_size > 0 then g.target / g.source_size else 0 end as each,
    (row_number() over (partition by d.source order by d.size, md5('mix:' || coalesce(d.doc_id::varchar, '')), d.doc_id) - 1)::double as k
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, (floor(each * (k + 1) + u) - floor(each * k + u))::bigint * size as taken from r
"""
