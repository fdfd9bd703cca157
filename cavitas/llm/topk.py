"""Operator 5, exact top-k search over norm-sorted vectors with SVD-rotated bounds.

Vectors are turned into whole numbers, so scores are exact. Candidates are
written once, range-partitioned by falling length and ordered so within each
partition. Queries come in blocks of a fixed number of rows; a block is first
run against the longest vectors, which gives every query a lower bound of its
k-th score, and is then broadcast to all partitions. A task takes its vectors
by falling length in chunks: a query stops at the first chunk whose length
bound |q||x| is below its k-th score, and pairs whose partial product over the
leading rotated dimensions plus the Cauchy-Schwarz bound of the rest
stays below it are never scored. The rotation comes from the eigenvectors of
the candidates' second moments, summed up over partitions.

Edge cases: vectors that are null, empty, hold a null or a non-finite component, or
have a null id take no part; vectors of another length than the query's do not
meet it; rows with the query's own vec_id are never its answers; repeated
candidate rows count each; equal query rows are answered once. Without queries
or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.llm.shared import stored

#: Queries broadcast at once: at 64 components about 8 MB.
BLOCK = 16_384
#: The longest vectors, by which a block's first bounds are found.
HEAD = 8_192
CHUNK = 2_048
QUERIES_AT_ONCE = 512


def whole(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def valid(vector: str = "embedding") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch, dim)
            total += m.T @ m
        yield pa.record_batch([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["at", "x"])

    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all candidates, the strongest first; dim x dim numbers reach the driver."""
    found = rows.select("v").mapInArrow(_moments(dim), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    moments = np.zeros(dim * dim)
    moments[found["at"].to_numpy()] = found["x"].to_numpy()
    return np.linalg.eigh(moments.reshape(dim, dim))[1][:, ::-1]


def _search(block, k: int, dim: int, lead: int):
    """A task's k best candidates of each query of the block that reach the bounds known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, turn, bound = block.value
        q_turned, length = q @ turn, np.sqrt((q * q).sum(axis=1))
        q_rest = np.sqrt((q_turned[:, lead:] ** 2).sum(axis=1))
        slack = 1e-9 * length
        scores, vecs = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        floor = bound.copy()
        for batch in batches:
            m, own = _matrix(batch, dim), batch["vec_id"].to_numpy()
            for i in range(0, len(m), CHUNK):
                x, x_id = m[i : i + CHUNK], own[i : i + CHUNK]
                x_turned, x_length = x @ turn, np.sqrt((x * x).sum(axis=1))
                x_rest = np.sqrt((x_turned[:, lead:] ** 2).sum(axis=1))
                live = np.flatnonzero(length * x_length.max() + slack * x_length.max() >= floor)
                for part in np.split(live, range(QUERIES_AT_ONCE, len(live), QUERIES_AT_ONCE)):
                    if not len(part):
                        continue
                    most = q_turned[part, :lead] @ x_turned[:, :lead].T + q_rest[part, None] * x_rest + slack[part, None] * x_length
                    a, b = np.nonzero((most >= floor[part, None]) & (ids[part, None] != x_id))
                    for j in range(0, len(a), 1 << 17):
                        of, at = part[a[j : j + (1 << 17)]], b[j : j + (1 << 17)]
                        score = np.einsum("ij,ij->i", q[of], x[at])  # whole numbers: exact below 2**53
                        good = score >= floor[of]
                        of, vec, score = of[good], x_id[at[good]], score[good]
                        met = np.unique(of)
                        of = np.concatenate([of, np.repeat(met, k)])
                        score, vec = np.concatenate([score, scores[met].ravel()]), np.concatenate([vec, vecs[met].ravel()])
                        order = np.lexsort((vec, -score, of))
                        of, score, vec = of[order], score[order], vec[order]
                        first = np.flatnonzero(np.diff(of, prepend=-1))
                        take = first[:, None] + np.arange(k)
                        scores[met], vecs[met] = score[take], vec[take]
                        floor[met] = np.maximum(floor[met], scores[met, k - 1])
        at, rank = np.nonzero(np.isfinite(scores))
        yield pa.record_batch([pa.array(at), pa.array(vecs[at, rank]), pa.array(scores[at, rank].astype(np.int64))], names=["q", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query row."""
    spark = rows.sparkSession
    kept = rows.where(valid(vector) & F.col("vec_id").isNotNull())
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), whole(vector).alias("v"))
    kept = kept.withColumn("size", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(kept.repartitionByRange(parts, F.col("size").desc(), "vec_id").sortWithinPartitions(F.col("size").desc(), "vec_id"), "vectors")
    asked = kept.where("is_query").select("vec_id", "v").distinct()
    # queries by number, in blocks: numbered within hash buckets, so no task sees them all
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 10))
    order = asked.withColumn("salt", salt).withColumn("n", F.row_number().over(W.partitionBy("salt").orderBy("vec_id", "v")))
    order = stored(order.withColumn("slot", F.col("n").cast("long")), "queries")
    result = None
    schema = "q long, vec_id long, score long"
    for dim in [r.d for r in kept.select(F.size("v").alias("d")).distinct().collect()]:
        vectors, turn = kept.where(F.size("v") == dim), None
        queries = order.where(F.size("v") == dim)
        head = stored(vectors.orderBy(F.col("size").desc(), "vec_id").limit(HEAD), "head")
        for low, high in _blocks(queries):
            block = queries.where((F.col("slot") * 1024 + F.col("salt")).between(low, high)).select("vec_id", "v").toPandas()
            if block.empty:
                continue
            turn = rotation(vectors, dim) if turn is None else turn
            ids, q = block["vec_id"].to_numpy(), np.stack(block["v"].to_list()).astype(float)
            lead = max(1, dim // 4)
            seed = spark.sparkContext.broadcast((ids, q, turn, np.full(len(ids), -np.inf)))
            known = _best(head.select("vec_id", "v").mapInArrow(_search(seed, k, dim, lead), schema), k).where(F.col("rank") == k).select("q", "score").toPandas()
            bound = np.full(len(ids), -np.inf)
            bound[known["q"].to_numpy()] = known["score"].to_numpy()
            share = spark.sparkContext.broadcast((ids, q, turn, bound))
            found = _best(vectors.select("vec_id", "v").mapInArrow(_search(share, k, dim, lead), schema), k)
            of = spark.createDataFrame(block[["vec_id"]].rename(columns={"vec_id": "query_id"}).assign(q=range(len(ids))), "query_id long, q long")
            found = stored(found.join(of, "q").select("query_id", "rank", "vec_id", "score"), "answers")
            result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if result is None else result


def _blocks(queries: DataFrame) -> list[tuple[int, int]]:
    """Ranges of the queries' numbers; each holds about BLOCK queries, and BLOCK + 1024 numbers at most."""
    most = queries.agg(F.max(F.col("slot") * 1024 + F.col("salt"))).first()[0]
    return [] if most is None else [(i, i + BLOCK - 1) for i in range(0, most + 1, BLOCK)]


#: The same in DuckDB's SQL, for embeddings.
SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select distinct vec_id, v from e where vec_id % 50 = 0) q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
