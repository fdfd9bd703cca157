"""Incremental ingest and job feeds by Structured Streaming, with the batch forms of the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import store, tables
from cavitas.sources import readers


def ingest_reports(spark: SparkSession, source: str, target: store.Atlas | tables.Dataset, checkpoint: str) -> None:
    """All new report files into the atlas, the last report of a pocket or protein winning.

    The checkpoint remembers the files, so a restart goes on where it ended. Among the files of one batch the one that was
    changed last is the last, then the greater name, then the later line. Proteins and pockets are committed together;
    the batch number orders batches, so a repeated one changes nothing. A plain Dataset takes pockets alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seq = F.lit(batch_id).cast("long")
        batch = batch.withColumn("_order", F.struct("_changed", "_file", "_block", F.monotonically_increasing_id())).where("pdb_id is not null")
        pockets = readers.report_pockets(batch, "_order").where("pocket_id is not null")
        pockets = tables.latest(pockets, tables.KEYS["pockets"], "_order").drop("_order").withColumn("ingest_seq", seq)
        if isinstance(target, tables.Dataset):
            target.upsert(pockets, tables.KEYS["pockets"])
            return
        proteins = tables.latest(readers.report_proteins(batch, "_order", "runtime_seconds"), tables.KEYS["proteins"], "_order").drop("_order")
        proteins = proteins.withColumns({"ingest_seq": seq, "created_at": F.current_timestamp()})
        totals = batch.agg(F.count("*").cast("double").alias("reports"), F.coalesce(F.sum("runtime_seconds"), F.lit(0.0)).alias("runtime_seconds")).first().asDict()
        target.commit({"proteins": proteins, "pockets": pockets}, batch_id, totals)

    stream = spark.readStream.schema(readers.REPORT).json(source)
    stream = stream.withColumns({"_changed": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def crawl_progress(cases: DataFrame, target: store.Atlas) -> DataFrame:
    """Ids of the list, those done and those left, with the reports and seconds of all runs so far. The total is the present list's, not that of a run before."""
    done = target.read("proteins")
    ids = cases.select(S.norm_id("pdb_id").alias("pdb_id")).distinct()
    flagged = ids.withColumn("done", F.lit(False)) if done is None else ids.join(done.select("pdb_id", F.lit(True).alias("done")), "pdb_id", "left")
    sums = target.totals()
    counts = flagged.agg(F.count("*").alias("total"), F.count_if(F.coalesce("done", F.lit(False))).alias("done"))
    return counts.select("total", "done", (F.col("total") - F.col("done")).alias("left"), F.lit(int(sums.get("reports", 0))).cast("long").alias("reports"), F.lit(float(sums.get("runtime_seconds", 0))).alias("runtime_seconds"))


def status_counts(stream: DataFrame) -> DataFrame:
    """Results by status, for batch or stream."""
    return stream.groupBy("status").agg(F.count("*").alias("n"))


def run_available(rows: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream gives for all that is there now, as an in-memory table."""
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)


def submissions(rows: DataFrame) -> DataFrame:
    """Y04 in batch: per key the number of submissions, and whether payloads differ."""
    payload = S.hash_key("job_type", "payload")
    return rows.groupBy("key").agg(F.count("*").alias("submitted"), (F.count_distinct(payload) > 1).alias("conflict"), F.min("job_id").alias("job_id"))


def rate_limited(rows: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Each client's requests in order; those beyond `limit` accepted ones of the last seconds are rejected.

    Rejected requests do not count, so the rule is sequential per client. A task reads its clients' requests
    sorted, batch by batch, and holds the times of at most `limit` accepted ones, however many a client makes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, accepted = object(), []
        for batch in batches:
            ok, wait = [], []
            for client, t in zip(batch["client"].to_pylist(), batch["t"].to_pylist(), strict=True):
                if client != last:
                    last, accepted = client, []
                accepted = [x for x in accepted if t - x < seconds]
                good = len(accepted) < limit
                ok.append(good)
                wait.append(0.0 if good else round(seconds - (t - accepted[0]), 3))
                if good:
                    accepted.append(t)
            yield pa.RecordBatch.from_arrays([batch["client"], batch["job_id"], pa.array(ok, pa.bool_()), pa.array(wait, pa.float64())], names=["client", "job_id", "allowed", "retry_after"])

    kinds = dict(rows.dtypes)
    timed = rows.select("client", "job_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.repartition("client").sortWithinPartitions("client", "t", "job_id").mapInArrow(run, f"client {kinds['client']}, job_id {kinds['job_id']}, allowed boolean, retry_after double")


def request_counts(stream: DataFrame, width: str = "1 minute", slide: str = "30 seconds", delay: str = "5 minutes") -> DataFrame:
    """Y05, for watching: requests per client and sliding window."""
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    found = rows.groupBy(F.window("ts", width, slide), "client").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "client", "n")


def status_changes(rows: DataFrame, key: str = "client") -> DataFrame:
    """Rows whose status differs from the one before, of the same key."""
    before = F.lag("status").over(W.partitionBy(key).orderBy("ts", "job_id"))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("status"))).select(key, "job_id", "ts", "before", "status")


def status_feed(stream: DataFrame, key: str = "client") -> DataFrame:
    """Y06 on a stream: changes of status, with the last status as state."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for part in batches:
            for status in part.sort_values("ts")["status"]:
                if status != last:
                    rows.append((k[0], last, status))
                    last = status
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, "before", "status"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, before string, status string", "last string", "append", "NoTimeout")


def latency_windows(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Jobs, mean and approximate p95 latency per tumbling window."""
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    found = rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("jobs"), F.round(F.avg("latency"), 8).alias("avg_latency"), F.percentile_approx("latency", 0.95).alias("p95_approx"))
    return found.select(F.col("window.start").alias("start"), "jobs", "avg_latency", "p95_approx")


def cached(requests: DataFrame, results: DataFrame, max_hours: float = 168.0) -> DataFrame:
    """Requests met by a result of the same key that is not too old."""
    ok = results.select("key", F.col("ts").alias("made"))
    joined = requests.join(ok, "key", "left").withColumn("fresh", S.age_hours("made", "ts").between(0, max_hours))
    return joined.groupBy(*requests.columns).agg(F.coalesce(F.bool_or("fresh"), F.lit(False)).alias("hit"))


def remaining(cases: DataFrame, done: DataFrame, config: dict[str, str]) -> DataFrame:
    """Cases and modes not yet run under this very configuration."""
    key = F.sha2(F.lit(",".join(f"{k}={v}" for k, v in sorted(config.items()))).cast("binary"), 256)
    return cases.withColumn("config_hash", key).join(done.select("pdb_id", "mode", "config_hash").distinct(), ["pdb_id", "mode", "config_hash"], "left_anti")


def recent(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """T07."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.col("ts").desc(), "job_id").limit(limit)
