"""Rules that need a client's or key's past, on streams: limits, idempotent submission and progress, with state that expires.

Each rule has a batch form that reads a key's rows in order and gives the same rows as the stream does when every key's rows arrive in
the order of their times. Inside a micro-batch rows are put in that order. Rows behind the watermark are not judged: Spark leaves
them out. Event-time timers remove the state of keys whose past no longer matters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.functions import scalars as S

#: Steps of a job on its way, and the per cent done at each; a job that failed has come to its end, too.
PROGRESS = {"queued": 0, "running": 50, "succeeded": 100, "failed": 100}
ENDS = ("succeeded", "failed")


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _timer(state, at: float) -> None:
    """Wakes the key at a time in seconds, or as soon as the watermark has passed if that lies behind it."""
    state.setTimeoutTimestamp(max(int(at * 1000) + 1, state.getCurrentWatermarkMs() + 1))


# Y05


class Window:
    """The times of a client's last accepted requests, `limit` at most."""

    def __init__(self, limit: int, seconds: float, accepted: Iterable[float] = ()):
        self.limit, self.seconds, self.accepted = limit, seconds, deque(accepted, limit)

    def allow(self, t: float) -> tuple[bool, float]:
        """Whether a request at t is accepted, and after how many seconds it would be."""
        while self.accepted and t - self.accepted[0] >= self.seconds:
            self.accepted.popleft()
        if len(self.accepted) < self.limit:
            self.accepted.append(t)
            return True, 0.0
        return False, round(self.seconds - (t - self.accepted[0]), 3)


def limited(stream: DataFrame, limit: int, seconds: float, delay: str = "5 minutes") -> DataFrame:
    """Y05 on a stream of client, job_id and ts: client, job_id, allowed and retry_after of every request.

    A client's state is the times of at most `limit` accepted requests; it goes once the last of them is `seconds` behind the watermark.
    """
    kinds = dict(stream.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(limit, seconds, state.get[0] if state.exists else ())
        rows = pd.concat(list(parts)).sort_values(["t", "job_id"], kind="stable")
        found = [window.allow(t) for t in rows["t"].tolist()]
        state.update((list(window.accepted),))
        if window.accepted:
            _timer(state, window.accepted[-1] + seconds)
        yield pd.DataFrame({"client": key[0], "job_id": rows["job_id"].to_numpy(), "allowed": [a for a, _ in found], "retry_after": [w for _, w in found]})

    timed = stream.withWatermark("ts", delay).select("client", "job_id", "ts", _seconds("ts").alias("t"))
    return timed.groupBy("client").applyInPandasWithState(step, f"client {kinds['client']}, job_id {kinds['job_id']}, allowed boolean, retry_after double", "accepted array<double>", "append", "EventTimeTimeout")


# Y04


def payload_hash() -> Column:
    return S.hash_key("job_type", "payload")


class Held:
    """The first submission of a key: its payload's hash, its job, and when it came."""

    def __init__(self, keep: float, payload: str | None = None, job: int | None = None, since: float = 0.0):
        self.keep, self.payload, self.job, self.since = keep, payload, job, since

    def outcome(self, payload: str, job: int, t: float) -> str:
        """new, reused or conflict; a key that is `keep` seconds old is free again."""
        if self.payload is None or t - self.since >= self.keep:
            self.payload, self.job, self.since = payload, job, t
            return "new"
        return "reused" if payload == self.payload else "conflict"


def submitted(stream: DataFrame, keep: float, delay: str = "5 minutes") -> DataFrame:
    """Y04 on a stream of key, job_type, payload, job_id and ts: the outcome of every submission, and the job that holds the key.

    A new key gets its own job; the same payload again is answered by that job, another payload is a conflict. State goes `keep` seconds
    after the key's first submission.
    """
    kinds = dict(stream.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Held(keep, *(state.get if state.exists else ()))
        rows = pd.concat(list(parts)).sort_values(["t", "job_id"], kind="stable")
        found = [(held.outcome(p, int(j), t), held.job) for p, j, t in zip(rows["payload"], rows["job_id"], rows["t"].tolist(), strict=True)]
        state.update((held.payload, int(held.job), float(held.since)))
        _timer(state, held.since + keep)
        yield pd.DataFrame({"key": key[0], "job_id": rows["job_id"].to_numpy(), "outcome": [o for o, _ in found], "held_by": [j for _, j in found]})

    rows = stream.withWatermark("ts", delay).select("key", "job_id", payload_hash().alias("payload"), "ts", _seconds("ts").alias("t"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kinds['key']}, job_id long, outcome string, held_by long", "payload string, job long, since double", "append", "EventTimeTimeout")


def outcomes(rows: DataFrame, keep: float) -> DataFrame:
    """Y04 in batch: the same rows from a table. A task reads its keys' submissions in order, batch by batch, and holds one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), Held(keep)
        for batch in batches:
            found, jobs = [], []
            for key, job, payload, t in zip(*(batch[c].to_pylist() for c in ("key", "job_id", "payload", "t")), strict=True):
                if key != last:
                    last, held = key, Held(keep)
                found.append(held.outcome(payload, job, t))
                jobs.append(held.job)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["job_id"], pa.array(found, pa.string()), pa.array(jobs, pa.int64())], names=["key", "job_id", "outcome", "held_by"])

    timed = rows.select("key", F.col("job_id").cast("long").alias("job_id"), payload_hash().alias("payload"), _seconds("ts").alias("t"))
    return timed.repartition("key").sortWithinPartitions("key", "t", "job_id").mapInArrow(run, f"key {dict(rows.dtypes)['key']}, job_id long, outcome string, held_by long")


# Y06


def progress_of(status: Column) -> Column:
    """Per cent done at a status; null for one that is unknown."""
    found = F.lit(None).cast("int")
    for name, done in PROGRESS.items():
        found = F.when(status == name, done).otherwise(found)
    return found


def progress(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Y06 in batch: the changes of each job's status up to its end, with progress_pct. rows: key, ts, status."""
    from pyspark.sql import Window as W

    order = W.partitionBy(key).orderBy("ts", "status")
    ended = F.max(F.col("status").isin(*ENDS)).over(order.rowsBetween(W.unboundedPreceding, -1))
    before = F.lag("status").over(order)
    changed = rows.withColumns({"before": before, "_ended": F.coalesce(ended, F.lit(False))}).where(~F.col("_ended") & (F.col("before").isNull() | (F.col("before") != F.col("status"))))
    return changed.select(key, "ts", "before", "status", progress_of(F.col("status")).alias("progress_pct"))


def progress_feed(stream: DataFrame, key: str = "job_id", idle: float = 86_400.0, delay: str = "5 minutes") -> DataFrame:
    """Y06 on a stream: the same changes as they come. The state is a job's last status; it goes when nothing came for `idle` seconds."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "status"], kind="stable")
        found = []
        for ts, status in zip(rows["ts"], rows["status"], strict=True):
            if status != last and last not in ENDS:
                found.append((k[0], ts, last, status, PROGRESS.get(status)))
                last = status
        state.update((last,))
        _timer(state, rows["ts"].iloc[-1].timestamp() + idle)
        if found:
            yield pd.DataFrame(found, columns=[key, "ts", "before", "status", "progress_pct"]).astype({"progress_pct": "Int32"})

    schema = f"{key} {kind}, ts timestamp, before string, status string, progress_pct int"
    return stream.withWatermark("ts", delay).select(key, "ts", "status").groupBy(key).applyInPandasWithState(step, schema, "last string", "append", "EventTimeTimeout")


def each_step(rows: DataFrame, run: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, path: str) -> DataFrame:
    """What a stateful stream gives for all that is there now, appended to Parquet files; a later call goes on from the checkpoint."""
    out = run(rows).writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    out.format("parquet").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(path)
