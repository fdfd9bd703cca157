"""Queries of rules with state, and of the written atlas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.operators import ensemble, store, tables
from cavitas.plans.carriers import Carriers
from cavitas.plans.registry import P, query, then
from cavitas.streaming import jobs, state

KEEP = 3600.0
FREE = "w.payload is null or r.t - w.since >= 3600"
HELD = f"r as (select client, job_id, status, epoch_us(ts) / 1e6 as t, row_number() over (partition by client order by ts, job_id) as k from c_jobs), walk as (select client, 0::bigint as k, null::bigint as job_id, null::varchar as payload, null::bigint as held_by, null::double as since, '' as outcome from (select distinct client from r) union all select r.client, r.k, r.job_id, case when {FREE} then r.status else w.payload end, case when {FREE} then r.job_id else w.held_by end, case when {FREE} then r.t else w.since end, case when {FREE} then 'new' when r.status = w.payload then 'reused' else 'conflict' end from walk w join r on r.client = w.client and r.k = w.k + 1)"


@query("c_jobs", sql=then(HELD) + " select client::varchar as key, job_id, outcome, held_by from walk where k > 0")
def submission_outcomes(c: Carriers) -> DataFrame:
    """Clients as idempotency keys, their jobs' statuses as payloads; a key is held for an hour."""
    rows = c.jobs.select(F.col("client").cast("string").alias("key"), F.lit("scan").alias("job_type"), F.col("status").alias("payload"), "job_id", "ts")
    return state.outcomes(rows, KEEP)


@query("c_jobs", sql=then("o as (select *, lag(status) over w as before, coalesce(bool_or(status in ('succeeded', 'failed')) over (partition by client order by ts, status rows between unbounded preceding and 1 preceding), false) as ended from c_jobs window w as (partition by client order by ts, status))") + " select client, ts, before, status, case status when 'queued' then 0 when 'running' then 50 else 100 end as progress_pct from o where not ended and (before is null or before <> status)")
def job_progress(c: Carriers) -> DataFrame:
    """A client's events as the steps of one job."""
    return state.progress(c.jobs, "client")


@query(P, sql="select pdb_id, pocket_id, case when right(pdb_id, 1) = '7' then 0.25 else bio_score end::double as bio_score, case when right(pdb_id, 1) = '7' then 0.25 else max(bio_score) over (partition by pdb_id) end::double as top_bio_score, (select count(distinct pdb_id) + count(distinct pdb_id) filter (right(pdb_id, 1) = '7') from c_pockets) as reports from c_pockets")
def report_ingest(c: Carriers) -> DataFrame:
    """Reports of all proteins ingested as a stream, then corrected ones of the ids that end in 7."""
    source, check = c.scratch("reports"), c.scratch("check")
    target = store.Atlas(c.spark, c.scratch("ingested"))
    tables.reports(c.pockets).write.mode("append").json(source)
    jobs.ingest_reports(c.spark, source, target, check)
    tables.reports(c.pockets.where("pdb_id like '%7'").withColumn("bio_score", F.lit(0.25))).write.mode("append").json(source)
    jobs.ingest_reports(c.spark, source, target, check)
    tops = target.read("proteins").select("pdb_id", "top_bio_score")
    reports = F.lit(int(target.totals()["reports"])).cast("long").alias("reports")
    return target.read("pockets").join(tops, "pdb_id").select("pdb_id", "pocket_id", "bio_score", "top_bio_score", reports)


@query()
def frame_pipeline(c: Carriers) -> DataFrame:
    """Two generated frames of every structure through cavities and consensus; the second frame of ids that end in 3 has lost most residues."""
    atoms = c.atoms.select("pdb_id", "res_id", "res_name", "element", *"xyz")
    modes = atoms.select("pdb_id", "res_id", F.lit(1).alias("mode"), F.lit(0.1).alias("dx"), F.lit(0.05).alias("dy"), F.lit(0.0).alias("dz"))
    moved = ensemble.generated(atoms.select("pdb_id", "res_id", *"xyz"), modes, n=2, amplitudes=(2.0,)).join(atoms.select("pdb_id", "res_id", "res_name", "element"), ["pdb_id", "res_id"])
    frames = moved.where("not (frame = 1 and pdb_id like '%3' and res_id > 10)").drop("mode", "amplitude")
    got = ensemble.run(frames, mapper=lambda rows: rows.withColumn("meta_file", F.concat("pdb_id", F.lit("_frame"), "frame")), least=20)
    clusters = got.consensus.groupBy("pdb_id").agg(F.count("*").alias("n_clusters"))
    return got.frames.join(clusters, "pdb_id", "left").fillna(0, ["n_clusters"])
