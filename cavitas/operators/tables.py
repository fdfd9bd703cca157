"""Sinks and table maintenance on plain Parquet datasets: new versions are written beside the old and then named current."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.operators import atlas

KEYS = {"proteins": ["pdb_id"], "pockets": ["pdb_id", "pocket_id"], "docking": ["pdb_id", "pocket_id", "ligand_name"]}


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str = "ingest_seq", created: str | None = "created_at") -> DataFrame:
    """The last row of each key wins; the first creation time is kept.

    A key's rows meet in one task; a key has as many rows as it was ingested.
    """
    return newest(existing.unionByName(incoming, allowMissingColumns=True), keys, seq, created)


def newest(rows: DataFrame, keys: list[str], seq: str = "ingest_seq", created: str | None = "created_at") -> DataFrame:
    """The row of each key with the largest seq, with the key's first creation time."""
    last = F.max_by(F.struct(*rows.columns), F.coalesce(F.col(seq), F.lit(-1)))
    found = rows.groupBy(*keys).agg(last.alias("_last"), *([F.min(created).alias("_created")] if created in rows.columns else []))
    flat = found.select("_last.*", *(["_created"] if created in rows.columns else []))
    return flat.withColumn(created, F.col("_created")).drop("_created") if created in rows.columns else flat


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those gone."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the keys, and how many rows went from each."""
    counts = None
    for name, rows in tables.items():
        n = rows.join(gone.select(*keys).distinct(), keys, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return {name: without(rows, gone, keys) for name, rows in tables.items()}, counts


def updated(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns replaced where the changes have a value for the key."""
    new = changes.groupBy(*keys).agg(*(F.last(c, ignorenulls=True).alias(f"_{c}") for c in columns))
    joined = rows.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*rows.columns)


def kept(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among the sampled ones."""
    return rows.join(ids.select(*keys).distinct(), keys, "left_semi")


class Dataset:
    """A Parquet dataset in versions: a reader never sees a folder that is being written."""

    def __init__(self, spark: SparkSession, path: str, partitions: list[str] | None = None):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions or []

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Versions that were written to the end."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        out = rows.write.mode("overwrite")
        (out.partitionBy(*self.partitions) if self.partitions else out).parquet(f"{self.path}/v{version}")
        return version

    def upsert(self, incoming: DataFrame, keys: list[str], seq: str = "ingest_seq") -> int:
        now = self.read()
        return self.write(upserted(incoming.limit(0) if now is None else now, incoming, keys, seq))

    def insert(self, incoming: DataFrame, keys: list[str], seq: str = "ingest_seq") -> int:
        """Returns how many rows came in, counted while they are written."""
        seen = Observation()
        self.upsert(incoming.observe(seen, F.count("*").alias("n")), keys, seq)
        return int(seen.get["n"])


def reports(pockets: DataFrame) -> DataFrame:
    """One nested report per protein, cavities by rank."""
    cavity = F.struct("rank", F.col("pocket_id").alias("id"), F.round("bio_score", 4).alias("bio_score"), F.round("volume", 2).alias("volume"), "druggable", "druggability_class", F.array(*(F.round(c, 3) for c in atlas.CENTER)).alias("center"))
    return pockets.groupBy("pdb_id").agg(F.count("*").alias("total_cavities"), F.count_if("druggable").alias("druggable_cavities"), F.array_sort(F.collect_list(cavity)).alias("cavities"))


def write_reports(pockets: DataFrame, path: str) -> None:
    reports(pockets).write.mode("overwrite").json(path)


def write_result(summary: DataFrame, results: DataFrame, path: str) -> None:
    """An analysis as JSON: its summary row, and its results as lines beside it, however many."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines with the time in UTC."""
    rows.withColumn("timestamp", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


#: The columns of the two CSV exports.
ELITE_COLUMNS = ("pdb_id", "pocket_id", "rank", "bio_score", "volume", "druggability_class", "hydrophobic_ratio", "enclosure_score", "depth_score")
SEARCH_COLUMNS = ("pdb_id", "pocket_id", "rank", "bio_score", "volume", "druggability_class", "druggable", "hydrophobic_ratio", "enclosure_score", "depth_score", "profile_used")


def elite_csv(pockets: DataFrame, path: str, min_score: float = 0.6) -> int:
    """Returns the number of rows written."""
    rows = atlas.elite(pockets, min_score).select(*ELITE_COLUMNS)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows.sparkSession.read.option("header", True).csv(path).count()


def search_csv(pockets: DataFrame, path: str, limit: int = 5000, **conditions) -> None:
    """K11."""
    rows = atlas.search(pockets, limit=limit, **conditions)
    rows.select(*SEARCH_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Each row as CSV text."""
    return rows.select(F.to_csv(F.struct(*rows.columns)).alias("line"))


def holdout_manifest(recall: DataFrame, benchmark: DataFrame, seed: str) -> DataFrame:
    """One nested row with both holdouts and a hash of their ids."""
    ids = lambda df, n: df.agg(F.array_sort(F.collect_list("pdb_id")).alias(n))
    rows = ids(recall, "recall_ids").crossJoin(ids(benchmark, "benchmark_ids"))  # one row each
    return rows.select(F.lit(seed).alias("seed"), "recall_ids", "benchmark_ids", F.sha2(F.concat_ws(",", "recall_ids", "benchmark_ids").cast("binary"), 256).alias("ids_sha256"))


def file_manifest(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Name below path, size and SHA-256 of every file, and whether the expected ones are there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(F.substring_index("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return found.withColumn("found", F.lit(True))
    return expected.select("name").join(found, "name", "left").withColumn("found", F.col("sha256").isNotNull())


def verified(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Checks of a manifest against files, one row each."""
    rows = manifest.select("name", F.col("sha256").alias("want")).join(now.select("name", "sha256"), "name", "left")
    one = rows.agg((F.count("*") == F.count("sha256")).alias("none_missing"), F.coalesce(F.bool_and(F.coalesce(F.col("want") == F.col("sha256"), F.lit(False))), F.lit(True)).alias("hashes_equal"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("pass")) for c in ("none_missing", "hashes_equal")))).alias("c")).select("c.*")


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key, by a window."""
    w = W.partitionBy(*keys).orderBy(F.col(seq).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
