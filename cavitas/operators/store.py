"""The atlas as a bucketed store: several tables committed together, rewritten and read by bucket.

A table's rows lie in buckets by a hash of their protein, sorted by it within each file. A commit writes new folders for the
buckets that it touches and then one manifest, which names the folder of every bucket of every table; the manifest's appearance is the commit, so
all tables change at once and a reader of the manifest before sees what it saw. A lookup reads the files of its buckets alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.operators import tables

BUCKET, CREATED = "bucket", "created_at"


class Atlas:
    """Tables keyed as in tables.KEYS, in `buckets` buckets by the hash of pdb_id, each in up to `slices` files a commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slices: int = 4):
        self.spark, self.path, self.slices = spark, path.rstrip("/"), slices
        self.buckets = self.manifest().get("buckets", buckets)

    # Manifests

    def _place(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        files, place = self._place("manifest")
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; empty before the first commit."""
        found = self.versions() if version is None else [version]
        if not found:
            return {}
        files, place = self._place(f"manifest/v{found[-1]}.json")
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Written beside and renamed: a version of this number that is there already is another writer's, and an error."""
        version = manifest["version"]
        files, draft = self._place(f"manifest/.draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._place(f"manifest/v{version}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # Reading

    def bucket_of(self, pdb_id: Column) -> Column:
        return F.pmod(F.xxhash64(pdb_id), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        held = manifest.get("tables", {}).get(table)
        if held is None:
            return None
        paths = [f"{self.path}/{folder}" for b, folder in sorted(held["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(held["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """All rows of a table, or None before its first commit."""
        return self._read(self.manifest(version), table)

    def lookup(self, table: str, *pdb_ids: str) -> DataFrame | None:
        """The rows of some proteins: only their buckets' files are listed, and the ids go down to the scan."""
        ids = [i.strip().upper() for i in pdb_ids]
        manifest = self.manifest()
        one = self.spark.range(1).select(F.array(*(self.bucket_of(F.lit(i)) for i in ids)).alias("b")).first()["b"] if ids else []
        rows = self._read(manifest, table, set(one))
        return rows if rows is None else rows.where(F.col("pdb_id").isin(*ids))

    # Writing

    def commit(self, incoming: dict[str, DataFrame], batch: int | None = None, totals: dict[str, float] | None = None, seq: str = "ingest_seq") -> int:
        """Rows merged by key into the touched buckets of all tables, in one step; the last row of a key wins.

        batch: a number that rises with each batch of a stream; a batch that was committed before changes nothing.
        totals: numbers added to those of the commits before. Returns the version.
        """
        before = self.manifest()
        if batch is not None and batch <= before.get("batch", -1):
            return before["version"]
        version, held, counts = before.get("version", 0) + 1, dict(before.get("tables", {})), {}
        for name, rows in incoming.items():
            keys = tables.KEYS[name]
            folder = f"data/{name}/c{version}-{uuid.uuid4().hex}"
            placed = rows.withColumn(BUCKET, self.bucket_of(F.col("pdb_id")))
            old = touched = None
            if name in held:  # only then the buckets must be known before they are written
                touched = {r[BUCKET] for r in placed.select(BUCKET).distinct().collect()}  # a number per bucket at most
                if not touched:
                    continue
                old = self._read(before, name, touched)
            merged = placed if old is None else old.withColumn(BUCKET, self.bucket_of(F.col("pdb_id"))).unionByName(placed, allowMissingColumns=True)
            slice_ = F.pmod(F.xxhash64(*keys), F.lit(self.slices))
            spread = merged.withColumn("_slice", slice_).repartition(BUCKET, "_slice")
            # the sort that brings a key's rows together is also that of the files
            own = W.partitionBy(BUCKET, *keys, "_slice")
            if CREATED in spread.columns:
                spread = spread.withColumn(CREATED, F.min(CREATED).over(own))
            place = F.row_number().over(own.orderBy(F.coalesce(F.col(seq), F.lit(-1)).desc()))
            out = spread.withColumn("_place", place).where("_place = 1").drop("_place", "_slice").sortWithinPartitions(BUCKET, *keys)
            out.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
            if touched is None:
                touched = self._written(folder)
                if not touched:
                    continue
            schema = ", ".join(f"`{c}` {t}" for c, t in out.drop(BUCKET).dtypes)
            paths = dict(held.get(name, {}).get("buckets", {})) | {str(b): f"{folder}/{BUCKET}={b}" for b in touched}
            held[name] = {"schema": schema, "buckets": paths}
            counts[name] = sorted(touched)
        old_totals = before.get("totals", {})
        summed = {k: old_totals.get(k, 0) + (totals or {}).get(k, 0) for k in {*old_totals, *(totals or {})}}
        return self._publish({"version": version, "buckets": self.buckets, "batch": before.get("batch", -1) if batch is None else batch, "touched": counts, "totals": summed, "tables": held})

    def _written(self, folder: str) -> set[int]:
        """The buckets that a commit's folder holds."""
        files, place = self._place(folder)
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def totals(self) -> dict[str, float]:
        """What all commits have added up to."""
        return self.manifest().get("totals", {})


def protein(store: Atlas, pdb_id: str) -> DataFrame:
    """Q01."""
    return store.lookup("proteins", pdb_id)


def pockets_of(store: Atlas, pdb_id: str) -> DataFrame:
    """Q02: one protein's pockets by their stored rank."""
    return store.lookup("pockets", pdb_id).orderBy("rank", "pocket_id")


