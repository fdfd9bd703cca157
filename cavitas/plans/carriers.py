"""Domain tables derived from the supplied tables, and the same derivations as SQL.

The expressions are written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.operators import atlas, store
from cavitas.session import shared_folder

ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
TYPES = ("cryptic", "allosteric", "orthosteric", "interface", "surface")

SCORE = "0.25 * volume_score + 0.25 * hydrophobicity_score + 0.25 * enclosure_score + 0.25 * depth_score"

_POCKETS = f"""
select *, case when bio_score >= 0.55 then 'high' when bio_score >= 0.30 then 'medium' else 'low' end as druggability_class
from (
  select *, round({SCORE}, 4) as bio_score
  from (
    select *, hydrophobic_ratio > 0.3 and polar_atoms < 6 as druggable, hydrophobic_ratio as hydrophobicity_score,
      case when volume < 80 then cast(0 as double) when volume > 2500 then cast(1 as double) else (volume - 80) / cast(2420 as double) end as volume_score
    from (
      select concat('P', lpad(cast(l_suppkey as string), 6, '0')) as pdb_id,
        row_number() over (partition by l_suppkey order by {ORDER}) as pocket_id,
        cast(l_linenumber as int) as frame, l_returnflag as tool, cast(l_extendedprice as double) / 20 as volume,
        least(cast(1 as double), abs(cast(l_discount as double)) * 10) as hydrophobic_ratio,
        cast(floor(cast(l_quantity as double)) as int) % 12 as polar_atoms, cast(1 + l_partkey % 12 as int) as merged_vertices,
        least(cast(1 as double), abs(cast(l_tax as double)) / cast(0.08 as double)) as enclosure_score,
        (cast(l_quantity as double) - 1) / 49 as depth_score, cast(l_partkey % 100 as double) / 100 as sphericity,
        cast(l_partkey % 97 as double) * 0.5 as center_x, cast(l_orderkey % 89 as double) * 0.5 as center_y,
        cast(l_linenumber as double) * 4 + cast(l_orderkey % 13 as double) * 0.5 as center_z,
        concat('L', cast(l_partkey % 3 as string)) as ligand_name, -cast(l_quantity as double) / 5 as affinity
      from lineitem
    ) a
  ) b
) c
"""
_RANKED = "select *, row_number() over (partition by pdb_id order by bio_score desc, pocket_id) as rank from c_base"

SQL: dict[str, str] = {
    "c_base": _POCKETS,
    "c_pockets": _RANKED,
    "c_known": "select concat('P', lpad(cast(s_suppkey as string), 6, '0')) as pdb_id, cast(s_suppkey * 31 % 97 as double) * 0.5 as x, cast(s_suppkey * 17 % 89 as double) * 0.5 as y, cast(6 + s_suppkey % 29 as double) as z, case cast(s_nationkey % 5 as int) "
    + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TYPES))
    + " end as pocket_type, cast(8 as double) as radius from supplier",
    "c_eval": "select d.doc_id, cast(l.quality as int) as y_true, cast(d.n_chars % 1000 as double) / 1000 as y_proba from documents d join labels l on d.doc_id = l.doc_id",
    "c_jobs": "select event_id as job_id, user_id as client, ts, case event_type when 'purchase' then 'succeeded' when 'signup' then 'succeeded' when 'error' then 'failed' when 'click' then 'running' else 'queued' end as status, cast(value as double) / 100 as latency from events",
}


def with_sql(*names: str) -> str:
    """A WITH clause of the named derivations, for an oracle."""
    names = ("c_base", *names) if "c_pockets" in names else names
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in dict.fromkeys(names)) + "\n"


#: Atlases written by this process: by application, folder, and length and time of the table they come from.
_ATLASES: dict[tuple, store.Atlas] = {}


def rounded(sql: str, places: int) -> str:
    """For Spark, what round(sql, places) is on DuckDB: see scalars.rounded."""
    return f"round(({sql}) * 1e{places}) / 1e{places}"


class Carriers:
    """The derived tables of one folder of supplied tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def scratch(self, name: str) -> str:
        """A fresh folder in the one that all executors share, removed when the driver's JVM ends."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        return path

    def atlas(self) -> store.Atlas:
        """The pockets and proteins as a bucketed atlas, written once per session for each state of the folder."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/lineitem.parquet")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        key = (self.spark.sparkContext.applicationId, self.sf_dir, files.getContentSummary(place).getLength(), files.getFileStatus(place).getModificationTime())
        if key not in _ATLASES:
            made = store.Atlas(self.spark, self.scratch("atlas"))
            once = [df.withColumn("ingest_seq", F.lit(1).cast("long")) for df in (atlas.proteins(self.base), self.pockets)]
            made.commit(dict(zip(("proteins", "pockets"), once, strict=True)))
            _ATLASES[key] = made
        return _ATLASES[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str, **tables: DataFrame) -> DataFrame:
        text = SQL[name].replace(f"round({SCORE}, 4)", rounded(SCORE, 4))
        return self.spark.sql(text.replace("c_base", "{c_base}").replace("from lineitem", "from {lineitem}").replace("from supplier", "from {supplier}").replace("from documents d join labels l", "from {documents} d join {labels} l").replace("from events", "from {events}"), **tables)

    def base_of(self, lineitem: DataFrame) -> DataFrame:
        return self._derived("c_base", lineitem=lineitem)

    @property
    def base(self) -> DataFrame:
        return self.base_of(self.table("lineitem"))

    @property
    def pockets(self) -> DataFrame:
        return self._derived("c_pockets", c_base=self.base)

    @property
    def known(self) -> DataFrame:
        return self._derived("c_known", supplier=self.table("supplier"))

    @property
    def eval(self) -> DataFrame:
        return self._derived("c_eval", documents=self.table("documents").select("doc_id", "n_chars"), labels=self.table("labels"))

    @property
    def jobs(self) -> DataFrame:
        return self._derived("c_jobs", events=self.table("events"))

    @property
    def atoms(self) -> DataFrame:
        """21 points of each vector, as alpha carbons of a structure."""
        names = ", ".join(f"'{r}'" for r in RESIDUES)
        return self.table("embeddings").selectExpr(
            "concat('E', cast(vec_id as string)) as pdb_id",
            "label",
            "embedding",
            "explode(sequence(1, 21)) as res_id",
        ).selectExpr(
            "pdb_id",
            "res_id",
            f"element_at(array({names}), cast((label + res_id) % 20 as int) + 1) as res_name",
            "'CA' as atom_name",
            "'C' as element",
            *(f"cast(embedding[3 * (res_id - 1) + {k}] as double) * 80 as {axis}" for k, axis in enumerate("xyz")),
        )


_NAMES = ", ".join(f"'{r}'" for r in RESIDUES)
SQL["c_atoms"] = f"""select concat('E', cast(vec_id as string)) as pdb_id, res_id, list_extract([{_NAMES}], ((label + res_id) % 20 + 1)::int) as res_name,
  embedding[3 * (res_id - 1) + 1]::double * 80 as x, embedding[3 * (res_id - 1) + 2]::double * 80 as y, embedding[3 * (res_id - 1) + 3]::double * 80 as z
  from (select vec_id, label, embedding, unnest(range(1, 22))::int as res_id from embeddings)"""
