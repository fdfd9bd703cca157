"""Readers of structure text, tool output and reports: JSON always with a schema, lines numbered where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.functions import scalars as S

#: Solvents and ions that are no ligands.
NOT_LIGANDS = ("HOH", "WAT", "DOD", "SOL", "H2O", "NA", "CL", "K", "MG", "CA", "ZN", "MN", "FE", "CU", "CO", "NI", "CD", "HG", "SO4", "PO4", "GOL", "PEG", "EDO", "ACT")

CAVITY = "struct<id: long, rank: int, bio_score: double, volume: double, druggable: boolean, druggability_class: string, center: array<double>, hydrophobic_ratio: double, polar_atoms: int, merged_vertices: int, score_components: struct<volume_score: double, hydrophobicity_score: double, enclosure_score: double, depth_score: double, sphericity: double>>"
REPORT = f"pdb_id string, n_frames int, scoring_profile string, runtime_seconds double, cavities array<{CAVITY}>"
CRAWL = "pdb_id string, status string, runtime double, total_cavities int, druggable_count int, high_score int, medium_score int, top_bio_score double, error string, timestamp string, _corrupt_record string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and place, which orders those of a file: the start of their split and their number in its task.

    Files are split as Spark splits them, so a task holds a line and no whole file.
    """
    text = spark.read.text(path, lineSep="\n")
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"))
    return text.select(F.col("_metadata.file_path").alias("file"), place.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _cut(first: int, last: int) -> Column:
    return F.trim(F.substring("value", first, last - first + 1))


def atom_columns(rows: DataFrame) -> DataFrame:
    """Fixed columns of ATOM and HETATM lines; lines without three coordinates are skipped."""
    rows = rows.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    name = _cut(13, 16)
    element = F.when(_cut(77, 78) != "", F.upper(_cut(77, 78))).otherwise(F.upper(F.regexp_extract(name, "([A-Za-z])", 1)))
    chain = F.when(F.substring("value", 22, 1) != " ", F.substring("value", 22, 1)).otherwise("A")
    atoms = rows.select(
        *(c for c in rows.columns if c != "value"),
        _cut(1, 6).alias("record"),
        _cut(7, 11).try_cast("int").alias("serial"),
        name.alias("atom_name"),
        _cut(18, 20).alias("res_name"),
        chain.alias("chain_id"),
        _cut(23, 26).try_cast("int").alias("res_id"),
        _cut(27, 27).alias("ins_code"),
        *(_cut(a, b).try_cast("double").alias(c) for c, (a, b) in {"x": (31, 38), "y": (39, 46), "z": (47, 54)}.items()),
        element.alias("element"),
    )
    return atoms.where("x is not null and y is not null and z is not null")


def structures(spark: SparkSession, path: str, first_model: bool = True) -> DataFrame:
    """Atoms of all files, those of the first model only if so asked; pdb_id is the file's name."""
    rows = lines(spark, path).withColumn("pdb_id", F.upper(F.regexp_extract("file", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)))
    if first_model:
        model = F.count_if(F.col("value").startswith("MODEL")).over(W.partitionBy("file").orderBy("line_no"))
        rows = rows.withColumn("model", model).where("model <= 1").drop("model")
    return atom_columns(rows)


def atom_kind(kind: str) -> Column:
    """Heavy, ca, polar, receptor or ligand atoms."""
    c = F.col
    conditions = {
        "heavy": c("element").isin("C", "N", "O", "S"),
        "ca": (c("atom_name") == "CA") & (c("record") == "ATOM"),
        "polar": c("element").isin("N", "O"),
        "receptor": ~c("atom_name").startswith("H") & ~c("res_name").isin("HOH", "WAT"),
        "ligand": (c("record") == "HETATM") & ~c("res_name").isin(*NOT_LIGANDS),
    }
    return conditions[kind]


def select_atoms(atoms: DataFrame, kind: str) -> DataFrame:
    return atoms.where(atom_kind(kind))


def pose_atoms(spark: SparkSession, path: str, k: int = 0) -> DataFrame:
    """Atoms of the k-th model of each file that has atoms, counted from 0, of the first if there is no k-th."""
    in_file = W.partitionBy("file")
    rows = lines(spark, path).withColumn("model", F.count_if(F.col("value").rlike(r"^\s*MODEL\s")).over(in_file.orderBy("line_no")))
    rows = rows.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")).withColumn("ordinal", F.dense_rank().over(in_file.orderBy("model")) - 1)
    chosen = F.when(F.max("ordinal").over(in_file) >= k, k).otherwise(0)
    return atom_columns(rows.withColumn("chosen", chosen).where("ordinal = chosen").select("file", "line_no", "value"))


#: What ends a structure in a file of several: a line of its own.
END = "\nEND\n"


def archived(spark: SparkSession, path: str) -> DataFrame:
    """Structures of files that hold any number: the id, from column 63 of the HEADER line on, and the text. A row holds one structure; files are split between them."""
    name = F.upper(F.regexp_extract("value", r"(?md)^HEADER.{56}(\S+)", 1)).alias("pdb_id")
    return spark.read.text(path, lineSep=END).where(F.col("value").rlike(r"\S")).select(name, F.concat(F.lit("\n"), "value").alias("value"))


def _atoms_of(rows: DataFrame, text: Column) -> DataFrame:
    return atom_columns(rows.select("pdb_id", F.explode(F.split(text, r"\r?\n")).alias("value")))


def archived_structures(spark: SparkSession, path: str, first_model: bool = True) -> DataFrame:
    """S01, S04 of files that hold any number of structures, each ended by END."""
    models = F.split("value", r"(?md)^(?=MODEL)")  # the first is what stands before all models
    return _atoms_of(archived(spark, path), F.array_join(F.slice(models, 1, 2), "") if first_model else F.col("value"))


def archived_poses(spark: SparkSession, path: str, k: int = 0) -> DataFrame:
    """S05 of files that hold any number of structures."""
    blank = r"[\t\f\r ]"
    models = F.filter(F.split("value", rf"(?md)^(?={blank}*MODEL{blank})"), lambda x: x.rlike(r"(?md)^(?:ATOM  |HETATM)"))
    return _atoms_of(archived(spark, path), F.coalesce(F.get(models, F.lit(k)), F.get(models, F.lit(0))))


#: The sites that stand in for a missing file.
BUILT_IN_SITES = (
    ("1CBS", "Retinoic acid binding", "side-chain_flip", 12.5, 22.0, 18.5),
    ("3C79", "TEM-1 Beta-Lactamase", "loop_rearrangement", 15.2, 35.8, 22.4),
    ("1F41", "Interleukin-2", "side-chain_flip", 28.5, 12.0, 45.2),
    ("1YET", "Bcl-xL", "helix_displacement", 41.2, -46.55, 65.6),
    ("1G4E", "p38 MAP Kinase", "loop_rearrangement", 32.5, 18.0, 42.5),
)


def built_in_sites(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(BUILT_IN_SITES, "pdb_id string, name string, pocket_type string, x double, y double, z double")
    return rows.withColumns({"radius": F.lit(8.0), "known_ligand": F.lit(None).cast("string")})


def known_sites(spark: SparkSession, path: str) -> DataFrame:
    """The test cases of a known-site file, with defaults; the built-in sites if there is no file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return built_in_sites(spark)
    case = "struct<pdb_id: string, name: string, pocket_type: string, cryptic_pocket_center: array<double>, radius: double, known_ligand: string>"
    rows = spark.read.schema(f"test_cases array<{case}>").json(path, multiLine=True).select(F.explode("test_cases").alias("t")).select("t.*")
    center = F.col("cryptic_pocket_center")
    return rows.select(S.norm_id("pdb_id").alias("pdb_id"), F.coalesce("name", "pdb_id").alias("name"), F.coalesce("pocket_type", F.lit("unknown")).alias("pocket_type"), *(F.coalesce(F.get(center, F.lit(k)), F.lit(0.0)).alias(a) for k, a in enumerate("xyz")), F.coalesce("radius", F.lit(8.0)).alias("radius"), "known_ligand")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Pocket rows of run reports; the id falls back to the place in the list."""
    return report_pockets(spark.read.schema(REPORT).json(path))


def report_pockets(rows: DataFrame, *keep: str) -> DataFrame:
    flat = rows.select(S.norm_id("pdb_id").alias("pdb_id"), *keep, F.posexplode_outer("cavities").alias("pos", "c"))
    center = F.col("c.center")
    return flat.select("pdb_id", *keep, F.coalesce("c.id", F.col("pos").cast("long")).alias("pocket_id"), *(F.col(f"c.{n}").alias(n) for n in ("rank", "bio_score", "volume", "druggable", "druggability_class", "hydrophobic_ratio", "polar_atoms", "merged_vertices")), *(F.coalesce(F.get(center, F.lit(k)), F.lit(0.0)).alias(f"center_{a}") for k, a in enumerate("xyz")))


def report_proteins(rows: DataFrame, *keep: str) -> DataFrame:
    """The protein rows of run reports."""
    return rows.select(S.norm_id("pdb_id").alias("pdb_id"), *keep, "n_frames", "scoring_profile", F.coalesce(F.size("cavities"), F.lit(0)).alias("total_cavities"), F.array_max(F.transform("cavities", lambda c: c["bio_score"])).alias("top_bio_score"))


def crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """A crawl's JSON lines; what is no JSON stays in _corrupt_record."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", CRAWL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def log_quality(log: DataFrame) -> DataFrame:
    rows = log.select("pdb_id", "_corrupt_record")
    return rows.agg(F.count("*").alias("lines"), F.count("_corrupt_record").alias("parse_errors"))


def tool_summary(spark: SparkSession, path: str) -> DataFrame:
    """Pockets of an external tool's summary, of successful runs, with real centres."""
    pocket = "struct<pocket_id: long, center: array<double>, volume: double, score: double, druggability_score: double>"
    rows = spark.read.schema(f"pdb_id string, status string, pockets array<{pocket}>").json(path).where("status = 'ok'")
    flat = rows.select(S.norm_id("pdb_id").alias("pdb_id"), F.explode("pockets").alias("p")).select("pdb_id", "p.*")
    ok = S.valid_center("center") & F.exists("center", lambda x: F.abs(x) > 1e-12)
    return flat.where(ok)


def tool_filter(rows: DataFrame, min_volume: float, min_score: float = 0.2) -> DataFrame:
    """NaN counts as 0."""
    return rows.where((F.nanvl("volume", F.lit(0.0)) >= min_volume) & (F.nanvl("score", F.lit(0.0)) >= min_score))


#: A number as text, with an exponent or without: small ones are written as 1.0E-4.
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _under_headers(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the pocket of the last header above them or in them: "pocket" and a number, in any case."""
    head = F.regexp_extract("value", r"(?i)pocket\s*(\d+)", 1)
    rows = lines(spark, path).withColumn("head", F.when(head != "", head.cast("long")))
    return rows.withColumn("pocket_id", F.last("head", ignorenulls=True).over(W.partitionBy("file").orderBy("line_no"))).where("pocket_id is not null")


def tool_info(spark: SparkSession, path: str) -> DataFrame:
    """Key and value lines under pocket headers as they are, one row per pocket and key."""
    key, value = F.trim(F.regexp_extract("value", r"^\s*([^:]+?)\s*:", 1)), F.regexp_extract("value", rf":\s*({NUMBER})", 1).try_cast("double")
    return _under_headers(spark, path).where("head is null").select("file", "pocket_id", key.alias("key"), value.alias("value")).where("key <> '' and value is not null")


def tool_pockets(spark: SparkSession, path: str) -> DataFrame:
    """druggability_score, volume and score of each pocket of each file: the last number of the last line that names them, whatever the version's wording."""
    text = F.lower("value")
    kind = F.when(text.contains("drugg") & text.contains("score"), "druggability_score").when(text.contains("volume") & ~text.contains("volume score"), "volume").when(F.trim(F.translate(text, "\t", " ")).startswith("score"), "score")
    number = F.element_at(F.regexp_extract_all("value", F.lit(NUMBER), F.lit(0)), -1).cast("double")
    rows = _under_headers(spark, path).select("file", "pocket_id", "line_no", kind.alias("kind"), F.when(F.col("value").rlike(r"\d"), number).alias("number"))
    last = lambda k: F.max_by("number", F.when((F.col("kind") == k) & F.col("number").isNotNull(), F.col("line_no"))).alias(k)
    return rows.groupBy("file", "pocket_id").agg(*map(last, ("druggability_score", "volume", "score")))


def mean_centers(atoms: DataFrame, *more: Column, key: str = "file") -> DataFrame:
    """Mean atom position per file or other key, with any more aggregates."""
    return atoms.groupBy(key).agg(*(F.avg(a).alias(f"center_{a}") for a in "xyz"), *more)


def pose_table(rows: DataFrame) -> DataFrame:
    """Mode, affinity and both RMSD bounds of table lines."""
    fields = F.split(F.trim("value"), r"\s+")
    names = (("mode", "int"), ("affinity", "double"), ("rmsd_lb", "double"), ("rmsd_ub", "double"))
    found = rows.where(F.size(fields) == 4).select(*(c for c in rows.columns if c != "value"), *(F.get(fields, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(names)))
    return found.dropna(subset=[n for n, _ in names])


def pose_remarks(rows: DataFrame) -> DataFrame:
    """The same of REMARK lines; the mode is their number in the file."""
    key, names = "REMARK VINA RESULT:", ("affinity", "rmsd_lb", "rmsd_ub")
    fields = F.split(F.trim(F.substring_index("value", ":", -1)), r"\s+")
    found = rows.where(F.ltrim("value").startswith(key)).select("file", "line_no", *(F.get(fields, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)))
    return found.dropna(subset=list(names)).select("file", F.row_number().over(W.partitionBy("file").orderBy("line_no")).alias("mode"), *names)


def tool_blocks(text: DataFrame) -> DataFrame:
    """Pocket number, score and volume of the blocks of one text column, value."""
    kept = [c for c in text.columns if c != "value"]
    rows = text.select(*kept, F.explode(F.split("value", "Pocket ")).alias("block"))

    def field(key: str) -> Column:
        """The number after the first line of that key, found by one expression over the block."""
        own = F.regexp_extract("block", rf"(?md)^[ \t]*{key}[ \t]*(:[^\n]*?)?\r?$", 1)
        return F.trim(F.translate(F.substring_index(own, ":", -1), "\t", " ")).try_cast("double")

    number = F.trim(F.regexp_extract("block", r"\A((?:(?!\r?\n)[^:])*)", 1)).try_cast("long")
    return rows.select(*kept, number.alias("pocket_id"), field("Score").alias("score"), field("Volume").alias("volume")).dropna(subset=["pocket_id", "score", "volume"])


def id_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Ids of an object with pdb_ids or of a bare list."""
    text = spark.read.text(path, wholetext=True)
    ids = F.coalesce(F.from_json(F.get_json_object("value", "$.pdb_ids"), "array<string>"), F.from_json("value", "array<string>"))
    rows = text.select(F.explode(ids).alias("pdb_id")).select(S.norm_id("pdb_id").alias("pdb_id"))
    return rows if limit is None else rows.limit(limit)


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Frame files with their number, each path once."""
    files = spark.read.format("binaryFile").load(path).select("path").dropDuplicates(["path"])
    return files.withColumn("frame", F.regexp_extract("path", r"frame_(\d+)", 1).try_cast("int")).where("frame is not null")
