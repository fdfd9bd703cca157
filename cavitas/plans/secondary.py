"""Queries of the smaller rules: predicates, scalars, summaries, choices and job feeds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import atlas, ensemble, geometry, matching, ml, spatial, stats, tables, validation
from cavitas.plans.carriers import Carriers
from cavitas.plans.registry import D, EXACT_MEAN, FEATS, FRAMES, LISTS, MATCH, P, PAIRED, _lists, _matches, decimal_round, query, then
from cavitas.streaming import jobs

# Predicates and scalars


@query(P, sql="select raw, upper(trim(raw)) as pdb_id, regexp_full_match(upper(trim(raw)), '[A-Z0-9]{4,12}') as valid from (select distinct case when pocket_id % 2 = 0 then concat(' ', lower(pdb_id), ' ') else concat(pdb_id, '-x') end as raw from c_pockets)")
def id_rules(c: Carriers) -> DataFrame:
    raw = F.when(F.col("pocket_id") % 2 == 0, F.concat(F.lit(" "), F.lower("pdb_id"), F.lit(" "))).otherwise(F.concat("pdb_id", F.lit("-x")))
    rows = c.base.select(raw.alias("raw")).distinct()
    return rows.select("raw", S.norm_id("raw").alias("pdb_id"), S.valid_id("raw", 4, 12).alias("valid"))


@query(P, sql="select pdb_id, pocket_id, case when pocket_id % 7 = 0 or pocket_id % 11 = 0 then 0 else volume end as volume, pocket_id % 3 <> 0 as center_ok from c_pockets")
def number_rules(c: Carriers) -> DataFrame:
    """Volumes as text, some of them no numbers; centres of two or three coordinates."""
    text = F.when(F.col("pocket_id") % 7 == 0, "n/a").when(F.col("pocket_id") % 11 == 0, "NaN").otherwise(F.col("volume").cast("string"))
    center = F.when(F.col("pocket_id") % 3 == 0, F.array("center_x", "center_y")).otherwise(F.array(*atlas.CENTER))
    rows = c.base.withColumns({"text": text, "center": center})
    return rows.select("pdb_id", "pocket_id", S.safe_float("text").alias("volume"), S.valid_center("center").alias("center_ok"))


@query(P, sql="select pdb_id, pocket_id, " + decimal_round("4 / 3 * pi() * (depth_score * 10) ** 3", 3) + " as sphere, greatest(20, least(30, depth_score * 30 * 2 + 6))::double as box, case when affinity < -8 then 'strong' when affinity < -6 then 'good' when affinity < -4 then 'weak' else 'none' end as affinity_class, case when polar_atoms > 0 then volume / (polar_atoms * 100) between 0.5 and 2 else true end as ratio_ok, round(sqrt(center_x ** 2 + center_y ** 2 + center_z ** 2), 4) as from_origin from c_pockets")
def pocket_scalars(c: Carriers) -> DataFrame:
    zero = [F.lit(0.0)] * 3
    rows = c.base.withColumns({"r": F.col("depth_score") * 10, "box_r": F.col("depth_score") * 30, "other": F.col("polar_atoms") * 100.0})
    return rows.select("pdb_id", "pocket_id", F.round(S.sphere_volume("r"), 3).alias("sphere"), S.box_size("box_r").alias("box"), S.affinity_class("affinity").alias("affinity_class"), S.volume_ratio_ok("volume", "other").alias("ratio_ok"), F.round(S.distance(atlas.CENTER, zero), 4).alias("from_origin"))


@query(P, sql="select pdb_id, pocket_id, case when polar_atoms = 0 then 0 else least(1, hydrophobic_ratio * 1.5::double) end as hydrophobicity, case when merged_vertices < 4 or polar_atoms = 0 then case when sphericity > 0 then least(1, depth_score / sphericity) else 0.5 end else case when volume > 0 then greatest(0, least(1, volume / (polar_atoms * 1000))) else 0.5 end end::double as enclosure, greatest(0, least(1, (1 - center_x / 50) * case when center_y < 5 then center_y / 5 else 1 end))::double as depth from c_pockets")
def component_scores(c: Carriers) -> DataFrame:
    rows = c.base.withColumns({"ratio": F.when(F.col("polar_atoms") > 0, F.col("hydrophobic_ratio") * 1.5), "hull": F.when(F.col("polar_atoms") > 0, F.col("polar_atoms") * 1000.0)})
    enclosure = S.enclosure("merged_vertices", "depth_score", "sphericity", "volume", "hull")
    return rows.select("pdb_id", "pocket_id", S.normalize_hydrophobicity("ratio").alias("hydrophobicity"), enclosure.alias("enclosure"), S.depth("center_x", F.lit(50.0), "center_y").alias("depth"))


HYDRO = " ".join(f"when '{k}' then {v}" for k, v in S.HYDROPATHY.items())


@query("c_atoms", sql=f"select pdb_id, round(avg(case res_name {HYDRO} else 0 end::double), 4) as hydropathy, count(*) as n from c_atoms group by 1")
def hydropathy(c: Carriers) -> DataFrame:
    return c.atoms.groupBy("pdb_id").agg(F.round(F.avg(S.hydropathy("res_name")), 4).alias("hydropathy"), F.count("*").alias("n"))


@query("c_atoms", sql="select element, count(*) as n, any_value(case upper(element) when 'N' then 'NA' when 'CL' then 'Cl' when 'ZN' then 'Zn' else left(element, 2) end) as atom_type from (select case res_id % 4 when 0 then 'N' when 1 then 'cl' when 2 then 'ZN' else 'XYZ' end as element from c_atoms) group by 1")
def atom_types(c: Carriers) -> DataFrame:
    element = F.expr("case res_id % 4 when 0 then 'N' when 1 then 'cl' when 2 then 'ZN' else 'XYZ' end").alias("element")
    return c.atoms.groupBy(element).agg(F.count("*").alias("n")).withColumn("atom_type", S.atom_type("element"))


@query(P, sql="select pdb_id, pocket_id, sha256(concat_ws(':', pdb_id, pocket_id::varchar, ligand_name)) as key from c_pockets")
def hash_keys(c: Carriers) -> DataFrame:
    return c.base.select("pdb_id", "pocket_id", S.hash_key("pdb_id", F.col("pocket_id").cast("string"), "ligand_name").alias("key"))


@query("c_jobs", sql="select job_id, round((epoch_us(timestamp '2030-01-01') - epoch_us(ts)) / 3.6e9, 5) as age from c_jobs")
def job_age(c: Carriers) -> DataFrame:
    return c.jobs.select("job_id", F.round(S.age_hours("ts", F.lit("2030-01-01 00:00:00").cast("timestamp")), 5).alias("age"))


@query(P, sql="select pdb_id, pocket_id, rank, bio_score, volume, druggable, case when pocket_id % 4 = 0 then 0 else sphericity end::double as sphericity from c_pockets")
def typed_view(c: Carriers) -> DataFrame:
    """Every fourth row's metadata is no JSON."""
    text = F.when(F.col("pocket_id") % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"sphericity": '), F.col("sphericity").cast("string"), F.lit("}")))
    return atlas.typed_view(c.pockets.withColumn("metadata_json", text))


@query(P, sql="select pdb_id, pocket_id, case when pocket_id % 5 = 0 or (center_x = 0 and center_y = 0 and center_z = 0) then 'missing' end as source, pocket_id % 2 = 0 or not (pocket_id % 5 = 0 or (center_x = 0 and center_y = 0 and center_z = 0)) as kept from c_pockets")
def zero_center_flags(c: Carriers) -> DataFrame:
    """Every fifth centre is zero; rows of even ids have JSON metadata with a note, the others text."""
    zeroed = {x: F.when(F.col("pocket_id") % 5 == 0, 0.0).otherwise(F.col(x)) for x in atlas.CENTER}
    text = F.when(F.col("pocket_id") % 2 == 0, '{"note": "n"}').otherwise("plain")
    rows = atlas.flag_zero_centers(c.base.withColumns(zeroed).withColumn("metadata_json", text))
    read = lambda k: F.when(F.col("metadata_json").startswith("{"), F.get_json_object("metadata_json", f"$.{k}"))
    kept = (F.col("metadata_json") == "plain") | F.coalesce(read("note") == "n", F.lit(False))
    return rows.select("pdb_id", "pocket_id", read("center_source").alias("source"), kept.alias("kept"))


@query("c_atoms", sql="select pdb_id, count(*) as n_atoms, case when count(*) < 20 then 'too_few' when count(*) filter (x is null) > 0 then 'bad_number' when greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) > 30 then 'box' end as reason from (select pdb_id, case when right(pdb_id, 1) = '7' and res_id = 3 then null else x end as x, y, z from c_atoms where right(pdb_id, 1) <> '3' or res_id <= 10) group by 1")
def admission(c: Carriers) -> DataFrame:
    """Structures of ids ending in 3 lack atoms, one atom of those ending in 7 has no place."""
    rows = c.atoms.where("right(pdb_id, 1) <> '3' or res_id <= 10").withColumn("x", F.expr("case when right(pdb_id, 1) = '7' and res_id = 3 then null else x end"))
    return atlas.admitted(rows, 20, 100_000, 30.0).select("pdb_id", "n_atoms", "reason")


@query(P, sql=then("n as (select pdb_id, count(*) as n_atoms, count(*) filter (druggable) as n_voids from c_pockets group by 1)") + " select pdb_id, case when n_atoms > 2000 then 12 when n_atoms < 500 then 9 else 10 end::double as clearance_max, case when n_atoms < 300 then 40 when n_atoms > 3000 then 72 else 60 end::double as volume_min, case when n_voids > 200 then 4.5 when n_voids > 100 then 4 when n_voids < 10 then 2.5 else 3 end::double + case when n_atoms > 2000 then 0.5 else 0 end::double as merge_threshold from n")
def adaptive_limits(c: Carriers) -> DataFrame:
    per = c.base.groupBy("pdb_id").agg(F.count("*").alias("n_atoms"), F.count_if("druggable").alias("n_voids"))
    return atlas.thresholds(per, n_voids="n_voids").select("pdb_id", "clearance_max", "volume_min", "merge_threshold")


@query(P, sql="select pdb_id, ordinal, volume from (select *, row_number() over (partition by pdb_id, round(x, 2), round(y, 2), round(z, 2) order by clearance > 10, ordinal) as k from (select pdb_id, pocket_id as ordinal, center_x as x, center_y as y, center_z as z, volume, depth_score * 15 as clearance from c_pockets) where clearance between 2.5 and 12 and volume between 60 and 5000) where k = 1")
def void_window(c: Carriers) -> DataFrame:
    rows = c.base.selectExpr("pdb_id", "pocket_id as ordinal", "center_x as x", "center_y as y", "center_z as z", "volume", "depth_score * 15 as clearance", "cast(10 as double) as clearance_max")
    return atlas.voids(rows, 60.0).select("pdb_id", "ordinal", "volume")


# Atlas


@query(P, sql=then("t as (select pdb_id, max(bio_score) as s from c_pockets group by 1 order by 2 desc, 1 limit 8)") + " select count(distinct pdb_id) as total_proteins, count(*) as total_pockets, count(*) filter (druggability_class = 'high') as high, count(*) filter (druggability_class = 'low') as low, (select string_agg(pdb_id, ',' order by s desc, pdb_id) from t) as leaders from c_pockets")
def atlas_overview(c: Carriers) -> DataFrame:
    n = lambda k: F.coalesce(F.try_element_at("distribution", F.lit(k)), F.lit(0)).alias(k)
    return atlas.overview(c.base).select("total_proteins", "total_pockets", n("high"), n("low"), F.array_join(F.transform("leaders", lambda x: x["pdb_id"]), ",").alias("leaders"))


@query(P, sql="select pdb_id, pocket_id, rank from c_pockets where bio_score >= 0.5 qualify row_number() over (partition by pdb_id order by rank) <= 20")
def elite_of_each(c: Carriers) -> DataFrame:
    return atlas.elite_of_each(c.base, 0.5, 20).select("pdb_id", "pocket_id", "rank")


@query(P, sql="select pdb_id, pocket_id, row_number() over (partition by pdb_id order by case when pocket_id % 10 < 2 then null else bio_score end desc nulls last, pocket_id) as rank from c_pockets")
def rank_missing_last(c: Carriers) -> DataFrame:
    """Of ten pockets one has no score and one NaN."""
    score = F.when(F.col("pocket_id") % 10 == 0, None).when(F.col("pocket_id") % 10 == 1, float("nan")).otherwise(F.col("bio_score"))
    return atlas.ranked(c.base.select("pdb_id", "pocket_id", score.alias("bio_score"))).select("pdb_id", "pocket_id", "rank")


@query(P, sql="select pdb_id, arg_max(pocket_id, (p, bio_score, -pocket_id)) as pocket_id from (select *, (pdb_id >= 'P000005' and tool = 'A')::int as p from c_pockets where tool = 'R' or (pdb_id >= 'P000005' and tool = 'A')) group by 1")
def best_with_fallback(c: Carriers) -> DataFrame:
    return atlas.best_of_each(c.base.where("pdb_id >= 'P000005' and tool = 'A'"), c.base.where("tool = 'R'")).select("pdb_id", "pocket_id")


@query(P, sql=f"select floor(volume / 250)::int as bin, {EXACT_MEAN} as avg_score, count(*) as n from c_pockets group by 1")
def score_by_volume(c: Carriers) -> DataFrame:
    return atlas.chart_tables(c.pockets)["volume_score"]


# Joins


@query(P, sql="select pdb_id, count(*) as n, max(bio_score) as top from c_pockets where pocket_id % 3 <> 0 group by 1")
def pocket_delete(c: Carriers) -> DataFrame:
    rows = c.base.select("pdb_id", "pocket_id", "bio_score")
    left = tables.without(rows, rows.where("pocket_id % 3 = 0"), tables.KEYS["pockets"])
    return left.groupBy("pdb_id").agg(F.count("*").alias("n"), F.max("bio_score").alias("top"))


@query(P, "c_known", sql="select pdb_id, pocket_id from c_pockets where pdb_id in (select pdb_id from c_known order by sha256('seed7:' || upper(pdb_id)), pdb_id limit 15)")
def kept_ids(c: Carriers) -> DataFrame:
    return tables.kept(c.base.select("pdb_id", "pocket_id"), validation.hash_sample(c.known, 15, "seed7"), ["pdb_id"])


@query(P, sql="select pdb_id, pocket_id, pocket_id % 4 = 0 as docked from c_pockets")
def docking_evidence(c: Carriers) -> DataFrame:
    """Two docking rows for each second pocket, one of them validated for each fourth."""
    docking = c.base.where("pocket_id % 2 = 0").select("pdb_id", "pocket_id", F.explode(F.array(F.lit(False), F.col("pocket_id") % 4 == 0)).alias("validated"))
    return matching.with_docking(c.base.select("pdb_id", "pocket_id"), docking)


@query(P, sql=then("z as (select *, pocket_id % 5 = 0 or (center_x = 0 and center_y = 0 and center_z = 0) as zero from c_pockets), s as (select case when not zero then 'kept' when pocket_id % 10 = 0 then 'by_id' when pocket_id % 15 = 0 then 'computed' else 'missing' end as s from z)") + " select count(*) filter (s = 'kept') as kept, count(*) filter (s = 'by_id') as by_id, count(*) filter (s = 'by_rank') as by_rank, count(*) filter (s = 'computed') as computed, count(*) filter (s = 'missing') as missing, round(count(*) filter (s in ('by_id', 'by_rank', 'computed')) * 100 / count(*) filter (s <> 'kept'), 2) as recovered_pct from s")
def repair_totals(c: Carriers) -> DataFrame:
    rows = c.pockets
    bad = rows.withColumns({x: F.when(F.col("pocket_id") % 5 == 0, 0.0).otherwise(F.col(x)) for x in atlas.CENTER})
    return matching.repair_accounting(matching.repaired(bad, rows.where("pocket_id % 10 = 0"), rows.where("false"), rows.where("pocket_id % 15 = 0")))


@query(P, "c_known", sql=then(PAIRED) + " select pdb_id, a as legacy, b as refined, a and not b as regressed, not a and b as improved from pp")
def config_impact(c: Carriers) -> DataFrame:
    runs = {"legacy": _matches(c), "refined": matching.site_match(c.known, c.pockets, top_n=5)}
    rows = [r.select("pdb_id", F.lit(k).alias("config"), "matched") for k, r in runs.items()]
    return matching.impact(rows[0].unionByName(rows[1]))


@query("c_atoms", sql="select a.pdb_id, a.res_id as a, b.res_id as b, round(" + D.format("a.", "b.") + ", 4) as dist from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <= 10 and b.res_id > 10 and " + D.format("a.", "b.") + " <= 7")
def neighbours_of_two_sets(c: Carriers) -> DataFrame:
    a, b = (c.atoms.where(w).select("pdb_id", "res_id", *"xyz") for w in ("res_id <= 10", "res_id > 10"))
    axes = ("b_x", "b_y", "b_z")
    found = spatial.within(a, spatial.renamed(b, "b_"), 7.0, right_axes=axes)
    return found.select("a.pdb_id", F.col("res_id").alias("a"), F.col("b_res_id").alias("b"), F.round("dist", 4).alias("dist"))


PARTS = "[{0}volume_score, {0}hydrophobicity_score, {0}enclosure_score, {0}depth_score, {0}sphericity]"


@query(P, sql=then("e as (select pdb_id, pocket_id, tool, volume_score, hydrophobicity_score, enclosure_score, depth_score, sphericity from c_pockets where druggable and volume >= 100 and tool in ('A', 'R') qualify row_number() over (partition by pdb_id, tool order by bio_score desc, pocket_id) <= 20)") + " select a.pdb_id as pair, a.pocket_id as a_id, b.pocket_id as b_id, " + decimal_round("0.6 * greatest(0, coalesce(list_cosine_similarity(" + PARTS.format("a.") + ", " + PARTS.format("b.") + "), 0)) + 0.4 * greatest(0, 1 - list_distance(" + PARTS.format("a.") + ", " + PARTS.format("b.") + ") / sqrt(5))", 4) + " as composite from e a join e b on a.pdb_id = b.pdb_id and a.tool = 'A' and b.tool = 'R'")
def compare_pocket_lists(c: Carriers) -> DataFrame:
    """The two tools' best druggable pockets of each protein, all against all."""
    own = [atlas.top_extract(c.base.where(F.col("tool") == t)).withColumn("pair", F.col("pdb_id")) for t in "AR"]
    return spatial.compare_all(*own)


def _thirds(c: Carriers) -> DataFrame:
    """Seven atoms each as the vertices of a cavity."""
    return c.atoms.selectExpr("pdb_id", "cast((res_id - 1) div 7 + 1 as int) as cavity_id", "res_id", "x", "y", "z", "cast(res_id as double) as volume")


VERTICES = "v as (select pdb_id, ((res_id - 1) // 7 + 1)::int as cavity_id, res_id, x, y, z from c_atoms), m as (select pdb_id, cavity_id, avg(x) as cx, avg(y) as cy, avg(z) as cz, count(*) as merged_vertices from v group by 1, 2)"
TO_CENTER = "sqrt(({0}x - cx) ** 2 + ({0}y - cy) ** 2 + ({0}z - cz) ** 2)"


@query("c_atoms", sql=then(VERTICES) + ", g as (select m.pdb_id, m.cavity_id, max(" + TO_CENTER.format("v.") + ") as radius_geom from m join v on m.pdb_id = v.pdb_id and m.cavity_id = v.cavity_id group by 1, 2), k as (select m.pdb_id, m.cavity_id, min(" + TO_CENTER.format("a.") + ") as radius_clear from m join c_atoms a on m.pdb_id = a.pdb_id group by 1, 2) select m.pdb_id, m.cavity_id, round(cx, 4) as center_x, merged_vertices, round(radius_geom, 4) as radius_geom, round(case when radius_clear <= 15 then radius_clear end, 4) as radius_clear from m join g on m.pdb_id = g.pdb_id and m.cavity_id = g.cavity_id join k on m.pdb_id = k.pdb_id and m.cavity_id = k.cavity_id")
def cavity_shapes(c: Carriers) -> DataFrame:
    rows = spatial.cavity_properties(_thirds(c), c.atoms.withColumn("serial", F.col("res_id")))
    return rows.select("pdb_id", "cavity_id", F.round("center_x", 4).alias("center_x"), "merged_vertices", F.round("radius_geom", 4).alias("radius_geom"), F.round("radius_clear", 4).alias("radius_clear"))


KIND = "r.res_name in ('" + "', '".join(S.HYDROPHOBIC) + "')"


@query("c_atoms", sql=then(VERTICES) + ", n as (select m.pdb_id, m.cavity_id, count(r.res_id) as k, coalesce(avg(case when r.res_id is not null then (" + KIND + ")::int end), 0) as h, count(*) filter (r.res_name in ('" + "', '".join(S.POLAR + S.CHARGED) + "')) as p from m left join c_atoms r on r.pdb_id = m.pdb_id and " + TO_CENTER.format("r.") + " <= 6 group by 1, 2) select pdb_id, cavity_id, round(h, 4) as hydrophobic_ratio, p as polar_atoms, k as n_residues, k > 0 and h > 0.3 and p < 6 as druggable from n")
def cavity_neighbourhoods(c: Carriers) -> DataFrame:
    centers = _thirds(c).groupBy("pdb_id", "cavity_id").agg(*(F.avg(a).alias(f"center_{a}") for a in "xyz"))
    return spatial.neighbourhood(centers, c.atoms).withColumn("hydrophobic_ratio", F.round("hydrophobic_ratio", 4))


@query("c_atoms", sql="select pdb_id, res_id as cavity_id, 1 as merged_vertices, 0::double as radius_geom, round(x, 4) as center_x, res_id::double as radius_clear from c_atoms")
def unmerged_voids(c: Carriers) -> DataFrame:
    voids = c.atoms.select("pdb_id", F.col("res_id").alias("ordinal"), *"xyz", F.col("res_id").cast("double").alias("clearance"))
    return geometry.unmerged(voids).select("pdb_id", "cavity_id", "merged_vertices", "radius_geom", F.round("center_x", 4).alias("center_x"), "radius_clear")


@query(P, sql=then(LISTS) + ", s as (select pdb_id, list_sort(list(volume)) as src from b group by 1), e as (select pdb_id, list_sort(list(volume)) as dst from a group by 1), r as (select b.pdb_id, b.ord, b.volume, src, dst, len(list_filter(src, lambda x: x < b.volume)) / greatest(len(src) - 1, 1) as share from b left join s using (pdb_id) left join e using (pdb_id)) select pdb_id, ord, " + decimal_round("case when len(src) >= 10 and len(dst) >= 10 then dst[least(round_even(share * (len(dst) - 1), 0)::int, len(dst) - 1) + 1] * (1 + 0.5::double * (1 - least(1, share)) ** 2) else volume end", 3) + " as calibrated from r")
def boosted_calibration(c: Carriers) -> DataFrame:
    a, b = _lists(c)
    return matching.calibrated(b, b, a, boost_max=0.5, boost_power=2.0).select("pdb_id", "ord", F.round("calibrated", 3).alias("calibrated"))


# Validation


@query(P, sql=then("r as (select round(avg((not druggable)::int), 4) as rate from c_pockets)") + " select t::double as threshold, rate, round(t::double - rate, 4) as margin, rate <= t::double as passes from r, (select unnest([0.1, 0.5, 0.9]) as t)")
def threshold_margins(c: Carriers) -> DataFrame:
    one = c.base.agg(F.round(F.avg((~F.col("druggable")).cast("int")), 4).alias("rate"))
    return validation.threshold_sweep(one, "rate", [0.1, 0.5, 0.9])


SECOND = MATCH + ", b5 as (select *, row_number() over (partition by pdb_id order by d, rank) as k from n where rank <= 5 and druggable), m5 as (select c_known.pdb_id, round(b5.d, 4) as best_distance, coalesce(b5.d <= 8, false) as matched from c_known left join b5 on b5.pdb_id = c_known.pdb_id and b5.k = 1)"


def _two_runs(c: Carriers) -> tuple[DataFrame, DataFrame]:
    return _matches(c), matching.site_match(c.known, c.pockets, top_n=5)


@query(P, "c_known", sql=then(SECOND) + ", u as (select 'wide' as run, best_distance from m union all select 'narrow', best_distance from m5), s as (select t::double as tolerance, round(count(*) filter (run = 'narrow' and best_distance <= t) / count(*) filter (run = 'narrow'), 4) as narrow, round(count(*) filter (run = 'wide' and best_distance <= t) / count(*) filter (run = 'wide'), 4) as wide from u, (select unnest([4, 8, 12]) as t) group by 1) select tolerance, narrow, wide, round(wide - narrow, 4) as delta from s")
def recall_change(c: Carriers) -> DataFrame:
    wide, narrow = _two_runs(c)
    sweeps = [validation.tolerance_sweep(r.withColumn("run", F.lit(k)), [4, 8, 12], "run") for k, r in (("wide", wide), ("narrow", narrow))]
    return validation.recall_delta(sweeps[0].unionByName(sweeps[1]), "narrow", "wide")


@query("c_atoms", sql=then(FRAMES) + " select pdb_id, frame::int as frame, round(min(sqrt((x - 1) ** 2 + (y - 2) ** 2 + (z - 3) ** 2)), 4) as clearance from fr where frame % 2 = 0 group by 1, 2")
def clearance_at_point(c: Carriers) -> DataFrame:
    rows = c.atoms.selectExpr("pdb_id", "cast(floor((res_id - 1) / 7) as int) as frame", "x", "y", "z", "cast(1 as double) as px", "cast(2 as double) as py", "cast(3 as double) as pz")
    return validation.clearance_volume(rows, 2).select("pdb_id", "frame", F.round("clearance", 4).alias("clearance"))


@query(P, sql=then("log as (select pdb_id, case when bio_score >= 0.6 then 'success' when druggable then 'timeout' else 'error' end as status, volume as runtime from c_pockets where rank = 1)") + " select count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status = 'error') as error, count(*) filter (status = 'timeout') as timeout, round(count(*) filter (status = 'success') * 100 / count(*), 2) as success_pct, " + decimal_round("sum(runtime)", 2) + " as runtime, coalesce((select string_agg(pdb_id, ',' order by pdb_id) from (select pdb_id from log where status <> 'success' order by 1 limit 50)), '') as first_failures from log")
def crawl_totals(c: Carriers) -> DataFrame:
    log = c.pockets.where("rank = 1").select("pdb_id", F.when(F.col("bio_score") >= 0.6, "success").when(F.col("druggable"), "timeout").otherwise("error").alias("status"), F.col("volume").alias("runtime"))
    return validation.crawl_summary(log).withColumns({"first_failures": F.array_join("first_failures", ","), "runtime": F.round("runtime", 2)})


@query("c_jobs", sql="select status as step, round(sum(latency), 4) as seconds, round(sum(latency) * 100 / sum(sum(latency)) over (), 2) as share_pct, sum(latency) = max(sum(latency)) over () as bottleneck from c_jobs group by 1")
def step_times(c: Carriers) -> DataFrame:
    rows = c.jobs.select(F.col("status").alias("step"), F.col("latency").alias("seconds"))
    return validation.step_summary(rows).withColumn("seconds", F.round("seconds", 4))


@query(P, "c_known", sql=then(SECOND) + " select m.pdb_id, m5.matched as single, m.matched as multi, round(m.best_distance - m5.best_distance, 4) as change, not m5.matched and m.matched as improved, m5.matched and not m.matched as regressed from m join m5 using (pdb_id)")
def case_changes(c: Carriers) -> DataFrame:
    wide, narrow = _two_runs(c)
    return validation.changes(narrow, wide)


@query(P, sql=then("t as (select frame as trial, round(avg(druggable::int), 4) as recall, count(*) as n from c_pockets group by 1)") + " select trial, recall, round(recall - (select recall from t order by trial limit 1), 4) as gain, recall >= 0.22 as stop from t order by recall desc, n desc, trial limit 1")
def best_trial(c: Carriers) -> DataFrame:
    trials = c.base.groupBy(F.col("frame").alias("trial")).agg(F.round(F.avg(F.col("druggable").cast("int")), 4).alias("recall"), F.count("*").alias("n"))
    return validation.best_trial(trials, ["recall", "n"])


@query(P, "c_known", sql=then(SECOND) + ", u as (select 1 as pass_id, pdb_id, matched, best_distance from m5 union all select 2, pdb_id, matched, best_distance from m) select pdb_id, pass_id, matched, best_distance from u qualify row_number() over (partition by pdb_id order by matched desc, best_distance nulls last, pass_id) = 1")
def better_pass(c: Carriers) -> DataFrame:
    wide, narrow = _two_runs(c)
    rows = [r.select("pdb_id", F.lit(k).alias("pass_id"), "matched", "best_distance") for k, r in ((1, narrow), (2, wide))]
    return validation.better_row(rows[0].unionByName(rows[1]))


@query(P, "c_known", sql=then(MATCH) + " select pdb_id, count(*) as n from (select pdb_id from c_pockets where tool = 'A' union all select pdb_id from c_pockets where tool = 'R' and pdb_id in (select pdb_id from m where not matched)) group by 1")
def widened_lists(c: Carriers) -> DataFrame:
    rows = c.base.select("pdb_id", "tool", "pocket_id")
    return validation.widened(rows.where("tool = 'A'"), rows.where("tool = 'R'"), _matches(c).where("not matched")).groupBy("pdb_id").agg(F.count("*").alias("n"))


@query("c_known", sql="select pdb_id, t as trial, t * 4.0::double as tolerance from c_known, (select unnest([1, 2, 3]) as t)")
def trial_cases(c: Carriers) -> DataFrame:
    specs = c.spark.createDataFrame([(k, k * 4.0) for k in (1, 2, 3)], "trial int, tolerance double")
    return validation.trial_grid(c.known.select("pdb_id"), specs)


@query(P, "c_known", sql=then(SECOND) + " select count(*) as guarded, count(*) filter (m5.matched) as hits, coalesce(bool_and(m5.matched), true) as holds from m join m5 using (pdb_id) where m.matched")
def guarded_hits(c: Carriers) -> DataFrame:
    wide, narrow = _two_runs(c)
    return validation.guard(wide.where("matched").select("pdb_id"), narrow)


@query(P, "c_known", sql=then(SECOND) + ", r as (select m.pdb_id, coalesce(m5.best_distance - m.best_distance, 0) as drop, m.best_distance is not null and m.best_distance <= 12 as near, m.matched, (select count(*) from c_pockets p where p.pdb_id = m.pdb_id) as n_pockets from m join m5 using (pdb_id)) select pdb_id, round(drop, 4) as drop, near, matched, n_pockets from r order by r.drop desc, near desc, matched, n_pockets, pdb_id limit 25")
def pilot_cases(c: Carriers) -> DataFrame:
    wide, narrow = _two_runs(c)
    rows = wide.select("pdb_id", "matched", "best_distance").join(narrow.select("pdb_id", F.col("best_distance").alias("other")), "pdb_id").join(c.base.groupBy("pdb_id").agg(F.count("*").alias("n_pockets")), "pdb_id", "left").fillna(0, ["n_pockets"])
    rows = rows.select("pdb_id", F.coalesce(F.col("other") - F.col("best_distance"), F.lit(0.0)).alias("drop"), F.coalesce(F.col("best_distance") <= 12, F.lit(False)).alias("near"), "matched", "n_pockets")
    return validation.pilot(rows).withColumn("drop", F.round("drop", 4))


@query(P, sql="select canonical, count(*) as n from (select 6 + frame % 4 = 8 and 10 * (1 + polar_atoms % 2) = 20 and druggable as canonical from c_pockets) group by 1")
def canonical_runs(c: Carriers) -> DataFrame:
    runs = c.base.selectExpr("cast(6 + frame % 4 as double) as tolerance", "10 * (1 + polar_atoms % 2) as top_n", "druggable as druggable_only")
    return validation.config_drift(runs).groupBy("canonical").agg(F.count("*").alias("n"))


@query(P, "c_known", sql=then(MATCH) + " select m.pdb_id, case when right(m.pdb_id, 1) = '1' then m.pdb_id else 'site ' || m.pdb_id end as name, case when right(m.pdb_id, 1) = '1' then 'unknown' else m.pocket_type end as pocket_type, case when right(m.pdb_id, 1) = '1' then 0 else c_known.x end::double as x, m.matched, best_distance from m join c_known using (pdb_id)")
def mapped_results(c: Carriers) -> DataFrame:
    """Cases of ids that end in 1 are not in the case table."""
    cases = c.known.where("right(pdb_id, 1) <> '1'").withColumn("name", F.concat(F.lit("site "), "pdb_id"))
    return validation.as_results(_matches(c), cases).select("pdb_id", "name", "pocket_type", "x", "matched", "best_distance")


# Ensembles


@query(P, sql="select pdb_id, count(*) as consensus_clusters, round(avg(merged_vertices), 3) as avg_support_frames, round(avg(3 * sphericity), 3) as avg_center_stability, round(avg(0.3::double * sphericity), 3) as avg_volume_cv from c_pockets group by 1")
def consensus_totals(c: Carriers) -> DataFrame:
    return ensemble.consensus_stats(c.base.withColumns({"support_frames": F.col("merged_vertices"), "center_stability": F.col("sphericity") * 3.0, "volume_cv": F.col("sphericity") * 0.3}))


@query(P, sql="select pdb_id, count(*) as n_pockets, round(avg(depth_score), 4) as avg_persistence, max(depth_score) as max_persistence from c_pockets group by 1")
def persistence_totals(c: Carriers) -> DataFrame:
    return ensemble.persistence_summary(c.base.withColumn("persistence_score", F.col("depth_score")))


RESCUE = "druggability_class = 'high' and bio_score >= 0.75 and merged_vertices >= 4 and sphericity <= 0.35 and 0.3::double * sphericity <= 0.25 and hydrophobic_ratio >= 0.45"


@query(P, sql=f"select pdb_id, pocket_id, druggable or ({RESCUE}) as druggable, ({RESCUE}) and not druggable as rescued from c_pockets")
def rescued_pockets(c: Carriers) -> DataFrame:
    rows = c.base.withColumns({"support_frames": F.col("merged_vertices"), "center_stability": F.col("sphericity"), "volume_cv": F.col("sphericity") * 0.3})
    return ensemble.rescue(rows).select("pdb_id", "pocket_id", "druggable", "rescued")


@query(P, sql="select pdb_id, pocket_id, " + decimal_round("least(1, 0.4::double * bio_score + 0.25::double * sphericity + 0.2::double * (depth_score + enclosure_score) / 2 + 0.15::double * least(1, case when polar_atoms = 0 then frame / 7 else polar_atoms / 11 end))", 4) + " as confidence from c_pockets")
def ensemble_confidence(c: Carriers) -> DataFrame:
    rows = c.base.withColumn("support", F.when(F.col("polar_atoms") > 0, F.col("polar_atoms") / 11.0))
    score = S.ensemble_confidence("bio_score", "sphericity", "depth_score", "enclosure_score", "support", "frame", F.lit(7))
    return rows.select("pdb_id", "pocket_id", score.alias("confidence"))


MOTION = "f0 as (select pdb_id, frame, round(avg(depth_score), 4) as rmsd from c_pockets group by 1, 2), f1 as (select *, row_number() over (partition by pdb_id order by frame) - 1 as idx, count(*) over (partition by pdb_id) as n, row_number() over (partition by pdb_id order by rmsd desc, frame) as motion from f0), f2 as (select *, idx = 0 or idx = n - 1 or idx = floor(n / 2) as anchor, (idx * 5) % n as spread from f1), f3 as (select *, case when anchor then 0 when motion <= 3 then 1 else 2 end as o from f2), f4 as (select *, row_number() over (partition by pdb_id order by o, case when o = 1 then motion else spread end, frame) <= 5 as chosen from f3)"


def _motion(c: Carriers) -> DataFrame:
    return c.base.groupBy("pdb_id", "frame").agg(F.round(F.avg("depth_score"), 4).alias("rmsd"))


@query(P, sql=then(MOTION) + " select pdb_id, frame from f4 where chosen")
def motion_frames(c: Carriers) -> DataFrame:
    return ensemble.frame_subset(_motion(c), 5)


@query(P, sql=then(MOTION) + " select pdb_id, count(*) filter (chosen) as n_chosen, round(avg(rmsd) filter (chosen), 4) as avg_chosen, round(avg(rmsd), 4) as avg_all, max(rmsd) filter (chosen) as max_chosen, max(rmsd) as max_all from f4 group by 1")
def frame_diagnostics(c: Carriers) -> DataFrame:
    rows = _motion(c)
    return ensemble.subset_diagnostics(rows, ensemble.frame_subset(rows, 5))


@query(P, sql="select pdb_id, frame, case when frame <> 3 then count(*) end as n_pockets, case when frame <> 3 then count(*) filter (druggable) end as n_druggable, case when frame = 3 then 'bad_number' end as error from c_pockets group by 1, 2")
def frame_statistics(c: Carriers) -> DataFrame:
    """The third frame of every protein could not be analysed."""
    frames = c.base.select("pdb_id", "frame").distinct().withColumn("error", F.when(F.col("frame") == 3, "bad_number"))
    return ensemble.frame_statistics(c.base, frames)


# Jobs, statistics and models


@query("c_jobs", sql="select q.job_id, q.client::varchar as key, coalesce(bool_or(q.ts >= r.ts and date_diff('microsecond', r.ts, q.ts) <= 168 * 3.6e9), false) as hit from c_jobs q left join (select * from c_jobs where status = 'succeeded') r on q.client = r.client where q.status <> 'succeeded' group by 1, 2")
def cache_hits(c: Carriers) -> DataFrame:
    rows = c.jobs.select("job_id", F.col("client").cast("string").alias("key"), "ts", "status")
    return jobs.cached(rows.where("status <> 'succeeded'").drop("status"), rows.where("status = 'succeeded'")).select("job_id", "key", "hit")


@query("c_known", sql="select pdb_id, mode, sha256('n=20,tolerance=8') as config_hash from c_known, (select unnest(['single', 'multi']) as mode) where not (mode = 'single' and pocket_type = 'cryptic')")
def remaining_cases(c: Carriers) -> DataFrame:
    """The cryptic cases were run singly under this configuration, all of them under another."""
    cases = c.known.select("pdb_id", "pocket_type", F.explode(F.array(F.lit("single"), F.lit("multi"))).alias("mode"))
    key = lambda n: F.sha2(F.lit(f"n={n},tolerance=8").cast("binary"), 256).alias("config_hash")
    done = cases.where("pocket_type = 'cryptic' and mode = 'single'").select("pdb_id", "mode", key(20)).unionByName(cases.select("pdb_id", "mode", key(5)))
    return jobs.remaining(cases.drop("pocket_type"), done, {"tolerance": "8", "n": "20"})


@query("c_jobs", sql="select time_bucket(interval 30 minute, ts) - k * interval 30 minute as start, client, count(*) as n from c_jobs, (select unnest([0, 1]) as k) group by 1, 2")
def sliding_requests(c: Carriers) -> DataFrame:
    return jobs.request_counts(c.jobs, "1 hour", "30 minutes")


@query(P, "c_known", sql=then(MATCH) + " select count(*) as n, count(*) filter (matched) as hits, round(avg(matched::int), 4) as recall, round(avg(best_distance) filter (matched), 4) as matched_distance, round(avg(best_distance) filter (not matched), 4) as unmatched_distance from m")
def recall_statistics(c: Carriers) -> DataFrame:
    return stats.recall_stats(_matches(c))


@query(P, sql="select tool as test, round(avg(bio_score), 6) as p, round(0.05::double / count(*) over (), 6) as threshold, coalesce(round(avg(bio_score), 6) < round(0.05::double / count(*) over (), 6), false) as significant from c_pockets group by 1")
def bonferroni(c: Carriers) -> DataFrame:
    return stats.bonferroni(c.base.groupBy(F.col("tool").alias("test")).agg(F.round(F.avg("bio_score"), 6).alias("p")))


@query(P, sql=then("lab as (select pdb_id, pocket_id, case when bio_score <= 0.3 then 0 else 1 end as y from c_pockets where (bio_score >= 0.65 and druggable) or bio_score <= 0.3), i as (select pdb_id, row_number() over (order by substr(h, 1, 2), h, pdb_id) as place, count(*) over () as n from (select distinct pdb_id, sha256('split:' || upper(pdb_id)) as h from lab)), s as (select lab.*, case when place <= floor(n * 0.7) then 'train' when place <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from lab join i using (pdb_id))") + " select split, count(*) as rows, count(*) filter (y = 1) as positives, count(distinct pdb_id) as proteins from s group by 1")
def dataset_manifest(c: Carriers) -> DataFrame:
    return ml.manifest(ml.dataset(c.base)).drop("content_hash")


@query(P, sql="select pdb_id, pocket_id, row_number() over (partition by pdb_id order by depth_score desc, pocket_id) as ml_rank from c_pockets")
def model_rerank(c: Carriers) -> DataFrame:
    return ml.reranked(c.base.select("pdb_id", "pocket_id", "depth_score"), "depth_score").drop("depth_score")


def _parts(c: Carriers) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, stored once: models read them many times. No model needs the pockets' numbers, for which all rows would be sorted."""
    path = c.scratch("dataset")
    ml.dataset(c.base.select("pdb_id", "bio_score", "druggable", *FEATS), 0.5, 0.45).write.parquet(path)
    rows = c.spark.read.parquet(path)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query()
def model_comparison(c: Carriers) -> DataFrame:
    return ml.compared(*_parts(c), FEATS)


@query()
def feature_importances(c: Carriers) -> DataFrame:
    return ml.importances(ml.train(_parts(c)[0], FEATS), FEATS, c.spark)


@query()
def calibrated_model(c: Carriers) -> DataFrame:
    """Boundaries of the isotonic regression and what it predicts at them."""
    model = ml.calibrated(_parts(c)[0], FEATS)
    pairs = list(zip(map(float, model.boundaries), map(float, model.predictions), strict=True))
    return c.spark.createDataFrame(pairs, "boundary double, prediction double")


@query()
def feature_ablation(c: Carriers) -> DataFrame:
    train, test = _parts(c)
    return ml.ablation(train, test, FEATS)
