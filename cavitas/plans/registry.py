"""The registered queries over the supplied tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.functions import scalars as S
from cavitas.operators import atlas, ensemble, geometry, graph, matching, ml, spatial, stats, store, tables, validation
from cavitas.plans.carriers import Carriers, with_sql
from cavitas.sources import readers
from cavitas.streaming import jobs

Query = Callable[[Carriers], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
METRICS = ("volume_score", "hydrophobicity_score", "enclosure_score", "depth_score")
D = "sqrt(({0}x - {1}x) ** 2 + ({0}y - {1}y) ** 2 + ({0}z - {1}z) ** 2)"


def query(*needs: str, sql: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; sql goes on after a WITH clause of the needed derivations."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_sql(*needs) + sql if needs else sql
        return f

    return register


def decimal_round(sql: str, places: int) -> str:
    """Rounds the number's decimal text half up, as Spark does."""
    return f"round(cast(cast({sql} as varchar) as decimal(38, 18)), {places})::double"


def then(sql: str) -> str:
    """More WITH members after the derivations."""
    return ", " + sql


# Atlas

#: The mean of scores of four places to six places, in integers.
EXACT_MEAN = "((sum(round(bio_score * 10000)::bigint) * 200 + count(*)) // (2 * count(*)))::double / 1000000"
P = "c_pockets"
TOP = ("pdb_id", "pocket_id", "bio_score", "volume")


@query(P, sql="select pdb_id, count(*) as total_cavities, count(*) filter (druggable) as druggable_count, count(*) filter (druggability_class = 'high') as high_score, count(*) filter (druggability_class = 'medium') as medium_score, count(*) filter (druggability_class = 'low') as low_score, max(bio_score) as top_bio_score, round(avg(bio_score), 4) as avg_bio_score, round(avg(volume), 2) as avg_volume from c_pockets group by pdb_id")
def protein_detail(c: Carriers) -> DataFrame:
    return atlas.proteins(c.base)


@query(P, sql="select count(distinct pdb_id) as total_proteins, count(*) as total_pockets, count(*) filter (druggable) as druggable_pockets, count(*) filter (druggable and bio_score >= 0.6) as elite_pockets, round(avg(bio_score), 4) as avg_bio_score, min(bio_score) as min_bio_score, max(bio_score) as max_bio_score, round(avg(volume), 2) as avg_volume from c_pockets")
def atlas_statistics(c: Carriers) -> DataFrame:
    return atlas.statistics(c.base)


@query(P, sql="select druggability_class, count(*) as n from c_pockets group by 1")
def class_distribution(c: Carriers) -> DataFrame:
    return atlas.class_distribution(c.base)


@query(P, sql="select pdb_id, pocket_id, bio_score, volume from c_pockets where bio_score between 0.4 and 0.6 order by bio_score desc, pdb_id, pocket_id limit 100 offset 50")
def score_range_page(c: Carriers) -> DataFrame:
    return atlas.score_range(c.base, 0.4, 0.6, 100, 50).select(*TOP)


@query(P, sql="select pdb_id, pocket_id, bio_score, volume from c_pockets where druggable and volume >= 500 and druggability_class = 'medium' order by bio_score desc, pdb_id, pocket_id limit 1000")
def druggable_pockets(c: Carriers) -> DataFrame:
    return atlas.druggable(c.base, "medium", 500).select(*TOP)


@query(P, sql="select pdb_id, pocket_id, bio_score, volume from c_pockets where druggable and bio_score >= 0.6 and volume >= 100 order by bio_score desc, pdb_id, pocket_id limit 1000")
def elite_pockets(c: Carriers) -> DataFrame:
    return atlas.elite(c.base).select(*TOP)


@query(P, sql="select pdb_id, pocket_id, bio_score, volume from c_pockets where bio_score >= 0.3 and volume between 200 and 2000 and druggable order by volume desc, pdb_id, pocket_id limit 200 offset 20")
def search_pockets(c: Carriers) -> DataFrame:
    return atlas.search(c.base, min_score=0.3, min_volume=200, max_volume=2000, druggable=True, order="volume_desc", limit=200, offset=20).select(*TOP)


@query(P, sql="select pdb_id, pocket_id, rank, bio_score from c_pockets where pdb_id = 'P000003' order by rank")
def pockets_of_protein(c: Carriers) -> DataFrame:
    return store.pockets_of(c.atlas(), " p000003 ").select("pdb_id", "pocket_id", "rank", "bio_score")


@query(P, sql="select pdb_id, count(*) as total_cavities, count(*) filter (druggable) as druggable_count, max(bio_score) as top_bio_score from c_pockets where pdb_id = 'P000003' group by 1")
def protein_of_atlas(c: Carriers) -> DataFrame:
    return store.protein(c.atlas(), "p000003").select("pdb_id", "total_cavities", "druggable_count", "top_bio_score")


@query(P, sql="select distinct pdb_id from c_pockets")
def protein_list(c: Carriers) -> DataFrame:
    return c.base.select("pdb_id").distinct().orderBy("pdb_id")


@query(P, sql="select pdb_id, max(bio_score) as top_bio_score from c_pockets group by 1 order by 2 desc, 1 limit 10")
def top_proteins(c: Carriers) -> DataFrame:
    return atlas.leaders(c.base.groupBy("pdb_id").agg(F.max("bio_score").alias("top_bio_score")))


@query(P, sql="select pdb_id, pocket_id, bio_score, center_x, center_y, center_z from c_pockets where rank = 1")
def best_pocket_per_protein(c: Carriers) -> DataFrame:
    return atlas.best_of_each(c.base)


@query(P, sql="select pdb_id, pocket_id, rank from (select pdb_id, pocket_id, row_number() over (partition by pdb_id order by bio_score desc, pocket_id) as rank from c_pockets where druggable and volume >= 100) where rank <= 20")
def topn_extract(c: Carriers) -> DataFrame:
    return atlas.top_extract(c.base.select("pdb_id", "pocket_id", "druggable", "volume", "bio_score")).select("pdb_id", "pocket_id", "rank")


@query(P, sql="select least(floor(bio_score * 20), 19)::int as bin, count(*) as n from c_pockets group by 1")
def score_histogram(c: Carriers) -> DataFrame:
    return atlas.histogram(c.base)


@query(P, sql="select pdb_id, pages from (select distinct pdb_id, (select ceil(count(distinct pdb_id) / 10)::bigint from c_pockets where contains(pdb_id, '01')) as pages from c_pockets where contains(pdb_id, '01')) order by pdb_id limit 10")
def search_box_page(c: Carriers) -> DataFrame:
    return atlas.contains_page(c.base.select("pdb_id").distinct(), "01", 1, 10)


@query(P, sql="select pdb_id, frame, pocket_id from (select *, row_number() over (partition by pdb_id, frame order by pocket_id) - 1 as place, count(*) over (partition by pdb_id, frame) as n from c_pockets) where place = floor(n / 2)")
def middle_pick(c: Carriers) -> DataFrame:
    lines = c.table("lineitem")
    n = lines.count()  # from the files' footers
    rows = c.base_of(atlas.dealt(lines, n, "l_suppkey")).select("pdb_id", "frame", "pocket_id")
    return atlas.middle_of_each(rows, ["pdb_id", "frame"], "pocket_id", n)


@query(P, sql="select pdb_id, pocket_id from c_pockets where rank <= 50 and (druggable or druggability_class in ('high', 'medium'))")
def worth_storing(c: Carriers) -> DataFrame:
    return atlas.worth_storing(c.pockets).select("pdb_id", "pocket_id")


# Scoring


@query(P, sql="select pdb_id, pocket_id, " + decimal_round("0.15 * volume_score + 0.2 * hydrophobicity_score + 0.35 * enclosure_score + 0.3 * depth_score", 4) + " as enzyme, " + decimal_round("0.35 * volume_score + 0.35 * hydrophobicity_score + 0.1 * enclosure_score + 0.2 * depth_score", 4) + " as ppi from c_pockets")
def bio_score(c: Carriers) -> DataFrame:
    metrics = [F.col(m) for m in METRICS]
    return c.base.select("pdb_id", "pocket_id", *(S.bio_score(*metrics, profile=p).alias(p) for p in ("enzyme", "ppi")))


@query(P, sql="select pdb_id, pocket_id, rank from c_pockets where rank <= 10")
def rank_pockets(c: Carriers) -> DataFrame:
    return atlas.ranked(c.base.select("pdb_id", "pocket_id", "bio_score"), 10).select("pdb_id", "pocket_id", "rank")


@query(P, sql="select pdb_id, pocket_id, ((volume between 200 and 1000)::int + (hydrophobicity_score between 0.3 and 0.7)::int + (enclosure_score > 0.5)::int + (depth_score > 0.3)::int) / 4.0::double as drug_likeness from c_pockets")
def drug_likeness(c: Carriers) -> DataFrame:
    return c.base.select("pdb_id", "pocket_id", S.drug_likeness("volume", "hydrophobicity_score", "enclosure_score", "depth_score").alias("drug_likeness"))


CONFIDENCE = "c as (select *, case when volume > 80 and volume < 2500 then 1.0 else 0.6 end::double as cv, 0.8::double as ch, least(1.0::double, merged_vertices / 10.0::double) as ce, 0.9::double as cd from c_pockets), o as (select *, (cv + ch + ce + cd) / 4 as overall from c)"


@query(P, sql=then(CONFIDENCE) + " select pdb_id, pocket_id, round(overall, 4) as overall, " + decimal_round("greatest(0::double, (volume_score * cv + hydrophobicity_score * ch + enclosure_score * ce + depth_score * cd) / (cv + ch + ce + cd) - 0.15::double * (1 - overall))", 4) + " as score_lower from o")
def confidence(c: Carriers) -> DataFrame:
    metrics = {k: F.col(f"{k}_score") for k in ("volume", "hydrophobicity", "enclosure", "depth")}
    rows = c.base.withColumn("conf", S.confidence("merged_vertices", "volume", "hydrophobic_ratio", metrics))
    return rows.select("pdb_id", "pocket_id", F.col("conf.overall").alias("overall"), F.col("conf.score_lower").alias("score_lower"))


@query(P, sql=then(CONFIDENCE) + ", p as (select *, case when bio_score >= 0.55 then 3 when bio_score >= 0.3 then 2 when bio_score >= 0.2 then 1 else 0 end + case when round(overall, 4) >= 0.8 then 2 when round(overall, 4) >= 0.6 then 1 else 0 end + case when merged_vertices >= 8 then 2 when merged_vertices >= 4 then 1 else 0 end + case when druggable then 1.5 else 0 end + case when volume between 150 and 2500 then 1 when volume >= 80 and volume < 150 then 0.5 else 0 end + (depth_score >= 0.5)::int + (enclosure_score >= 0.6)::int + 0.5 * (sphericity between 0.3 and 0.9)::int + 0.5 * (hydrophobic_ratio >= 0.4)::int as pts from o) select tier, count(*) as n from (select case when pts >= 8 then 'strong' when pts >= 5 then 'moderate' when pts >= 2.5 then 'weak' else 'insufficient' end as tier from p) group by 1")
def evidence_tier(c: Carriers) -> DataFrame:
    metrics = {k: F.col(f"{k}_score") for k in ("volume", "hydrophobicity", "enclosure", "depth")}
    rows = c.base.withColumn("conf", S.confidence("merged_vertices", "volume", "hydrophobic_ratio", metrics))
    tier = S.evidence_tier("bio_score", "conf.overall", "merged_vertices", "druggable", "volume", "depth_score", "enclosure_score", "sphericity", "hydrophobic_ratio")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(P, sql="select y, count(*) as n from (select case when bio_score >= 0.65 and druggable then 1 when bio_score <= 0.3 then 0 else -1 end as y from c_pockets) group by 1")
def label_policy(c: Carriers) -> DataFrame:
    return c.base.groupBy(S.label_policy("bio_score", "druggable").alias("y")).agg(F.count("*").alias("n"))


@query(P, sql="select pdb_id, pocket_id, center_x as x, center_y as y, center_z as z from c_pockets")
def parse_center_text(c: Carriers) -> DataFrame:
    text = F.concat(F.lit("["), F.concat_ws(", ", *(F.col(a).cast("string") for a in atlas.CENTER)), F.lit("]"))
    rows = c.base.withColumn("c", S.parse_center(text))
    return rows.select("pdb_id", "pocket_id", *(F.col("c")[k].alias(a) for k, a in enumerate("xyz")))


@query(P, sql=then("a as (select * from (select pdb_id, pocket_id, center_x as x, center_y as y, center_z as z, depth_score, enclosure_score, bio_score, row_number() over (partition by pdb_id order by volume desc, pocket_id) as ord from c_pockets where tool = 'A') where ord <= 20), r as (select * from (select pdb_id, pocket_id, center_x as x, center_y as y, center_z as z, row_number() over (partition by pdb_id order by volume desc, pocket_id) as ord from c_pockets where tool = 'R') where ord <= 20), n as (select a.pdb_id, a.pocket_id, min(" + D.format("a.", "r.") + ") as d from a left join r on a.pdb_id = r.pdb_id group by all)") + " select a.pdb_id, a.pocket_id, " + decimal_round("least(1, greatest(0, depth_score * 0.3 + enclosure_score * 0.3 + bio_score * 0.2 + case when d is null or d > 8 then 0.2 else 0.2 * (d / 8) end))", 4) + " as novelty from a join n on a.pdb_id = n.pdb_id and a.pocket_id = n.pocket_id")
def novelty(c: Carriers) -> DataFrame:
    rows = atlas.ranked(c.base.where("tool = 'A'"), 20, score="volume")
    rival = matching.tool_lists(c.base, "R").select("pdb_id", *(F.col(x).alias(f"r_{x}") for x in atlas.CENTER), F.col("ord").alias("r_ord"))
    near = spatial.nearest(rows, rival, "pdb_id", ["pocket_id"], [f"r_{x}" for x in atlas.CENTER], list(atlas.CENTER), ["r_ord"], "r_ord")
    found = rows.join(near.select("pdb_id", "pocket_id", F.col("dist").alias("d")), ["pdb_id", "pocket_id"], "left")
    return found.select("pdb_id", "pocket_id", S.novelty("depth_score", "enclosure_score", "bio_score", "d").alias("novelty"))


# Spatial joins and matching

NEAR = "select pdb_id, pocket_type, x, y, z, pocket_id, bio_score, rank, druggable, " + D.format("k.", "q.") + " as d from c_known k join (select pdb_id, pocket_id, bio_score, rank, druggable, center_x as x, center_y as y, center_z as z from c_pockets) q using (pdb_id)"
NEAR = NEAR.replace("x, y, z, pocket_id", "k.x, k.y, k.z, pocket_id")


@query(P, "c_known", sql=then(f"n as ({NEAR}), e as (select *, d * case when bio_score >= 0.55 then 0.85 when bio_score >= 0.3 then 0.92 else 1 end as eff from n), b as (select *, row_number() over (partition by pdb_id order by eff, pocket_id) as k, count(*) over (partition by pdb_id) as n_pockets from e)") + " select c_known.pdb_id, c_known.pocket_type, b.pocket_id, round(b.d, 4) as distance, coalesce(b.eff <= 8, false) as hit, coalesce(b.n_pockets, 0) as n_pockets from c_known left join b on b.pdb_id = c_known.pdb_id and b.k = 1")
def known_site_hits(c: Carriers) -> DataFrame:
    return matching.known_hits(c.known, c.base)


MATCH = f"n as ({NEAR}), b as (select *, row_number() over (partition by pdb_id order by d, rank) as k from n where rank <= 20 and druggable), m as (select c_known.pdb_id, c_known.pocket_type, b.pocket_id, b.rank, round(b.d, 4) as best_distance, coalesce(b.d <= 8, false) as matched from c_known left join b on b.pdb_id = c_known.pdb_id and b.k = 1)"


def _matches(c: Carriers) -> DataFrame:
    return matching.site_match(c.known, c.pockets)


@query(P, "c_known", sql=then(MATCH) + " select * from m")
def known_site_match(c: Carriers) -> DataFrame:
    return _matches(c).drop("bio_score")


@query(P, "c_known", sql=then(MATCH) + " select pocket_type, count(*) as cases, count(*) filter (matched) as hits, round(count(*) filter (matched) / count(*), 4) as recall, coalesce(round(count(*) filter (matched) / nullif(count(best_distance), 0), 4), 0) as precision, round(2 * count(*) filter (matched) / (count(best_distance) + count(*)), 4) as f1, round(avg(best_distance), 4) as avg_distance from m group by 1")
def recall_by_type(c: Carriers) -> DataFrame:
    return validation.recall_summary(_matches(c), "pocket_type")


@query(P, "c_known", sql=then(MATCH) + " select t::double as tolerance, count(*) as cases, count(*) filter (best_distance <= t) as hits, round(count(*) filter (best_distance <= t) / count(*), 4) as recall, round(avg(best_distance) filter (best_distance <= t), 4) as avg_distance, count(*) filter (best_distance > t and best_distance <= t + 2) as near_misses from m, (select unnest([4, 6, 8, 10, 12]) as t) group by t")
def tolerance_sweep(c: Carriers) -> DataFrame:
    return validation.tolerance_sweep(_matches(c), [4, 6, 8, 10, 12])


@query(P, "c_known", sql=then(MATCH) + " select t::int as top_n, count(*) as cases, count(*) filter (matched and (rank is null or rank <= t)) as hits, round(count(*) filter (matched and (rank is null or rank <= t)) / count(*), 4) as recall, 'exact' as note from m, (select unnest([1, 3, 5, 10, 20]) as t) group by t")
def top_n_sweep(c: Carriers) -> DataFrame:
    return validation.top_n_sweep(_matches(c), [1, 3, 5, 10, 20])


@query(P, "c_known", sql=then(MATCH) + " select pdb_id, pocket_type, best_distance, round(best_distance - 8, 4) as gap, case when best_distance is null then 'no_pocket' when round(best_distance - 8, 4) <= 1 then 'marginal' when round(best_distance - 8, 4) <= 4 then 'near' else 'far' end as category from m where not matched")
def near_miss(c: Carriers) -> DataFrame:
    return validation.near_misses(_matches(c))


LISTS = "t as (select *, row_number() over (partition by pdb_id, tool order by volume desc, pocket_id) as ord from c_pockets), a as (select * from t where tool = 'A' and ord <= 20), b as (select * from t where tool = 'R' and ord <= 20), pr as (select a.pdb_id, a.ord as a, b.ord as b, a.volume as va, b.volume as vb, sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2 + (a.center_z - b.center_z) ** 2) as d from a join b on a.pdb_id = b.pdb_id)"


def _lists(c: Carriers) -> tuple[DataFrame, DataFrame]:
    return matching.tool_lists(c.base, "A"), matching.tool_lists(c.base, "R")


@query(P, sql=then(LISTS) + " select pdb_id, a, b, round(d, 4) as d from pr where d <= 8")
def tool_pairs(c: Carriers) -> DataFrame:
    return matching.candidate_pairs(*_lists(c)).select("pdb_id", "a", "b", F.round("d", 4).alias("d"))


GREEDY = LISTS + ", opts as (select pdb_id, a, list(b order by d, b) as bs from pr where d <= 8 group by 1, 2), steps as (select *, row_number() over (partition by pdb_id order by a) as k from opts), walk as (select pdb_id, 0::bigint as k, []::bigint[] as used from (select distinct pdb_id from opts) union all select w.pdb_id, s.k, case when len(list_filter(s.bs, lambda x: not list_contains(w.used, x))) > 0 then list_append(w.used, list_filter(s.bs, lambda x: not list_contains(w.used, x))[1]) else w.used end from walk w join steps s on s.pdb_id = w.pdb_id and s.k = w.k + 1), done as (select pdb_id, arg_max(len(used), k) as matched from walk group by 1), na as (select pdb_id, count(*) as n_a from a group by 1), nb as (select pdb_id, count(*) as n_b from b group by 1), o as (select coalesce(na.pdb_id, nb.pdb_id) as pdb_id, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b, coalesce(matched, 0) as matched from na full join nb on na.pdb_id = nb.pdb_id left join done on done.pdb_id = coalesce(na.pdb_id, nb.pdb_id))"


def _overlap(c: Carriers) -> DataFrame:
    a, b = _lists(c)
    return matching.overlap(a, b, matching.greedy(matching.candidate_pairs(a, b)))


@query(P, sql=then(GREEDY) + " select *, n_a - matched as unique_a, n_b - matched as unique_b, round(2 * matched / (n_a + n_b), 4) as dice from o")
def greedy_match_dice(c: Carriers) -> DataFrame:
    return _overlap(c)


@query(P, sql=then(GREEDY) + " select sum(matched)::bigint as matched, sum(n_a - matched)::bigint as unique_a, sum(n_b - matched)::bigint as unique_b, round(sum(matched) * 2.0::double / sum(n_a + n_b), 4) as dice, round(sum(n_a - matched) * 100.0::double / sum(n_a), 2) as unique_a_pct from o")
def global_overlap(c: Carriers) -> DataFrame:
    return matching.global_overlap(_overlap(c))


#: By Koenig's theorem a largest matching is as large as the least vertex cover: over all sets of A's pockets left out, those kept and all neighbours of those left out.
COVER = "nb as (select pdb_id, a, bit_or(1::bigint << b) as mask, row_number() over (partition by pdb_id order by a) - 1 as i from pr where d <= 8 group by 1, 2), ks as (select pdb_id, count(*) as k from nb group by 1), sets as (select pdb_id, k, unnest(range(1::bigint << k)) as s from ks), covers as (select s.pdb_id, s.s, any_value(s.k) - bit_count(s.s) + bit_count(bit_or(case when (s.s >> nb.i) & 1 = 1 then nb.mask else 0 end)) as size from sets s join nb on nb.pdb_id = s.pdb_id group by 1, 2)"


@query(P, sql=then(LISTS + ", " + COVER) + " select pdb_id, min(size)::int as size from covers group by 1")
def maximum_matching(c: Carriers) -> DataFrame:
    return matching.most_matches(matching.candidate_pairs(*_lists(c)))


@query(P, sql=then(LISTS) + ", q as (select pdb_id, a, count(*) filter (va / vb between 0.5 and 2) as ok, count(*) filter (va / vb < 0.5) as lo, count(*) filter (va / vb > 2) as hi from pr where d <= 8 group by 1, 2), z as (select a.pdb_id, case when ok is null then 'distance' when ok > 0 then 'pass' when lo >= hi then 'volume_low' else 'volume_high' end as reason from a left join q on q.pdb_id = a.pdb_id and q.a = a.ord) select pdb_id, count(*) filter (reason = 'pass') as pass, count(*) filter (reason = 'distance') as distance, count(*) filter (reason = 'volume_low') as volume_low, count(*) filter (reason = 'volume_high') as volume_high, 0::bigint as volume_missing from z group by 1")
def match_diagnostics(c: Carriers) -> DataFrame:
    return matching.diagnostics(*_lists(c))


@query(P, sql=then(LISTS) + " select pdb_id, round(min(d), 4) as min_nearest, round(quantile_cont(d, 0.5), 4) as median_nearest, count(*) filter (d <= 8) as within from (select pdb_id, a, min(d) as d from pr group by 1, 2) group by 1")
def nearest_rival(c: Carriers) -> DataFrame:
    return matching.nearest_stats(*_lists(c))


@query(P, sql=then(LISTS) + ", g(config, low, high) as (values (0, 0.5::double, 2.0::double), (1, 0.4, 2.5), (2, 0.33, 3.0), (3, 0.25, 4.0), (4, 0.2, 5.0)), h as (select config, count(distinct (pdb_id, a)) as hits from pr, g where d <= 8 and va / vb between low and high group by 1), f as (select g.config, low, high, coalesce(hits, 0) as hits, round(coalesce(hits, 0) * 2.0::double / ((select count(*) from a) + (select count(*) from b)), 4) as overlap from g left join h using (config)) select *, config = (select config from f order by overlap desc, config limit 1) as best from f")
def config_overlap(c: Carriers) -> DataFrame:
    a, b = _lists(c)
    n = a.select("pdb_id").unionByName(b.select("pdb_id")).agg(F.count("*").alias("n"))
    return matching.config_overlap(matching.candidate_pairs(a, b), n)


@query(P, sql=then(LISTS) + ", s as (select pdb_id, list_sort(list(volume)) as src from b group by 1), e as (select pdb_id, list_sort(list(volume)) as dst from a group by 1) select b.pdb_id, b.ord, round(case when len(src) >= 10 and len(dst) >= 10 then dst[round_even(len(list_filter(src, lambda x: x < b.volume)) / greatest(len(src) - 1, 1) * (len(dst) - 1), 0)::int + 1] else b.volume end, 4) as calibrated from b left join s using (pdb_id) left join e using (pdb_id)")
def volume_calibration(c: Carriers) -> DataFrame:
    a, b = _lists(c)
    return matching.calibrated(b, b, a).select("pdb_id", "ord", F.round("calibrated", 4).alias("calibrated"))


@query(P, sql=then(LISTS) + ", v as (select list_sort(list(va / vb)) as v from pr where d <= 8) select round(v[round_even((len(v) - 1) * 0.1, 0)::int + 1], 4) as p10, round(v[round_even((len(v) - 1) * 0.5, 0)::int + 1], 4) as p50, round(v[round_even((len(v) - 1) * 0.9, 0)::int + 1], 4) as p90 from v where len(v) > 0")
def ratio_percentiles(c: Carriers) -> DataFrame:
    pairs = matching.candidate_pairs(*_lists(c)).withColumn("ratio", F.col("va") / F.col("vb"))
    return matching.nearest_rank(pairs, "ratio", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(P, sql=then("q as (select * from c_pockets where pdb_id = 'P000001' and rank = 1), v as (select p.pdb_id, p.pocket_id, [p.volume_score, p.hydrophobicity_score, p.enclosure_score, p.depth_score, p.sphericity] as v, [q.volume_score, q.hydrophobicity_score, q.enclosure_score, q.depth_score, q.sphericity] as w from c_pockets p, q where not (p.pdb_id = q.pdb_id and p.pocket_id = q.pocket_id)), s as (select pdb_id, pocket_id, list_cosine_similarity(v, w) as c, list_distance(v, w) as e from v)") + " select pdb_id, pocket_id, round(0.6 * greatest(0, c) + 0.4 * greatest(0, 1 - e / sqrt(5)), 4) as composite, round(c, 4) as cosine, round(e, 4) as euclid from s order by 3 desc, 1, 2 limit 10")
def pocket_similarity_topk(c: Carriers) -> DataFrame:
    rows = c.pockets
    return spatial.similar(rows.where("pdb_id = 'P000001' and rank = 1"), rows)


@query("c_atoms", sql="select a.pdb_id, a.res_id as src, b.res_id as dst, round(" + D.format("a.", "b.") + ", 4) as dist from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id where " + D.format("a.", "b.") + " < 8")
def contact_pairs(c: Carriers) -> DataFrame:
    return graph.contacts(c.atoms).withColumn("dist", F.round("dist", 4))


@query("c_atoms", sql="select a.pdb_id, a.res_id, count(b.res_id) as n_near from c_atoms a left join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id and " + D.format("a.", "b.") + " <= 6 group by all")
def radius_neighbours(c: Carriers) -> DataFrame:
    found = spatial.pairs(c.atoms.select("pdb_id", "res_id", *"xyz"), 6.0, "res_id", strict=False)
    n = found.groupBy("pdb_id", F.col("a_res_id").alias("res_id")).agg(F.count("*").alias("n_near"))
    return c.atoms.select("pdb_id", "res_id").join(n, ["pdb_id", "res_id"], "left").fillna(0, ["n_near"])


SPLIT = "r as (select *, case res_id % 3 when 0 then 'N' when 1 then 'C' else 'O' end as element from c_atoms where res_id <= 14), l as (select *, case res_id % 2 when 0 then 'O' else 'C' end as element from c_atoms where res_id > 14), i as (select r.pdb_id, concat(r.res_name, r.res_id) as res, r.element as e, l.element as f, " + D.format("r.", "l.") + " as d from r join l on r.pdb_id = l.pdb_id), t as (select *, case when e in ('N', 'O') and f in ('N', 'O') and d between 2.5 and 3.5 then 'hbond' when e = 'C' and f = 'C' then 'hydrophobic' else 'vdw' end as kind from i where d < 4)"


@query("c_atoms", sql=then(SPLIT) + " select pdb_id, count(*) filter (kind = 'hbond') as n_hbond, count(*) filter (kind = 'vdw') as n_vdw, count(*) filter (kind = 'hydrophobic') as n_hydrophobic, string_agg(distinct res, ',' order by res) as residues from t group by 1")
def interaction_report(c: Carriers) -> DataFrame:
    rows = c.atoms
    receptor = rows.where("res_id <= 14").withColumn("element", F.expr("case res_id % 3 when 0 then 'N' when 1 then 'C' else 'O' end"))
    ligand = rows.where("res_id > 14").withColumn("element", F.expr("case res_id % 2 when 0 then 'O' else 'C' end"))
    return spatial.interaction_report(spatial.interactions(receptor, ligand)).withColumn("residues", F.array_join("residues", ","))


@query(P, sql=then("z as (select pdb_id, pocket_id, rank, case when pocket_id % 5 = 0 then 0 else center_x end as x, case when pocket_id % 5 = 0 then 0 else center_y end as y, case when pocket_id % 5 = 0 then 0 else center_z end as z from c_pockets), f as (select z.*, abs(x) < 1e-12 and abs(y) < 1e-12 and abs(z) < 1e-12 as zero from z)") + " select case when not zero then 'kept' when pocket_id % 10 = 0 then 'by_id' when pocket_id % 15 = 0 then 'computed' else 'missing' end as center_source, count(*) as n from f group by 1")
def center_repair(c: Carriers) -> DataFrame:
    rows = c.pockets
    bad = rows.withColumns({x: F.when(F.col("pocket_id") % 5 == 0, 0.0).otherwise(F.col(x)) for x in atlas.CENTER})
    none = rows.where("false")
    fixed = matching.repaired(bad, rows.where("pocket_id % 10 = 0"), none, rows.where("pocket_id % 15 = 0"))
    return fixed.groupBy("center_source").agg(F.count("*").alias("n"))


# Validation


@query(P, sql="select v::double as min_volume, count(*) filter (volume >= v) as detected, count(*) filter (volume < v) as not_detected, 0::bigint as unavailable, round(count(*) filter (volume >= v) / count(*), 4) as rate from c_pockets, (select unnest([100, 500, 1000, 2000]) as v) group by v")
def min_volume_sweep(c: Carriers) -> DataFrame:
    return validation.min_volume_sweep(c.base.select("volume"), [100, 500, 1000, 2000])


EVID = "e as (select pdb_id, pocket_id, bio_score, pocket_id % 4 = 0 as known_match, pocket_id % 3 = 0 as ligand_nearby, pocket_id % 5 = 0 as tool_match, affinity < -6 as docking_validated, (pocket_id % 3)::int as sources from c_pockets where rank <= 20), w as (select *, round(0.2 * known_match::int + 0.3 * ligand_nearby::int + 0.3 * tool_match::int + 0.2 * docking_validated::int, 4)::double as weight from e), s as (select *, case when weight >= 0.3 then 'supported' when sources < 2 then 'unknown' else 'unsupported' end as status from w)"


def _evidence(c: Carriers) -> DataFrame:
    rows = validation.candidates(c.pockets).selectExpr("pdb_id", "pocket_id", "bio_score", "pocket_id % 4 = 0 as known_match", "pocket_id % 3 = 0 as ligand_nearby", "pocket_id % 5 = 0 as tool_match", "affinity < -6 as docking_validated", "cast(pocket_id % 3 as int) as sources", "true as center_ok")
    return validation.evidence_status(rows)


@query(P, sql=then(EVID) + " select count(*) as candidates, count(*) filter (status = 'supported') as supported, count(*) filter (status = 'unsupported') as unsupported, count(*) filter (status = 'unknown') as unknown, round(count(*) filter (status = 'unsupported') / count(*) filter (status <> 'unknown'), 4) as fpr_conservative, round(count(*) filter (status <> 'supported') / count(*), 4) as fpr_strict, round(count(*) filter (status = 'unknown') / count(*), 4) as unknown_rate, count(*) filter (known_match) as known_match, count(*) filter (ligand_nearby) as ligand_nearby, count(*) filter (tool_match) as tool_match, count(*) filter (docking_validated) as docking_validated from s")
def fpr_summary(c: Carriers) -> DataFrame:
    return validation.fpr_summary(_evidence(c))


@query(P, sql=then(EVID) + " select pdb_id, pocket_id, bio_score, weight as evidence_weight, case when weight >= 0.3::double - 0.1::double then 'borderline' else 'likely_false_positive' end as verdict from s where status = 'unsupported' order by bio_score desc, pdb_id, pocket_id limit 20")
def manual_review(c: Carriers) -> DataFrame:
    return validation.review(_evidence(c))


@query(P, "c_known", sql=then("n as (select p.pdb_id, frame, pocket_id, volume, sqrt((center_x - k.x) ** 2 + (center_y - k.y) ** 2 + (center_z - k.z) ** 2) as d from c_pockets p join c_known k using (pdb_id)), b as (select *, row_number() over (partition by pdb_id, frame order by d, pocket_id) as k from n), m as (select pdb_id, d, case when d <= 8 then volume else 0 end as v from b where k = 1), r as (select pdb_id, count(*) as snapshots, round(avg(v), 2) as avg_volume, round(max(v), 2) as max_volume, round(count(*) filter (v >= 100) / count(*), 4) as open_fraction, round(min(d), 4) as min_distance from m group by 1)") + " select *, case when open_fraction >= 0.5 then 'open' when open_fraction > 0 then 'transient' else 'closed' end as status from r")
def snapshot_summary(c: Carriers) -> DataFrame:
    ref = c.known.select("pdb_id", *(F.col(a).alias(f"ref_{a}") for a in "xyz"))
    return validation.snapshot_summary(validation.snapshot_match(c.base.select("pdb_id", "frame", "pocket_id", "volume", *atlas.CENTER), ref))


@query("c_known", sql=then("t as (select *, count(*) over (partition by pocket_type) as type_size, row_number() over (partition by pocket_type order by sha256('seed7:' || upper(pdb_id)), pdb_id) as turn from c_known)") + " select pdb_id, pocket_type, turn from t order by turn, type_size, pocket_type limit 25")
def holdout_roundrobin(c: Carriers) -> DataFrame:
    return validation.round_robin(c.known, 25, "seed7").select("pdb_id", "pocket_type", "turn")


@query("c_known", sql="select pdb_id from c_known order by sha256('seed7:' || upper(pdb_id)), pdb_id limit 15")
def holdout_hash(c: Carriers) -> DataFrame:
    return validation.hash_sample(c.known, 15, "seed7")


PAIRED = MATCH + ", m2 as (select *, row_number() over (partition by pdb_id order by d, rank) as k from n where rank <= 5 and druggable), s2 as (select c_known.pdb_id, coalesce(m2.d <= 8, false) as matched from c_known left join m2 on m2.pdb_id = c_known.pdb_id and m2.k = 1), pp as (select m.pdb_id, m.matched as a, s2.matched as b from m join s2 using (pdb_id))"


def _paired(c: Carriers) -> DataFrame:
    return matching.paired(_matches(c), matching.site_match(c.known, c.pockets, top_n=5))


@query(P, "c_known", sql=then(PAIRED) + " select count(*) filter (a and b) as both, count(*) filter (a and not b) as only_a, count(*) filter (not a and b) as only_b, count(*) filter (not a and not b) as neither, round(count(*) filter (a <> b) * 100 / count(*), 2) as complementarity_pct from pp")
def paired_outcomes(c: Carriers) -> DataFrame:
    return matching.pairing_summary(_paired(c))


@query(P, "c_known", sql=then(PAIRED) + " select n10, n01, round(case when n10 + n01 = 0 then 1 else least(1, 2 * (select sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))) from range(least(n10, n01) + 1) t(i))) end, 6) as p_exact, round(case when n10 + n01 = 0 then 0 else greatest(abs(n10 - n01) - 1, 0) ** 2 / (n10 + n01) end, 4) as chi2, case when n10 + n01 = 0 then 'none' else 'exact_binomial' end as method from (select count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01 from pp)")
def mcnemar(c: Carriers) -> DataFrame:
    return stats.mcnemar(_paired(c))


@query(P, sql="select *, value >= threshold as passes, bool_and(value >= threshold) over () as all_pass from (select 'elite_share' as metric, round(avg((druggable and bio_score >= 0.6)::int), 4) as value, 0.1::double as threshold, '>=' as direction from c_pockets union all select 'mean_score', round(avg(bio_score), 4), 0.3, '>=' from c_pockets)")
def gate_table(c: Carriers) -> DataFrame:
    one = c.base.agg(F.round(F.avg((F.col("druggable") & (F.col("bio_score") >= 0.6)).cast("double")), 4).alias("elite_share"), F.round(F.avg("bio_score"), 4).alias("mean_score"))
    rows = one.unpivot([], ["elite_share", "mean_score"], "metric", "value")
    return validation.gates(rows, c.spark.createDataFrame([("elite_share", 0.1, ">="), ("mean_score", 0.3, ">=")], "metric string, threshold double, direction string"))


@query("c_jobs", sql=then("x as (select row_number() over (order by latency) - 1 as i, latency, count(*) over () as n from c_jobs where status in ('succeeded', 'failed') and latency is not null)") + " select count(*) as submitted, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as running, count(*) filter (status = 'queued') as queued, round(avg(latency) filter (status in ('succeeded', 'failed')), 4) as avg_latency, (select round(latency, 4) from x where i = floor((n - 1) * 0.95)) as p95_latency from c_jobs")
def job_metrics(c: Carriers) -> DataFrame:
    return validation.job_metrics(c.jobs)


@query("c_jobs", sql="select client, job_id, ts, before, status from (select *, lag(status) over (partition by client order by ts, job_id) as before from c_jobs) where before is null or before <> status")
def status_changes(c: Carriers) -> DataFrame:
    return jobs.status_changes(c.jobs)


@query("c_jobs", sql="select time_bucket(interval 1 hour, ts) as start, count(*) as jobs, round(avg(latency), 8) as avg_latency from c_jobs group by 1")
def latency_windows(c: Carriers) -> DataFrame:
    return jobs.latency_windows(c.jobs).drop("p95_approx")


@query("c_jobs", sql="select job_id, client, status from c_jobs where status = 'failed' order by ts desc, job_id limit 50")
def recent_failures(c: Carriers) -> DataFrame:
    return jobs.recent(c.jobs, "failed").select("job_id", "client", "status")


LIMITED = "r as (select client, job_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by client order by ts, job_id) as k from c_jobs), walk as (select client, 0::bigint as k, null::bigint as job_id, []::double[] as acc, true as allowed, 0::double as retry_after from (select distinct client from r) union all select client, k, job_id, case when len(f) < 3 then list_append(f, t) else f end, len(f) < 3, case when len(f) < 3 then 0 else round(3600 - (t - f[1]), 3) end::double from (select w.client, r.k, r.job_id, r.t, list_filter(w.acc, lambda x: r.t - x < 3600) as f from walk w join r on r.client = w.client and r.k = w.k + 1) s)"


@query("c_jobs", sql=then(LIMITED) + " select client, job_id, allowed, retry_after from walk where k > 0")
def rate_limit(c: Carriers) -> DataFrame:
    return jobs.rate_limited(c.jobs, 3, 3600.0)


# Ensembles


WALK = "p as (select *, row_number() over (partition by pdb_id order by frame, frame_rank) as k from (select pdb_id, frame, pocket_id, bio_score, volume, druggable, center_x as x, center_y as y, center_z as z, row_number() over (partition by pdb_id, frame order by bio_score desc, pocket_id) as frame_rank from c_pockets)), walk as (select pdb_id, 0::bigint as k, 0::bigint as own, []::double[] as xs, []::double[] as ys, []::double[] as zs, []::bigint[] as ns from (select distinct pdb_id from p) union all select pdb_id, k, own, {} from (select *, case when len(ds) > 0 and list_min(ds) <= 6 then list_position(ds, list_min(ds)) else len(ds) + 1 end as own from (select w.pdb_id, p.k, p.x, p.y, p.z, w.xs, w.ys, w.zs, w.ns, list_transform(range(1, len(w.ns) + 1), lambda i: sqrt((w.xs[i] - p.x) ** 2 + (w.ys[i] - p.y) ** 2 + (w.zs[i] - p.z) ** 2)) as ds from walk w join p on p.pdb_id = w.pdb_id and p.k = w.k + 1)))".format(
    ", ".join(f"case when own > len(ns) then list_append({v}s, {v}) else list_transform({v}s, lambda m, i: case when i = own then (m * ns[i] + {v}) / (ns[i] + 1) else m end) end" for v in "xyz") + ", case when own > len(ns) then list_append(ns, 1) else list_transform(ns, lambda n, i: case when i = own then n + 1 else n end) end"
)
CLUSTERED = WALK + ", j as (select p.*, w.own - 1 as cluster from p join walk w on p.pdb_id = w.pdb_id and p.k = w.k), g as (select pdb_id, cluster, avg(x) as cx, avg(y) as cy, avg(z) as cz, list(pocket_id order by bio_score desc, k)[1] as pocket_id, max(bio_score) as bio_score, avg(bio_score) as mean_score, bool_or(druggable) as druggable, count(distinct frame) as support, fsum(volume) / count(*) as vm, stddev_pop(volume) as vs, string_agg(distinct frame::varchar, ',' order by frame::varchar) as frame_hits from j group by 1, 2), t as (select g.*, (select count(distinct frame) from c_pockets) as n_frames, (select avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) from j where j.pdb_id = g.pdb_id and j.cluster = g.cluster) as stability from g where support >= 2), u as (select *, printf('%.4f', (0.65 * mean_score + 0.25 * support / n_frames + 0.1 * (0.5 * greatest(0, 1 - stability / 4) + 0.5 * greatest(0, 1 - vs / vm / 0.35))) * (1 + 1e-12))::double as consensus_score from t)"


@query(P, sql=then(CLUSTERED) + " select pdb_id, cluster::int as cluster, round(cx, 4) as center_x, round(cy, 4) as center_y, round(cz, 4) as center_z, pocket_id, bio_score, druggable, support::int as support_frames, printf('%.4f', (support / n_frames) * (1 + 1e-12))::double as support_ratio, printf('%.4f', (stability) * (1 + 1e-12))::double as center_stability, printf('%.4f', (vm) * (1 + 1e-12))::double as volume_mean, printf('%.4f', (vs) * (1 + 1e-12))::double as volume_std, printf('%.4f', (vs / vm) * (1 + 1e-12))::double as volume_cv, consensus_score, frame_hits, row_number() over (partition by pdb_id order by consensus_score desc, bio_score desc, support desc, cluster)::int as rank from u")
def frame_consensus(c: Carriers) -> DataFrame:
    """All frames of the table were analysed for every protein."""
    frames = c.base.select("pdb_id").distinct().crossJoin(F.broadcast(c.base.select("frame").distinct()))  # seven frames
    found = ensemble.consensus(c.base, frames=frames).withColumns({a: F.round(a, 4) for a in atlas.CENTER})
    return found.withColumn("frame_hits", F.array_join("frame_hits", ","))


@query(P, sql=then("h as (select distinct pdb_id, concat(ligand_name, '-', polar_atoms) as pocket_id, frame from c_pockets), fr as (select pdb_id, frame, row_number() over (partition by pdb_id order by frame) - 1 as idx, count(*) over (partition by pdb_id) as total from (select distinct pdb_id, frame from c_pockets)), g as (select h.pdb_id, pocket_id, idx, total, idx - row_number() over (partition by h.pdb_id, pocket_id order by idx) as island from h join fr on h.pdb_id = fr.pdb_id and h.frame = fr.frame), r as (select pdb_id, pocket_id, total, island, count(*) as n, min(idx) as lo, max(idx) as hi from g group by all), s as (select pdb_id, pocket_id, total, sum(n)::bigint as hit_count, min(lo) as first, max(hi) as last, max(n) as longest, count(*) - 1 as flicker from r group by 1, 2, 3)") + " select pdb_id, pocket_id, hit_count, first, last, last - first + 1 as span, longest, flicker, round(0.5 * hit_count / total + 0.3 * longest / total + 0.2 * (1 - least(1, flicker / hit_count)), 4) as persistence_score from s")
def persistence(c: Carriers) -> DataFrame:
    hits = c.base.select("pdb_id", F.concat("ligand_name", F.lit("-"), F.col("polar_atoms").cast("string")).alias("pocket_id"), "frame")
    return ensemble.persistence(hits, c.base.select("pdb_id", "frame").distinct())


REFINED = "m as (select *, case when max(bio_score) over w - min(bio_score) over w < 1e-12 then 0.5 else (bio_score - min(bio_score) over w) / (max(bio_score) over w - min(bio_score) over w) end as bn, least(1, merged_vertices / greatest(max(merged_vertices) over w, 1)) as sn, case druggability_class when 'high' then 1 when 'medium' then 0.6 else 0.3 end::double as dn, 3 * sphericity as cs, 0.3::double * sphericity as vc from c_pockets window w as (partition by pdb_id)), q as (select *, " + decimal_round("bn * 0.35::double + sn * 0.25::double + dn * 0.15::double + (1 - least(1, cs / 2)) * 0.15::double + (1 - least(1, vc / 0.2::double)) * 0.1::double", 6) + " as rank_score, merged_vertices >= 2 and cs <= 2 and vc <= 0.2 as passes from m), k as (select *, bool_or(passes) over (partition by pdb_id) as any_passes from q)"


@query(P, sql=then(REFINED) + " select pdb_id, pocket_id, rank_score from k where passes or not any_passes")
def refined_rank(c: Carriers) -> DataFrame:
    rows = c.pockets.withColumns({"support_frames": F.col("merged_vertices"), "center_stability": F.col("sphericity") * 3.0, "volume_cv": F.col("sphericity") * 0.3})
    return ensemble.refined_rank(rows).select("pdb_id", "pocket_id", "rank_score")


FRAMES = "fr as (select pdb_id, (res_id - 1) // 7 as frame, (res_id - 1) % 7 as r, x, y, z from c_atoms), z as (select pdb_id, r, x as x0, y as y0, z as z0 from fr where frame = 0)"


@query("c_atoms", sql=then(FRAMES) + " select fr.pdb_id, fr.frame::int as frame, round(sqrt(avg((x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2)), 4) as rmsd from fr join z on fr.pdb_id = z.pdb_id and fr.r = z.r group by 1, 2")
def frame_rmsd(c: Carriers) -> DataFrame:
    return ensemble.frame_rmsd(c.atoms.selectExpr("pdb_id", "cast(floor((res_id - 1) / 7) as int) as frame", "(res_id - 1) % 7 as res_id", "x", "y", "z"))


@query(P, sql=then("fr as (select pdb_id, frame, row_number() over (partition by pdb_id order by frame) - 1 as idx, count(*) over (partition by pdb_id) as n from (select distinct pdb_id, frame from c_pockets))") + " select pdb_id, frame from fr where n <= 3 or idx in (0, floor(1 * (n - 1) / 2), floor(2 * (n - 1) / 2))")
def frame_subset(c: Carriers) -> DataFrame:
    return ensemble.even_frames(c.base.select("pdb_id", "frame").distinct(), 3)


@query("c_atoms", sql="select pdb_id, res_id, 1 as mode, a::double as amplitude, f::int as frame, round(x + a * sin(f * (2 * pi() / 10)) * 0.1, 4) as x, round(y, 4) as y, round(z, 4) as z from c_atoms, (select unnest([2.0, 3.0, 5.0]) as a), (select unnest(range(10)) as f)")
def generate_frames(c: Carriers) -> DataFrame:
    rows = c.atoms.select("pdb_id", "res_id", *"xyz")
    modes = rows.select("pdb_id", "res_id", F.lit(1).alias("mode"), F.lit(0.1).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return ensemble.generated(rows, modes).select("pdb_id", "res_id", "mode", "amplitude", "frame", *(F.round(a, 4).alias(a) for a in "xyz"))


@query(P, sql="select pdb_id, pocket_id, count(*) as docks, count(affinity) as successes, round(count(affinity) / count(*), 4) as success_share, round(avg(affinity), 4) as avg_affinity, round(stddev_pop(affinity), 4) as std_affinity, least(0, min(affinity)) as best_affinity, count(affinity) / count(*) >= 0.6 as stable from (select pdb_id, polar_atoms::bigint as pocket_id, case when (frame + polar_atoms) % 3 <> 0 then affinity end as affinity from c_pockets) group by 1, 2")
def docking_consistency(c: Carriers) -> DataFrame:
    """Some frames fail to dock: they have no affinity."""
    rows = c.base.withColumn("affinity", F.when((F.col("frame") + F.col("polar_atoms")) % 3 != 0, F.col("affinity")))
    return ensemble.docking_consistency(rows.select("pdb_id", F.col("polar_atoms").cast("long").alias("pocket_id"), "affinity"))


# Geometry and graphs


@query("c_atoms", sql=then("pr as (select a.pdb_id, a.res_id as i, b.res_id as j, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz, " + D.format("a.", "b.") + " as d from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id), o as (select pdb_id, i, j, p, q, -[dx, dy, dz][p + 1] * [dx, dy, dz][q + 1] / (d * d) as value from pr, (select unnest([0, 1, 2]) as p), (select unnest([0, 1, 2]) as q) where d < 15)") + " select pdb_id, i, j, p as a, q as b, round(value, 6) as value from o union all select pdb_id, i, i, p, q, round(-sum(value), 6) from o group by 1, 2, 3, 4, 5")
def network_blocks(c: Carriers) -> DataFrame:
    return geometry.network_blocks(c.atoms).withColumn("value", F.round("value", 6))


BLOCKS = "pr as (select a.pdb_id, a.res_id as i, b.res_id as j, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz, " + D.format("a.", "b.") + " as d from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id), o as (select pdb_id, i, j, p as a, q as b, -[dx, dy, dz][p + 1] * [dx, dy, dz][q + 1] / (d * d) as value from pr, (select unnest([0, 1, 2]) as p), (select unnest([0, 1, 2]) as q) where d < 15), bl as (select * from o union all select pdb_id, i, i, a, b, -sum(value) from o group by 1, 2, 3, 4, 5)"


@query("c_atoms", sql=then(BLOCKS) + ", g as (select x.pdb_id, round(max(abs(x.value - coalesce(y.value, 0))), 6) as asymmetry, count(*) as entries from bl x left join bl y on x.pdb_id = y.pdb_id and x.i = y.j and x.j = y.i and x.a = y.b and x.b = y.a group by 1), r as (select pdb_id, round(max(abs(s)), 6) as row_sum_error from (select pdb_id, i, a, b, sum(value) as s from bl group by all) group by 1) select * from g join r using (pdb_id)")
def network_checks(c: Carriers) -> DataFrame:
    return geometry.network_checks(geometry.network_blocks(c.atoms))


@query("c_atoms", sql="select pdb_id, res_id as mode, x as eigenvalue, x >= -1e-6 and coalesce(x >= lag(x) over (partition by pdb_id order by res_id) - 1e-9, true) as ok from c_atoms")
def mode_order(c: Carriers) -> DataFrame:
    """One coordinate in the place of eigenvalues: of a structure's modes, those that are negative or do not ascend are marked."""
    return geometry.mode_checks(c.atoms.select("pdb_id", F.col("res_id").alias("mode"), F.col("x").alias("eigenvalue")))


@query("c_atoms", sql=then("dirs as (select sqrt(1 - w * w) * cos(t) as a, sqrt(1 - w * w) * sin(t) as b, w as c, i from (select i, 1 - 2 * (i + 0.5::double) / 64 as w, pi() * (1 + sqrt(5)) * (i + 0.5::double) as t from (select unnest(range(64)) as i))), dots as (select pdb_id, res_id, i, x * a + y * b + z * c as dot from c_atoms, dirs), h as (select pdb_id, i, max(dot) as h from dots group by 1, 2)") + " select d.pdb_id, d.res_id, round(min(h.h - d.dot), 4) as to_surface, min(h.h - d.dot) >= 0 as inside from dots d join h on d.pdb_id = h.pdb_id and d.i = h.i group by 1, 2")
def support_depth(c: Carriers) -> DataFrame:
    rows = c.atoms.select("pdb_id", "res_id", *"xyz")
    return geometry.buried(rows, geometry.support(rows)).select("pdb_id", "res_id", F.round("to_surface", 4).alias("to_surface"), "inside")


LATTICE = "box as (select pdb_id, min(x) as lx, min(y) as ly, min(z) as lz, floor((max(x) - min(x)) / 2)::int as nx, floor((max(y) - min(y)) / 2)::int as ny, floor((max(z) - min(z)) / 2)::int as nz, list(x) as xs, list(y) as ys, list(z) as zs from c_atoms group by 1), s0 as (select *, unnest(range(nx + 1)) as i0 from box), s1 as (select *, unnest(range(ny + 1)) as i1 from s0), s2 as (select *, unnest(range(nz + 1)) as i2, lx + i0 * 2.0::double as x, ly + i1 * 2.0::double as y from s1), pt as (select pdb_id, i0, i1, i2, x, y, lz + i2 * 2.0::double as z, xs, ys, zs from s2), near as (select pdb_id, i0, i1, i2, x, y, z, list_min(list_transform(range(1, len(xs) + 1), lambda n: sqrt((x - xs[n]) * (x - xs[n]) + (y - ys[n]) * (y - ys[n]) + (z - zs[n]) * (z - zs[n])))) as dist from pt), c as (select *, case when dist <= 12 then dist end as d from near), m as (select *, greatest(AROUND) as other from c window w0 as (partition by pdb_id, i1, i2 order by i0), w1 as (partition by pdb_id, i0, i2 order by i1), w2 as (partition by pdb_id, i0, i1 order by i2))"
LATTICE = LATTICE.replace("AROUND", ", ".join(f"coalesce({f}(d) over w{k}, -1)" for k in range(3) for f in ("lag", "lead")))


@query("c_atoms", sql=then(LATTICE) + " select pdb_id, (row_number() over (partition by pdb_id order by i0, i1, i2))::int as ordinal, x, y, z, round(d, 4) as clearance, round(4 / 3.0::double * pi() * d ** 3, 4) as volume from m where d is not null and d >= other")
def void_lattice(c: Carriers) -> DataFrame:
    return geometry.lattice_voids(c.atoms)


@query()
def cavity_pipeline(c: Carriers) -> DataFrame:
    return geometry.cavities(c.atoms).select("pdb_id", "cavity_id", "rank", "bio_score", "volume", "merged_vertices", "druggable")


CONTACT = "pr as (select a.pdb_id, a.res_id, " + D.format("a.", "b.") + " as d from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id), g as (select pdb_id, res_id, count(*) filter (d < 8) as n_near, avg(d) filter (d < 8) as avg_near, count(*) filter (d > 8 and d < 15) as n_far from pr group by 1, 2)"


@query("c_atoms", sql=then(CONTACT) + " select pdb_id, res_id, round((res_id - 1) / 20, 6) as relative_position, round(n_near / 21, 6) as contact_count, round(coalesce(avg_near / 8, 1), 6) as avg_contact_dist, round(n_near / 20, 6) as local_density, round(1 - n_far / 21, 6) as exposure from g")
def contact_graph_features(c: Carriers) -> DataFrame:
    names = graph.FEATURES[4:]
    return graph.node_features(c.atoms).select("pdb_id", "res_id", *(F.round(n, 6).alias(n) for n in names))


def _passes(n: int = 3) -> str:
    """WITH members n0 to n3: each residue's features, halved and joined with half of its neighbours' mean."""
    names, among = graph.FEATURES, lambda some: "(res_name in (" + ", ".join(f"'{r}'" for r in some) + "))::int::double"
    hydropathy = "case res_name " + " ".join(f"when '{k}' then {v}" for k, v in S.HYDROPATHY.items()) + " else 0 end / 4.5::double"
    own = (hydropathy, among(S.HYDROPHOBIC), among(S.POLAR), among(S.CHARGED), "(res_id - 1) / 20", "n_near / 21", "coalesce(avg_near / 8, 1)", "n_near / 20", "1 - n_far / 21")
    members = ["e as materialized (select pdb_id, a.res_id as src, b.res_id as dst from c_atoms a join c_atoms b using (pdb_id) where a.res_id <> b.res_id and " + D.format("a.", "b.") + " < 8)"]
    members.append("n0 as (select pdb_id, res_id, res_name, " + ", ".join(f"({v})::double as {k}" for k, v in zip(names, own, strict=True)) + " from c_atoms join g using (pdb_id, res_id))")
    for k in range(n):
        mean = ", ".join(f"avg({f}) as {f}" for f in names)
        half = ", ".join(f"n.{f} * 0.5 + coalesce(m.{f}, 0) * 0.5 as {f}" for f in names)
        members.append(f"m{k} as (select e.pdb_id, e.src as res_id, {mean} from e join n{k} x on x.pdb_id = e.pdb_id and x.res_id = e.dst group by 1, 2)")
        members.append(f"n{k + 1} as (select n.pdb_id, n.res_id, n.res_name, {half} from n{k} n left join m{k} m on m.pdb_id = n.pdb_id and m.res_id = n.res_id)")
    return ", ".join(members)


@query("c_atoms", sql=then(CONTACT + ", " + _passes()) + ", s as (select *, " + decimal_round("greatest(0, hydrophobicity) * 0.3::double + is_hydrophobic * 0.2::double + (1 - exposure) * 0.2::double + local_density * 0.15::double + contact_count * 0.15::double", 4) + " as pocket_score from n3), k as (select *, row_number() over (partition by pdb_id order by pocket_score desc, res_id)::int as rank from s) select pdb_id, res_id, res_name, pocket_score, rank from k where rank <= 20")
def message_passing(c: Carriers) -> DataFrame:
    return graph.pocket_residues(graph.passed(graph.node_features(c.atoms), graph.contacts(c.atoms)))


CLUSTERS = "e as materialized (select a.pdb_id, a.res_id as src, b.res_id as dst from c_atoms a join c_atoms b on a.pdb_id = b.pdb_id and a.res_id <> b.res_id and " + D.format("a.", "b.") + " <= 6), core as (select pdb_id, src as res_id from e group by 1, 2 having count(*) >= 2), inner_e as (select e.* from e join core a on a.pdb_id = e.pdb_id and a.res_id = e.src join core b on b.pdb_id = e.pdb_id and b.res_id = e.dst), reach as (select pdb_id, res_id, res_id as other from core union select r.pdb_id, r.res_id, i.dst from reach r join inner_e i on i.pdb_id = r.pdb_id and i.src = r.other), lab as (select pdb_id, res_id, min(other) as label from reach group by 1, 2), every as (select * from lab union all select e.pdb_id, e.dst, min(label) from e join lab l on l.pdb_id = e.pdb_id and l.res_id = e.src where not exists (select 1 from core c where c.pdb_id = e.pdb_id and c.res_id = e.dst) group by 1, 2), placed as (select every.pdb_id, label, x, y, z, a.res_id / 21.0::double as score from every join c_atoms a on a.pdb_id = every.pdb_id and a.res_id = every.res_id), c as (select pdb_id, label, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz, avg(score) as s, max(score) as t from placed group by 1, 2)"


@query("c_atoms", sql=then(CLUSTERS) + " select c.pdb_id, c.label, any_value(n) as n, round(any_value(cx), 4) as center_x, round(any_value(cy), 4) as center_y, round(any_value(cz), 4) as center_z, round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 4) as radius, round(any_value(s), 4) as avg_score, round(any_value(t), 4) as max_score from c join placed p on p.pdb_id = c.pdb_id and p.label = c.label group by 1, 2")
def residue_clusters(c: Carriers) -> DataFrame:
    return graph.clusters(c.atoms.withColumn("score", F.col("res_id") / 21.0))


# Models and statistics

RANKS = "per as (select y_proba, count(*) as n, count(*) filter (y_true = 1) as pos from c_eval group by 1), x as (select *, sum(n) over (order by y_proba) - (n - 1) / 2 as r, sum(pos) over (order by y_proba desc) as tp, sum(n) over (order by y_proba desc) as seen from per), y as (select sum(pos)::double as p, sum(n)::double - sum(pos) as q, sum(pos * r) as sr, sum(pos * tp / seen) as ap from x)"


@query("c_eval", sql=then(RANKS) + " select round((sr - p * (p + 1) / 2) / (p * q), 6) as roc_auc, round(ap / p, 6) as average_precision from y")
def average_precision(c: Carriers) -> DataFrame:
    return ml.ranking(c.eval)


@query("c_eval", sql=then("m as (select count(*) filter (y_true = 1 and y_proba >= 0.5) as tp, count(*) filter (y_true = 0 and y_proba >= 0.5) as fp, count(*) filter (y_true = 1 and y_proba < 0.5) as fn, count(*) filter (y_true = 0 and y_proba < 0.5) as tn from c_eval)") + " select *, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from m")
def confusion_metrics(c: Carriers) -> DataFrame:
    return ml.metrics(c.eval.withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int")))


@query("c_eval", sql="select round(sum(n / t * abs(acc - conf)), 6) as ece from (select count(*) as n, avg(y_true) as acc, avg(y_proba) as conf, (select count(*) from c_eval) as t from c_eval where y_proba >= 0 and y_proba < 1 group by floor(y_proba * 10))")
def ece(c: Carriers) -> DataFrame:
    return ml.calibration_error(c.eval)


@query("c_eval", sql="select sum(y_true)::bigint as hits, count(*) as k, round(sum(y_true) / count(*), 6) as precision_at_k, round(sum(y_true) / (select sum(y_true) from c_eval), 6) as recall_at_k from (select * from c_eval order by y_proba desc, doc_id limit 50)")
def recall_at_k(c: Carriers) -> DataFrame:
    return ml.at_k(c.eval, 50, "doc_id")


FEATS = ("volume", "merged_vertices", "hydrophobic_ratio", "polar_atoms", *METRICS, "sphericity")


@query(P, sql="select pdb_id, pocket_id, volume::double as volume, 0::double as radius_geom, merged_vertices::double as merged_vertices, hydrophobic_ratio, polar_atoms::double as polar_atoms, sphericity from c_pockets")
def feature_matrix(c: Carriers) -> DataFrame:
    return ml.features(c.base).select("pdb_id", "pocket_id", "volume", "radius_geom", "merged_vertices", "hydrophobic_ratio", "polar_atoms", "sphericity")


@query(P, sql=" union all ".join(f"select '{f}' as feature, round(avg({f}), 3) as mean, round(stddev_pop({f}), 3) as std, round(min({f}), 3) as min, round(max({f}), 3) as max from c_pockets" for f in FEATS))
def feature_summary(c: Carriers) -> DataFrame:
    return ml.summary(c.base, FEATS).select("feature", *(F.round(x, 3).alias(x) for x in ("mean", "std", "min", "max")))


@query(P, sql="select pdb_id, pocket_id, round((volume - (select avg(volume) from c_pockets)) / (select stddev_pop(volume) from c_pockets), 5) as volume, round((polar_atoms - (select avg(polar_atoms) from c_pockets)) / (select stddev_pop(polar_atoms) from c_pockets), 5) as polar_atoms from c_pockets")
def normalise_features(c: Carriers) -> DataFrame:
    rows = c.base.select("pdb_id", "pocket_id", "volume", F.col("polar_atoms").cast("double").alias("polar_atoms"))
    return ml.normalised(rows, ("volume", "polar_atoms")).select("pdb_id", "pocket_id", F.round("volume", 5).alias("volume"), F.round("polar_atoms", 5).alias("polar_atoms"))


@query(P, sql="select round(quantile_cont(bio_score, 0.75), 6) as positive_min, round(quantile_cont(bio_score, 0.3), 6) as negative_max from c_pockets")
def label_limits(c: Carriers) -> DataFrame:
    return ml.label_limits(c.base)


@query(P, sql=then("i as (select pdb_id, row_number() over (order by substr(h, 1, 2), h, pdb_id) as place, count(*) over () as n from (select distinct pdb_id, sha256('split:' || upper(pdb_id)) as h from c_pockets))") + " select pdb_id, case when place <= floor(n * 0.7) then 'train' when place <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from i")
def protein_split(c: Carriers) -> DataFrame:
    return validation.split(c.base.select("pdb_id").distinct())


LEAKY = "lab as (select pdb_id, pocket_id from c_pockets where (bio_score >= 0.65 and druggable) or bio_score <= 0.3), i as (select pdb_id, row_number() over (order by substr(h, 1, 2), h, pdb_id) as place, count(*) over () as n from (select distinct pdb_id, sha256('split:' || upper(pdb_id)) as h from lab)), s as (select pdb_id, case when pocket_id % 50 = 0 then 'test' when place <= floor(n * 0.7) then 'train' when place <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from lab join i using (pdb_id))"


@query(P, sql=then(LEAKY) + " select count(*) as leaked from (select pdb_id from s group by 1 having count(distinct split) > 1)")
def leakage_check(c: Carriers) -> DataFrame:
    """Every fiftieth pocket is put into the test split whatever its protein's is."""
    rows = ml.dataset(c.base)
    return ml.leakage(rows.withColumn("split", F.when(F.col("pocket_id") % 50 == 0, "test").otherwise(F.col("split"))))


@query()
def train_rf(c: Carriers) -> DataFrame:
    parts, test = secondary._parts(c)
    return ml.metrics(ml.predict(ml.train(parts, FEATS), test, FEATS))


@query(P, sql=then(GREEDY) + ", f as (select *, round(2 * matched / (n_a + n_b), 4) as dice from o) select round(avg(dice), 4) as mean_dice, round(2 * sum(matched) / sum(n_a + n_b), 4) as global_dice, count(*) filter (dice > 0) as nonzero, count(*) as n, round(avg(dice) / stddev_samp(dice), 4) as cohens_d from f")
def effect_size(c: Carriers) -> DataFrame:
    return stats.overlap_stats(_overlap(c))


@query(P, sql=then("d as (select round(avg_s - 0.4, 6) as d from (select avg(bio_score) as avg_s from c_pockets group by pdb_id)), r as (select d, abs(d) as a from d where d <> 0), s as (select a, count(*) as t, count(*) filter (d > 0) as up from r group by 1), x as (select *, sum(t) over (order by a) - (t - 1) / 2 as rk from s), y as (select coalesce(sum(t), 0)::bigint as n, sum(up * rk)::double as w, sum(t ** 3 - t) as ties from x)") + " select n, round(w, 4) as w_plus, case when n >= 10 then round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 4) end as z from y")
def wilcoxon(c: Carriers) -> DataFrame:
    rows = c.base.groupBy("pdb_id").agg(F.avg("bio_score").alias("s")).select(F.round(F.col("s") - 0.4, 6).alias("d"))
    return stats.wilcoxon(rows, "d")


TAIL = "a as (select count(s)::double as n, avg(s) as mean, stddev_samp(s) as sd from (select avg(bio_score) as s from c_pockets group by pdb_id)), t as (select *, (mean - 0.4) / (sd / sqrt(n)) as t, n - 1 as v from a), g as (select i, t * i / 4000 as x, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end as w from t, (select unnest(range(4001)) as i)), p as (select 0.5 - sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + x * x / v, -(v + 1) / 2)) * any_value(t.t) / 12000 as p from g, t)"


@query(P, sql=then(TAIL) + " select n::bigint as n, round(mean, 4) as mean, round(t, 4) as t, round(p, 6) + 0 as p from t, p")
def t_test(c: Carriers) -> DataFrame:
    return stats.t_test(c.base.groupBy("pdb_id").agg(F.avg("bio_score").alias("s")), "s", 0.4)


def resampled(cells: str, draws: int = 3000, seed: int = 42) -> str:
    """WITH members: cells (x, size), then the percentiles of the mean over draws, weighted as stats.draws weighs them."""
    below = "[" + ", ".join("[" + ", ".join(f"{p!r}::double" for p in row) + "]" for row in stats.poisson_table()) + "]"
    return (
        f"cells as ({cells}), total as (select sum(size)::bigint as n, sum(x * size) / sum(size) as estimate from cells), "
        f"hashed as (select draw, x, size, sha256('{seed}:' || n || ':' || draw || ':' || x || ',1.0') as h from cells, total, (select unnest(range({draws})) as draw)), "
        "u as (select *, (('0x' || substr(h, 1, 8))::bigint + 0.5::double) / 4294967296 as a, (('0x' || substr(h, 9, 8))::bigint + 0.5::double) / 4294967296 as b from hashed), "
        f"weighed as (select *, case when size < {stats.SMALL} then len(list_filter(({below})[least(size, {stats.SMALL - 1})], lambda c: a > c))::double else greatest(0, round(size + sqrt(size) * sqrt(ln(a) * -2) * cos(b * 2 * pi()))) end as weight from u), "
        "each as (select draw, sum(x * weight) / nullif(sum(weight), 0) as s from weighed group by 1)"
    )


INTERVAL = " select (select round(estimate, 4) from total) as estimate, (select round(quantile_cont(s, 0.025), 4) from each) as low, (select round(quantile_cont(s, 0.975), 4) from each) as high, (select n from total) as n"


@query(P, "c_known", sql=then(MATCH + ", " + resampled("select matched::double as x, count(*) as size from m group by 1")) + INTERVAL)
def bootstrap_recall_ci(c: Carriers) -> DataFrame:
    rows = _matches(c).select("pdb_id", F.col("matched").cast("double").alias("m"))
    return stats.bootstrap(rows, "pdb_id", stats.mean_of("m"))


@query(P, sql=then(GREEDY) + ", coins as (select draw, matched, case when coin then n_b else n_a end as p, case when coin then n_a else n_b end as q from (select *, substr(sha256('42:' || draw || ':' || pdb_id), 1, 1) < '8' as coin from o, (select unnest(range(1000)) as draw))), each as (select draw, sum(matched) * 2.0::double / (sum(p) + sum(q)) as s from coins group by 1), seen as (select sum(matched) * 2.0::double / sum(n_a + n_b) as observed from o) select (select round(observed, 4) from seen) as observed, count(*) as draws, round(avg((s >= observed - 1e-12)::int), 4) as p from each, seen")
def permutation_test(c: Carriers) -> DataFrame:
    return stats.permutation(_overlap(c))


@query(P, sql=f"select rank, {EXACT_MEAN} as avg_score, count(*) as n from c_pockets group by 1")
def score_by_rank(c: Carriers) -> DataFrame:
    return atlas.chart_tables(c.pockets)["score_by_rank"]


@query("c_atoms", sql="select a.pdb_id, a.res_id, round(coalesce(f.x, a.x), 4) as x, round(coalesce(f.y, a.y), 4) as y, round(coalesce(f.z, a.z), 4) as z, f.x is not null as moved from c_atoms a left join c_atoms f on f.pdb_id = a.pdb_id and f.res_id = a.res_id + 7 and a.res_id <= 7")
def ca_displacement(c: Carriers) -> DataFrame:
    """The first seven residues moved on to the places of the next seven; the others have no match and stay."""
    rows = c.atoms.withColumns({"chain_id": F.lit("A"), "ins_code": F.lit(""), "name": F.col("res_name"), "res_name": F.lit("ANY")})
    frame = rows.where("res_id between 8 and 14").withColumn("res_id", F.col("res_id") - 7)
    moved = spatial.displaced(rows, rows.where("res_id <= 7"), frame)
    return moved.select("pdb_id", "res_id", *(F.round(a, 4).alias(a) for a in "xyz"), "moved")


@query("c_jobs", sql="select client::varchar as key, count(*) as submitted, count(distinct status) > 1 as conflict, min(job_id) as job_id from c_jobs group by 1")
def submission_conflicts(c: Carriers) -> DataFrame:
    rows = c.jobs.select(F.col("client").cast("string").alias("key"), F.lit("scan").alias("job_type"), F.col("status").alias("payload"), "job_id")
    return jobs.submissions(rows)


@query(P, "c_known", sql=then(MATCH) + " select pdb_id, pocket_type, matched, best_distance from m where pocket_type in ('cryptic', 'interface')")
def case_subset(c: Carriers) -> DataFrame:
    return validation.case_subset(_matches(c), ("cryptic", "interface")).select("pdb_id", "pocket_type", "matched", "best_distance")


@query(P, sql=then(EVID + ", " + resampled("select (status = 'unsupported')::int::double as x, count(*) as size from s where status <> 'unknown' group by 1")) + INTERVAL)
def fpr_interval(c: Carriers) -> DataFrame:
    return stats.fpr_stats(_evidence(c))


# Tables


@query(P, sql="select pdb_id, pocket_id, bio_score, ingest_seq from (select pdb_id, pocket_id, bio_score, 1::bigint as ingest_seq from c_pockets where pocket_id % 7 <> 0 union all select pdb_id, pocket_id, bio_score + 1, 2 from c_pockets where pocket_id % 7 = 0)")
def upsert_last_wins(c: Carriers) -> DataFrame:
    rows = c.base.select("pdb_id", "pocket_id", "bio_score", F.lit(1).cast("long").alias("ingest_seq"))
    new = rows.where("pocket_id % 7 = 0").withColumns({"bio_score": F.col("bio_score") + 1, "ingest_seq": F.lit(2).cast("long")})
    return tables.upserted(rows, new, tables.KEYS["pockets"])


@query(P, sql="select 'docking' as \"table\", count(*) as deleted from c_pockets where pdb_id < 'P000010' and affinity < -6 union all select 'pockets', count(*) from c_pockets where pdb_id < 'P000010'")
def cascade_delete(c: Carriers) -> DataFrame:
    rows = c.base.select("pdb_id", "pocket_id", "affinity")
    gone = rows.where("pdb_id < 'P000010'").select("pdb_id").distinct()
    return tables.cascade({"pockets": rows, "docking": rows.where("affinity < -6")}, gone, ["pdb_id"])[1]


@query(P, sql="select pdb_id, count(*) as total_cavities, count(*) filter (druggable) as druggable_cavities, max(round(bio_score, 4)) as top from c_pockets group by 1")
def nested_reports(c: Carriers) -> DataFrame:
    """Nested reports and back: what is read from a report's cavities."""
    rows = tables.reports(c.pockets)
    return rows.select("pdb_id", "total_cavities", "druggable_cavities", F.array_max(F.transform("cavities", lambda x: x["bio_score"])).alias("top"))


@query("c_known", P, sql="select pdb_id, string_agg(source, ',' order by source) as sources from (select distinct pdb_id, 'known' as source from c_known union select distinct pdb_id, 'pockets' from c_pockets where pocket_id % 9 = 0) group by 1")
def id_sources(c: Carriers) -> DataFrame:
    return validation.sources_of({"known": c.known, "pockets": c.base.where("pocket_id % 9 = 0").select("pdb_id").distinct()}).withColumn("sources", F.array_join("sources", ","))


@query("c_atoms", sql="select pdb_id, res_id, res_name, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from c_atoms")
def structure_lines(c: Carriers) -> DataFrame:
    """Fixed-width lines of the atoms, scanned back."""
    line = F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", "res_id", "res_name", "res_id", *"xyz")
    return readers.atom_columns(c.atoms.select("pdb_id", line.alias("value"))).select("pdb_id", "res_id", "res_name", *"xyz")


@query(P, sql="select outcome as status, count(*) as n from (select case when pocket_id % 11 = 0 then 'error' when pocket_id % 13 = 0 then 'timeout' else 'success' end as outcome from c_pockets) group by 1")
def crawl_status(c: Carriers) -> DataFrame:
    rows = c.base.selectExpr("pdb_id", "case when pocket_id % 11 = 0 then 'error' when pocket_id % 13 = 0 then 'timeout' else 'success' end as status")
    return jobs.status_counts(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Carriers(spark, sf_dir)) for name, f in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, rank, keep the elite of each protein and roll it up."""
    rows = atlas.scored(Carriers(spark, sf_dir).base)
    return atlas.proteins(atlas.elite_of_each(rows, 0.3, 20))


from cavitas.plans import files, secondary, stateful  # noqa: E402,F401  (they register their queries)
