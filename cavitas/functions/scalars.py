"""Scalar functions of the pocket domain, all as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
VOLUME_MIN, VOLUME_MAX = 80.0, 2500.0
CLASS_HIGH, CLASS_MEDIUM = 0.55, 0.30
PROFILES: dict[str, dict[str, float]] = {
    "enzyme": {"volume": 0.15, "hydrophobicity": 0.20, "enclosure": 0.35, "depth": 0.30},
    "ppi": {"volume": 0.35, "hydrophobicity": 0.35, "enclosure": 0.10, "depth": 0.20},
    "gpcr": {"volume": 0.20, "hydrophobicity": 0.15, "enclosure": 0.30, "depth": 0.35},
    "default": {"volume": 0.25, "hydrophobicity": 0.25, "enclosure": 0.25, "depth": 0.25},
}
#: Kyte-Doolittle hydropathy, and the three residue classes in the order of their names.
HYDROPATHY = {"ALA": 1.8, "ARG": -4.5, "ASN": -3.5, "ASP": -3.5, "CYS": 2.5, "GLN": -3.5, "GLU": -3.5, "GLY": -0.4, "HIS": -3.2, "ILE": 4.5, "LEU": 3.8, "LYS": -3.9, "MET": 1.9, "PHE": 2.8, "PRO": -1.6, "SER": -0.8, "THR": -0.7, "TRP": -0.9, "TYR": -1.3, "VAL": 4.2}
HYDROPHOBIC = ("ALA", "ILE", "LEU", "MET", "PHE", "PRO", "TRP", "VAL")
POLAR = ("ASN", "CYS", "GLN", "SER", "THR", "TYR")
CHARGED = ("ARG", "ASP", "GLU", "HIS", "LYS")
#: Force-field atom types of elements.
ATOM_TYPES = {"C": "C", "N": "NA", "O": "OA", "S": "SA", "P": "P", "F": "F", "CL": "Cl", "BR": "Br", "I": "I", "ZN": "Zn", "FE": "Fe", "MG": "Mg", "CA": "Ca", "MN": "Mn", "CU": "Cu", "NA": "Na", "K": "K"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_id(x: Column | str) -> Column:
    """Ids are upper case without blanks around."""
    return F.upper(F.trim(col(x)))


def valid_id(x: Column | str, shortest: int = 4, longest: int = 4) -> Column:
    return norm_id(x).rlike(f"^[A-Z0-9]{{{shortest},{longest}}}$")


def safe_float(x: Column | str, default: float = 0.0) -> Column:
    """Text that is no number, NaN and infinity become the default."""
    number = F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(default)).otherwise(number)


def parse_center(text: Column | str) -> Column:
    """array<double> of a text such as "[1, 2, 3]" or "1,2,3"; null unless three finite numbers."""
    parts = F.filter(F.split(F.regexp_replace(col(text), r"[\[\](),]", " "), r"\s+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(valid_center(numbers), numbers)


def valid_center(c: Column | str) -> Column:
    """Three finite numbers."""
    return F.coalesce((F.size(col(c)) == 3) & F.forall(col(c), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def zero_center(x: Column | str, y: Column | str, z: Column | str, eps: float = 1e-12) -> Column:
    return (F.abs(col(x)) < eps) & (F.abs(col(y)) < eps) & (F.abs(col(z)) < eps)


def distance(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """F01."""
    squares = [(col(p) - col(q)) * (col(p) - col(q)) for p, q in zip(a, b, strict=True)]
    return F.sqrt(sum(squares[1:], squares[0]))


def sphere_volume(r: Column | str) -> Column:
    """F02."""
    return F.lit(4 / 3 * math.pi) * F.pow(col(r), 3)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalize_volume(v: Column | str, low: float = VOLUME_MIN, high: float = VOLUME_MAX) -> Column:
    """0 at or below low, 1 above high, linear between; NaN, infinite and missing values are 0."""
    v = col(v)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < low), 0.0).when(v > high, 1.0).otherwise((v - low) / (high - low))


def normalize_hydrophobicity(r: Column | str) -> Column:
    """F04."""
    r = col(r)
    return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(clamp(r))


def enclosure(n_vertices: Column | str, radius_clear: Column | str, radius_geom: Column | str, volume: Column | str, hull_volume: Column | str) -> Column:
    """ratio of radii for under four vertices or without a hull, else of volumes."""
    ratio = F.when(col(radius_geom) > 0, F.least(F.lit(1.0), col(radius_clear) / col(radius_geom))).otherwise(0.5)
    hull = F.when((col(volume) > 0) & (col(hull_volume) > 0), clamp(col(volume) / col(hull_volume))).otherwise(0.5)
    return F.when((col(n_vertices) < 4) | col(hull_volume).isNull(), ratio).otherwise(hull)


def depth(to_center: Column | str, radius: Column | str, to_surface: Column | str | None = None, shallow: float = 5.0) -> Column:
    """F06."""
    raw = F.when(col(radius) > 0, F.lit(1.0) - col(to_center) / col(radius)).otherwise(0.5)
    if to_surface is not None:
        raw = raw * F.when(col(to_surface) < shallow, col(to_surface) / shallow).otherwise(1.0)
    return clamp(raw)


def weights_of(profile: str | Mapping[str, float]) -> Mapping[str, float]:
    """A named profile or one's own weights; they have to be non-negative and sum to 1."""
    weights = PROFILES[profile.lower()] if isinstance(profile, str) else profile
    if abs(sum(weights.values()) - 1) > 1e-6 or min(weights.values()) < 0:
        raise ValueError(f"weights must be non-negative and sum to 1: {dict(weights)}")
    return weights


def bio_score(volume: Column, hydrophobicity: Column, enclosure_: Column, depth_: Column, profile: str | Mapping[str, float] = "default") -> Column:
    """the weighted sum of the clamped metrics, to four places."""
    metrics = {"volume": volume, "hydrophobicity": hydrophobicity, "enclosure": enclosure_, "depth": depth_}
    terms = [F.lit(w) * clamp(metrics[k]) for k, w in weights_of(profile).items() if k in metrics]
    return F.round(sum(terms[1:], terms[0]), 4)


def druggability_class(score: Column | str) -> Column:
    """F09."""
    return F.when(col(score) >= CLASS_HIGH, "high").when(col(score) >= CLASS_MEDIUM, "medium").otherwise("low")


def confidence(n_vertices: Column | str, volume: Column | str, hydrophobic_ratio: Column | str, metrics: Mapping[str, Column]) -> Column:
    """struct of overall, score_lower and score_upper."""
    each = {
        "volume": F.when((col(volume) > VOLUME_MIN) & (col(volume) < VOLUME_MAX), 1.0).otherwise(0.6),
        "hydrophobicity": F.when(col(hydrophobic_ratio).isNotNull(), 0.8).otherwise(0.3),
        "enclosure": F.least(F.lit(1.0), col(n_vertices) / 10.0),
        "depth": F.lit(0.9),
    }
    total = each["volume"] + each["hydrophobicity"] + each["enclosure"] + each["depth"]
    overall = total / 4.0
    weighted = (metrics["volume"] * each["volume"] + metrics["hydrophobicity"] * each["hydrophobicity"] + metrics["enclosure"] * each["enclosure"] + metrics["depth"] * each["depth"]) / total
    margin = F.lit(0.15) * (F.lit(1.0) - overall)
    return F.struct(F.round(overall, 4).alias("overall"), F.round(F.greatest(F.lit(0.0), weighted - margin), 4).alias("score_lower"), F.round(F.least(F.lit(1.0), weighted + margin), 4).alias("score_upper"))


def novelty(depth_: Column | str, enclosure_: Column | str, score: Column | str, rival_distance: Column | str, tolerance: float = 8.0) -> Column:
    """full marks for rivals beyond the tolerance or for none."""
    d = col(rival_distance)
    rival = F.when(d.isNull() | (d > tolerance), 0.2).otherwise(0.2 * (d / tolerance))
    return F.round(clamp(col(depth_) * 0.3 + col(enclosure_) * 0.3 + col(score) * 0.2 + rival), 4)


def drug_likeness(volume: Column | str, hydrophobicity: Column | str, enclosure_: Column | str, depth_: Column | str) -> Column:
    """the share of four range tests that hold."""
    tests = [col(volume).between(200, 1000), col(hydrophobicity).between(0.3, 0.7), col(enclosure_) > 0.5, col(depth_) > 0.3]
    points = [F.coalesce(t, F.lit(False)).cast("int") for t in tests]
    return F.round(sum(points[1:], points[0]) / 4.0, 4)


def evidence_tier(score: Column | str, overall: Column | str, n_vertices: Column | str, druggable: Column | str, volume: Column | str, depth_: Column | str, enclosure_: Column | str, sphericity: Column | str, hydrophobic_ratio: Column | str) -> Column:
    """points of nine rules, then a tier."""
    score, overall, n, volume = col(score), col(overall), col(n_vertices), col(volume)
    points = [
        F.when(score >= CLASS_HIGH, 3.0).when(score >= CLASS_MEDIUM, 2.0).when(score >= 0.2, 1.0),
        F.when(overall >= 0.8, 2.0).when(overall >= 0.6, 1.0),
        F.when(n >= 8, 2.0).when(n >= 4, 1.0),
        F.when(col(druggable), 1.5),
        F.when(volume.between(150, 2500), 1.0).when((volume >= 80) & (volume < 150), 0.5),
        F.when(col(depth_) >= 0.5, 1.0),
        F.when(col(enclosure_) >= 0.6, 1.0),
        F.when(col(sphericity).between(0.3, 0.9), 0.5),
        F.when(col(hydrophobic_ratio) >= 0.4, 0.5),
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in points[1:]), F.coalesce(points[0], F.lit(0.0)))
    return F.when(total >= 8, "strong").when(total >= 5, "moderate").when(total >= 2.5, "weak").otherwise("insufficient")


def ensemble_confidence(score: Column | str, persistence: Column | str, depth_: Column | str, enclosure_: Column | str, support_ratio: Column | str, n_hits: Column | str, n_frames: Column | str) -> Column:
    """.40 score, .25 persistence, .20 geometry, .15 support; a missing support ratio is taken from the frame hits."""
    support = F.coalesce(col(support_ratio), F.when(col(n_frames) > 0, col(n_hits) / col(n_frames)), F.lit(0.0))
    geometry = (F.coalesce(col(depth_), F.lit(0.0)) + F.coalesce(col(enclosure_), F.lit(0.0))) / 2.0
    each = [(0.40, F.coalesce(col(score), F.lit(0.0))), (0.25, F.coalesce(col(persistence), F.lit(0.0))), (0.20, geometry), (0.15, support)]
    terms = [F.lit(w) * clamp(x) for w, x in each]
    return F.round(clamp(sum(terms[1:], terms[0])), 4)


def cosine(a: Column | str, b: Column | str) -> Column:
    """F16 on arrays of doubles; 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when((size(a) > 0) & (size(b) > 0), dot / (size(a) * size(b))).otherwise(0.0)


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def composite(a: Column | str, b: Column | str) -> Column:
    """F16: .6 of the cosine and .4 of the closeness, as a share of the largest distance of vectors in [0, 1]."""
    close = F.lit(1.0) - euclid(a, b) / F.sqrt(F.size(col(a)))
    return F.greatest(F.lit(0.0), cosine(a, b)) * 0.6 + F.greatest(F.lit(0.0), close) * 0.4


def similarity(a: Column | str, b: Column | str) -> Column:
    """F16: the composite to four places."""
    return F.round(composite(a, b), 4)


def rounded(x: Column | str, places: int) -> Column:
    """x rounded as DuckDB rounds doubles: the scaled double half up. F.round rounds the decimal text, and parts from it where a tie is off by a last bit."""
    return F.round(col(x) * 10.0**places) / 10.0**places


def affinity_class(affinity: Column | str) -> Column:
    """F17."""
    a = col(affinity)
    return F.when(a.isNull(), "failed").when(a < -8, "strong").when(a < -6, "good").when(a < -4, "weak").otherwise("none")


def box_size(radius: Column | str) -> Column:
    """F18."""
    return F.greatest(F.lit(20.0), F.least(F.lit(30.0), col(radius) * 2 + 6.0))


def interaction_type(el_a: Column | str, el_b: Column | str, d: Column | str) -> Column:
    """hydrogen bonds by elements and distance; two carbons are hydrophobic; the rest touch."""
    polar = col(el_a).isin("N", "O", "S", "F") & col(el_b).isin("N", "O", "S", "F") & col(d).between(2.5, 3.5)
    return F.when(polar, "hbond").when((col(el_a) == "C") & (col(el_b) == "C"), "hydrophobic").otherwise("vdw")


def volume_ratio_ok(a: Column | str, b: Column | str, low: float = 0.5, high: float = 2.0, missing: bool = True) -> Column:
    """both missing-data rules; missing or non-positive volumes give `missing`."""
    known = (col(a) > 0) & (col(b) > 0)
    return F.when(F.coalesce(known, F.lit(False)), (col(a) / col(b)).between(low, high)).otherwise(F.lit(missing))


def label_policy(score: Column | str, druggable: Column | str, positive: float | Column = 0.65, negative: float | Column = 0.3) -> Column:
    """1, 0, or -1 for uncertain."""
    return F.when((col(score) >= positive) & col(druggable), 1).when(col(score) <= negative, 0).otherwise(-1)


def atom_type(element: Column | str) -> Column:
    """the force-field type of an element; an unknown one's first two letters."""
    table = F.create_map(*(F.lit(x) for kv in ATOM_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(col(element))), F.substring(col(element), 1, 2))


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(col(p) for p in parts)).cast("binary"), 256)


def hydropathy(res_name: Column | str) -> Column:
    """F26."""
    table = F.create_map(*(F.lit(x) for kv in HYDROPATHY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(res_name)), F.lit(0.0))


def json_number(text: Column | str, path: str, default: float = 0.0) -> Column:
    """a number at a path of JSON text; the default on bad JSON."""
    return F.coalesce(F.get_json_object(col(text), path).try_cast("double"), F.lit(default))


def age_hours(ts: Column | str, now: Column | str) -> Column:
    """F29."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(now) - micros(ts)) / 3.6e9
