"""Coded quality rules: each is a function from a dataset's tables to findings.

A finding is (rule_code, severity, message, target_type, target_ref, evidence). Rules are registered with the decorator
and run in code order; `only` and `skip` choose among them. A rule that fails while its plan is built becomes a finding
itself; expressions are null-safe, so rows never fail a rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay
from ..functions.dates import strict_date
from ..functions.properties import OFFICIAL
from ..storage import materialise
from . import spatial, topology

PREFIX = "QH-"
FINDING = "rule_code string, severity string, message string, target_type string, target_ref string, evidence string"
SEVERITIES = ("info", "warning", "error", "critical")


@dataclass
class Context:
    """features(layer_id, ord, key, geom, properties, valid_from, valid_to), layers(layer_id, layer_name, geometry_type,
    expected_type, required, overlap, gap, cross), datasets(dataset_id, epsg, derivation_level, authority, grp,
    recorded_sha, actual_sha, approval_date, effective_from, effective_to, signed_date, record_code, document_number,
    decision), inputs(dataset_id: those with provenance inputs)."""

    features: DataFrame | None = None
    layers: DataFrame | None = None
    datasets: DataFrame | None = None
    inputs: DataFrame | None = None
    cell: float = 0.05
    cache: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    code: str
    description: str
    severity: str
    applies_to: str
    run: Callable[[Context], DataFrame]


RULES: dict[str, Rule] = {}


def rule(code: str, description: str, severity: str, applies_to: str = "feature"):
    def add(run):
        RULES[PREFIX + code] = Rule(PREFIX + code, description, severity, applies_to, run)
        return run

    return add


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.code, r.description, r.severity, r.applies_to) for r in RULES.values()], "rule_code string, description string, severity string, applies_to string")


def found(df: DataFrame, code: str, message: Column, ref: Column, severity: str | Column | None = None, target: str = "feature", evidence: Column | None = None) -> DataFrame:
    own = severity if isinstance(severity, Column) else F.lit(severity or RULES[PREFIX + code].severity)
    return df.select(F.lit(PREFIX + code).alias("rule_code"), own.alias("severity"), message.alias("message"), F.lit(target).alias("target_type"), ref.cast("string").alias("target_ref"), (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence"))


def run(ctx: Context, spark: SparkSession, only: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the chosen rules. Each rule is carried out by itself, into a table of its own: one that fails, as it is
    planned or as it runs, becomes a finding and hides no other."""
    out = []
    for code in sorted(RULES):
        if (not only or code in only) and code not in skip:
            try:
                out.append(materialise(RULES[code].run(ctx), "findings"))
            except Exception as e:
                said = re.search(r"\[([A-Z_.]+)\]", str(e))
                out.append(spark.createDataFrame([(PREFIX + "RULE-ERROR", "error", f"{code}: {type(e).__name__}{' ' + said[1] if said else ''}", "dataset", None, None)], FINDING))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FINDING)


def _layer(c: Context) -> DataFrame:
    return c.features.join(c.layers, "layer_id")


_name = lambda: F.to_json(F.struct(F.col("layer_name").alias("layer")))


@rule("GEOM-EMPTY", "Geometry is missing or empty", "error")
def geom_empty(c: Context) -> DataFrame:
    issue = G.structure_issue(F.col("geom"))
    return found(_layer(c).where(issue.isin("null", "empty")), "GEOM-EMPTY", F.concat(F.lit("geometry is "), issue), F.col("key"), evidence=_name())


@rule("GEOM-INVALID", "Geometry is not valid", "error")
def geom_invalid(c: Context) -> DataFrame:
    rows = _layer(c).withColumn("issue", G.structure_issue(F.col("geom"))).where(F.col("issue").isNull() | F.col("issue").isin("not_finite", "few_points", "unclosed_ring"))
    bad = rows.withColumn("broken", F.when(F.col("issue").isNull() & F.col("geom.gtype").isin("Polygon", "MultiPolygon"), overlay.breaks_rules("geom.parts")))
    return found(bad.where("issue IS NOT NULL OR broken IS NOT NULL"), "GEOM-INVALID", F.coalesce("issue", "broken"), F.col("key"), evidence=_name())


@rule("GEOM-COLLECTION", "Geometry is a collection", "warning")
def geom_collection(c: Context) -> DataFrame:
    return found(_layer(c).where("geom.gtype = 'GeometryCollection'"), "GEOM-COLLECTION", F.lit("geometry collection"), F.col("key"), evidence=_name())


@rule("GEOM-TYPE-MISMATCH", "Geometry type differs from the layer's", "error")
def geom_type(c: Context) -> DataFrame:
    expected = F.upper(F.coalesce(F.nullif("expected_type", F.lit("")), F.nullif("geometry_type", F.lit(""))))
    actual = F.upper(F.col("geom.gtype"))
    ok = (actual == expected) | (expected.isin("POINT", "LINESTRING", "POLYGON") & (actual == F.concat(F.lit("MULTI"), expected)))
    return found(_layer(c).where(F.coalesce(~ok, F.lit(False))), "GEOM-TYPE-MISMATCH", F.concat(F.lit("expected "), expected, F.lit(", found "), F.col("geom.gtype")), F.col("key"), evidence=_name())


@rule("GEOM-DUPLICATE", "Same geometry as another feature of the layer", "warning")
def geom_duplicate(c: Context) -> DataFrame:
    """The first of equal geometries is found by an aggregate, so copies never meet in a sort."""
    h = _layer(c).where("geom IS NOT NULL").withColumn("h", F.sha2(F.to_json("geom"), 256))
    first = h.groupBy("layer_id", "h").agg(F.min(F.struct("ord", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = h.join(first, ["layer_id", "h"]).where(F.struct("ord", "key") > F.col("first"))  # places in files repeat, keys tell
    return found(later, "GEOM-DUPLICATE", F.concat(F.lit("duplicate of "), F.col("first.key")), F.col("key"), evidence=_name())


@rule("CRS-MISSING", "Coordinate system is not identified", "critical", "dataset")
def crs_missing(c: Context) -> DataFrame:
    return found(c.datasets.where(~G.identified(F.col("epsg"))), "CRS-MISSING", F.lit("coordinate system not identified"), F.col("dataset_id"), target="dataset")


@rule("CRS-BOUNDS", "Coordinates outside the expected extent", "warning")
def crs_bounds(c: Context) -> DataFrame:
    near = G.bbox_intersects(F.col("geom"), *G.EXTENT)
    rows = _layer(c).join(c.datasets.where(F.col("epsg").isin(4326, 4756)).select("dataset_id"), "dataset_id").where(F.coalesce(~near, F.lit(False)))
    return found(rows, "CRS-BOUNDS", F.lit("outside the expected extent"), F.col("key"), evidence=_name())


def _opted(c: Context, flag: str, family: tuple[str, ...]) -> DataFrame:
    """Sound features of a family in opted-in layers."""
    return _layer(c).where(F.col(flag) & F.col("geom.gtype").isin(*family) & G.structure_issue(F.col("geom")).isNull())


def _met(c: Context, first: DataFrame, second: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """Pairs of features of a layer whose boxes meet, first by order; each side's columns end in _a and _b."""
    side = lambda rows, s: rows.select("layer_id", F.col("layer_name").alias(f"name_{s}"), *[F.col(k).alias(f"{k}_{s}") for k in ("ord", "key", *more)], *[F.col(f"geom.{k}").alias(f"{s}_{k}") for k in ("minx", "miny", "maxx", "maxy")])
    box = lambda s: tuple(f"{s}_{k}" for k in ("minx", "miny", "maxx", "maxy"))
    return spatial.box_join(side(first, "a"), side(second, "b"), box("a"), box("b"), c.cell, on=["layer_id"]).where("ord_a < ord_b")


def _pairs(c: Context, flag: str, family: tuple[str, ...]) -> DataFrame:
    """Pairs of features of an opted-in layer whose boxes meet, first by order."""
    rows = _opted(c, flag, family)
    return _met(c, rows, rows, ("geom",))


@rule("TOPO-POLY-OVERLAP", "Polygons of a layer overlap", "warning")
def poly_overlap(c: Context) -> DataFrame:
    """Two boxes share what their sides tell; their shapes don't go through the join. All other pairs are overlaid."""
    own = F.abs(F.aggregate(F.flatten("geom.parts"), F.lit(0.0), lambda s, r: s + G.planar_area(r)))
    rows = _opted(c, "overlap", ("Polygon", "MultiPolygon")).withColumns({"own": own, "plain": G.is_box(F.col("geom"))})
    plain, others = rows.where("plain"), rows.where("NOT plain")
    wide, high = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx"), F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    columns = ["name_a", "key_a", "key_b", "own_a", "shared"]
    both = _met(c, plain, plain, ("own",)).withColumn("shared", wide * high).select(columns)
    for first, second in ((others, rows), (plain, others)):
        met = _met(c, first, second, ("own", "geom")).withColumn("shared", overlay.overlap_degrees("geom_a.parts", "geom_b.parts"))
        both = both.unionByName(met.select(columns))
    bad = both.where(F.col("shared") > 1e-9 * F.greatest("own_a", F.lit(1e-12)))
    return found(bad, "TOPO-POLY-OVERLAP", F.concat(F.lit("overlaps "), F.col("key_b")), F.col("key_a"), evidence=F.to_json(F.struct(F.col("name_a").alias("layer"), F.round("shared", 12).alias("degrees2"))))


@rule("TOPO-POLY-GAP", "Polygons of a layer leave gaps", "info", "layer")
def poly_gap(c: Context) -> DataFrame:
    """Holes in what the valid polygons of a layer cover, if they are two or more and cover one piece."""
    rows = _layer(c).where(F.col("gap") & F.col("geom.gtype").isin("Polygon", "MultiPolygon") & G.structure_issue(F.col("geom")).isNull())
    valid = rows.where(overlay.breaks_rules("geom.parts").isNull())
    several = valid.groupBy("layer_id").agg(F.first("layer_name").alias("layer_name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    holes = topology.coverage(valid.select("layer_id", "key", "geom"), c.cell).where("pieces = 1 AND holes > 0")
    return found(holes.join(several, "layer_id"), "TOPO-POLY-GAP", F.concat(F.col("holes").cast("string"), F.lit(" gap(s)")), F.col("layer_id"), target="layer", evidence=_name())


@rule("TOPO-LINE-CROSS", "Lines of a layer meet in one point", "warning")
def line_cross(c: Context) -> DataFrame:
    """Lines that share one point only, ends included. Parallel segments in one line share the ends of their common part,
    so lines that join end to end have one point and lines that run along each other two."""
    segs = lambda s: F.flatten(F.transform(F.flatten(f"geom_{s}.parts"), G.segments))
    near = lambda s, t: F.greatest(F.least(s["a"]["x"], s["b"]["x"]), F.least(t["a"]["x"], t["b"]["x"])) - 1e-9 <= F.least(F.greatest(s["a"]["x"], s["b"]["x"]), F.greatest(t["a"]["x"], t["b"]["x"]))
    p = _pairs(c, "cross", ("LineString", "MultiLineString")).select("layer_id", "name_a", "key_a", "key_b", F.explode(segs("a")).alias("s"), segs("b").alias("others"))
    p = p.select("layer_id", "name_a", "key_a", "key_b", "s", F.explode(F.filter("others", lambda t: near(F.col("s"), t))).alias("t"))
    length = lambda s: F.expr(f"sqrt(power({s}.b.x - {s}.a.x, 2) + power({s}.b.y - {s}.a.y, 2))")
    p = p.withColumn("ls", length("s")).withColumn("lt", length("t")).where("ls > 0 AND lt > 0")
    det = F.expr("(s.b.x - s.a.x) * (t.b.y - t.a.y) - (s.b.y - s.a.y) * (t.b.x - t.a.x)")
    u = F.expr("((t.a.x - s.a.x) * (t.b.y - t.a.y) - (t.a.y - s.a.y) * (t.b.x - t.a.x)) / det")
    v = F.expr("((t.a.x - s.a.x) * (s.b.y - s.a.y) - (t.a.y - s.a.y) * (s.b.x - s.a.x)) / det")
    cut = F.when(u.between(-1e-12, 1 + 1e-12) & v.between(-1e-12, 1 + 1e-12), F.array(u))
    aside = F.expr("abs((t.a.x - s.a.x) * (s.b.y - s.a.y) - (t.a.y - s.a.y) * (s.b.x - s.a.x)) / ls")
    along = lambda e: F.expr(f"((t.{e}.x - s.a.x) * (s.b.x - s.a.x) + (t.{e}.y - s.a.y) * (s.b.y - s.a.y)) / (ls * ls)")
    low, high = F.greatest(F.lit(0.0), F.least(along("a"), along("b"))), F.least(F.lit(1.0), F.greatest(along("a"), along("b")))
    common = F.when((aside <= 1e-9) & (low <= high + 1e-12), F.array(low, high))
    hit = p.withColumn("det", det).withColumn("u", F.explode(F.when(F.expr("abs(det) > 1e-9 * greatest(ls, lt)"), cut).otherwise(common)))
    at = hit.select("layer_id", "name_a", "key_a", "key_b", F.struct(F.expr("round(s.a.x + u * (s.b.x - s.a.x), 9)").alias("x"), F.expr("round(s.a.y + u * (s.b.y - s.a.y), 9)").alias("y")).alias("at"))
    one = at.groupBy("layer_id", "name_a", "key_a", "key_b").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first = last")
    return found(one, "TOPO-LINE-CROSS", F.concat(F.lit("crosses "), F.col("key_b")), F.col("key_a"), evidence=F.to_json(F.struct("first")))


@rule("ATTR-REQUIRED", "Required attribute is missing or empty", "error")
def attr_required(c: Context) -> DataFrame:
    missing = F.array_sort(F.filter("required", lambda k: ~F.map_contains_key("properties", k) | (F.coalesce(F.col("properties")[k], F.lit("")) == "")))
    rows = _layer(c).withColumn("missing", missing).where(F.size("missing") > 0)
    return found(rows, "ATTR-REQUIRED", F.concat(F.lit("missing: "), F.concat_ws(", ", "missing")), F.col("key"), evidence=_name())


@rule("TIME-INVALID", "A date can't be read", "error")
def time_invalid(c: Context) -> DataFrame:
    bad = lambda n: F.when(F.col(n).isNotNull() & strict_date(F.col(n)).isNull(), n)
    f = _layer(c).withColumn("bad", F.explode(F.array_compact(F.array(bad("valid_from"), bad("valid_to")))))
    d = c.datasets.withColumn("bad", F.explode(F.array_compact(F.array(*map(bad, ("approval_date", "effective_from", "effective_to", "signed_date"))))))
    return found(f, "TIME-INVALID", F.concat(F.lit("unreadable "), F.col("bad")), F.col("key"), evidence=_name()).unionByName(found(d, "TIME-INVALID", F.concat(F.lit("unreadable "), F.col("bad")), F.col("dataset_id"), target="dataset"))


@rule("TIME-ORDER", "Dates are in an impossible order", "error")
def time_order(c: Context) -> DataFrame:
    d = lambda n: strict_date(F.col(n))
    a = found(c.datasets.where(d("effective_to") < d("effective_from")), "TIME-ORDER", F.lit("effective_to before effective_from"), F.col("dataset_id"), target="dataset")
    b = found(c.datasets.where(d("effective_from") < d("approval_date")), "TIME-ORDER", F.lit("effective_from before approval_date"), F.col("dataset_id"), "warning", "dataset")
    f = found(_layer(c).where(d("valid_to") < d("valid_from")), "TIME-ORDER", F.lit("valid_to before valid_from"), F.col("key"), evidence=_name())
    return a.unionByName(b).unionByName(f)


@rule("ARTIFACT-HASH-MISMATCH", "Content changed since it was recorded", "critical", "dataset")
def hash_mismatch(c: Context) -> DataFrame:
    return found(c.datasets.where("recorded_sha IS NOT NULL AND actual_sha IS NOT NULL AND recorded_sha <> actual_sha"), "ARTIFACT-HASH-MISMATCH", F.lit("content differs from its recorded digest"), F.col("dataset_id"), target="dataset", evidence=F.to_json(F.struct("recorded_sha", "actual_sha")))


@rule("PROV-ORPHAN", "Derived data without inputs", "error", "dataset")
def prov_orphan(c: Context) -> DataFrame:
    rows = c.datasets.where(F.col("derivation_level").startswith("derived_")).join(c.inputs.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return found(rows, "PROV-ORPHAN", F.concat(F.col("derivation_level"), F.lit(" without inputs")), F.col("dataset_id"), target="dataset")


@rule("AUTH-MISSING", "Official data without an authority", "error", "dataset")
def auth_missing(c: Context) -> DataFrame:
    return found(c.datasets.where(F.col("derivation_level").isin(*OFFICIAL) & (F.coalesce("authority", F.lit("")) == "")), "AUTH-MISSING", F.lit("no authority"), F.col("dataset_id"), target="dataset")


@rule("META-CODE-MISMATCH", "Planning codes disagree", "warning", "dataset")
def code_mismatch(c: Context) -> DataFrame:
    t = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    a = found(c.datasets.where(t("decision") != t("document_number")), "META-CODE-MISMATCH", F.lit("decision differs from document number"), F.col("dataset_id"), target="dataset")
    b = found(c.datasets.where(t("record_code") == t("decision")), "META-CODE-MISMATCH", F.lit("record code equals decision"), F.col("dataset_id"), target="dataset")
    return a.unionByName(b)


@rule("VN-GROUP-UNKNOWN", "Planning group not known", "info", "dataset")
def group_unknown(c: Context) -> DataFrame:
    return found(c.datasets.where("grp = 'other'"), "VN-GROUP-UNKNOWN", F.lit("group not known"), F.col("dataset_id"), target="dataset")


def summary(findings: DataFrame) -> DataFrame:
    """total, has_errors, by_severity and by_rule (maps) in one row; counted by rule first."""
    by = findings.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"))
    sev = by.groupBy("severity").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    rules = by.groupBy("rule_code").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_code", "n")))).alias("by_rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    bad = by.agg(F.coalesce(F.bool_or(F.col("severity").isin("error", "critical")), F.lit(False)).alias("has_errors"))
    return rules.crossJoin(F.broadcast(sev)).crossJoin(F.broadcast(bad))  # one row each


def report(findings: DataFrame) -> DataFrame:
    """JSON and text line of each finding."""
    line = F.format_string("[%s] %s %s:%s %s", F.upper("severity"), F.col("rule_code"), F.col("target_type"), F.coalesce("target_ref", F.lit("-")), F.col("message"))
    return findings.select("rule_code", "target_ref", F.to_json(F.struct(*[c.split()[0] for c in FINDING.split(", ")])).alias("json"), line.alias("line"))


def persist(findings: DataFrame, known_targets: DataFrame, dataset_id: Column, open_before: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """findings(dataset_id, ...) -> new observations with resolved targets, old ones with resolution, dataset states.

    A target that isn't known falls back to its dataset; only dataset-level observations are superseded by a new run."""
    t = known_targets.select("target_type", "target_ref", F.lit(True).alias("_known"))
    new = findings.join(t, ["target_type", "target_ref"], "left").select("dataset_id", "rule_code", "severity", "message", F.when(F.col("_known"), F.col("target_type")).otherwise("dataset").alias("target_type"), F.when(F.col("_known"), F.col("target_ref")).otherwise(dataset_id.cast("string")).alias("target_ref"))
    runs = findings.select("dataset_id").distinct().withColumn("_run", F.lit(True))
    old = open_before.join(runs, "dataset_id", "left").withColumn("resolution", F.when(F.col("_run") & (F.col("target_type") == "dataset"), "superseded by new run")).drop("_run")
    state = findings.groupBy("dataset_id").agg(F.when(F.bool_or(F.col("severity").isin("error", "critical")), "errors").otherwise("warnings").alias("quality_state"))
    return new, old, state
