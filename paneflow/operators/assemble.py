"""From observation tables to sealed snapshots: one declarative plan over all captures.

observations -> entities -> hierarchy and regions -> relations -> nodes with tokens, hints and evidence -> seal. Each
stage is a table keyed by capture, so a capture of any share of the rows is spread by its entities and grid cells; only
the seal reads a snapshot's pieces in order, in a stream that holds one digest and never the snapshot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow import schemas as S
from paneflow.functions import geometry as G
from paneflow.functions.canonical import canonical, canonical_json, sha256_text
from paneflow.functions.lengths import PX_PER_UNIT
from paneflow.functions.text import canonical_color
from paneflow.operators import structure as R
from paneflow.operators import validate as V
from paneflow.operators.observe import derived_best_match, derived_boxes, lookup, normalize_dom, normalize_runs, rows_of, visual_geometry
from paneflow.operators.ordering import ordinal
from paneflow.operators.requests import RequestError, may_be_authoritative, profile_issues
from paneflow.operators.views import affordance, node_kind
from paneflow.session import cut, default_parallelism, ship_package, small, small_rows

SCHEMA_VERSION = "1.0.0"
GEOMETRY = "struct<document_rect:{r},viewport_rect:{r},normalized_rect:{r},visibility:string,clipped:boolean>".format(r=G.RECT_TYPE)
EVIDENCE = "struct<stage:int,ord:bigint,source_id:string,source_type:string,confidence:double,claims:array<string>,coordinate_space_id:string,artifact_ref:string,provider:string,provider_version:string,role:string,name:string,text:string,geometry:" + GEOMETRY + ",frame_id:string,kind:string>"


@dataclass(frozen=True)
class BuildOptions:
    """Options of a build; all of them count in the input hash."""

    builder_version: str = "paneflow@1"
    schema_version: str = SCHEMA_VERSION
    relation_policy_version: str = "relations@1"
    dna_projection_version: str = "dna-projection@1"
    redaction_policy_version: str = "redaction@1"
    use_mode: str = "offline_eval"
    max_nodes: int = 2000
    max_persisted_edges_per_node: int = 8
    repeated_region_threshold: int = 3
    text_policy: str = "truncate"
    include_hidden_explanatory_nodes: bool = False

    def issues(self) -> list[str]:
        """Codes of everything that is wrong: blank versions, a foreign schema, limits that are no positive safe integers."""
        versions = (self.builder_version, self.schema_version, self.relation_policy_version, self.dna_projection_version, self.redaction_policy_version)
        out = ["missing_version" for v in versions if not isinstance(v, str) or not v.strip()]
        out += ["unsupported_output_schema"] if self.schema_version != SCHEMA_VERSION else []
        limits = (self.max_nodes, self.max_persisted_edges_per_node, self.repeated_region_threshold)
        return out + ["invalid_limit" for n in limits if isinstance(n, bool) or not isinstance(n, int) or not 0 < n < 1 << 53]

    def json(self) -> dict:
        camel = lambda k: re.sub("_([a-z])", lambda m: m.group(1).upper(), k)
        return {camel(k): v for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Profile:
    """A design-token profile: tokens are (value, category, confidence) by reference. A bounded design artefact."""

    version: str
    content_digest: str
    state: str
    tokens: dict[str, tuple]
    use_mode: str | None = None
    projection_schema_version: str = "1.0.0"
    exceptions: tuple[dict, ...] = ()
    #: The profile as it was given, where the input hash is to be that of its JSON.
    source: dict | None = field(default=None, compare=False)

    def json(self) -> dict:
        if self.source is not None:
            return self.source
        body = {"projectionSchemaVersion": self.projection_schema_version, "dnaVersion": self.version, "dnaContentDigest": self.content_digest, "state": self.state, "tokens": {k: {"value": v, "category": c, "confidence": p} for k, (v, c, p) in self.tokens.items()}}
        return {**body, **({"useMode": self.use_mode} if self.use_mode else {})}


@dataclass
class Snapshots:
    """Sealed snapshots as tables keyed by capture_id (and snapshot_id): headers, nodes, edges, regions, spaces, warnings, pieces."""

    headers: DataFrame
    nodes: DataFrame
    edges: DataFrame
    regions: DataFrame
    spaces: DataFrame
    warnings: DataFrame
    pieces: DataFrame
    issues: DataFrame


def _geo(prefix: str = "") -> Column:
    at = lambda c: F.col(prefix + c)
    v, n = at("viewport"), at("viewport_rect")
    whole = G.rect(F.try_divide(n["x"], v["width_css_px"]), F.try_divide(n["y"], v["height_css_px"]), F.try_divide(n["width"], v["width_css_px"]), F.try_divide(n["height"], v["height_css_px"]))
    return F.when(n.isNotNull(), F.struct(at("document_rect").alias("document_rect"), n.alias("viewport_rect"), whole.alias("normalized_rect"), at("visibility").alias("visibility"), at("visibility").isin("offscreen", "clipped").alias("clipped")))


def observations(dom: DataFrame, ax: DataFrame, runs: DataFrame, captures: DataFrame, derived: DataFrame, include_hidden: bool = False) -> DataFrame:
    """capture_id, entity, e: each observation with its claims, evidence and geometry, and the entity that it speaks of.

    A DOM row is an entity if it is shown. Accessibility rows and text runs join it by their explicit link, derived rows
    by their overlap; what joins none stands alone.
    """
    norm = cut(normalize_dom(dom, captures).select("capture_id", "source_id", "frame_id", "ord", "role", "tag", "visible", "document_rect", "viewport_rect", "visibility", "viewport"))
    hidden = (F.col("visibility") == "hidden") & F.col("viewport_rect").isNotNull() | ~F.coalesce("visible", F.lit(True))
    shown = norm if include_hidden else norm.where(~hidden)
    none = F.lit(None).cast("string")
    claim = lambda **said: F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c)) for k, c in said.items()]))

    def told(df: DataFrame, entity: Column, stage: int, kind: Column, source_type: Column, confidence: Column, claims: Column, space: Column = none, role: Column = none, name: Column = none, text: Column = none, geometry: Column | None = None, extra: tuple[str, str, str] | None = None) -> DataFrame:
        more = [F.col(x) for x in extra] if extra else [none, none, none]
        geometry = F.lit(None).cast(GEOMETRY) if geometry is None else geometry
        e = F.struct(F.lit(stage).alias("stage"), F.col("ord").cast("bigint").alias("ord"), F.col("source_id").alias("source_id"), source_type.alias("source_type"), confidence.alias("confidence"), claims.alias("claims"), space.alias("coordinate_space_id"), more[0].alias("artifact_ref"), more[1].alias("provider"), more[2].alias("provider_version"), role.alias("role"), name.alias("name"), text.alias("text"), geometry.alias("geometry"), F.col("frame_id").alias("frame_id"), kind.alias("kind"))
        return df.select("capture_id", entity.alias("entity"), e.cast(EVIDENCE).alias("e"))

    space = F.when(F.col("viewport_rect").isNotNull(), F.concat(F.lit("cs_frame_"), "frame_id"))
    conf = {k: F.lit(v) for k, v in S.BASE_CONFIDENCE.items()}
    d = told(shown, F.concat(F.lit("dom:"), "source_id"), 0, F.lit("dom"), F.lit("dom"), conf["dom"], claim(role=F.col("role"), tag=F.col("tag")), space, role=F.col("role"), geometry=_geo())
    known = norm.select("capture_id", F.col("source_id").alias("dom_id"), (F.lit(True) if include_hidden else ~hidden).alias("hit"), _geo().alias("g"))
    hit = F.coalesce("hit", F.lit(False))
    a = rows_of(ax).where("true" if include_hidden else "not coalesce(ignored, false)").withColumnRenamed("backend_dom_source_id", "dom_id").join(known, ["capture_id", "dom_id"], "left")
    a = told(a, F.when(hit, F.concat(F.lit("dom:"), "dom_id")).otherwise(F.concat(F.lit("ax:"), "source_id")), 1, F.when(hit, "dom").otherwise("ax_only"), F.lit("accessibility"), conf["accessibility"], claim(role=F.col("role"), name=F.col("name")), role=F.col("role"), name=F.col("name"), geometry=F.when(~hit, F.col("g")))
    r = normalize_runs(runs, captures).withColumnRenamed("dom_source_id", "dom_id").join(known.drop("g"), ["capture_id", "dom_id"], "left")
    value = F.when(F.col("redacted") | (F.col("text") == ""), None).otherwise(F.col("text"))
    r = told(r, F.when(hit, F.concat(F.lit("dom:"), "dom_id")).otherwise(F.concat(F.lit("text:"), "source_id")), 2, F.when(hit, "dom").otherwise("text"), F.lit("text_run"), conf["text_run"], claim(text=value), text=value, geometry=F.when(~hit, _geo()))
    best = derived_best_match(derived, norm, captures, include_hidden=include_hidden).select("capture_id", "source_id", F.col("dom_source_id").alias("dom_id"))
    i = derived_boxes(derived, captures).join(best, ["capture_id", "source_id"], "left").join(visual_geometry(derived, captures).drop("viewport"), ["capture_id", "source_id"], "left")
    c, hit = F.col("confidence"), F.col("dom_id").isNotNull()
    own = F.when(F.col("viewport_rect").isNotNull(), F.struct("document_rect", "viewport_rect", "normalized_rect", "visibility", F.col("visibility").isin("offscreen", "clipped").alias("clipped")))
    said = F.when(F.col("text") != "", F.col("text"))
    i = i.withColumn("ord", F.coalesce("obs_ord", F.lit(0)).cast("bigint") * (1 << 32) + F.coalesce("item_ord", F.lit(0)))
    i = told(i, F.when(hit, F.concat(F.lit("dom:"), "dom_id")).otherwise(F.concat(F.lit("visual:"), "source_id")), 3, F.when(hit, "dom").otherwise("visual"), F.col("kind"), F.when(G.finite(c), G.clamp01(c)).otherwise(0.0), claim(text=said), F.when(own.isNotNull(), F.concat(F.lit("cs_frame_"), "frame_id")), text=said, geometry=F.when(~hit, own), extra=("source_image_ref", "provider", "provider_version"))
    return d.unionByName(a).unionByName(r).unionByName(i)


def _fact(evidence: Column, fact: str) -> Column:
    """Struct (value, confidence, conflict) of the most competent claim, then the most confident, then the smallest; null without any."""
    table = S.COMPETENCE[fact]
    rank = lambda e: F.coalesce(lookup({k: v for k, v in table.items() if k}, e["source_type"]), F.lit(table[""]))
    present = F.filter(evidence, lambda e: F.trim(e[fact]) != "")
    best = lambda p: F.array_min(F.transform(p, lambda e: F.struct((-rank(e)).alias("r"), (-e["confidence"]).alias("c"), e[fact].alias("v"))))
    many = lambda p: F.size(F.array_distinct(F.transform(p, lambda e: e[fact]))) > 1
    picked = G.bind(present, lambda p: F.struct(best(p).alias("b"), many(p).alias("conflict")))
    return G.bind(picked, lambda x: F.when(x["b"].isNotNull(), F.struct(x["b"]["v"].alias("value"), F.when(x["conflict"], -x["b"]["c"] * S.CONFLICT_FACTOR).otherwise(-x["b"]["c"]).alias("confidence"), x["conflict"].alias("conflict"))))


def entities(observed: DataFrame, captures: DataFrame) -> DataFrame:
    """One row per entity in total order: candidate_id, kind, frame_id, geometry, role, name, text, evidence, flags, confidence.

    A capture of which nothing was observed has one entity, its document.
    """
    g = observed.groupBy("capture_id", "entity").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    first = F.get("evidence", F.lit(0))
    n = g.select("capture_id", "entity", "evidence", first["kind"].alias("kind"), first["frame_id"].alias("frame_id"), first["source_id"].alias("first_source"), first["geometry"].alias("geometry"), *[_fact(F.col("evidence"), f).alias(f) for f in ("role", "name", "text")])
    conf = F.array_min(F.array_compact(F.array("role.confidence", "name.confidence", "text.confidence")))
    flags = F.array_compact(F.array(*[F.when(F.col(f"{f}.conflict"), F.lit(f"conflict:{f}")) for f in ("role", "name", "text")]))
    hide = F.when((F.col("kind") == "dom") & (F.col("geometry.visibility") == "hidden"), F.array(F.lit("hidden_explanatory"))).otherwise(F.array().cast("array<string>"))
    n = n.withColumns({"flags": F.concat(hide, flags), "confidence": F.coalesce(conf, F.when(F.col("geometry").isNotNull(), S.NO_FACT_CONFIDENCE[0]).otherwise(S.NO_FACT_CONFIDENCE[1]))})
    y, x = F.col("geometry.viewport_rect.y"), F.col("geometry.viewport_rect.x")
    n = ordinal(n, ["capture_id"], [F.col("frame_id"), F.floor(y / 256)], [y.asc_nulls_last(), x.asc_nulls_last(), F.col("kind"), F.col("first_source")], "place")
    n = n.withColumn("candidate_id", F.format_string("cand_%04d", "place")).drop("place", "first_source")
    v = F.col("viewport")
    whole = G.rect(F.lit(0.0), F.lit(0.0), v["width_css_px"], v["height_css_px"])
    frame = F.coalesce(F.get("frames", F.lit(0))["frame_id"], F.lit("root"))
    e = F.struct(F.lit(0).alias("stage"), F.lit(0).cast("bigint").alias("ord"), F.col("capture_id").alias("source_id"), F.lit("layout").alias("source_type"), F.lit(0.5).alias("confidence"), F.array(F.lit("document_bounds"), F.lit("no_element_evidence")).alias("claims"), F.lit("cs_viewport").alias("coordinate_space_id"), *[F.lit(None).cast("string").alias(c) for c in ("artifact_ref", "provider", "provider_version", "role", "name", "text")], F.lit(None).cast(GEOMETRY).alias("geometry"), frame.alias("frame_id"), F.lit("dom").alias("kind"))
    empty = captures.join(n.select("capture_id").distinct(), "capture_id", "left_anti").select(
        "capture_id", F.lit("document").alias("entity"), F.array(e.cast(EVIDENCE)).alias("evidence"), F.lit("dom").alias("kind"), frame.alias("frame_id"),
        F.struct(whole.alias("document_rect"), whole.alias("viewport_rect"), G.rect(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("normalized_rect"), F.lit("visible").alias("visibility"), F.lit(False).alias("clipped")).cast(GEOMETRY).alias("geometry"),
        F.struct(F.lit("document").alias("value"), F.lit(0.5).alias("confidence"), F.lit(False).alias("conflict")).alias("role"),
        *[F.lit(None).cast("struct<value:string,confidence:double,conflict:boolean>").alias(f) for f in ("name", "text")],
        F.array(F.lit("partial:no_element_evidence")).alias("flags"), F.lit(0.5).alias("confidence"), F.lit("cand_0000").alias("candidate_id"),
    )
    return n.select(*empty.columns).unionByName(empty)


def boxes(nodes: DataFrame, rect: str) -> DataFrame:
    """The node table of ``structure`` for entities, by one of their rectangles."""
    r = F.col(f"geometry.{rect}")
    return nodes.select("capture_id", F.col("candidate_id").alias("node_id"), "frame_id", r["x"].alias("x"), r["y"].alias("y"), r["width"].alias("w"), r["height"].alias("h"), F.col("role.value").alias("role"), "kind", F.col("geometry.visibility").alias("visibility"))


def _evidence_json(evidence: Column, fallback: Column) -> Column:
    """Evidence claims as they are published; an empty list of claims says what they are for."""
    return F.transform(evidence, lambda e: F.struct(e["source_type"].alias("sourceType"), e["source_id"].alias("sourceId"), e["confidence"].alias("confidence"), F.when(F.size(e["claims"]) > 0, e["claims"]).otherwise(F.array(fallback)).alias("claims"), e["coordinate_space_id"].alias("coordinateSpaceId"), e["artifact_ref"].alias("artifactRef"), e["provider"].alias("provider"), e["provider_version"].alias("providerVersion")))


def _quoted(text: Column) -> Column:
    """Canonical JSON of a string."""
    one = canonical_json(F.when(text.isNotNull(), F.to_json(F.array(text))))
    return F.substring(one, 2, F.length(one) - 2)


def style_of(facts: Column, z_index: Column) -> Column:
    """The typed style of an element: colours canonical, lengths in CSS px, radii and spacing by sorted name."""
    entries = F.map_entries(facts)
    named = lambda e, *names: F.lower(e["key"]).isin(*[n.lower() for n in names])
    first = lambda test: F.get(F.filter(entries, test), F.lit(0))["value"]
    is_color = lambda e: e["key"].rlike("(?i)colou?r") & e["value"]["s"].isNotNull()
    color = lambda name: canonical_color(F.get(F.filter(entries, lambda e: named(e, name) & is_color(e)), F.lit(0))["value"]["s"])
    length = lambda *names: G.bind(F.get(F.filter(entries, lambda e: named(e, *names) & ~is_color(e) & _has_unit(e["value"])), F.lit(0)), lambda e: _px(e["value"]))
    number = lambda *names: G.bind(first(lambda e: named(e, *names)), lambda v: F.coalesce(v["n"], F.trim(v["s"]).try_cast("double")))
    text = lambda *names: first(lambda e: named(e, *names))["s"]
    lengths = lambda pattern: F.array_sort(F.filter(F.transform(F.filter(entries, lambda e: e["key"].rlike(pattern) & ~is_color(e)), lambda e: F.struct(e["key"].alias("key"), _px(e["value"]).alias("value"))), lambda e: e["value"].isNotNull()))
    listed = lambda c: F.when(F.size(c) > 0, c)
    z = F.when(z_index.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.try_parse_json(z_index)).otherwise(z_index.cast("variant"))
    return F.struct(
        color("color").alias("color"), color("backgroundColor").alias("backgroundColor"), text("fontFamily", "font-family").alias("fontFamily"),
        length("fontSizeCssPx", "fontSize", "font-size").alias("fontSizeCssPx"), number("fontWeight", "font-weight").alias("fontWeight"), length("lineHeightCssPx", "lineHeight", "line-height").alias("lineHeightCssPx"),
        number("opacity").alias("opacity"), text("display").alias("display"), text("position").alias("position"), z.alias("zIndex"),
        G.bind(lengths("(?i)borderradius"), lambda c: listed(F.transform(c, lambda e: e["value"]))).alias("borderRadiusCssPx"),
        G.bind(lengths("(?i)^(margin|padding|gap|rowgap|columngap)"), lambda c: F.when(F.size(c) > 0, F.map_from_entries(c))).alias("spacing"),
    )


_LENGTH = r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z%]*)$"


def _has_unit(v: Column) -> Column:
    """Whether a fact reads as a length at all, absolute or not."""
    return F.when(v["n"].isNotNull(), G.in_bounds(v["n"])).otherwise(F.coalesce(F.lower(F.trim(v["s"])).rlike(_LENGTH), F.lit(False)))


def _px(v: Column) -> Column:
    t = F.lower(F.trim(v["s"]))
    factor = lookup({**PX_PER_UNIT, "": 1.0}, F.regexp_extract(t, _LENGTH, 2))
    px = F.coalesce(v["n"], F.nullif(F.regexp_extract(t, _LENGTH, 1), F.lit("")).try_cast("double") * factor)
    return F.when(G.in_bounds(px), px)


def _px_of(value) -> float | None:
    """A token's value in CSS px."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value) if abs(value) <= G.MAX_COORD else None
    m = re.fullmatch(_LENGTH.strip("^$"), str(value).strip().lower())
    factor = {**PX_PER_UNIT, "": 1.0}.get(m.group(2)) if m else None
    return float(m.group(1)) * factor if factor is not None and abs(float(m.group(1)) * factor) <= G.MAX_COORD else None


MATCH = "struct<authoritative:boolean,dnaRef:string,category:string,status:string,method:string,observed:variant,canonical:variant,delta:double,confidence:double,evidence:array<struct<sourceType:string,confidence:double,claims:array<string>>>>"


def token_matches(style: Column, confidence: Column, route: Column, profile: Profile, authoritative: bool, colors: dict[str, str | None]) -> Column:
    """Array of token matches of a style: colours exact or drift, numbers to the nearest token of their category.

    ``colors`` has the canonical form of each colour token. Tolerance is half a px or 2 % of the observed value. A
    category without tokens, or an unreadable observation, gives no match. Exceptions turn drift into excepted.
    """
    by: dict[str, list[tuple]] = {}
    for ref in sorted(profile.tokens):
        value, category, p = profile.tokens[ref]
        by.setdefault(category, []).append((ref, value, float(p)))
    variant = lambda v: F.lit(v).cast("variant") if isinstance(v, str) else F.lit(float(v)).cast("variant")
    evidence = lambda prop: F.struct(F.lit("ui_dna").alias("sourceType"), F.lit(1.0).alias("confidence"), F.array(F.concat(F.lit("style:"), prop)).alias("claims"))

    def match(prop: Column, category: str, ref: Column, status: Column, method: str, observed: Column, canonical_: Column, delta: Column, sure: Column) -> Column:
        rule, why = F.lit(False), F.lit(None).cast("string")
        for e in reversed(profile.exceptions):
            applies = F.lit("elementRef" not in e and e.get("category", category) == category) & (route == F.lit(e["route"]) if "route" in e else F.lit(True))
            rule, why = F.when(applies, True).otherwise(rule), F.when(applies, F.lit(f"exception:{e['reason']}")).otherwise(why)
        excepted = (status == "drift") & rule
        final = F.when(excepted, "excepted").otherwise(status)
        also = F.struct(F.lit("ui_dna").alias("sourceType"), F.lit(1.0).alias("confidence"), F.array(why).alias("claims"))
        return F.struct(
            (F.lit(authoritative) & (final != "drift")).alias("authoritative"), ref.alias("dnaRef"), F.lit(category).alias("category"), final.alias("status"), F.when(excepted, "rule_evaluation").otherwise(method).alias("method"),
            observed.alias("observed"), canonical_.cast("variant").alias("canonical"), delta.alias("delta"), F.when(status == "drift", confidence).otherwise(sure).alias("confidence"), F.when(excepted, F.array(evidence(prop), also)).otherwise(F.array(evidence(prop))).alias("evidence"),
        ).cast(MATCH)

    none = F.lit(None)
    out: list[Column] = []
    for prop in ("color", "backgroundColor"):
        if by.get("color"):
            hits = F.array(*[F.struct(F.lit(colors.get(r)).cast("string").alias("c"), F.lit(r).alias("ref"), variant(v).alias("value"), F.lit(p).alias("p")) for r, v, p in by["color"]])
            one = lambda x: F.get(F.filter(hits, lambda h: h["c"] == x), F.lit(0))  # noqa: B023, E731
            m = G.bind(F.struct(style[prop].alias("o"), one(style[prop]).alias("h")), lambda x, prop=prop: match(F.lit(prop), "token", F.coalesce(x["h"]["ref"], F.lit("category:color")), F.when(x["h"].isNotNull(), "exact").otherwise("drift"), "exact_value", x["o"].cast("variant"), x["h"]["value"], none.cast("double"), x["h"]["p"]))
            out.append(F.when(style[prop].isNotNull(), F.array(m)).otherwise(F.array().cast(f"array<{MATCH}>")))

    def numbers(values: Column, category: str) -> Column:
        """Matches of an array of (prop, v)."""
        known = [(r, v, p, px) for r, v, p in by.get(category, []) if (px := _px_of(v)) is not None]
        if not known:
            return F.array().cast(f"array<{MATCH}>")
        hits = F.array(*[F.struct(F.lit(px).alias("px"), F.lit(r).alias("ref"), variant(v).alias("value"), F.lit(p).alias("p")) for r, v, p, px in known])
        nearest = lambda v: F.array_min(F.transform(hits, lambda h, i: F.struct(F.abs(v - h["px"]).alias("d"), i.alias("i"))))

        def one(x: Column) -> Column:
            h = F.get(hits, x["n"]["i"])
            d, v = x["n"]["d"], x["o"]["v"]
            status = F.when(d == 0, "exact").when(d <= F.greatest(F.lit(0.5), v * 0.02), "within_tolerance").otherwise("drift")
            return match(x["o"]["prop"], "scale", h["ref"], status, "numeric_tolerance", v.cast("variant"), h["value"], d, h["p"])

        return F.transform(values, lambda o: G.bind(F.struct(o.alias("o"), nearest(o["v"]).alias("n")), one))

    obs = lambda prop, v: F.struct(F.lit(prop).alias("prop") if isinstance(prop, str) else prop.alias("prop"), v.alias("v"))
    sized = lambda name: F.when(style[name].isNotNull(), F.array(obs(name, style[name]))).otherwise(F.array().cast("array<struct<prop:string,v:double>>"))
    out.append(numbers(F.concat(sized("fontSizeCssPx"), sized("lineHeightCssPx")), "typography"))
    out.append(numbers(F.transform(F.coalesce(style["borderRadiusCssPx"], F.array().cast("array<double>")), lambda v: obs("borderRadiusCssPx", v)), "radii"))
    spacing = F.array_sort(F.coalesce(F.map_entries(style["spacing"]), F.array().cast("array<struct<key:string,value:double>>")))
    out.append(numbers(F.transform(spacing, lambda e: obs(F.concat(F.lit("spacing."), e["key"]), e["value"])), "spacing"))
    return F.concat(*out)


HINT = "struct<kind:string,value:string,scope:string,uniqueness:double,stability:double,confidence:double>"


def _hints() -> Column:
    c = F.col
    hint = lambda kind, value, scope, u, s, p: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(scope).alias("scope"), F.lit(u).alias("uniqueness"), F.lit(s).alias("stability"), G.clamp01(p).alias("confidence")).cast(HINT)
    attr = lambda a: F.element_at("attributes", a)
    found = [F.when(attr(a) != "", hint(kind, attr(a), scope, u, s, c("confidence"))) for a, kind, scope, u, s in S.ATTRIBUTE_HINTS]
    found.append(F.when(c("role").isNotNull() & c("name").isNotNull(), hint("role_name", F.concat_ws(":", "frame_id", "role.value", "name.value"), "route_version", 0.85, 0.8, F.least("role.confidence", "name.confidence"))))
    found.append(F.when(c("text.value") != "", hint("text", F.concat(F.lit("sha256:"), F.substring(F.sha2("text_quoted", 256), 1, 32)), "route_version", 0.55, 0.5, c("text.confidence"))))
    found.append(hint("structural_path", F.concat_ws("/", "frame_id", F.coalesce("parent_node_id", F.lit("root")), "node_id"), "route_version", 0.9, 0.6, c("confidence")))
    found.append(F.when(c("geometry").isNotNull(), hint("geometry", F.concat(c("frame_id"), F.lit(":"), "rect_text"), "capture_session", 0.25, 0.2, c("confidence"))))
    return F.array_compact(F.array(*found))


def _states(state: Column) -> Column:
    """Accessibility states as JSON scalars; text that is no JSON scalar is a string."""
    return F.transform_values(F.coalesce(state, F.create_map().cast("map<string,string>")), lambda k, v: F.when(v.rlike(r'^(true|false|null|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|".*")$'), F.coalesce(F.try_parse_json(v), v.cast("variant"))).otherwise(v.cast("variant")))


def _identity(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """capture_id, candidate_id, identity: a hash chained from the top of the hierarchy down, folded along each node's path.

    The text of a link is canonical JSON of frame, kind, the identity above and the sorted sources of the evidence.
    """
    link = F.array_sort(F.transform("evidence", lambda e: F.concat(e["source_type"], F.lit(":"), F.coalesce(e["source_id"], e["artifact_ref"], F.lit("unknown")))))
    # the identity above stands between two parts that only the node itself decides
    own = nodes.select("capture_id", "candidate_id", canonical_json(F.to_json(F.struct(F.col("frame_id").alias("frameKey"), "kind"))).alias("head"), canonical_json(F.to_json(F.struct(link.alias("preferredSourceLinkage")))).alias("tail"))
    own = own.select("capture_id", "candidate_id", F.struct(F.expr("substring(head, 1, length(head) - 1)").alias("head"), F.expr("substring(tail, 2)").alias("tail")).alias("own"))
    hashed = lambda above, o: F.substring(F.sha2(F.concat(o["head"], F.lit(',"normalizedAncestorIdentity":"'), above, F.lit('",'), o["tail"]), 256), 1, 16)
    up = paths.select("capture_id", "node_id", F.posexplode("path").alias("d", "at"))
    up = up.join(own.select("capture_id", F.col("candidate_id").alias("at"), "own"), ["capture_id", "at"]).groupBy("capture_id", F.col("node_id").alias("candidate_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "own"))).alias("up"))
    both = own.join(up, ["capture_id", "candidate_id"], "left")
    above = F.aggregate(F.coalesce("up", F.array().cast(up.schema["up"].dataType)), F.lit("root"), lambda a, x: hashed(a, x["own"]))
    return both.select("capture_id", "candidate_id", hashed(above, F.col("own")).alias("identity"))


def build_snapshots(captures: DataFrame, dom: DataFrame, ax: DataFrame, runs: DataFrame, derived: DataFrame, screenshots: DataFrame | None = None, profile: Profile | None = None, options: BuildOptions = BuildOptions(), input_hash: DataFrame | None = None) -> Snapshots:
    """Sealed snapshots of all captures that validate; a capture with any issue gives none (see ``issues``).

    ``input_hash`` (capture_id, input_hash) comes with captures that were read from JSON. Without it, the hash is one over
    the rows of the capture in any order. Null keys are left out, repeated deliveries count once, empty tables give no
    snapshots, and a capture without shown elements has its document for a node.
    """
    if bad := options.issues():
        raise RequestError(bad)
    spark = captures.sparkSession
    ship_package(spark)
    mode, authoritative = options.use_mode, False
    if profile is not None:
        mode, wrong = profile_issues({"projection_schema_version": profile.projection_schema_version, "state": profile.state, "use_mode": profile.use_mode}, options.use_mode)
        if wrong:
            raise RequestError(wrong)
        authoritative = may_be_authoritative({"state": profile.state}, mode)
    issues = cut(V.all_issues(captures, dom, ax, runs, derived, screenshots))
    caps = cut(rows_of(captures, "capture_id").join(issues.select("capture_id").distinct(), "capture_id", "left_anti"))
    dom, ax, runs, derived = (rows_of(t).join(issues.select("capture_id").distinct(), "capture_id", "left_anti") for t in (dom, ax, runs, derived))
    hidden = options.include_hidden_explanatory_nodes
    fused = cut(entities(observations(dom, ax, runs, caps, derived, hidden), caps))
    all_boxes = cut(boxes(fused, "document_rect"))
    parents = cut(R.containment_parent(all_boxes))
    kept = R.node_cap(all_boxes, parents, options.max_nodes, options.repeated_region_threshold).select("capture_id", F.col("node_id").alias("candidate_id"))
    sizes = fused.groupBy("capture_id").agg(F.count("*").alias("all"))
    nodes = cut(fused.join(kept, ["capture_id", "candidate_id"], "left_semi"))
    on = lambda df, *names: df.join(kept.withColumnRenamed("candidate_id", names[0]), ["capture_id", names[0]], "left_semi")
    flat = cut(boxes(nodes, "viewport_rect"))
    up = cut(on(parents, "node_id"))
    all_paths = cut(R.paths(parents))
    closure = R.closure_of(all_paths)
    # whole subtrees are left out, so the path of a kept node has kept nodes only
    paths = on(all_paths, "node_id")
    # regions are told from all nodes, then hold the kept ones
    members = cut(on(R.region_members(all_boxes, parents, options.repeated_region_threshold, closure), "node_id"))
    edges = cut(R.edge_cap(R.relations(flat, up, members), options.max_persisted_edges_per_node))

    slug = F.substring(F.regexp_replace("frame_id", "[^a-zA-Z0-9_-]", "_"), 1, 20)
    slug = F.when(slug == "", F.lit(hashlib.sha256(b'""').hexdigest()[:8])).otherwise(slug)
    ids = cut(_identity(nodes, paths).join(nodes.select("capture_id", "candidate_id", slug.alias("slug")), ["capture_id", "candidate_id"]).select("capture_id", "candidate_id", F.concat(F.lit("n_"), "slug", F.lit("_"), F.substring("candidate_id", 6, 20), F.lit("_"), "identity").alias("node_id")))
    as_id = lambda df, old, new: df.join(ids.select("capture_id", F.col("candidate_id").alias(old), F.col("node_id").alias(new)), ["capture_id", old])

    regions = cut(_regions(all_boxes, parents, closure, fused, members, options, ids))
    node_regions = regions.select("capture_id", "region_id", F.explode("member_node_ids").alias("node_id")).groupBy("capture_id", "node_id").agg(F.array_sort(F.collect_list("region_id")).alias("region_ids"))
    edge_rows = _edges(edges, nodes, as_id)
    node_rows = cut(_nodes(nodes, up, ids, as_id, node_regions, dom, ax, caps, profile, authoritative, spark))
    warn = _warnings(fused, sizes, nodes, caps, screenshots, options)
    head = _headers(caps, dom, ax, fused, nodes, node_rows, edge_rows, regions, profile, mode, options, derived, input_hash)
    spaces = _spaces(caps, dom, runs, screenshots)

    piece = lambda df, section, key, text: df.select("capture_id", F.lit(section).alias("section"), key.alias("key"), text.alias("text"), F.lit(None).cast("string").alias("tail"))
    pieces = piece(head, "build", F.lit(""), F.col("build")).unionByName(piece(head, "source", F.lit(""), F.col("source"))).unionByName(piece(head, "metrics", F.lit(""), F.col("metrics"))).unionByName(piece(head, "schemaVersion", F.lit(""), F.lit(f'"{SCHEMA_VERSION}"')))
    if profile is not None:
        pieces = pieces.unionByName(piece(head, "dnaProjection", F.lit(""), F.col("projection")))
    for section, df, key in (("coordinateSpaces", spaces, "space_id"), ("edges", edge_rows, "edge_id"), ("regions", regions, "region_id"), ("warnings", warn, "key")):
        pieces = pieces.unionByName(piece(caps, section, F.lit(None).cast("string"), F.lit(None).cast("string"))).unionByName(piece(df, section, F.col(key), F.col("json")))
    pieces = pieces.unionByName(piece(caps, "nodes", F.lit(None).cast("string"), F.lit(None).cast("string"))).unionByName(node_rows.select("capture_id", F.lit("nodes").alias("section"), F.col("node_id").alias("key"), F.col("json_head").alias("text"), F.col("json_tail").alias("tail")))
    sealed, refs, pieces = seal_pieces(cut(pieces))
    named = lambda df: df.join(small(sealed.select("capture_id", "snapshot_id")), "capture_id")
    nodes_out = named(node_rows.join(refs, ["capture_id", "node_id"]))
    headers = sealed.join(head, "capture_id")
    return Snapshots(headers, nodes_out, named(edge_rows), named(regions), named(spaces), named(warn), pieces, issues)


def _regions(all_boxes, parents, closure, fused, members, options, ids) -> DataFrame:
    """region_id, root_node_id, kind, label, member_node_ids, counts and JSON of the regions whose root was kept."""
    own = fused.select("capture_id", F.col("candidate_id"), F.col("name.value").alias("name"), "evidence", "confidence")
    named = R.promoted_regions(all_boxes, parents, closure).select("capture_id", F.concat(F.lit("role:"), "root_id").alias("region"), F.col("root_id").alias("root"), F.col("root_id").alias("from"), F.col("region_kind").alias("kind"), F.col("item_count").cast("bigint").alias("item_count"), F.lit(None).cast("bigint").alias("visible_item_count"), F.lit(None).cast("string").alias("pattern_hash"))
    rep = R.repeated_regions(all_boxes, parents, options.repeated_region_threshold).select("capture_id", F.concat(F.lit("rep:"), F.coalesce("parent_id", F.lit("root")), F.lit(":"), "signature").alias("region"), F.coalesce("parent_id", "first_id").alias("root"), F.col("first_id").alias("from"), F.lit("repeated").alias("kind"), "item_count", "visible_item_count", "pattern_hash")
    held = members.join(ids.select("capture_id", F.col("candidate_id").alias("node_id"), F.col("node_id").alias("m")), ["capture_id", "node_id"]).groupBy("capture_id", "region").agg(F.array_sort(F.collect_list("m")).alias("member_node_ids"))
    r = named.unionByName(rep).join(held, ["capture_id", "region"], "left").join(ids.select("capture_id", F.col("candidate_id").alias("root"), F.col("node_id").alias("root_node_id")), ["capture_id", "root"])
    r = r.join(own.withColumnRenamed("candidate_id", "from"), ["capture_id", "from"]).withColumn("member_node_ids", F.coalesce("member_node_ids", F.array().cast("array<string>")))
    quoted = F.concat(F.lit('"'), F.array_join("member_node_ids", '","'), F.lit('"'))
    body = F.concat(F.lit('{"kind":"'), "kind", F.lit('","memberNodeIds":['), F.when(F.size("member_node_ids") > 0, quoted).otherwise(""), F.lit('],"rootNodeId":"'), "root_node_id", F.lit('"}'))
    r = r.withColumn("region_id", F.concat(F.lit("r_"), F.substring(F.sha2(body, 256), 1, 16))).withColumn("label", F.when(F.col("kind") != "repeated", F.col("name")))
    summary = F.struct(F.col("item_count").alias("itemCount"), F.col("visible_item_count").alias("visibleItemCount"), F.col("pattern_hash").alias("repeatedPatternHash"))
    json = F.to_json(F.struct(F.col("region_id").alias("regionId"), F.col("root_node_id").alias("rootNodeId"), "kind", "label", F.col("member_node_ids").alias("memberNodeIds"), summary.alias("summary"), _evidence_json(F.col("evidence"), F.concat(F.lit("region:"), F.col("kind"))).alias("evidence"), "confidence"))
    return r.select("capture_id", "region_id", "root_node_id", "kind", "label", "member_node_ids", "item_count", "visible_item_count", "pattern_hash", "confidence", canonical_json(json).alias("json"))


def _edges(edges: DataFrame, nodes: DataFrame, as_id) -> DataFrame:
    """edge_id, kind, ends, weight and JSON of the kept edges. Their evidence is the first of the node that they come from."""
    e = as_id(as_id(edges, "from_id", "from_node_id"), "to_id", "to_node_id").withColumn("directed", F.col("kind").isin("contains", "reading_next"))
    body = F.concat(F.lit('{"directed":'), F.col("directed").cast("string"), F.lit(',"fromNodeId":"'), "from_node_id", F.lit('","kind":"'), "kind", F.lit('","toNodeId":"'), "to_node_id", F.lit('"}'))
    e = e.withColumn("edge_id", F.concat(F.lit("e_"), F.substring(F.sha2(body, 256), 1, 16)))
    e = e.join(nodes.select("capture_id", F.col("candidate_id").alias("from_id"), F.slice("evidence", 1, 1).alias("evidence")), ["capture_id", "from_id"])
    said = F.concat(F.lit("relation:"), F.col("kind"))
    evidence = F.transform(_evidence_json(F.col("evidence"), said), lambda x: x.withField("claims", F.array_distinct(F.concat(x["claims"], F.array(said)))))
    attributes = F.struct(F.when(F.col("kind") == "overlaps", F.round("weight", 3)).alias("iou"))
    json = F.to_json(F.struct(F.col("edge_id").alias("edgeId"), F.col("from_node_id").alias("fromNodeId"), F.col("to_node_id").alias("toNodeId"), "kind", "directed", "weight", attributes.alias("attributes"), evidence.alias("evidence")))
    return cut(e.select("capture_id", "edge_id", "kind", "from_node_id", "to_node_id", "directed", "weight", canonical_json(json).alias("json")))


def _nodes(nodes, up, ids, as_id, node_regions, dom, ax, caps, profile, authoritative, spark) -> DataFrame:
    """The published node of each entity: columns for other operators, and its JSON in two halves, between which the reference goes."""
    n = nodes.join(ids, ["capture_id", "candidate_id"]).join(up.select("capture_id", F.col("node_id").alias("candidate_id"), F.col("parent_id")), ["capture_id", "candidate_id"])
    n = n.join(ids.select("capture_id", F.col("candidate_id").alias("parent_id"), F.col("node_id").alias("parent_node_id")), ["capture_id", "parent_id"], "left").join(node_regions, ["capture_id", "node_id"], "left")
    source = lambda t: F.get(F.filter("evidence", lambda e: e["source_type"] == t), F.lit(0))["source_id"]
    n = n.withColumns({"dom_id": source("dom"), "ax_id": source("accessibility")})
    n = n.join(dom.select("capture_id", F.col("source_id").alias("dom_id"), "tag", "attributes", "paint_order", style_of(F.col("style_facts"), F.col("z_index")).alias("style")), ["capture_id", "dom_id"], "left")
    n = n.join(ax.select("capture_id", F.col("source_id").alias("ax_id"), "description", "state"), ["capture_id", "ax_id"], "left")
    n = n.join(small(caps.select("capture_id", "viewport", "route", F.col("redaction.redacted_source_ids").alias("redacted_ids"))), "capture_id")
    rect = F.col("geometry.viewport_rect")
    rect_json = canonical_json(F.when(rect.isNotNull(), F.to_json(F.array(rect["x"], rect["y"], rect["width"], rect["height"]))))
    n = n.withColumns({"rect_text": rect_json, "text_quoted": _quoted(F.col("text.value"))})
    n = n.withColumn("rect_text", F.expr("substring(rect_text, 2, length(rect_text) - 2)"))
    style_names = ("backgroundColor", "borderRadiusCssPx", "color", "display", "fontFamily", "fontSizeCssPx", "fontWeight", "lineHeightCssPx", "opacity", "position", "spacing", "zIndex")
    told = F.array_compact(F.array(*[F.when(F.col(f"style.{k}").isNotNull(), F.lit(f"style:{k}")) for k in style_names]))
    n = n.withColumn("kind_out", node_kind(F.col("role.value"), F.col("tag"), F.col("kind")))
    ev = _evidence_json(F.col("evidence"), F.lit("source_observation"))
    styled = F.struct(F.lit("computed_style").alias("sourceType"), F.col("dom_id").alias("sourceId"), F.lit(0.9).alias("confidence"), told.alias("claims"), *[F.lit(None).cast("string").alias(c) for c in ("coordinateSpaceId", "artifactRef", "provider", "providerVersion")])
    n = n.withColumn("evidence_out", F.when(F.col("dom_id").isNotNull() & (F.size(told) > 0), F.concat(ev, F.array(styled))).otherwise(ev))
    n = n.withColumn("redacted", F.coalesce(F.arrays_overlap(F.transform("evidence", lambda e: e["source_id"]), "redacted_ids"), F.lit(False)))
    n = n.withColumn("sensitivity", F.array(F.when(F.col("redacted"), "redacted").otherwise("tenant_private")))
    v = F.col("viewport")
    inside = lambda k: F.col(f"geometry.normalized_rect.{k}").between(0.0, 1.0)
    norm = F.when(inside("x") & inside("y") & inside("width") & inside("height"), F.col("geometry.normalized_rect"))
    geometry = F.struct(F.col("frame_id").alias("frameId"), F.coalesce("geometry.clipped", F.lit(False)).alias("clipped"), F.col("geometry.document_rect").alias("documentRect"), rect.alias("viewportRect"), G.visible_part(rect, v["width_css_px"], v["height_css_px"]).alias("visibleRect"), norm.alias("normalizedViewportRect"), F.col("paint_order").alias("paintOrder"))
    semantics = F.struct(_states(F.col("state")).alias("states"), F.col("role.value").alias("role"), F.col("name.value").alias("name"), "description", F.col("text.value").alias("text"))
    disabled = F.coalesce(F.element_at("state", "disabled") == "true", F.lit(False))
    verb = F.when((F.col("kind_out") == "control") & ~disabled, affordance(F.lower(F.col("role.value"))))
    if profile is None:
        matches = F.array().cast(f"array<{MATCH}>")
    else:
        colors = _token_colors(profile, spark)
        matches = F.when(F.col("style").isNotNull(), token_matches(F.col("style"), F.col("confidence"), F.col("route"), profile, authoritative, colors)).otherwise(F.array().cast(f"array<{MATCH}>"))
    n = n.withColumns({"affordances": F.array_compact(F.array(verb)), "dna_matches": matches, "locator_hints": _hints(), "geometry_out": geometry, "semantics": semantics, "regions_out": F.coalesce("region_ids", F.array().cast("array<string>")), "flags": F.array_sort("flags"), "confidence": G.clamp01(F.col("confidence"))})
    head = F.to_json(F.struct("affordances", "confidence", F.col("dna_matches").alias("dnaMatches")))
    tail = F.struct(F.col("evidence_out").alias("evidence"), "flags", F.col("geometry_out").alias("geometry"), F.col("kind_out").alias("kind"), F.col("locator_hints").alias("locatorHints"), F.col("node_id").alias("nodeId"), F.col("parent_node_id").alias("parentNodeId"), F.col("regions_out").alias("regionIds"), "semantics", "sensitivity", F.col("style"))
    # an element without DOM row has an empty style
    tail = F.when(F.col("style").isNotNull(), F.to_json(tail)).otherwise(F.regexp_replace(F.to_json(tail), r"\}$", ',"style":{}}'))
    return n.select(
        "capture_id", "node_id", "candidate_id", "parent_node_id", F.col("kind_out").alias("kind"), "frame_id", F.col("role.value").alias("role"), F.col("name.value").alias("name"), F.col("text.value").alias("text"), "geometry_out", "semantics", "style", "affordances", "dna_matches", "locator_hints",
        F.col("regions_out").alias("region_ids"), F.col("evidence_out").alias("evidence"), "sensitivity", "confidence", "flags", canonical_json(head).alias("json_head"), canonical_json(tail).alias("json_tail"),
    )


def _token_colors(profile: Profile, spark) -> dict[str, str | None]:
    rows = [(r, str(v)) for r, (v, c, _) in profile.tokens.items() if c == "color"]
    if not rows:
        return {}
    return {r[0]: r[1] for r in spark.createDataFrame(rows, "r string, v string").select("r", canonical_color(F.col("v"))).collect()}


def _warnings(fused, sizes, nodes, caps, screenshots, options) -> DataFrame:
    """key and JSON of each distinct warning, in the order of code and message."""
    row = lambda df, code, severity, message: df.select("capture_id", code.alias("code") if isinstance(code, Column) else F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message") if isinstance(message, Column) else F.lit(message).alias("message"))
    fact = F.explode(F.array_compact(F.transform(F.array(F.lit("role"), F.lit("name"), F.lit("text")), lambda f: F.when(F.array_contains("flags", F.concat(F.lit("conflict:"), f)), f))))
    out = row(fused.select("capture_id", "candidate_id", fact.alias("fact")), "source_conflict", "warning", F.concat(F.lit("sources disagree on "), "fact", F.lit(" for candidate "), "candidate_id"))
    lost = caps.select("capture_id", F.explode("frames").alias("f"), "frames")
    out = out.unionByName(row(lost.where(G.frame_cycle(F.col("frames"), F.col("f.frame_id"))), "invalid_transform", "warning", F.concat(F.lit("frame "), "f.frame_id", F.lit(" is part of a transform cycle; treating as root"))))
    out = out.unionByName(row(caps.where("not page_health.stable"), "capture_unstable", "warning", "capture did not reach visual quiescence")).unionByName(row(caps.where("page_health.partial"), "capture_partial", "warning", "capture is partial"))
    blind = caps if screenshots is None else caps.join(screenshots.select("capture_id").distinct(), "capture_id", "left_anti")
    out = out.unionByName(row(blind, "visual_evidence_unavailable", "info", "no screenshot evidence was supplied; structured graph remains available"))
    out = out.unionByName(row(caps.select("capture_id", F.explode("page_health.reasons").alias("r")), "page_health", "warning", F.col("r")))
    counts = sizes.join(nodes.groupBy("capture_id").agg(F.count("*").alias("kept")), "capture_id").where(F.col("all") > options.max_nodes)
    out = out.unionByName(row(counts, "node_cap_exceeded", "warning", F.concat((F.col("all") - F.col("kept")).cast("string"), F.lit(" nodes summarized by the configured node cap"))))
    over = counts.where(F.col("kept") > options.max_nodes)
    out = out.unionByName(row(over, "source_conflict", "warning", F.concat(F.lit("node count "), F.col("all").cast("string"), F.lit(f" exceeds maxNodes {options.max_nodes} even after summarizing repeated regions"))))
    return out.distinct().select("*", F.concat_ws("\x01", "code", "message", "severity").alias("key"), canonical_json(F.to_json(F.struct("code", "severity", "message"))).alias("json"))


def _headers(caps, dom, ax, fused, nodes, node_rows, edge_rows, regions, profile, mode, options, derived, input_hash) -> DataFrame:
    """JSON of build, source, metrics and token projection, and the figures in columns."""
    count = lambda df, name: df.groupBy("capture_id").agg(F.count("*").alias(name))
    interactive = F.lower(F.coalesce("role.value", F.lit(""))).isin(*S.INTERACTIVE_ROLES)
    visual, placed = F.col("kind") == "visual", F.col("geometry").isNotNull()
    m = nodes.groupBy("capture_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(visual).alias("n_visual"), F.count_if(placed).alias("n_placed"), F.count_if(placed & ~visual).alias("n_structured"), F.count_if(placed & visual).alias("n_parser"), F.count_if(interactive).alias("n_interactive"),
        F.count_if(interactive & F.exists("evidence", lambda e: e["source_type"] == "accessibility")).alias("n_accessible"), F.sum(F.size(F.filter("flags", lambda f: f.startswith("conflict:")))).alias("n_conflicts"),
    )
    degree = R.degrees(edge_rows.select("capture_id", F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id"))).groupBy("capture_id").agg(F.max("degree").alias("max_degree"))
    status = node_rows.select("capture_id", F.explode("dna_matches").alias("m")).groupBy("capture_id").agg(F.count_if("m.authoritative").alias("n_authoritative"), F.count_if(~F.col("m.authoritative")).alias("n_advisory"), F.count_if(F.col("m.status") == "drift").alias("n_drift"))
    providers = derived.where("kind is not null").select("capture_id", "obs_ord", "kind", "provider", F.col("provider_version").alias("providerVersion")).distinct().groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("kind", "provider", "providerVersion"))).alias("providers"))
    h = caps
    for df in (m, count(edge_rows, "n_edges"), count(regions, "n_regions"), degree, count(dom, "n_dom"), count(ax, "n_ax"), status, providers, _table_hash(caps, dom, ax, options, profile) if input_hash is None else input_hash):
        h = h.join(df, "capture_id", "left")
    h = h.na.fill(0, ["n_edges", "n_regions", "max_degree", "n_dom", "n_ax", "n_authoritative", "n_advisory", "n_drift"])
    ratio = lambda a, b, empty: F.when(F.col(b) == 0, F.lit(empty)).otherwise(F.try_divide(F.col(a), F.col(b)))
    metrics = F.struct(
        F.struct(F.col("n_dom").alias("domNodes"), F.col("n_ax").alias("accessibilityNodes"), F.col("n_visual").alias("visualCandidates")).alias("source"),
        F.struct(F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), F.col("n_regions").alias("regions"), F.col("max_degree").alias("maxDegree"), F.col("n_conflicts").alias("conflictCount")).alias("graph"),
        F.struct(ratio("n_structured", "n_placed", 0.0).alias("structuredVisibleAreaRatio"), ratio("n_parser", "n_placed", 0.0).alias("parserOnlyAreaRatio"), ratio("n_accessible", "n_interactive", 1.0).alias("accessibleInteractiveRatio")).alias("coverage"),
    )
    build = F.struct(F.lit(options.builder_version).alias("builderVersion"), F.lit(options.relation_policy_version).alias("relationPolicyVersion"), F.lit(options.dna_projection_version).alias("dnaProjectionVersion"), F.lit(options.redaction_policy_version).alias("redactionPolicyVersion"), F.col("input_hash").alias("deterministicInputHash"))
    v = F.col("viewport")
    view = F.struct(*[v[a].alias(b) for a, b in (("width_css_px", "widthCssPx"), ("height_css_px", "heightCssPx"), ("device_scale_factor", "deviceScaleFactor"), ("scroll_x_css_px", "scrollXCssPx"), ("scroll_y_css_px", "scrollYCssPx"))])
    dna = [] if profile is None else [F.lit(x).alias(k) for k, x in (("dnaVersion", profile.version), ("dnaProjectionSchemaVersion", profile.projection_schema_version), ("dnaContentDigest", profile.content_digest), ("dnaState", profile.state), ("dnaUseMode", mode))]
    source = F.struct(F.col("capture_id").alias("captureId"), F.col("schema_version").alias("captureSchemaVersion"), F.col("capture_version").alias("captureVersion"), F.struct(F.col("repo_owner").alias("owner"), F.col("repo_name").alias("name")).alias("repository"), "route", view.alias("viewport"), F.coalesce("providers", F.array().cast("array<struct<kind:string,provider:string,providerVersion:string>>")).alias("derivedProviders"), F.col("head_sha").alias("headSha"), *dna)
    counts = [F.col(a).alias(b) for a, b in (("n_authoritative", "authoritativeMatchCount"), ("n_advisory", "advisoryMatchCount"), ("n_drift", "driftCount"))]
    projection = F.lit(None).cast("string") if profile is None else F.to_json(F.struct(F.lit(profile.version).alias("dnaVersion"), F.lit(profile.projection_schema_version).alias("projectionSchemaVersion"), F.lit(profile.content_digest).alias("dnaContentDigest"), F.lit(profile.state).alias("state"), F.lit(mode).alias("useMode"), *counts))
    return cut(h.select("capture_id", "route", "viewport", "input_hash", "n_nodes", "n_edges", "n_regions", "max_degree", "n_conflicts", "n_authoritative", "n_advisory", "n_drift", canonical_json(F.to_json(build)).alias("build"), canonical_json(F.to_json(source)).alias("source"), canonical_json(F.to_json(metrics)).alias("metrics"), canonical_json(projection).alias("projection")))


def _table_hash(caps, dom, ax, options, profile) -> DataFrame:
    """capture_id, input_hash: sums of the hashes of a capture's rows, which come in any order, with options and profile."""
    total = None
    for name, df in (("captures", caps), ("dom_nodes", dom), ("ax_nodes", ax)):
        h = F.sha2(F.concat(F.lit(name), F.to_json(F.struct(*sorted(df.columns)))), 256)
        rows = df.select("capture_id", *[F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(4)])
        total = rows if total is None else total.unionByName(rows)
    fixed = sha256_text(canonical({"options": options.json(), **({"dna": profile.json()} if profile else {})}))
    return total.groupBy("capture_id").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)]).select("capture_id", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", F.lit(fixed), *[F.col(f"h{i}").cast("string") for i in range(4)]), 256)).alias("input_hash"))


def _spaces(caps, dom, runs, screenshots) -> DataFrame:
    """space_id and JSON of the coordinate spaces: document, viewport, normalized, one for each frame, one for each screenshot."""
    v = F.col("viewport")
    w, h = v["width_css_px"], v["height_css_px"]
    extent = normalize_dom(dom, caps).select("capture_id", "document_rect").unionByName(normalize_runs(runs, caps).select("capture_id", "document_rect")).groupBy("capture_id").agg(F.max(F.col("document_rect.x") + F.col("document_rect.width")).alias("right"), F.max(F.col("document_rect.y") + F.col("document_rect.height")).alias("bottom"))
    c = caps.select("capture_id", "viewport", "frames").join(extent, "capture_id", "left")
    none = F.lit(None)
    space = lambda i, kind, a, b, t=none.cast("array<double>"), up=none.cast("string"): F.struct(i.alias("coordinateSpaceId"), F.lit(kind).alias("kind"), a.cast("double").alias("width"), b.cast("double").alias("height"), t.alias("transformToParent"), up.alias("parentCoordinateSpaceId"))
    fixed = F.array(space(F.lit("cs_document"), "document_css", F.greatest(w, F.col("right")), F.greatest(h, F.col("bottom"))), space(F.lit("cs_viewport"), "viewport_css", w, h), space(F.lit("cs_normalized"), "normalized", F.lit(1.0), F.lit(1.0)))
    frames = F.transform("frames", lambda f: space(F.concat(F.lit("cs_frame_"), f["frame_id"]), "frame_css", w, h, f["transform_to_parent"], F.coalesce(F.concat(F.lit("cs_frame_"), f["parent_frame_id"]), F.lit("cs_document"))))
    out = c.select("capture_id", F.explode(F.concat(fixed, F.coalesce(frames, F.array().cast("array<struct<coordinateSpaceId:string,kind:string,width:double,height:double,transformToParent:array<double>,parentCoordinateSpaceId:string>>")))).alias("s"))
    if screenshots is not None:
        s = screenshots.join(caps.select("capture_id"), "capture_id", "left_semi")
        out = out.unionByName(s.select("capture_id", space(F.concat(F.lit("cs_image_"), "frame_id", F.lit("_"), F.col("ord").cast("string")), "image_px", F.col("width_image_px"), F.col("height_image_px"), none.cast("array<double>"), F.concat(F.lit("cs_frame_"), "frame_id")).alias("s")))
    return out.select("capture_id", F.col("s.coordinateSpaceId").alias("space_id"), F.col("s.kind").alias("kind"), F.col("s.width").alias("width"), F.col("s.height").alias("height"), canonical_json(F.to_json("s")).alias("json"))


ARRAYS = ("coordinateSpaces", "edges", "nodes", "regions", "warnings")


class _Stream:
    """The canonical JSON of a snapshot, fed piece by piece in order, as a digest."""

    def __init__(self, scope: str | None):
        self.hash, self.scope, self.section, self.count, self.bytes, self.items = hashlib.sha256(), scope, None, 0, 0, 0
        self._put("{")

    def _put(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        self.bytes += len(raw)
        self.hash.update(raw)

    def add(self, section: str, key: str | None, text: str | None, tail: str | None) -> int | None:
        """Ordinal of a node, None for anything else."""
        if section != self.section:
            self._put(("]," if self.section in ARRAYS else "," if self.section else "") + f'"{section}":' + ("[" if section in ARRAYS else ""))
            self.section, self.items = section, 0
        if text is None:
            return None  # the mark of an array, which may be empty
        at = self.items
        if section in ARRAYS:
            self._put("," if at else "")
        self.items += 1
        if tail is None:
            self._put(text)
            return None
        ref = f'"elementRef":"ug:{self.scope}:{at}"' if self.scope else ""
        self._put("{" + ",".join(x for x in (text[1:-1], ref, tail[1:-1]) if x) + "}")
        return at

    def end(self) -> str:
        self._put(("]" if self.section in ARRAYS else "") + "}")
        return self.hash.hexdigest()


def seal_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, references, pieces): scope digest, content hash, snapshot id and size of each capture's snapshot; the reference of each node.

    ``pieces`` (capture_id, section, key, text, tail) are the parts of the snapshots' canonical JSON: the sections'
    items by their ids. They are read in order twice, since references hold the digest of the snapshot without them; a
    task holds one digest, whatever the size of a snapshot.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    n = default_parallelism(spark)
    ordered = lambda df: df.repartition(n, "capture_id").sortWithinPartitions("capture_id", "section", F.col("key").asc_nulls_first())

    def run(with_refs: bool):
        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at: str | None = None
            stream: _Stream | None = None
            out: list[tuple] = []
            for pdf in parts:
                scopes = pdf["scope"] if with_refs else [None] * len(pdf)
                for c, section, key, text, tail, scope in zip(pdf["capture_id"], pdf["section"], pdf["key"], pdf["text"], pdf["tail"], scopes):
                    if c != at:
                        if stream is not None:
                            out.append((at, None, stream.end(), stream.bytes))
                        at, stream = c, _Stream(scope)
                    i = stream.add(section, key if isinstance(key, str) else None, text if isinstance(text, str) else None, tail if isinstance(tail, str) else None)
                    if i is not None and with_refs:
                        out.append((c, key, f"ug:{scope}:{i}", i))
                yield pd.DataFrame(out, columns=["capture_id", "node_id", "value", "n"])
                out = []
            if stream is not None:
                out.append((at, None, stream.end(), stream.bytes))
            yield pd.DataFrame(out, columns=["capture_id", "node_id", "value", "n"])

        return scan

    shape = "capture_id string, node_id string, value string, n bigint"
    scope = cut(ordered(pieces).mapInPandas(run(False), shape).select("capture_id", F.substring("value", 1, 8).alias("scope"), F.concat(F.lit("sha256:"), "value").alias("scope_digest")))
    final = cut(ordered(pieces.join(small_rows(scope.select("capture_id", "scope")), "capture_id")).mapInPandas(run(True), shape))
    heads = final.where("node_id is null").select("capture_id", F.concat(F.lit("sha256:"), "value").alias("content_hash"), F.concat(F.lit(f"ugs_{SCHEMA_VERSION.split('.')[0]}_"), "value").alias("snapshot_id"), F.col("n").alias("content_bytes"))
    refs = final.where("node_id is not null").select("capture_id", "node_id", F.col("value").alias("element_ref"), F.col("n").cast("int").alias("ref_ordinal"))
    return heads.join(scope.select("capture_id", "scope_digest"), "capture_id"), refs, pieces
