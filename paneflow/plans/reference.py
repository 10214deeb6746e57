"""Queries of the capture operators over whole tables, and SQL that gives the same rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow import schemas as S
from paneflow.functions import text as X
from paneflow.operators import assemble as A
from paneflow.operators import design as D
from paneflow.operators import contracts as C
from paneflow.operators import evaluate as E
from paneflow.operators import identity as I
from paneflow.operators import observe as O
from paneflow.operators import query as QV
from paneflow.operators import requests as RQ
from paneflow.operators import structure as R
from paneflow.operators import validate as V
from paneflow.operators import views as Q
from paneflow.operators.snapshot_changes import snapshot_pairs
from paneflow.session import cut, small
from paneflow.sources.tables import latest, table


def _t(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [table(spark, root, n) for n in names]


def box_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The node table of the page elements: latest DOM rows with their rectangle in the viewport, whatever frame they are in."""
    n = O.normalize_dom(*_t(spark, root, "dom_nodes", "captures"))
    r = F.col("viewport_rect")
    return n.select("capture_id", F.col("source_id").alias("node_id"), "frame_id", *[(F.floor(r[k] * 1000 + 0.5) / 1000).alias(c) for c, k in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))], "role", F.col("tag").alias("kind"), "visibility")


r6 = lambda c: F.floor(c * 1e6 + 0.5) / 1e6


def normalize_geometry(spark, root):
    n = O.normalize_dom(*_t(spark, root, "dom_nodes", "captures"))
    flat = [r6(F.col(f"{r}.{k}")).alias(f"{a}_{k}") for r, a in (("document_rect", "doc"), ("viewport_rect", "view"), ("normalized_rect", "norm")) for k in ("x", "y", "width", "height")]
    return n.select("capture_id", "source_id", *flat, "visibility")


def css_color(spark, root):
    s = table(spark, root, "dom_nodes").select(F.explode("style_facts").alias("property", "fact")).where(F.col("property").rlike("(?i)colou?r")).select(F.col("fact.s").alias("original")).where("original is not null").distinct()
    return s.withColumn("canonical", X.canonical_color(F.col("original")))


def css_length(spark, root):
    return O.styles_of(table(spark, root, "dom_nodes")).where("not property rlike '(?i)colou?r'").select("capture_id", "source_id", "property", r6(F.col("value_css_px")).alias("value_css_px"))


def match_text(spark, root):
    return O.rows_of(table(spark, root, "text_runs")).select("capture_id", "source_id", X.match_text(F.col("text")).alias("match_text"))


def token_estimate(spark, root):
    return table(spark, root, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def patch_tokens(spark, root):
    c = O.rows_of(table(spark, root, "captures"), "capture_id")
    w, h = F.col("viewport.width_css_px"), F.col("viewport.height_css_px")
    return c.select("capture_id", X.patch_tokens(w, h, 16).alias("tokens_16"), X.patch_tokens(w, h, 28).alias("tokens_28"))


def sanitize_text(spark, root):
    return table(spark, root, "documents").select("doc_id", F.sha2(X.sanitize(F.col("text")), 256).alias("digest"))


def implicit_role(spark, root):
    return O.rows_of(table(spark, root, "dom_nodes")).select("capture_id", "source_id", O.implicit_role(F.col("tag"), F.col("attributes")).alias("implied"))


def durable_attributes(spark, root):
    d = O.rows_of(table(spark, root, "dom_nodes")).select("capture_id", "source_id", F.explode(O.durable_attributes(F.col("attributes"))).alias("attribute", "value"))
    return d


def url_identity(spark, root):
    f = O.rows_of(table(spark, root, "captures"), "capture_id").select("capture_id", F.explode("frames").alias("f"))
    return f.select("capture_id", "f.frame_id", X.url_identity(F.col("f.url")).alias("u")).select("capture_id", "frame_id", "u.route", "u.slug")


def text_back_references(spark, root):
    r = O.rows_of(table(spark, root, "text_runs")).where("dom_source_id is not null")
    return r.groupBy("capture_id", "dom_source_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"])).alias("text_source_ids"))


_SOURCES = ("dom_nodes", "ax_nodes", "text_runs", "captures", "derived_items")


def _observed(spark, root):
    return A.observations(*_t(spark, root, *_SOURCES))


def fuse_claims(spark, root):
    """What each entity is told by: sources, and claims of role, name and text that are not blank."""
    said = sum((F.count_if(F.trim(F.col(f"e.{f}")) != "") for f in ("name", "text")), F.count_if(F.trim(F.col("e.role")) != ""))
    return _observed(spark, root).groupBy("capture_id", "entity").agg(F.count_distinct("e.source_id").alias("sources"), said.alias("claims"))


def _entities(spark, root):
    caps = O.rows_of(table(spark, root, "captures"), "capture_id")
    return A.entities(_observed(spark, root), caps)


def fuse_facts(spark, root):
    facts = F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("v")) for f in ("role", "name", "text")]))
    e = _entities(spark, root).select("capture_id", "entity", facts.alias("f")).where("f.v is not null")
    return e.select("capture_id", "entity", "f.fact", "f.v.value", r6(F.col("f.v.confidence")).alias("confidence"), "f.v.conflict")


def fused_nodes(spark, root):
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["source_type"], e["source_id"])), ",")
    return _entities(spark, root).select("capture_id", "candidate_id", "entity", "kind", F.col("role.value").alias("role"), F.col("name.value").alias("name"), r6(F.col("confidence")).alias("confidence"), F.concat_ws(",", "flags").alias("flags"), evidence.alias("evidence"), F.col("geometry.visibility").alias("visibility"))


_BUILDS: dict[tuple[str, str], A.Snapshots] = {}


def _built(spark, root):
    """Snapshots of all captures, with the synthetic profile; the tables are checkpointed, so queries of one session share them.

    Some accessibility rows name themselves as their parent, which would refuse their captures: they are roots here.
    """
    key = (spark.sparkContext.applicationId, root)
    if key not in _BUILDS:
        _BUILDS[key] = _build(spark, root)
    return _BUILDS[key]


def _build(spark, root):
    profile = A.Profile("paneflow-dna@1", "sha256:" + "0" * 64, "approved", {r: (v if v is not None else n, c, 0.95) for r, c, v, n in S.DESIGN_TOKENS})
    caps, dom, ax, runs, derived = _t(spark, root, "captures", "dom_nodes", "ax_nodes", "text_runs", "derived_items")
    ax = ax.withColumn("parent_source_id", F.when(F.col("parent_source_id") != F.col("source_id"), F.col("parent_source_id")))
    return A.build_snapshots(caps, dom, ax, runs, derived, profile=profile)


def build_headers(spark, root):
    return _built(spark, root).headers.select("capture_id", "snapshot_id", "content_hash", "content_bytes", "n_nodes", "n_edges", "n_regions", "max_degree", "n_conflicts", "n_authoritative", "n_advisory", "n_drift")


def build_nodes(spark, root):
    return _built(spark, root).nodes.select("capture_id", "snapshot_id", "node_id", "element_ref", "parent_node_id", "kind", "role", "name", "text", "confidence", F.size("locator_hints").alias("n_hints"), F.size("dna_matches").alias("n_matches"), F.concat_ws(",", "affordances").alias("affordance"))


def build_edges(spark, root):
    return _built(spark, root).edges.select("capture_id", "edge_id", "kind", "from_node_id", "to_node_id", "directed", r6(F.col("weight")).alias("weight"))


def build_regions(spark, root):
    return _built(spark, root).regions.select("capture_id", "region_id", "kind", "root_node_id", "label", F.size("member_node_ids").alias("members"), "item_count", "visible_item_count")


def derived_best_match(spark, root):
    derived, dom, caps = _t(spark, root, "derived_items", "dom_nodes", "captures")
    return O.derived_best_match(derived, O.normalize_dom(dom, caps), caps).select("capture_id", "source_id", "dom_source_id", r6(F.col("iou")).alias("iou"))


def containment_parent(spark, root):
    return R.containment_parent(box_nodes(spark, root))


def _tree(spark, root):
    n = cut(box_nodes(spark, root))
    return n, cut(R.containment_parent(n))


def hierarchy_depth(spark, root):
    return R.depths(_tree(spark, root)[1]).select("capture_id", "node_id", "depth")


def descendants(spark, root):
    return R.ancestors(_tree(spark, root)[1]).groupBy("capture_id", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))


def region_promotion(spark, root):
    n, p = _tree(spark, root)
    # roles of all four kinds of regions are few on these pages: some of their own take their part here
    stand_in = F.create_map(*[F.lit(x) for kv in (("group", "list"), ("document", "main"), ("tab", "grid"), ("combobox", "form")) for x in kv])
    return R.promoted_regions(n.withColumn("role", F.coalesce(F.element_at(stand_in, F.col("role")), F.col("role"))), p)


def repeated_regions(spark, root):
    return R.repeated_regions(*_tree(spark, root))


def node_cap(spark, root):
    return R.node_cap(*_tree(spark, root), max_nodes=40)


def reading_next(spark, root):
    return R.reading_next(*_tree(spark, root))


def overlaps(spark, root):
    return R.overlaps(cut(box_nodes(spark, root))).withColumn("iou", r6(F.col("iou")))


def aligned(spark, root):
    n, p = _tree(spark, root)
    return R.aligned(n, R.region_members(n, p))


def near_knn(spark, root):
    return R.near_knn(cut(box_nodes(spark, root)))


def _graph(spark, root):
    n, p = _tree(spark, root)
    return n, p, R.relations(n, p)


def relation_counts(spark, root):
    return _graph(spark, root)[2].groupBy("capture_id", "kind").agg(F.count("*").alias("n"))


def edge_degree(spark, root):
    return R.degrees(_graph(spark, root)[2])


def edge_cap(spark, root):
    return R.edge_cap(_graph(spark, root)[2], 8)


def graph_metrics(spark, root):
    n, p, e = _graph(spark, root)
    return R.graph_metrics(n, e, p)


def node_identity(spark, root):
    """Identities chained along the hierarchy of the fused nodes."""
    e = cut(_entities(spark, root))
    p = R.containment_parent(cut(A.boxes(e, "document_rect")))
    return A._identity(e, R.paths(cut(p)))


def node_kind(spark, root):
    d = O.rows_of(table(spark, root, "dom_nodes"))
    return d.select("capture_id", "source_id", Q.node_kind(F.col("role"), F.col("tag"), F.lit("dom")).alias("node_kind"), Q.affordance(F.col("role")).alias("verb"))


def locator_hints(spark, root):
    d = O.rows_of(table(spark, root, "dom_nodes")).select("capture_id", F.col("source_id").alias("node_id"), "frame_id", F.col("parent_source_id").alias("parent_id"), "role", F.element_at("attributes", "aria-label").alias("name"), F.lit(None).cast("string").alias("text"), "attributes")
    return Q.locator_hints(d)


def _matches(spark, root, rules=None):
    return D.match_tokens(O.styles_of(table(spark, root, "dom_nodes")), D.design_tokens(spark), rules)


def token_match(spark, root):
    return _matches(spark, root).withColumn("delta", r6(F.col("delta")))


def token_summary(spark, root):
    return D.token_summary(_matches(spark, root), True)


def token_exceptions(spark, root):
    rules = spark.createDataFrame([(0, "spacing", "dom_5", "legacy"), (1, "radii", None, "rework")], "rule_ord int, category string, source_id string, reason string")
    return D.token_summary(_matches(spark, root, rules), False)


def violations(spark, root):
    return D.violations(_matches(spark, root), D.design_tokens(spark), budget=20).withColumn("delta", r6(F.col("delta")))


def saliency(spark, root):
    return D.saliency(box_nodes(spark, root))


def evidence_plan(spark, root):
    v = O.rows_of(table(spark, root, "captures"), "capture_id").select("capture_id", F.col("viewport.width_css_px").alias("view_w"), F.col("viewport.height_css_px").alias("view_h"))
    p = D.evidence_plan(box_nodes(spark, root), small(v))
    return p.withColumns({c: r6(F.col(c)) for c in ("x", "y", "w", "h")})


def _named(spark, root):
    return box_nodes(spark, root).join(O.rows_of(table(spark, root, "ax_nodes")).where("backend_dom_source_id is not null").groupBy("capture_id", F.col("backend_dom_source_id").alias("node_id")).agg(F.min("name").alias("name")), ["capture_id", "node_id"], "left")


def action_map(spark, root):
    return Q.action_map(_named(spark, root))


def summary_view(spark, root):
    n, p = _tree(spark, root)
    return Q.summary_view(n, R.depths(p))


def focus_view(spark, root):
    """Nodes around the checkboxes, over all kinds of edges."""
    n, p, e = _graph(spark, root)
    return Q.focus_view(e, n.where("role = 'checkbox'").select("capture_id", "node_id"))


def ax_outline(spark, root):
    return Q.ax_outline(table(spark, root, "ax_nodes"))


def view_budget(spark, root):
    a = _named(spark, root).where(F.col("role").isin(*S.AFFORDANCE_ROLES))
    rows = Q.top_k(a, 64, "node_id").select("capture_id", "rank", F.concat_ws(" ", "node_id", "role", X.sanitize(F.col("name"))).alias("text"))
    return Q.budget_of(rows, 120, 64)


def withheld_nodes(spark, root):
    n = latest(table(spark, root, "view_nodes").where("view_node_id is not null"), ["view_node_id"], "received_at")
    return Q.withheld(n).select("view_node_id", "name", "text", "withheld")


def sensitive_digest(spark, root):
    n = latest(table(spark, root, "view_nodes").where("view_node_id is not null"), ["view_node_id"], "received_at")
    return Q.sensitive_digest(n, "snapshot_ref")


_CONTENT = {"kind": "kind", "parent_node_id": "parentNodeId", "role": "role", "name": "name", "text": "text", "viewport_rect": "viewportRect", "color": "color", "font_size_css_px": "fontSizeCssPx", "flags": "flags"}


def _snapshot_rows(spark, root):
    n = table(spark, root, "snapshot_nodes").where("snapshot_id is not null and node_id is not null")
    return latest(n, ["snapshot_id", "node_id"], "received_at")


def seal_headers(spark, root):
    return I.seal_snapshots(_snapshot_rows(spark, root), "snapshot_id", "node_id", _CONTENT)[0]


def seal_refs(spark, root):
    return I.seal_snapshots(_snapshot_rows(spark, root), "snapshot_id", "node_id", _CONTENT)[1]


def _sides(spark, root):
    n = cut(_snapshot_rows(spark, root))
    pairs = cut(snapshot_pairs(table(spark, root, "graph_snapshots")).select("base_snapshot_id", "target_snapshot_id"))
    side = lambda c: n.join(small(pairs.select(F.col(c).alias("snapshot_id"), F.col("target_snapshot_id").alias("pair"))), "snapshot_id")
    return side("base_snapshot_id"), side("target_snapshot_id")


def _lineage_nodes(df):
    return df.select("pair", "node_id", F.col("element_ref").alias("ref"), "role", "kind", "name", F.col("parent_node_id").alias("region"), F.col("viewport_rect.x").alias("x"), F.col("viewport_rect.y").alias("y"), F.col("viewport_rect.width").alias("w"), F.col("viewport_rect.height").alias("h"))


def lineage_scores(spark, root):
    b, t = _sides(spark, root)
    return I.lineage_scores(_lineage_nodes(b), _lineage_nodes(t))


def lineage_match(spark, root):
    b, t = (_lineage_nodes(x) for x in _sides(spark, root))
    return I.lineage_match(cut(I.lineage_scores(b, t)), b)


_PLAIN = ["kind", "parent_node_id", "role", "name", "text", "color", "font_size_css_px"]


def delta_encode(spark, root):
    b, t = _sides(spark, root)
    return I.delta_encode(b.select("pair", "node_id", *_PLAIN), t.select("pair", "node_id", *_PLAIN), "node_id", _PLAIN).select("pair", "seq", "op", "node_id")


def delta_apply(spark, root):
    """The target rows, rebuilt from base and delta."""
    b, t = _sides(spark, root)
    ops = I.delta_encode(b.select("pair", "node_id", *_PLAIN), t.select("pair", "node_id", *_PLAIN), "node_id", _PLAIN)
    rows, _ = I.delta_apply(b, ops, "node_id", _PLAIN, ", ".join(f"{c} {'double' if c == 'font_size_css_px' else 'string'}" for c in _PLAIN))
    return rows


def diff_view(spark, root):
    b, t = _sides(spark, root)
    lb = _lineage_nodes(b)
    d = RQ.diff_view(b, t, matches=cut(I.lineage_match(cut(I.lineage_scores(lb, _lineage_nodes(t))), lb)))
    return d.withColumn("score", r6(F.col("score")))


def _faulty(spark, root):
    """The tables with faults that every rule should find: by place in the capture, so the same ones wherever they run."""
    caps, dom, ax, runs, derived = _t(spark, root, "captures", "dom_nodes", "ax_nodes", "text_runs", "derived_items")
    n = F.length("capture_id") + F.ascii(F.substring("capture_id", -1, 1))
    caps = caps.withColumns({"schema_version": F.when(n % 7 == 0, "2.0.0").otherwise(F.col("schema_version")), "route": F.when(n % 5 == 0, " ").otherwise(F.col("route")), "viewport": F.when(n % 6 == 0, F.col("viewport").withField("width_css_px", F.lit(0.0))).otherwise(F.col("viewport")), "redaction": F.when(n % 4 == 0, None).otherwise(F.col("redaction"))})
    wide = lambda c, when, v: F.when(when, F.col(c).withField("width", F.lit(v))).otherwise(F.col(c))
    dom = dom.withColumns({"bounds": wide("bounds", F.col("ord") % 50 == 7, -1.0)}).withColumn("bounds", wide("bounds", F.col("ord") % 50 == 8, 1e9))
    derived = derived.withColumns({"confidence": F.when(F.col("item_ord") == 1, 1.5).otherwise(F.col("confidence")), "provider": F.when(F.col("item_ord") == 2, "").otherwise(F.col("provider")), "source_id": F.when(F.col("item_ord") == 3, "dom_1").otherwise(F.col("source_id")), "source_image_ref": F.when(F.col("item_ord") == 4, "no ref").otherwise(F.col("source_image_ref"))})
    return caps, dom, ax, runs, derived


def issues(spark, root):
    """Issues of tables with injected faults."""
    caps, dom, ax, runs, derived = _faulty(spark, root)
    return V.capture_issues(caps).unionByName(V.geometry_issues(dom, runs)).unionByName(V.derived_issues(derived)).unionByName(V.duplicate_issues(dom, ax, runs, derived))


def issues_parent(spark, root):
    """Rows whose parent was taken away: every row 5 of its capture."""
    return V.parent_issues(table(spark, root, "dom_nodes").where("ord <> 5"))


def issues_cycle(spark, root):
    """Parents of a table with injected cycles: every row 13 of its capture hangs below row 14, and 14 below 13."""
    d = table(spark, root, "dom_nodes")
    p = F.when(F.col("ord") == 13, F.lit("dom_14")).when(F.col("ord") == 14, F.lit("dom_13")).otherwise(F.col("parent_source_id"))
    return V.cycle_issues(d.withColumn("parent_source_id", p))


def _measures(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.select(F.col("source").alias("cohort"), F.col("doc_id").alias("key"), F.octet_length("text").cast("double").alias("base"), F.octet_length(F.regexp_replace("text", r"\s+", " ")).cast("double").alias("candidate"))


def cohort_reduction(spark, root):
    return E.reduction(_measures(spark, root)).withColumn("reduction", r6(F.col("reduction")))


def bootstrap_ci(spark, root):
    """The reference's resampling: 2,000 replicates, seed 42."""
    b = E.bootstrap_exact(_measures(spark, root).withColumn("cohort", F.coalesce("cohort", F.lit("none"))))
    return b.withColumns({c: r6(F.col(c)) for c in ("point", "lower", "upper")})


def bootstrap_poisson(spark, root):
    """An extension: the cheaper interval by Poisson weights."""
    return E.bootstrap_cohorts(_measures(spark, root))


def resolve_refs(spark, root):
    """References of snapshot nodes as their rows claim them, against the sealed tables."""
    n = _snapshot_rows(spark, root)
    heads, refs = I.seal_snapshots(n, "snapshot_id", "node_id", _CONTENT)
    heads, refs = cut(heads), cut(refs)
    claims = n.select("snapshot_id", F.col("element_ref").alias("ref")).join(heads.select("snapshot_id", "content_hash"), "snapshot_id").unionByName(refs.join(heads, "snapshot_id").select("snapshot_id", F.col("sealed_ref").alias("ref"), "content_hash"))
    return C.resolve_refs(claims, heads, refs.withColumnRenamed("sealed_ref", "element_ref")).groupBy("snapshot_id", "resolution").agg(F.count("*").alias("n"))


_VIEW_BUDGET = dict(max_text_tokens=4000, max_nodes=64, max_edges=128)


def _view(spark, root, kind, refs=None):
    s = _built(spark, root)
    asked = s.nodes.where(refs).groupBy("snapshot_id").agg(F.min("element_ref").alias("ref")) if refs else None
    return QV.query_view(s, RQ.ViewSpec(kind, **_VIEW_BUDGET), asked).select("snapshot_id", "kind", "view_id", "estimated_text_tokens", "serialized_bytes", F.size("included_node_ids").alias("nodes"), F.size("included_edge_ids").alias("edges"), "truncated", F.concat_ws("; ", "reasons").alias("reasons"), F.sha2("text", 256).alias("text_digest"))


def query_summary(spark, root):
    return _view(spark, root, "summary")


def query_action_map(spark, root):
    return _view(spark, root, "actionMap")


def query_violations(spark, root):
    return _view(spark, root, "violations")


def query_patch_context(spark, root):
    return _view(spark, root, "patchContext", "role = 'button'")


def query_focus(spark, root):
    return _view(spark, root, "focus", "role = 'button'")


def mcnemar(spark, root):
    from paneflow.session import ship_package

    ship_package(spark)
    d = table(spark, root, "documents").where("source is not null")
    a, b = F.coalesce(F.col("accepted"), F.lit(False)), F.coalesce(F.col("votes") > 0, F.lit(False))
    c = d.groupBy("source").agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))
    p = E.mcnemar(F.col("a_only"), F.col("b_only"))
    return c.select("source", "a_only", "b_only", (F.floor(p * 1e6 + 0.5001) / 1e6).alias("p_value"))


def stability_probe(spark, root):
    """Digest of each capture's boxes in tenths of a px, in order of the rows."""
    n = box_nodes(spark, root).where("x is not null")
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5).cast("bigint").cast("string")
    h = F.conv(F.substring(F.sha2(F.concat_ws(",", "node_id", *[tenth(c) for c in ("x", "y", "w", "h")]), 256), 1, 12), 16, 10).cast("bigint")
    return n.groupBy("capture_id").agg(F.count("*").alias("boxes"), F.sum(h % 1_000_000_007).alias("digest"))


QUERIES = {f.__name__: f for f in (
    normalize_geometry, css_color, css_length, match_text, token_estimate, patch_tokens, sanitize_text, implicit_role, durable_attributes, url_identity, text_back_references,
    fuse_claims, fuse_facts, fused_nodes, build_headers, build_nodes, build_edges, build_regions, derived_best_match, containment_parent, hierarchy_depth, descendants, region_promotion, repeated_regions, node_cap, reading_next, overlaps, aligned, near_knn,
    relation_counts, edge_degree, edge_cap, graph_metrics, node_identity, node_kind, locator_hints, token_match, token_summary, token_exceptions, violations, saliency, evidence_plan, action_map, summary_view,
    focus_view, ax_outline, view_budget, withheld_nodes, sensitive_digest, seal_headers, seal_refs, lineage_scores, lineage_match, delta_encode, delta_apply, diff_view, issues, issues_parent, issues_cycle, cohort_reduction, bootstrap_ci, bootstrap_poisson, mcnemar, resolve_refs, query_summary, query_action_map, query_violations, query_patch_context, query_focus, stability_probe,
)}
