"""Views of sealed snapshots: a request of one of six kinds, answered for every snapshot within its budgets.

The plan picks, for each snapshot, the rows that a budget can show at most (so what is gathered of a snapshot is bounded
by the request, not by the page), and a vectorized function writes the text, halving the node budget until it fits.
What a view lists whole by contract are only ids: excepted findings, and the added, removed and ambiguous of a diff.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow import schemas as S
from paneflow.functions.canonical import canonical, sha256_text
from paneflow.functions.text import UNTRUSTED_CLOSE, UNTRUSTED_OPEN, UNTRUSTED_REMOVED
from paneflow.operators import identity as I
from paneflow.operators import structure as R
from paneflow.operators.assemble import Snapshots
from paneflow.operators.requests import RequestError, ViewSpec, require_valid, spec_hash, view_id
from paneflow.operators.views import reach
from paneflow.session import cut, ship_package, small

POLICY = "views@2"
#: Members listed of a region in a summary, durable hints of an element in a repair context (fixed values).
REGION_MEMBERS, HINTS = 24, 8
_CONTROL = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 127])


def clean(text: str) -> str:
    """Untrusted text without the marks around it and without control characters."""
    return text.replace(UNTRUSTED_OPEN, UNTRUSTED_REMOVED).replace(UNTRUSTED_CLOSE, UNTRUSTED_REMOVED).translate(_CONTROL)


def _round(x: float, digits: int) -> float:
    k = 10.0**digits
    return (x * k + 0.5) // 1 / k + 0.0


def _withheld(node: dict) -> bool:
    return any(x in S.WITHHELD for x in node["sensitivity"])


def _visibility(node: dict) -> str:
    g = node["geometry"]
    return "hidden" if "viewportRect" not in g else "offscreen" if "visibleRect" not in g else "clipped" if g["clipped"] else "visible"


def _said(node: dict) -> dict:
    """role, name and text of a node as views may show them."""
    shown = ("role",) if _withheld(node) else ("role", "name", "text")
    return {k: node["semantics"][k] for k in shown if k in node["semantics"]}


def _flags(node: dict) -> list[str]:
    return sorted([*node["flags"], *(["withheld:sensitive"] if _withheld(node) else [])])


def prompt_node(row: dict) -> dict:
    """A node as a prompt sees it: its place in the tree, what it says, where it is, and where its sources disagree."""
    node, said, g = row["node"], _said(row["node"]), row["node"]["geometry"]
    out = {"ref": node["elementRef"], "kind": node["kind"], "depth": row["depth"], **({"parent": row["parent"]} if row.get("parent") else {})}
    out |= {k: v if k == "role" else clean(v) for k, v in said.items()}
    if "viewportRect" in g:
        out["visibility"] = _visibility(node)
    if "normalizedViewportRect" in g:
        out["rect"] = {k: _round(v, 4) for k, v in g["normalizedViewportRect"].items()}
    conflicts = [k for k in ("role", "name", "text") if k in said and f"conflict:{k}" in node["flags"]]
    return {**out, **({"conflicts": conflicts} if conflicts else {}), **({"flags": _flags(node)} if _flags(node) else {})}


def prompt_region(r: dict, most: int | None = None) -> dict:
    members = sorted(r["members"])
    kept = members if most is None else members[:most]
    out = {"regionId": r["regionId"], "kind": r["kind"], "rootRef": r["root"], "memberCount": len(members), "memberRefs": kept}
    out |= {"label": clean(r["label"])} if r.get("label") is not None else {}
    out |= {"memberRefsTruncated": True} if len(kept) < len(members) else {}
    return out | {k: r[k] for k in ("itemCount", "visibleItemCount") if r.get(k) is not None}


def _rendered(text: str, refs: list[str], edges: list[str] = (), omitted: tuple[int, int, int] = (0, 0, 0), truncated: bool | None = None, empty: str | None = None) -> dict:
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2
    return {"text": text, "refs": list(refs), "edges": list(edges), "omitted": omitted, "truncated": omitted[0] > 0 or omitted[2] > 0 if truncated is None else truncated, "tokens": -(-units // 4), "empty": empty}


def _wrapped(body: dict) -> str:
    return f"{UNTRUSTED_OPEN}\n{canonical(body)}\n{UNTRUSTED_CLOSE}"


def render_focus(p: dict, k: int, max_edges: int) -> dict:
    if not p["asked"]:
        return _rendered("", [], empty="no ref resolved to a node in this snapshot; refusing to guess a neighborhood")
    rows = p["nodes"][:k]
    kept = {r["node"]["elementRef"] for r in rows}
    by_id = sorted(rows, key=lambda r: r["node"]["nodeId"])
    touching = [e for e in p["edges"] if e["from"] in kept or e["to"] in kept]
    inside = sorted((e for e in touching if e["from"] in kept and e["to"] in kept), key=lambda e: (e["from"], e["to"], e["kind"], e["id"]))
    edges = inside[:max_edges]
    named = {i for r in rows for i in r["node"]["regionIds"]}
    nodes = [prompt_node(r) for r in by_id]
    body = {"view": "focus", "policyVersion": POLICY, "refs": sorted(p["asked"]), "radius": p["radius"], "nodes": nodes, "regions": [prompt_region(r) for r in p["regions"] if r["regionId"] in named], "edges": [{x: e[x] for x in ("from", "to", "kind")} for e in edges]}
    gone = p["total"] - len(rows)
    return _rendered(_wrapped(body), [n["ref"] for n in nodes], [e["id"] for e in edges], (gone, len(touching) - len(edges), 0), gone > 0 or len(inside) > len(edges))


def render_summary(p: dict, k: int, max_edges: int) -> dict:
    acts, shallow, regions = p["affordances"][:k], p["outline"][:k], p["regions"][:k]
    listed = {r["node"]["elementRef"] for r in acts}
    order = lambda rows: [prompt_node(r) for r in sorted(rows, key=lambda r: r["node"]["nodeId"])]
    outline = order([r for r in shallow if r["node"]["elementRef"] not in listed])
    body = {"view": "summary", "policyVersion": POLICY, "regions": [prompt_region(r, REGION_MEMBERS) for r in regions], "outline": outline, "affordances": order(acts), "caveats": p["caveats"]}
    omitted = (p["n_affordances"] - len(acts) + p["n_outline"] - len(shallow), 0, p["n_regions"] - len(regions))
    return _rendered(_wrapped(body), sorted({*listed, *(n["ref"] for n in outline)}), (), omitted)


def render_action_map(p: dict, k: int, max_edges: int) -> dict:
    out = []
    for r in p["nodes"][:k]:
        node = r["node"]
        out.append({"ref": node["elementRef"], "role": node["semantics"]["role"], **({"name": _said(node)["name"]} if "name" in _said(node) else {}), "rect": node["geometry"]["normalizedViewportRect"], "state": {"visibility": _visibility(node), "clipped": node["geometry"]["clipped"], "flags": _flags(node)}})
    body = {"view": "actionMap", "policyVersion": POLICY, "snapshotId": p["snapshot_id"], "perceptionOnly": True, "actions": out}
    return _rendered(canonical(body), [x["ref"] for x in out], (), (p["total"] - len(out), 0, 0))


def patch_entry(node: dict) -> dict:
    """Facts for the repair of one element; of a withheld one its structure only."""
    g, hide = node["geometry"], _withheld(node)
    rect = g.get("normalizedViewportRect", g.get("viewportRect"))
    durable = sorted((h for h in node["locatorHints"] if h["scope"] != "capture_session"), key=lambda h: (-h["stability"], -h["uniqueness"], h["kind"]))
    family = next((m for m in node["dnaMatches"] if m["category"] == "component_family" and m["status"] != "unknown" and "canonical" in m), None)
    out = {"ref": node["elementRef"], **{k: v for k, v in _said(node).items() if k in ("role", "name")}, **({"rect": rect} if rect else {}), "sensitivity": sorted(node["sensitivity"]), "redacted": hide}
    if hide:
        return {**out, "selectorHints": [], "selectorHintsTruncated": False, "evidenceRefs": []}
    out |= {"style": node["style"]} if node["style"] else {}
    out |= {"componentFamilyCandidate": {"ref": str(family["canonical"]), "method": family["method"], "confidence": family["confidence"]}} if family else {}
    return {**out, "selectorHints": durable[:HINTS], "selectorHintsTruncated": len(durable) > HINTS, "evidenceRefs": sorted({e["artifactRef"] for e in node["evidence"] if "artifactRef" in e})}


def render_patch_context(p: dict, k: int, max_edges: int) -> dict:
    if not p["asked"]:
        return _rendered("", [], empty="patchContext requires at least one resolvable ref; refusing to guess repair context")
    rows = sorted(p["nodes"], key=lambda r: r["node"]["elementRef"])[:k]
    body = {"view": "patchContext", "policyVersion": POLICY, "advisory": True, "route": p["source"]["route"], "viewport": p["source"]["viewport"], "entries": [patch_entry(r["node"]) for r in rows]}
    return _rendered(canonical(body), [r["node"]["elementRef"] for r in rows], (), (p["total"] - len(rows), 0, 0))


def render_violations(p: dict, k: int, max_edges: int) -> dict:
    if not p["profile"]:
        return _rendered("", [], empty="no design profile projected onto this snapshot; refusing to claim drift without an authority")
    kept = p["findings"][:k]
    body = {"view": "violations", "policyVersion": POLICY, "authoritativeContext": p["authoritative"], "authoritative": kept if p["authoritative"] else [], "advisory": [] if p["authoritative"] else kept, "suppressed": p["suppressed"]}
    return _rendered(canonical(body), sorted({x["ref"] for x in kept}), (), (p["total"] - len(kept), 0, 0))


def render_diff(p: dict, k: int, max_edges: int) -> dict:
    kept = p["matched"][:k]
    body = {"view": "diff", "policyVersion": POLICY, "comparison": p["comparison"], "matched": kept, "added": p["added"], "removed": p["removed"], "ambiguous": p["ambiguous"], "abstainedCount": p["abstained"]}
    refs = sorted({*(x for e in kept for x in (e["baseRef"], e["targetRef"])), *p["added"], *p["removed"]})
    return _rendered(canonical(body), refs, (), (p["total"] - len(kept), 0, 0))


RENDER = {"focus": render_focus, "summary": render_summary, "actionMap": render_action_map, "patchContext": render_patch_context, "violations": render_violations, "diff": render_diff}


def within_budget(kind: str, payload: dict, spec: ViewSpec) -> tuple[dict, list[str]]:
    """The view at the largest of the halved node budgets whose text fits, and the reasons for what was cut."""
    k = spec.max_nodes
    view = RENDER[kind](payload, k, spec.max_edges)
    while view["tokens"] > spec.max_text_tokens and k > 1:
        k = max(1, k // 2)
        view = RENDER[kind](payload, k, spec.max_edges)
    reasons = [f"text_token_budget: node budget reduced {spec.max_nodes} → {k}"] if k < spec.max_nodes else []
    if view["tokens"] > spec.max_text_tokens:
        reasons.append(f"text_token_budget_exceeded: {view['tokens']} > {spec.max_text_tokens} at the minimum node budget")
    return view, reasons


def saliency_of(node: dict, width: float, height: float) -> float:
    w = S.SALIENCY_WEIGHTS.get(node["semantics"].get("role", ""), 0.3)
    clamp = lambda v: min(1.0, max(0.0, v))
    r = node["geometry"].get("viewportRect")
    if r is None:
        return clamp(0.1 + 0.1 * w)
    top, middle = clamp(1 - r["y"] / max(1.0, height)), clamp(1 - abs((r["x"] + r["width"] / 2) / max(1.0, width) - 0.5) * 2)
    large = clamp((max(0.0, r["width"] * r["height"]) / max(1.0, width * height)) ** 0.5)
    return _round(clamp(0.35 * top + 0.2 * middle + 0.25 * large + 0.2 * w), 6)


def plan_evidence(nodes: dict[str, dict], asked: list[str], artifact: str, width: float, height: float, most: int, padding: float = 24.0, full: float = 0.8, overlay: bool = False) -> tuple[list[dict], list[str]]:
    """(requests for crops, refusals) of elements by reference: the most salient first, then small ones, then by reference."""
    clip = lambda x, y, w, h: {"x": min(max(x, 0.0), width), "y": min(max(y, 0.0), height), "width": max(0.0, min(x + w, width) - min(max(x, 0.0), width)), "height": max(0.0, min(y + h, height) - min(max(y, 0.0), height))}
    refused, targets = [], []
    for ref in sorted(set(asked)):
        node = nodes.get(ref)
        r = node["geometry"].get("viewportRect") if node else None
        if r is None:
            refused.append((ref, "missing_geometry"))
            continue
        c = clip(r["x"], r["y"], r["width"], r["height"])
        if r["width"] <= 0 or r["height"] <= 0:
            refused.append((ref, "degenerate_geometry"))
        elif not c["width"] or not c["height"]:
            refused.append((ref, "outside_viewport"))
        else:
            types, score = [e["sourceType"] for e in node["evidence"]], saliency_of(node, width, height)
            reasons = ["requested_refs"] + (["small_or_dense_target"] if r["width"] * r["height"] < 1024 else [])
            reasons += ["parser_only_provenance"] if types and all(t == "vision_parser" for t in types) else []
            reasons += ["source_disagreement"] if any(f.startswith("conflict") for f in node["flags"]) or len(types) > 1 and node["confidence"] < 0.6 else []
            targets.append((-score, c["width"] * c["height"], ref, c, reasons + (["high_saliency"] if score >= 0.7 else [])))
    out = []
    for n, (_, _, ref, c, reasons) in enumerate(sorted(targets, key=lambda t: t[:3])[:most]):
        p = clip(c["x"] - padding, c["y"] - padding, c["width"] + 2 * padding, c["height"] + 2 * padding)
        whole = p["width"] * p["height"] / (width * height) > full
        body = {"kind": "full_screenshot" if whole else "crop", "sourceArtifactRef": artifact, "coordinateSpaceId": "viewport", "rect": {"x": 0, "y": 0, "width": width, "height": height} if whole else p, "candidateIds": [ref], "reasons": reasons, "priority": n, "saliencyProvider": "heuristic"}
        name = lambda b: "uge_" + sha256_text(canonical(b))[7:23]
        shown = lambda b: {"requestId": name(b), **{k: b[k] for k in ("kind", "sourceArtifactRef", "coordinateSpaceId", "priority")}, **({} if b["kind"] == "full_screenshot" else {"rect": b["rect"]}), "elementRefs": b["candidateIds"], "reason": ",".join(b["reasons"])}
        out.append(shown(body))
        if overlay and not whole:
            out.append(shown({**body, "kind": "marked_overlay", "unmarkedRequestId": name(body)}))
    return out, [f"evidence request refused for {r}: {why}" for r, why in sorted(refused)]


def answer(kind: str, payload: dict, spec: ViewSpec) -> dict:
    """The envelope of one view: identity, text, what it includes, evidence to ask for, budget, truncation, warnings."""
    view, reasons = within_budget(kind, payload, spec)
    nodes = {r["node"]["elementRef"]: r["node"] for part in ("nodes", "affordances", "outline") for r in payload.get(part, [])}
    requests, warnings = [], []
    if spec.max_crops > 0 and spec.screenshot is None:
        warnings = ["no screenshotArtifactRef supplied; a sealed snapshot carries no screenshot pointer, so no evidence requests were planned"]
    elif spec.max_crops > 0:
        v = payload["source"]["viewport"]
        requests, warnings = plan_evidence(nodes, list(spec.refs) or view["refs"], spec.screenshot, v["widthCssPx"], v["heightCssPx"], spec.max_crops)
    n, e, r = view["omitted"]
    cut_ = [f"{what}_budget: {k} {what}s omitted" for what, k in (("node", n), ("edge", e), ("region", r)) if k > 0]
    own = {x["ref"]: x["id"] for x in payload["ids"]}
    included = sorted({own[x] for x in view["refs"] if x in own})
    return {
        "schema_version": "1.0.0", "view_id": view_id(payload["content_hash"], spec), "spec_hash": spec_hash(spec), "text": view["text"], "included_node_ids": included, "included_edge_ids": sorted(set(view["edges"])), "evidence_requests": canonical(requests),
        "estimated_text_tokens": view["tokens"], "serialized_bytes": len(view["text"].encode("utf-8", "surrogatepass")), "truncated": view["truncated"] or bool(reasons), "reasons": [*reasons, *cut_], "omitted_nodes": n, "omitted_edges": e, "warnings": [*([view["empty"]] if view["empty"] else []), *warnings],
    }


ENVELOPE = "snapshot_id string, kind string, schema_version string, view_id string, spec_hash string, text string, included_node_ids array<string>, included_edge_ids array<string>, evidence_requests string, estimated_text_tokens int, serialized_bytes int, truncated boolean, reasons array<string>, omitted_nodes int, omitted_edges int, warnings array<string>"


def view_rows(s: Snapshots) -> DataFrame:
    """snapshot_id, node_id, ref, depth, parent, json, and what views choose by: role, visibility, normalized, region_ids."""
    n = s.nodes
    tree = n.select(F.col("snapshot_id").alias("capture_id"), "node_id", F.col("parent_node_id").alias("parent_id"))
    depth = R.paths(tree).select(F.col("capture_id").alias("snapshot_id"), "node_id", F.size("path").alias("depth"))
    up = n.select("snapshot_id", F.col("node_id").alias("parent_node_id"), F.col("element_ref").alias("parent"))
    body = F.concat(F.expr("substring(json_head, 1, length(json_head) - 1)"), F.lit(',"elementRef":"'), "element_ref", F.lit('",'), F.expr("substring(json_tail, 2)"))
    g = F.col("geometry_out")
    visible = F.when(g["viewportRect"].isNull(), "hidden").when(g["visibleRect"].isNull(), "offscreen").when(g["clipped"], "clipped").otherwise("visible")
    rows = n.join(up, ["snapshot_id", "parent_node_id"], "left").join(depth, ["snapshot_id", "node_id"])
    return cut(rows.select("snapshot_id", "node_id", F.col("element_ref").alias("ref"), "ref_ordinal", "depth", "parent", "role", visible.alias("visibility"), g["normalizedViewportRect"].isNotNull().alias("normalized"), "region_ids", body.alias("json")))


def _first(df: DataFrame, k: int, to: str, *order) -> DataFrame:
    """snapshot_id, ``to`` (the first k rows in order) and n_``to`` (their number)."""
    placed = df.withColumn("__r", F.row_number().over(W.partitionBy("snapshot_id").orderBy(*order)))
    rows = placed.where(F.col("__r") <= k).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("__r", "item"))).alias(to))
    return df.groupBy("snapshot_id").agg(F.count("*").alias(f"n_{to}")).join(rows.select("snapshot_id", F.transform(to, lambda x: x["item"]).alias(to)), "snapshot_id", "left")


def query_view(s: Snapshots, spec: ViewSpec, refs: DataFrame | None = None, target: Snapshots | None = None, pairs: DataFrame | None = None, radius: int = 2) -> DataFrame:
    """One view for each snapshot (columns of ``ENVELOPE``), by ``spec``; for a diff, one for each pair.

    ``refs`` (snapshot_id, ref) are the references that each snapshot is asked for. A reference that is no member of its
    snapshot refuses the whole request: it raises before anything is rendered. A diff compares with ``target`` by
    ``pairs`` (snapshot_id, target_snapshot_id). Snapshots with nothing to show give the empty view of their kind;
    no snapshots give no rows.
    """
    ask = ViewSpec(**{**spec.__dict__, "refs": spec.refs or (("ug:00000000:0",) if refs is not None else ())})
    diff = spec.kind == "diff"
    if diff and (target is None or pairs is None):
        raise RequestError(["comparison_snapshot_required"])
    require_valid(ask, (spec.comparison_snapshot_id, spec.comparison_content_hash) if diff else None)
    spark = s.nodes.sparkSession
    ship_package(spark)
    rows = view_rows(s)
    if refs is not None:
        lost = refs.join(rows.select("snapshot_id", "ref"), ["snapshot_id", "ref"], "left_anti").limit(1).collect()
        if lost:
            raise RequestError(["stale_or_foreign_ref"])
    k = spec.max_nodes
    item = F.struct(F.col("json").alias("node"), "depth", "parent")
    head = s.headers.select("snapshot_id", "content_hash", F.struct("route", "viewport").alias("source"))
    parts: dict[str, DataFrame] = {}
    if spec.kind == "focus":
        e = s.edges.select("snapshot_id", "edge_id", "kind", F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")).withColumn("capture_id", F.col("snapshot_id"))
        start = refs.join(rows.select("snapshot_id", "ref", "node_id"), ["snapshot_id", "ref"]).select(F.col("snapshot_id").alias("capture_id"), "node_id")
        near = cut(reach(e, start, radius).withColumnRenamed("capture_id", "snapshot_id").join(rows, ["snapshot_id", "node_id"]))
        top = cut(near.withColumn("__r", F.row_number().over(W.partitionBy("snapshot_id").orderBy("distance", "ref"))).where(F.col("__r") <= k))
        parts["nodes"] = _first(near.withColumn("item", item), k, "nodes", "distance", "ref")
        name = rows.select("snapshot_id", "node_id", "ref")
        ends = e.join(name.select("snapshot_id", F.col("node_id").alias("from_id"), F.col("ref").alias("a")), ["snapshot_id", "from_id"]).join(name.select("snapshot_id", F.col("node_id").alias("to_id"), F.col("ref").alias("b")), ["snapshot_id", "to_id"])
        touched = ends.join(top.select("snapshot_id", F.col("node_id").alias("from_id")), ["snapshot_id", "from_id"], "left_semi").unionByName(ends.join(top.select("snapshot_id", F.col("node_id").alias("to_id")), ["snapshot_id", "to_id"], "left_semi")).select("snapshot_id", "edge_id", "kind", "a", "b").distinct()
        parts["edges"] = touched.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct(F.col("edge_id").alias("id"), "kind", F.col("a").alias("from"), F.col("b").alias("to")))).alias("edges"))
        ids = top.select("snapshot_id", F.explode("region_ids").alias("region_id")).distinct()
        parts["regions"] = _regions(s, rows).join(ids, ["snapshot_id", "region_id"]).groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "item"))), lambda x: x["item"]).alias("regions"))
        parts["asked"] = refs.distinct().groupBy("snapshot_id").agg(F.array_sort(F.collect_list("ref")).alias("asked"))
    elif spec.kind == "summary":
        parts["affordances"] = _first(rows.where(F.col("role").isin(*S.AFFORDANCE_ROLES)).withColumn("item", item), k, "affordances", "ref")
        parts["outline"] = _first(rows.where("depth <= 2").withColumn("item", item), k, "outline", "depth", "ref")
        r = _regions(s, rows)
        parts["regions"] = _first(r, k, "regions", F.col("item.kind") == "repeated", F.desc(F.size("item.members")), "region_id")
        caveat = F.get_json_object("json", "$.severity"), F.get_json_object("json", "$.code"), F.get_json_object("json", "$.message")
        parts["caveats"] = s.warnings.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", *caveat))).alias("caveats"))
    elif spec.kind == "actionMap":
        parts["nodes"] = _first(rows.where(F.col("role").isin(*S.AFFORDANCE_ROLES) & F.col("visibility").isin("visible", "clipped") & F.col("normalized")).withColumn("item", item), k, "nodes", "ref")
    elif spec.kind == "patchContext":
        parts["nodes"] = _first(rows.join(refs.distinct(), ["snapshot_id", "ref"], "left_semi").withColumn("item", item), k, "nodes", "ref")
        parts["asked"] = refs.distinct().groupBy("snapshot_id").agg(F.array_sort(F.collect_list("ref")).alias("asked"))
    elif spec.kind == "violations":
        parts |= _violations(s, k)
        parts["ids"] = s.nodes.where(F.exists("dna_matches", lambda m: m["status"] == "drift")).groupBy("snapshot_id").agg(F.collect_list(F.struct(F.col("element_ref").alias("ref"), F.col("node_id").alias("id"))).alias("ids"))
        head = head.join(s.headers.select("snapshot_id", F.col("projection").isNotNull().alias("profile"), ((F.get_json_object("projection", "$.state") == "approved") & (F.get_json_object("projection", "$.useMode") == "production")).alias("authoritative")), "snapshot_id")
    else:
        parts |= _diff(s, target, pairs, k)
        told = pairs.join(s.headers.select("snapshot_id", "content_hash"), "snapshot_id").join(target.headers.select(F.col("snapshot_id").alias("target_snapshot_id"), F.col("content_hash").alias("target_hash")), "target_snapshot_id")
        head = head.join(told.select("snapshot_id", F.struct(F.col("snapshot_id").alias("baseSnapshotId"), F.col("content_hash").alias("baseContentHash"), F.col("target_snapshot_id").alias("targetSnapshotId"), F.col("target_hash").alias("targetContentHash")).alias("comparison")), "snapshot_id")
    out = head
    for df in parts.values():
        out = out.join(df, "snapshot_id", "left")
    fields = [c for c in out.columns if c != "snapshot_id"]
    payload = out.select("snapshot_id", F.to_json(F.struct("snapshot_id", *fields)).alias("payload"))
    kind, camel = spec.kind, {"width_css_px": "widthCssPx", "height_css_px": "heightCssPx", "device_scale_factor": "deviceScaleFactor", "scroll_x_css_px": "scrollXCssPx", "scroll_y_css_px": "scrollYCssPx"}

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for snapshot, text in zip(pdf["snapshot_id"], pdf["payload"]):
                p = json.loads(text)
                p["source"]["viewport"] = {camel[a]: b for a, b in p["source"]["viewport"].items()}
                for part in ("nodes", "affordances", "outline"):
                    p[part] = [{**r, "node": json.loads(r["node"])} for r in p.get(part) or []]
                for part in ("edges", "regions", "caveats", "asked", "findings", "suppressed", "matched", "added", "removed", "ambiguous"):
                    p[part] = p.get(part) or []
                if kind in ("violations", "diff"):
                    p |= {x: [json.loads(y) if isinstance(y, str) and y[:1] == "{" else y for y in p[x]] for x in ("findings", "suppressed", "matched")}
                p |= {"radius": radius, "total": p.get("n_nodes") or p.get("n_findings") or p.get("n_matched") or 0, "abstained": p.get("abstained") or 0, "profile": p.get("profile"), "authoritative": bool(p.get("authoritative"))}
                p |= {n: p.get(n) or 0 for n in ("n_affordances", "n_outline", "n_regions")}
                p["ids"] = p.get("ids") or [{"ref": r["node"]["elementRef"], "id": r["node"]["nodeId"]} for part in ("nodes", "affordances", "outline") for r in p[part]]
                own = ViewSpec(**{**spec.__dict__, "refs": tuple(p["asked"])})
                found.append({"snapshot_id": snapshot, "kind": kind, **answer(kind, p, own)})
            yield pd.DataFrame(found, columns=[c.split()[0] for c in ENVELOPE.split(", ")])

    return payload.mapInPandas(render, ENVELOPE)


def _regions(s: Snapshots, rows: DataFrame) -> DataFrame:
    """snapshot_id, region_id, item: regions in the terms of references. The label of a region whose root is withheld is left out."""
    name = rows.select("snapshot_id", "node_id", "ref")
    members = s.regions.select("snapshot_id", "region_id", F.explode("member_node_ids").alias("node_id")).join(name, ["snapshot_id", "node_id"]).groupBy("snapshot_id", "region_id").agg(F.array_sort(F.collect_list("ref")).alias("members"))
    hide = s.nodes.select("snapshot_id", F.col("node_id").alias("root_node_id"), F.arrays_overlap("sensitivity", F.array(*[F.lit(x) for x in S.WITHHELD])).alias("hide"))
    r = s.regions.join(members, ["snapshot_id", "region_id"], "left").join(name.select("snapshot_id", F.col("node_id").alias("root_node_id"), F.col("ref").alias("root")), ["snapshot_id", "root_node_id"]).join(hide, ["snapshot_id", "root_node_id"])
    item = F.struct(F.col("region_id").alias("regionId"), "kind", "root", F.when(~F.col("hide"), F.col("label")).alias("label"), F.coalesce("members", F.array().cast("array<string>")).alias("members"), F.col("item_count").alias("itemCount"), F.col("visible_item_count").alias("visibleItemCount"))
    return r.select("snapshot_id", "region_id", item.alias("item"))


def _violations(s: Snapshots, k: int) -> dict[str, DataFrame]:
    m = s.nodes.select("snapshot_id", F.col("element_ref").alias("ref"), F.explode("dna_matches").alias("m"))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m.confidence")))
    size = F.try_variant_get("m.canonical", "$", "double")
    off = F.when(size > 0, F.least(F.lit(1.0), F.col("m.delta") / size)).otherwise(1.0)
    severity = F.floor(F.when((F.col("m.category") == "scale") & F.col("m.delta").isNotNull() & F.col("m.canonical").isNotNull(), c * (0.5 + 0.5 * off)).otherwise(c) * 1e6 + 0.5) / 1e6
    need = F.when(F.col("m.category") == "scale", "computed length at the element confirms the off-scale value").otherwise("computed style + a rendered pixel sample at the element confirm the off-palette value")
    entry = F.to_json(F.struct("ref", "m.category", "m.observed", "m.canonical", "m.delta", "m.method", "m.confidence", "severity", need.alias("evidenceRequirement")))
    drift = m.where("m.status = 'drift'").withColumn("severity", severity).withColumn("item", entry)
    findings = _first(drift, k, "findings", F.desc("severity"), "ref", "m.category", F.to_json("m.observed"))
    hushed = m.where("m.status = 'excepted'").select("snapshot_id", F.struct("ref", "m.category", F.to_json(F.struct("ref", "m.category", "m.observed")).alias("j")).alias("x"))
    return {"findings": findings, "suppressed": hushed.groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]).alias("suppressed"))}


def _diff(s: Snapshots, target: Snapshots, pairs: DataFrame, k: int) -> dict[str, DataFrame]:
    link = pairs.select("snapshot_id", "target_snapshot_id", F.col("snapshot_id").alias("pair"))
    kinds = ("explicit_test_id", "stable_dom_id", "href_or_form_name")

    def side(snap: Snapshots, key: str) -> DataFrame:
        n = snap.nodes.withColumnRenamed("snapshot_id", key).join(small(link.select(key, "pair")), key)
        g = F.coalesce("geometry_out.normalizedViewportRect", "geometry_out.viewportRect")
        hints = F.transform(F.filter("locator_hints", lambda h: h["kind"].isin(*kinds)), lambda h: F.concat_ws(":", h["kind"], h["value"]))
        dna = F.array_sort(F.transform("dna_matches", lambda m: F.to_json(F.struct(m["category"], m["status"], m["canonical"]))))
        return cut(n.select("pair", "node_id", F.col("element_ref").alias("ref"), "role", "kind", "name", "text", F.col("region_ids").alias("regions"), hints.alias("hints"), g["x"].alias("x"), g["y"].alias("y"), g["width"].alias("w"), g["height"].alias("h"), F.to_json("style").alias("style"), F.to_json(dna).alias("dna")))

    b, t = side(s, "snapshot_id"), side(target, "target_snapshot_id")
    m = cut(I.lineage_match(cut(I.lineage_scores(b, t)), b))
    old, new = b.select("pair", F.col("node_id").alias("base_id"), F.struct("*").alias("a")), t.select("pair", F.col("node_id").alias("target_id"), F.struct("*").alias("z"))
    j = m.where("outcome = 'matched'").join(old, ["pair", "base_id"]).join(new, ["pair", "target_id"])
    differs = lambda *cs: sum(((~F.col(f"a.{c}").eqNullSafe(F.col(f"z.{c}"))).cast("int") for c in cs), F.lit(0)) > 0
    move = F.coalesce(F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"z.{c}")) for c in "xywh"]), F.lit(0.0))
    semantic, style, dna = differs("role", "name", "text"), differs("style"), differs("dna")
    change = F.when(semantic | style | dna | (move > 0.005), "product_change").when(move > 0, "capture_instability").otherwise("unchanged")
    entry = F.to_json(F.struct(F.col("a.ref").alias("baseRef"), F.col("z.ref").alias("targetRef"), "score", change.alias("changeKind"), F.struct(semantic.alias("semantic"), style.alias("style"), (move > 0).alias("geometry"), dna.alias("dna")).alias("changed")))
    matched = _first(j.select(F.col("pair").alias("snapshot_id"), entry.alias("item"), F.col("a.ref").alias("r")), k, "matched", "r")
    own = m.join(b.select("pair", F.col("node_id").alias("base_id"), "ref"), ["pair", "base_id"])
    listed = own.groupBy(F.col("pair").alias("snapshot_id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("ref")))).alias(o) for o in ("removed", "ambiguous")], F.count_if(F.col("outcome") == "abstained").alias("abstained"))
    added = t.join(m.where("outcome = 'matched'").select("pair", F.col("target_id").alias("node_id")), ["pair", "node_id"], "left_anti").groupBy(F.col("pair").alias("snapshot_id")).agg(F.array_sort(F.collect_list("ref")).alias("added"))
    ids = b.select("pair", "ref", F.col("node_id").alias("id")).groupBy(F.col("pair").alias("snapshot_id")).agg(F.collect_list(F.struct("ref", "id")).alias("ids"))
    return {"matched": matched, "listed": listed, "added": added, "ids": ids}
