"""Captures as JSON bundles, one text for each: parted into the tables of observations, hashed as a build's input, and made up for tests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions.canonical import canonical, sha256_text

_RECT = "struct<x:double,y:double,width:double,height:double>"
_DOM = f"struct<sourceId:string,parentSourceId:string,frameId:string,role:string,tag:string,attributes:map<string,string>,bounds:{_RECT},visible:boolean,paintOrder:double,zIndex:variant,styleFacts:map<string,variant>,textSourceIds:array<string>>"
_AX = "struct<sourceId:string,parentSourceId:string,frameId:string,role:string,name:string,description:string,state:map<string,variant>,ignored:boolean,ignoredReasons:array<string>,backendDomSourceId:string>"
_RUN = f"struct<sourceId:string,frameId:string,text:string,domSourceId:string,bounds:{_RECT}>"
_ITEM = f"struct<sourceId:string,rectImagePx:{_RECT},class:string,text:string,confidence:double>"
#: What a build reads of a bundle; other fields are tolerated, and count in its hash.
BUNDLE = (
    "schemaVersion string, captureId string, captureVersion string, repository struct<owner:string,name:string>, route string, headSha string, viewport struct<widthCssPx:double,heightCssPx:double,deviceScaleFactor:double,scrollXCssPx:double,scrollYCssPx:double>, "
    f"documents array<struct<frameId:string,parentFrameId:string,url:string,transformToParent:array<double>,domLayoutNodes:array<{_DOM}>,accessibilityNodes:array<{_AX}>,textRuns:array<{_RUN}>>>, "
    "screenshotEvidence array<struct<artifactRef:string,frameId:string,widthImagePx:double,heightImagePx:double,deviceScaleFactor:double>>, "
    f"derivedObservations array<struct<kind:string,provider:string,providerVersion:string,sourceImageRef:string,elements:array<{_ITEM}>,runs:array<{_ITEM}>>>, "
    "pageHealth struct<stable:boolean,partial:boolean,reasons:array<string>>, redaction struct<policyVersion:string,applied:boolean,redactedSourceIds:array<string>>"
)


def tables_of(bundles: DataFrame, column: str = "bundle") -> dict[str, DataFrame]:
    """captures, dom_nodes, ax_nodes, text_runs, derived_items and screenshots of bundles; texts that are no bundle give no rows.

    ``ord`` counts through the documents of a capture in their order.
    """
    b = bundles.select(F.from_json(F.col(column), BUNDLE).alias("b")).where("b.captureId is not null").select("b.*")
    v = F.col("viewport")
    frames = F.transform("documents", lambda d: F.struct(d["frameId"].alias("frame_id"), d["parentFrameId"].alias("parent_frame_id"), d["url"].alias("url"), d["transformToParent"].alias("transform_to_parent")))
    captures = b.select(
        F.col("captureId").alias("capture_id"), F.col("schemaVersion").alias("schema_version"), F.col("captureVersion").alias("capture_version"), F.col("repository.owner").alias("repo_owner"), F.col("repository.name").alias("repo_name"), "route", F.col("headSha").alias("head_sha"),
        F.struct(v["widthCssPx"].alias("width_css_px"), v["heightCssPx"].alias("height_css_px"), v["deviceScaleFactor"].alias("device_scale_factor"), v["scrollXCssPx"].alias("scroll_x_css_px"), v["scrollYCssPx"].alias("scroll_y_css_px")).alias("viewport"),
        F.col("pageHealth").alias("page_health"), F.struct(F.col("redaction.policyVersion").alias("policy_version"), F.col("redaction.applied").alias("applied"), F.col("redaction.redactedSourceIds").alias("redacted_source_ids")).alias("redaction"), frames.alias("frames"),
    )

    def rows(name: str) -> DataFrame:
        docs = b.select(F.col("captureId").alias("capture_id"), F.posexplode("documents").alias("doc", "d"))
        return docs.select("capture_id", "doc", F.posexplode(f"d.{name}").alias("i", "n")).withColumn("ord", F.col("doc").cast("bigint") * (1 << 32) + F.col("i"))

    text = lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
    is_number = lambda c: F.schema_of_variant(c).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    style = F.transform_values("n.styleFacts", lambda k, x: F.struct(F.when(~is_number(x), F.try_variant_get(x, "$", "string")).alias("s"), F.when(is_number(x), F.try_variant_get(x, "$", "double")).alias("n")))
    dom = rows("domLayoutNodes").select("capture_id", F.col("n.frameId").alias("frame_id"), "ord", F.col("n.sourceId").alias("source_id"), F.col("n.parentSourceId").alias("parent_source_id"), "n.role", "n.tag", "n.attributes", "n.bounds", "n.visible", F.col("n.paintOrder").alias("paint_order"), text(F.col("n.zIndex")).alias("z_index"), style.alias("style_facts"), F.col("n.textSourceIds").alias("text_source_ids"))
    ax = rows("accessibilityNodes").select("capture_id", F.col("n.frameId").alias("frame_id"), "ord", F.col("n.sourceId").alias("source_id"), F.col("n.parentSourceId").alias("parent_source_id"), "n.role", "n.name", "n.description", F.transform_values("n.state", lambda k, x: F.to_json(x)).alias("state"), "n.ignored", F.col("n.ignoredReasons").alias("ignored_reasons"), F.col("n.backendDomSourceId").alias("backend_dom_source_id"))
    runs = rows("textRuns").select("capture_id", F.col("n.frameId").alias("frame_id"), "ord", F.col("n.sourceId").alias("source_id"), "n.text", F.col("n.domSourceId").alias("dom_source_id"), "n.bounds")
    obs = b.select(F.col("captureId").alias("capture_id"), F.posexplode("derivedObservations").alias("obs_ord", "o"))
    items = obs.select("capture_id", "obs_ord", "o.kind", "o.provider", F.col("o.providerVersion").alias("provider_version"), F.col("o.sourceImageRef").alias("source_image_ref"), F.posexplode_outer(F.coalesce("o.elements", "o.runs")).alias("item_ord", "x"))
    derived = items.select("capture_id", "obs_ord", "item_ord", "kind", "provider", "provider_version", "source_image_ref", F.coalesce("x.sourceId", F.concat(F.lit("observation_"), F.col("obs_ord").cast("string"))).alias("source_id"), F.col("x.rectImagePx").alias("rect_image_px"), "x.class", "x.text", F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))
    shots = b.select(F.col("captureId").alias("capture_id"), F.posexplode("screenshotEvidence").alias("ord", "s")).select("capture_id", "ord", F.col("s.artifactRef").alias("artifact_ref"), F.col("s.frameId").alias("frame_id"), F.col("s.widthImagePx").alias("width_image_px"), F.col("s.heightImagePx").alias("height_image_px"), F.col("s.deviceScaleFactor").alias("device_scale_factor"))
    return {"captures": captures, "dom_nodes": dom, "ax_nodes": ax, "text_runs": runs, "derived_items": derived, "screenshots": shots}


def input_hashes(bundles: DataFrame, options: dict, profile: dict | None = None, column: str = "bundle") -> DataFrame:
    """capture_id, input_hash: digest of the canonical JSON of bundle, token profile and options together."""
    fixed = {"options": options, **({"dna": profile} if profile is not None else {})}

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sha256_text(canonical({"capture": json.loads(t), **fixed})) if t is not None else None)

    return bundles.select(F.get_json_object(column, "$.captureId").alias("capture_id"), digest(column).alias("input_hash")).where("capture_id is not null")


# Fixed values of the synthetic dashboard.
NAV = ["Overview", "Deployments", "Reviews", "Design system", "Insights", "Settings", "Billing", "Audit"]
ENVIRONMENTS = ["production", "staging", "preview", "canary", "sandbox", "edge", "eu-west", "ap-south"]
FIELDS = ["Team name", "Notification email", "Card number", "Billing address", "VAT id", "Slack channel"]
STATUSES = ["passed", "failed", "queued", "running"]
DASHBOARD_TOKENS = {
    "color.brand": ("#1b6ef3", "color", 0.99), "color.ink": ("#0b1021", "color", 0.99), "color.surface": ("#ffffff", "color", 0.99), "color.surfaceMuted": ("#f6f7fb", "color", 0.95), "color.onBrand": ("#ffffff", "color", 0.99),
    "space.sm": (8, "spacing", 0.97), "space.md": (12, "spacing", 0.97), "space.lg": (16, "spacing", 0.97), "radius.md": (8, "radii", 0.96),
    "type.body": (14, "typography", 0.95), "type.control": (15, "typography", 0.95), "type.display": (32, "typography", 0.95),
}


def dashboard(capture_id: str = "cap_synthetic_dashboard", nav: int = 6, cards: int = 6, rows: int = 24, fields: int = 4, width: int = 1440, height: int = 900, screenshot: bool = True, footer: str = "Sample footer page") -> dict:
    """A page with a banner, cards, a table, a form and a footer; one element whose sources disagree on its role, and one redacted field."""
    dom: list[dict] = []
    ax: list[dict] = []
    runs: list[dict] = []
    dash = lambda t: "-".join(t.lower().split())

    def put(name: str, tag: str, box: tuple, order: int, ax_role: str, label: str | None = None, up: str | None = None, role: str | None = None, attributes: dict | None = None, style: dict | None = None, state: dict | None = None, text: tuple | None = None) -> None:
        rect = lambda b: dict(zip(("x", "y", "width", "height"), b))
        optional = lambda **kw: {k: v for k, v in kw.items() if v is not None}
        dom.append({"sourceId": f"dom_{name}", "frameId": "root", "tag": tag, "bounds": rect(box), "visible": True, "paintOrder": order, **optional(parentSourceId=f"dom_{up}" if up else None, role=role, attributes=attributes, styleFacts=style)})
        ax.append({"sourceId": f"ax_{name}", "frameId": "root", "role": ax_role, "ignored": False, "backendDomSourceId": f"dom_{name}", **optional(name=label, state=state)})
        if text is not None:
            run, said, at = text
            runs.append({"sourceId": f"txt_{run}", "frameId": "root", "domSourceId": f"dom_{name}", "text": said, "bounds": rect(at)})

    put("body", "body", (0, 0, width, height), 0, "document", style={"backgroundColor": "#ffffff", "fontFamily": "Inter", "display": "block"})
    put("header", "header", (0, 0, width, 72), 1, "banner", "Site header", "body", style={"backgroundColor": "#0b1021", "display": "flex", "padding": "16px"})
    put("brand", "a", (24, 20, 132, 32), 2, "link", "Example", "header", attributes={"data-testid": "brand", "href": "/"}, text=("brand", "Example", (24, 26, 92, 20)))
    put("nav", "nav", (200, 20, 700, 32), 3, "navigation", "Primary", "header")
    for i in range(nav):
        label, x = NAV[i % len(NAV)], 200 + 112 * i
        put(f"nav_{i}", "a", (x, 24, 104, 24), 4 + i, "link", label, "nav", attributes={"data-testid": f"nav-{dash(label)}", "href": f"/{dash(label)}"}, style={"color": "#c7d2fe", "fontSizeCssPx": 14}, text=(f"nav_{i}", label, (x, 28, 96, 16)))
    put("cta", "a", (1264, 18, 152, 36), 20, "button", "New review", "header", role="link", attributes={"data-testid": "new-review", "id": "cta-new-review", "href": "/reviews/new"}, style={"color": "#ffffff", "backgroundColor": "#3b5bdb", "fontSizeCssPx": 15, "borderRadiusTopLeft": "7px", "padding": "13px"}, text=("cta", "New review", (1280, 26, 120, 20)))
    put("main", "main", (0, 72, width, height - 132), 21, "main", "Deployments", "body")
    put("h1", "h1", (24, 96, 420, 40), 22, "heading", "Recent deployments", "main", style={"color": "#0b1021", "fontSizeCssPx": 32, "fontWeight": 700, "lineHeightCssPx": 40}, state={"level": 1}, text=("h1", "Recent deployments", (24, 102, 396, 32)))
    put("cardlist", "ul", (24, 152, width - 48, 168), 23, "list", "Environments", "main")
    for i in range(cards):
        name, x = ENVIRONMENTS[i % len(ENVIRONMENTS)], 24 + 228 * i
        put(f"card_{i}", "li", (x, 152, 216, 168), 24 + 2 * i, "listitem", f"{name} environment", "cardlist", style={"backgroundColor": "#f6f7fb", "borderRadiusTopLeft": "8px", "padding": "16px"}, text=(f"card_{i}", f"{name} · healthy", (x + 16, 176, 184, 20)))
        put(f"card_link_{i}", "a", (x + 16, 268, 120, 24), 25 + 2 * i, "link", f"Open {name}", f"card_{i}", attributes={"data-testid": f"env-link-{name}", "href": f"/environments/{name}"}, style={"color": "#1b6ef3", "fontSizeCssPx": 14})
    top, line = 336, 28
    put("table", "table", (24, top, width - 48, line * (rows + 1)), 200, "table", "Deployment history", "main", attributes={"data-testid": "deploy-history"})
    for r in range(rows):
        y = top + line * (r + 1)
        put(f"row_{r}", "tr", (24, y, width - 48, line), 201 + 4 * r, "row", None, "table", attributes={"data-testid": f"deploy-row-{1000 + r}"})
        for c, said in enumerate((f"#{1000 + r}", f"feat/branch-{r}", STATUSES[r % len(STATUSES)])):
            put(f"cell_{r}_{c}", "td", (24 + 448 * c, y, 440, line), 202 + 4 * r + c, "cell", said, f"row_{r}", style={"color": "#0b1021", "fontSizeCssPx": 13}, text=(f"cell_{r}_{c}", said, (28 + 448 * c, y + 4, 200, 18)))
    form = top + line * (rows + 2)
    put("form", "form", (24, form, 640, 56 * (fields + 2)), 4000, "form", "Billing settings", "main")
    for f in range(fields):
        label, y = FIELDS[f % len(FIELDS)], form + 16 + 56 * f
        put(f"field_{f}", "input", (24, y, 380, 40), 4001 + 2 * f, "textbox", label, "form", attributes={"data-testid": f"field-{f}", "name": "_".join(label.lower().split())}, style={"backgroundColor": "#ffffff", "fontSizeCssPx": 15, "borderRadiusTopLeft": "6px", "padding": "12px"}, state={"required": f == 0}, text=(f"field_{f}", label, (24, y - 20, 200, 16)))
    last = form + 16 + 56 * fields
    put("submit", "button", (24, last, 168, 40), 4500, "button", "Save billing settings", "form", attributes={"data-testid": "save-billing", "id": "save-billing"}, style={"color": "#ffffff", "backgroundColor": "#1b6ef3", "fontSizeCssPx": 15, "borderRadiusTopLeft": "6px", "padding": "16px"}, text=("submit", "Save billing settings", (40, last + 10, 136, 20)))
    put("footer", "footer", (0, height - 60, width, 60), 5000, "contentinfo", "Footer", "body", text=("footer", footer, (24, height - 40, 240, 20)))
    shot = {"artifactRef": "artifact://synthetic/dashboard.png", "frameId": "root", "widthImagePx": width * 2, "heightImagePx": height * 2, "deviceScaleFactor": 2}
    return {
        "schemaVersion": "1.0.0", "captureId": capture_id, "captureVersion": "synthetic-capture@1", "repository": {"owner": "acme", "name": "dashboard"}, "route": "/deployments", "headSha": "0" * 40,
        "viewport": {"widthCssPx": width, "heightCssPx": height, "deviceScaleFactor": 2, "scrollXCssPx": 0, "scrollYCssPx": 0}, "documents": [{"frameId": "root", "url": "https://example.invalid/deployments", "domLayoutNodes": dom, "accessibilityNodes": ax, "textRuns": runs}],
        **({"screenshotEvidence": [shot]} if screenshot else {}), "pageHealth": {"stable": True, "partial": False, "reasons": []}, "redaction": {"policyVersion": "redaction@1", "applied": True, "redactedSourceIds": ["dom_field_2"] if fields > 2 else []},
    }
