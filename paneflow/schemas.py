"""Constants of the capture model (fixed values) and schemas of the input tables."""

from __future__ import annotations

RECT = "STRUCT<x:DOUBLE,y:DOUBLE,width:DOUBLE,height:DOUBLE>"

#: Input tables that may be read from JSON.
TABLES = {
    "captures": f"capture_id STRING, schema_version STRING, capture_version STRING, repo_owner STRING, repo_name STRING, route STRING, head_sha STRING, viewport STRUCT<width_css_px:DOUBLE,height_css_px:DOUBLE,device_scale_factor:DOUBLE,scroll_x_css_px:DOUBLE,scroll_y_css_px:DOUBLE>, page_health STRUCT<stable:BOOLEAN,partial:BOOLEAN,reasons:ARRAY<STRING>>, redaction STRUCT<policy_version:STRING,applied:BOOLEAN,redacted_source_ids:ARRAY<STRING>>, frames ARRAY<STRUCT<frame_id:STRING,parent_frame_id:STRING,url:STRING,transform_to_parent:ARRAY<DOUBLE>>>",
    "dom_nodes": f"capture_id STRING, frame_id STRING, ord INT, source_id STRING, parent_source_id STRING, role STRING, tag STRING, attributes MAP<STRING,STRING>, bounds {RECT}, visible BOOLEAN, paint_order DOUBLE, z_index STRING, style_facts MAP<STRING,STRUCT<s:STRING,n:DOUBLE>>, text_source_ids ARRAY<STRING>",
    "ax_nodes": "capture_id STRING, frame_id STRING, ord INT, source_id STRING, parent_source_id STRING, role STRING, name STRING, description STRING, state MAP<STRING,STRING>, ignored BOOLEAN, ignored_reasons ARRAY<STRING>, backend_dom_source_id STRING",
    "text_runs": f"capture_id STRING, frame_id STRING, ord INT, source_id STRING, text STRING, dom_source_id STRING, bounds {RECT}",
    "derived_items": f"capture_id STRING, obs_ord INT, item_ord INT, kind STRING, provider STRING, provider_version STRING, source_image_ref STRING, source_id STRING, rect_image_px {RECT}, class STRING, text STRING, confidence DOUBLE",
}

BASE_CONFIDENCE = {"dom": 0.9, "layout": 0.9, "accessibility": 0.85, "text_run": 0.8, "vision_parser": 0.6, "ocr": 0.6}
CONFLICT_FACTOR = 0.5
NO_FACT_CONFIDENCE = (0.6, 0.4)
COMPETENCE = {"role": {"accessibility": 3, "dom": 2, "": 1}, "name": {"accessibility": 3, "text_run": 2, "": 1}, "text": {"text_run": 3, "ocr": 2, "accessibility": 1, "": 0}}
INTERACTIVE_ROLES = ["button", "checkbox", "combobox", "link", "listbox", "menuitem", "option", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox"]
AFFORDANCE_ROLES = ["button", "link", "textbox", "combobox", "checkbox", "radio", "switch", "tab", "menuitem", "searchbox"]
AFFORDANCE_VERBS = {"link": "navigate", "textbox": "type", "searchbox": "type", "spinbutton": "type", "checkbox": "toggle", "radio": "toggle", "switch": "toggle", "combobox": "select", "listbox": "select", "option": "select", "button": "click", "menuitem": "click", "tab": "click", "slider": "drag"}
REGION_ROLES = {"landmark": ["navigation", "main", "banner", "contentinfo", "complementary", "region", "search"], "form": ["form"], "list": ["list", "listbox", "menu", "menubar"], "table": ["table", "grid", "treegrid"]}
EDGE_WEIGHTS = {"contains": 1.0, "reading_next": 0.7, "aligned": 0.5, "near": 0.3}
SALIENCY_WEIGHTS = {"heading": 1.0, "banner": 0.9, "main": 0.6, "button": 0.8, "link": 0.6, "img": 0.7, "image": 0.7, "navigation": 0.5, "search": 0.7, "alert": 1.0, "status": 0.6, "dialog": 0.9}
ATTRIBUTE_HINTS = [("data-testid", "explicit_test_id", "cross_capture_candidate", 0.98, 0.95), ("id", "stable_dom_id", "cross_capture_candidate", 0.9, 0.85), ("href", "href_or_form_name", "route_version", 0.7, 0.8), ("name", "href_or_form_name", "route_version", 0.65, 0.8)]
WITHHELD = ["pii", "secret", "credential", "redacted"]
FAIL_CLOSED = ["pii", "secret", "credential"]
LINEAGE_WEIGHTS = {"explicit_id": 0.35, "name": 0.2, "role": 0.15, "geometry": 0.15, "region": 0.1, "kind": 0.05}
NAMED_COLORS = {"transparent": "#00000000", "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff"}
#: Role that a tag has without being told, whatever its attributes; inputs by their type.
TAG_ROLES = {
    "article": "article", "aside": "complementary", "button": "button", "datalist": "listbox", "dd": "definition", "details": "group", "dialog": "dialog", "dt": "term", "fieldset": "group", "figure": "figure", "form": "form",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hr": "separator", "html": "document", "img": "img", "li": "listitem", "main": "main", "math": "math", "menu": "list", "meter": "meter",
    "nav": "navigation", "ol": "list", "optgroup": "group", "option": "option", "output": "status", "p": "paragraph", "progress": "progressbar", "search": "search", "summary": "button",
    "table": "table", "tbody": "rowgroup", "td": "cell", "textarea": "textbox", "tfoot": "rowgroup", "th": "columnheader", "thead": "rowgroup", "tr": "row", "ul": "list",
}
INPUT_ROLES = {"button": "button", "checkbox": "checkbox", "email": "textbox", "image": "button", "number": "spinbutton", "radio": "radio", "range": "slider", "reset": "button", "search": "searchbox", "submit": "button", "tel": "textbox", "text": "textbox", "url": "textbox"}
DURABLE_ATTRIBUTES = ["data-testid", "id", "href", "name"]
#: Approved design tokens of the synthetic profile: (ref, category, text, number).
DESIGN_TOKENS = [
    ("color.brand", "color", "#0b5fff", None), ("color.ink", "color", "#1a1a1a", None), ("color.paper", "color", "#ffffff", None), ("color.warn", "color", "#7a2e00", None),
    ("radius.md", "radii", None, 8.0), ("radius.sm", "radii", None, 4.0),
    ("space.lg", "spacing", None, 24.0), ("space.md", "spacing", None, 16.0), ("space.sm", "spacing", None, 8.0),
    ("type.body", "typography", None, 16.0), ("type.small", "typography", None, 14.0), ("type.title", "typography", None, 20.0),
]
