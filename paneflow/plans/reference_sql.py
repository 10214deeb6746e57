"""SQL with the same rows as the queries in ``reference``, in the dialect of DuckDB. Joins are plain, without any grid."""

from __future__ import annotations

from paneflow.plans import oracle_values as V


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': " + (f"'{v}'" if isinstance(v, str) else repr(v)) for k, v in d.items()) + "}"


def _one(name: str, keys: str = "capture_id, source_id") -> str:
    cond = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"(SELECT * FROM {name} WHERE {cond} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY received_at DESC) = 1)"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


DOM, AX, RUNS, CAPS, ITEMS = _one("dom_nodes"), _one("ax_nodes"), _one("text_runs"), _one("captures", "capture_id"), _one("derived_items")
PARENT = """par AS (SELECT b.capture_id, b.node_id, arg_min(o.node_id, {'a': o.w * o.h, 'i': o.node_id}) AS parent_id FROM b LEFT JOIN b o ON o.capture_id = b.capture_id AND o.frame_id = b.frame_id
  AND o.node_id <> b.node_id AND o.x <= b.x AND o.y <= b.y AND o.x + o.w >= b.x + b.w AND o.y + o.h >= b.y + b.h AND o.w * o.h > b.w * b.h GROUP BY ALL)"""
ANC = """anc AS (SELECT capture_id, node_id, parent_id AS ancestor_id, 1 AS distance FROM par WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.capture_id, a.node_id, p.parent_id, a.distance + 1 FROM anc a JOIN par p ON p.capture_id = a.capture_id AND p.node_id = a.ancestor_id WHERE p.parent_id IS NOT NULL)"""
SIG = "concat_ws('|', coalesce(role, '_'), coalesce(kind, '_'), CASE WHEN w IS NULL OR h IS NULL THEN 'na' ELSE CAST(CAST(floor(w / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(floor(h / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) END)"
SIGS = f"sg AS (SELECT b.*, par.parent_id, {SIG} AS signature FROM b JOIN par USING (capture_id, node_id))"
PAIRS = """sp AS (SELECT capture_id, greatest(100.0, max(x + w), max(y + h)) AS span FROM b WHERE x IS NOT NULL GROUP BY capture_id),
g AS (SELECT b.*, greatest(50.0, span / 20) AS c FROM b JOIN sp USING (capture_id) WHERE x IS NOT NULL),
pr AS (SELECT a.capture_id, a.node_id AS a, o.node_id AS o, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, o.x AS bx, o.y AS by_, o.w AS bw, o.h AS bh FROM g a JOIN g o ON a.capture_id = o.capture_id AND a.node_id < o.node_id
  AND floor(a.x / a.c) <= floor((o.x + o.w) / a.c) AND floor(o.x / a.c) <= floor((a.x + a.w) / a.c) AND floor(a.y / a.c) <= floor((o.y + o.h) / a.c) AND floor(o.y / a.c) <= floor((a.y + a.h) / a.c))"""
OVER = """ov AS (SELECT * FROM (SELECT capture_id, a AS from_id, o AS to_id, i / (aw * ah + bw * bh - i) AS iou FROM
  (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS i FROM pr) WHERE i > 0) WHERE iou >= 0.1)"""
ALIGN = """big AS (SELECT capture_id, parent_id, signature FROM sg GROUP BY ALL HAVING count(*) >= 3),
mem AS (SELECT sg.capture_id, node_id, coalesce(sg.parent_id, 'root') || ':' || sg.signature AS region FROM sg JOIN big ON sg.capture_id = big.capture_id AND sg.parent_id IS NOT DISTINCT FROM big.parent_id AND sg.signature = big.signature),
al AS (SELECT pr.capture_id, a AS from_id, o AS to_id, unnest(list_filter([CASE WHEN abs(ax - bx) <= 4 THEN 'aligned_start' END, CASE WHEN abs(ax + aw * 0.5 - (bx + bw * 0.5)) <= 4 THEN 'aligned_center' END,
  CASE WHEN abs(ax + aw - (bx + bw)) <= 4 THEN 'aligned_end' END], lambda k: k IS NOT NULL)) AS kind FROM pr JOIN mem m ON m.capture_id = pr.capture_id AND m.node_id = pr.a JOIN mem n ON n.capture_id = pr.capture_id AND n.node_id = pr.o AND n.region = m.region)"""
NEAR = """dd AS (SELECT capture_id, a AS n, o AS m, pow(ax + aw / 2 - bx - bw / 2, 2) + pow(ay + ah / 2 - by_ - bh / 2, 2) AS d FROM pr UNION ALL SELECT capture_id, o, a, pow(ax + aw / 2 - bx - bw / 2, 2) + pow(ay + ah / 2 - by_ - bh / 2, 2) FROM pr),
nr AS (SELECT DISTINCT capture_id, least(n, m) AS from_id, greatest(n, m) AS to_id FROM (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY capture_id, n ORDER BY d, m) <= 4))"""
NEXT = """rn AS (SELECT * FROM (SELECT b.capture_id, b.node_id AS from_id, lead(b.node_id) OVER (PARTITION BY b.capture_id, coalesce(parent_id, '') ORDER BY y, x, b.node_id) AS to_id FROM b JOIN par USING (capture_id, node_id) WHERE x IS NOT NULL AND y IS NOT NULL) WHERE to_id IS NOT NULL)"""
EDGES = """ed AS (SELECT capture_id, 'contains' AS kind, parent_id AS from_id, node_id AS to_id FROM par WHERE parent_id IS NOT NULL UNION ALL SELECT capture_id, 'reading_next', from_id, to_id FROM rn
  UNION ALL SELECT capture_id, 'overlaps', from_id, to_id FROM ov UNION ALL SELECT capture_id, kind, from_id, to_id FROM al UNION ALL SELECT capture_id, 'near', from_id, to_id FROM nr)"""
DEG = "dg AS (SELECT capture_id, node_id, count(*) AS degree FROM (SELECT capture_id, from_id AS node_id FROM ed UNION ALL SELECT capture_id, to_id FROM ed) GROUP BY ALL)"

_C = "coalesce(f.transform_to_parent, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])"
NORM = f"""fr AS (SELECT capture_id, unnest(frames) AS f FROM {CAPS}),
nd AS (SELECT d.*, c.viewport AS v, {_C} AS t FROM {DOM} d JOIN {CAPS} c USING (capture_id) LEFT JOIN fr ON fr.capture_id = d.capture_id AND fr.f.frame_id = d.frame_id),
k AS (SELECT *, t[1] * bounds.x + t[3] * bounds.y + t[5] AS x1, t[2] * bounds.x + t[4] * bounds.y + t[6] AS y1,
  t[1] * (bounds.x + bounds.width) + t[3] * (bounds.y + bounds.height) + t[5] AS x2, t[2] * (bounds.x + bounds.width) + t[4] * (bounds.y + bounds.height) + t[6] AS y2,
  t[1] * (bounds.x + bounds.width) + t[3] * bounds.y + t[5] AS x3, t[2] * (bounds.x + bounds.width) + t[4] * bounds.y + t[6] AS y3,
  t[1] * bounds.x + t[3] * (bounds.y + bounds.height) + t[5] AS x4, t[2] * bounds.x + t[4] * (bounds.y + bounds.height) + t[6] AS y4 FROM nd),
n0 AS (SELECT *, least(x1, x2, x3, x4) AS dx, least(y1, y2, y3, y4) AS dy, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS dw, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS dh FROM k),
n1 AS (SELECT *, dx - v.scroll_x_css_px AS vx, dy - v.scroll_y_css_px AS vy, v.width_css_px AS vw, v.height_css_px AS vh FROM n0),
nm AS (SELECT *, vx / vw BETWEEN 0 AND 1 AND vy / vh BETWEEN 0 AND 1 AND dw / vw BETWEEN 0 AND 1 AND dh / vh BETWEEN 0 AND 1 AS inside,
  CASE WHEN NOT visible OR dx IS NULL THEN 'hidden' WHEN least(vx + dw, vw) - greatest(vx, 0) <= 0 OR least(vy + dh, vh) - greatest(vy, 0) <= 0 THEN 'offscreen'
       WHEN least(vx + dw, vw) - greatest(vx, 0) >= dw - 1e-6 AND least(vy + dh, vh) - greatest(vy, 0) >= dh - 1e-6 THEN 'visible' ELSE 'clipped' END AS visibility FROM n1)"""


_R3 = "floor({0} * 1000 + 0.5) / 1000"
BOX = f"""{NORM}, b AS (SELECT capture_id, source_id AS node_id, frame_id, {_R3.format('vx')} AS x, {_R3.format('vy')} AS y, CASE WHEN vx IS NOT NULL THEN {_R3.format('dw')} END AS w, CASE WHEN vx IS NOT NULL THEN {_R3.format('dh')} END AS h, role, tag AS kind, visibility FROM nm)"""
GRAPH = ", ".join([BOX, PARENT, SIGS, PAIRS, OVER, ALIGN, NEAR, NEXT, EDGES])


def color(x: str) -> str:
    v = f"lower(trim({x}))"
    parts = f"list_transform(list_filter(regexp_split_to_array(regexp_extract({v}, '^rgba?\\(\\s*([^)]*)\\)$', 1), '[,/\\s]+'), lambda p: p <> ''), lambda p: TRY_CAST(p AS DOUBLE))"
    byte = lambda e: f"printf('%02x', CAST(greatest(0, least(255, floor({e} + 0.5))) AS INTEGER))"
    p = lambda i: f"({parts})[{i}]"
    rgb = f"'#' || {byte(p(1))} || {byte(p(2))} || {byte(p(3))}"
    return f"""CASE WHEN {v} IN {_in(list(V.NAMED_COLORS))} THEN {_map(V.NAMED_COLORS)}[{v}]
      WHEN regexp_matches({v}, '^#[0-9a-f]{{3,4}}$') THEN '#' || regexp_replace(substr({v}, 2), '([0-9a-f])', '\\1\\1', 'g')
      WHEN regexp_matches({v}, '^#[0-9a-f]{{6}}(ff)?$') THEN substr({v}, 1, 7) WHEN regexp_matches({v}, '^#[0-9a-f]{{8}}$') THEN {v}
      WHEN len({parts}) = 4 AND {p(4)} >= 0 AND {p(4)} < 1 THEN {rgb} || {byte(p(4) + ' * 255')} WHEN len({parts}) IN (3, 4) THEN {rgb} END"""


_LEN = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z%]*)$"
PX = f"coalesce(e.value.n, TRY_CAST(nullif(regexp_extract(lower(trim(e.value.s)), '{_LEN}', 1), '') AS DOUBLE) * {_map({**V.PX, '': 1.0})}[regexp_extract(lower(trim(e.value.s)), '{_LEN}', 2)])"
STYLE = f"st AS (SELECT capture_id, source_id, e.key AS property, CASE WHEN regexp_matches(e.key, '(?i)colou?r') THEN {color('e.value.s')} END AS color, CASE WHEN NOT regexp_matches(e.key, '(?i)colou?r') THEN {PX} END AS px FROM (SELECT capture_id, source_id, unnest(map_entries(style_facts)) AS e FROM {DOM}))"
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
TOKENS = "tk AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_lit(x) for x in t) + ")" for t in V.TOKENS) + ") t(token_ref, category, value_str, value_num))"
MATCH = f"""ob AS (SELECT *, {_map(V.CATEGORY)}[property] AS category FROM st WHERE property IN {_in(list(V.CATEGORY))}),
tm AS (SELECT ob.capture_id, ob.source_id, property, 'color' AS category, coalesce(min(token_ref), 'category:color') AS token_ref, CASE WHEN min(token_ref) IS NULL THEN 'drift' ELSE 'exact' END AS status, CAST(NULL AS DOUBLE) AS delta
    FROM ob LEFT JOIN tk ON tk.category = 'color' AND tk.value_str = ob.color WHERE ob.category = 'color' AND ob.color IS NOT NULL GROUP BY ob.capture_id, ob.source_id, property
  UNION ALL SELECT capture_id, source_id, property, category, n.r, CASE WHEN n.d = 0 THEN 'exact' WHEN n.d <= greatest(0.5, abs(px) * 0.02) THEN 'within_tolerance' ELSE 'drift' END, n.d FROM
    (SELECT ob.capture_id, ob.source_id, property, ob.category, px, min({{'d': abs(value_num - px), 'r': token_ref}}) AS n FROM ob JOIN tk USING (category) WHERE ob.category <> 'color' AND px IS NOT NULL GROUP BY ALL))"""

CLAIMS = f"""{NORM}, vis AS (SELECT capture_id, source_id FROM nm WHERE NOT (visibility = 'hidden' AND dx IS NOT NULL) AND coalesce(visible, true)),
it0 AS (SELECT i.*, c.viewport AS v FROM {ITEMS} i JOIN {CAPS} c USING (capture_id) WHERE i.kind IN ('vision_parser', 'ocr')),
it AS (SELECT *, v.device_scale_factor AS s, rect_image_px.x / s AS x, rect_image_px.y / s AS y, rect_image_px.width / s AS w, rect_image_px.height / s AS h FROM it0),
io AS (SELECT it.capture_id, it.source_id, nm.source_id AS dom_id, nm.ord, greatest(0, least(it.x + it.w, vx + dw) - greatest(it.x, vx)) * greatest(0, least(it.y + it.h, vy + dh) - greatest(it.y, vy)) AS i, it.w * it.h + dw * dh AS a
  FROM it JOIN nm ON nm.capture_id = it.capture_id WHERE nm.visible AND vx IS NOT NULL AND it.s > 0),
bi AS (SELECT capture_id, source_id, arg_min(dom_id, {{'a': -(i / (a - i)), 'b': ord}}) AS dom_id, max(i / (a - i)) AS iou FROM io WHERE i > 0 AND i / (a - i) >= 0.5 GROUP BY ALL),
cl AS (SELECT d.capture_id, 'dom:' || source_id AS entity, 'dom' AS kind, frame_id, 0 AS stage, CAST(ord AS BIGINT) AS ord, 'dom' AS source_type, source_id, role, NULL AS name, NULL AS text, 0.9 AS confidence FROM {DOM} d WHERE (capture_id, source_id) IN (SELECT capture_id, source_id FROM vis)
  UNION ALL SELECT a.capture_id, CASE WHEN v.source_id IS NULL THEN 'ax:' || a.source_id ELSE 'dom:' || v.source_id END, CASE WHEN v.source_id IS NULL THEN 'ax_only' ELSE 'dom' END, frame_id, 1, ord, 'accessibility', a.source_id, a.role, a.name, NULL, 0.85
    FROM {AX} a LEFT JOIN vis v ON v.capture_id = a.capture_id AND v.source_id = a.backend_dom_source_id WHERE NOT a.ignored
  UNION ALL SELECT r.capture_id, CASE WHEN v.source_id IS NULL THEN 'text:' || r.source_id ELSE 'dom:' || v.source_id END, CASE WHEN v.source_id IS NULL THEN 'text' ELSE 'dom' END, frame_id, 2, ord, 'text_run', r.source_id, NULL, NULL, CASE WHEN list_contains(c.redaction.redacted_source_ids, r.source_id) OR r.text = '' THEN NULL ELSE r.text END, 0.8
    FROM {RUNS} r JOIN {CAPS} c ON c.capture_id = r.capture_id LEFT JOIN vis v ON v.capture_id = r.capture_id AND v.source_id = r.dom_source_id
  UNION ALL SELECT it.capture_id, CASE WHEN dom_id IS NULL THEN 'visual:' || it.source_id ELSE 'dom:' || dom_id END, CASE WHEN dom_id IS NULL THEN 'visual' ELSE 'dom' END, 'main', 3, CAST(obs_ord AS BIGINT) * 4294967296 + item_ord, kind, it.source_id, NULL, NULL, nullif(it.text, ''), greatest(0.0, least(1.0, it.confidence))
    FROM it LEFT JOIN bi USING (capture_id, source_id))"""
FACTS = """rk AS (SELECT *, CASE fact WHEN 'role' THEN CASE source_type WHEN 'accessibility' THEN 3 WHEN 'dom' THEN 2 ELSE 1 END WHEN 'name' THEN CASE source_type WHEN 'accessibility' THEN 3 WHEN 'text_run' THEN 2 ELSE 1 END
    ELSE CASE source_type WHEN 'text_run' THEN 3 WHEN 'ocr' THEN 2 WHEN 'accessibility' THEN 1 ELSE 0 END END AS rank
  FROM (SELECT capture_id, entity, source_type, confidence, f.fact, CASE f.fact WHEN 'role' THEN role WHEN 'name' THEN name ELSE text END AS value FROM cl, (VALUES ('role'), ('name'), ('text')) f(fact)) WHERE trim(value) <> ''),
fc AS (SELECT capture_id, entity, fact, arg_min(value, {'a': -rank, 'b': -confidence, 'c': value}) AS value, arg_min(confidence, {'a': -rank, 'b': -confidence, 'c': value}) AS top, count(DISTINCT value) > 1 AS conflict FROM rk GROUP BY ALL)"""
ENTITIES = """en AS (SELECT capture_id, entity, min({'stage': stage, 'ord': ord, 's': source_id, 'kind': kind, 'f': frame_id, 't': source_type}) AS e, string_agg(source_type || ':' || source_id, ',' ORDER BY stage, ord, source_id) AS evidence,
  list_sort(list(source_type || ':' || source_id)) AS linkage, min(CASE WHEN stage = 1 THEN source_id END) AS ax_id FROM cl GROUP BY ALL),
ag AS (SELECT a.capture_id, a.source_id, nm.vx, nm.vy, nm.dx, nm.dy, nm.dw, nm.dh, nm.visibility FROM %s a JOIN nm ON nm.capture_id = a.capture_id AND nm.source_id = a.backend_dom_source_id),
rt AS (SELECT r.*, c.viewport AS v, coalesce(f.f.transform_to_parent, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]) AS t FROM %s r JOIN %s c USING (capture_id) LEFT JOIN fr f ON f.capture_id = r.capture_id AND f.f.frame_id = r.frame_id),
rg AS (SELECT capture_id, source_id, bounds.x + t[5] AS dx, bounds.y + t[6] AS dy, bounds.width AS dw, bounds.height AS dh, bounds.x + t[5] - v.scroll_x_css_px AS vx, bounds.y + t[6] - v.scroll_y_css_px AS vy, v.width_css_px AS vw, v.height_css_px AS vh FROM rt WHERE bounds IS NOT NULL),
ge AS (SELECT capture_id, 'dom:' || source_id AS entity, dx, dy, dw, dh, vx, vy, visibility FROM nm WHERE dx IS NOT NULL
  UNION ALL SELECT capture_id, 'ax:' || source_id, dx, dy, dw, dh, vx, vy, visibility FROM ag WHERE dx IS NOT NULL
  UNION ALL SELECT capture_id, 'text:' || source_id, dx, dy, dw, dh, vx, vy, CASE WHEN least(vx + dw, vw) - greatest(vx, 0) <= 0 OR least(vy + dh, vh) - greatest(vy, 0) <= 0 THEN 'offscreen' WHEN least(vx + dw, vw) - greatest(vx, 0) >= dw - 1e-6 AND least(vy + dh, vh) - greatest(vy, 0) >= dh - 1e-6 THEN 'visible' ELSE 'clipped' END FROM rg
  UNION ALL SELECT capture_id, 'visual:' || source_id, x, y, w, h, x - v.scroll_x_css_px, y - v.scroll_y_css_px, CASE WHEN least(x - v.scroll_x_css_px + w, v.width_css_px) - greatest(x - v.scroll_x_css_px, 0) <= 0 OR least(y - v.scroll_y_css_px + h, v.height_css_px) - greatest(y - v.scroll_y_css_px, 0) <= 0 THEN 'offscreen'
     WHEN least(x - v.scroll_x_css_px + w, v.width_css_px) - greatest(x - v.scroll_x_css_px, 0) >= w - 1e-6 AND least(y - v.scroll_y_css_px + h, v.height_css_px) - greatest(y - v.scroll_y_css_px, 0) >= h - 1e-6 THEN 'visible' ELSE 'clipped' END FROM it WHERE s > 0 AND rect_image_px IS NOT NULL),
ec AS (SELECT en.capture_id, en.entity, e.kind AS kind, e.f AS frame_id, evidence, linkage, ge.dx, ge.dy, ge.dw, ge.dh, ge.vx, ge.vy, ge.visibility, printf('cand_%%04d', row_number() OVER (PARTITION BY en.capture_id ORDER BY e.f, ge.vy ASC NULLS LAST, ge.vx ASC NULLS LAST, e.kind, e.s) - 1) AS candidate_id FROM en LEFT JOIN ge USING (capture_id, entity)),
wf AS (SELECT capture_id, entity, max(value) FILTER (fact = 'role') AS role, max(value) FILTER (fact = 'name') AS name, min(CASE WHEN conflict THEN top * 0.5 ELSE top END) AS confidence,
  concat_ws(',', max(CASE WHEN fact = 'role' AND conflict THEN 'conflict:role' END), max(CASE WHEN fact = 'name' AND conflict THEN 'conflict:name' END), max(CASE WHEN fact = 'text' AND conflict THEN 'conflict:text' END)) AS flags FROM fc GROUP BY ALL)""" % (AX, RUNS, CAPS)
SALIENCY = f"""sz AS (SELECT capture_id, greatest(1.0, max(x + w)) AS vw, greatest(1.0, max(y + h)) AS vh FROM b GROUP BY capture_id),
sl AS (SELECT capture_id, node_id, {r6(f"CASE WHEN x IS NULL THEN greatest(0, least(1, 0.1 + 0.1 * wt)) ELSE greatest(0, least(1, 0.35 * greatest(0, least(1, 1 - y / vh)) + 0.2 * greatest(0, least(1, 1 - abs((x + w / 2) / vw - 0.5) * 2)) + 0.25 * greatest(0, least(1, sqrt(w * h / greatest(1.0, vw * vh)))) + 0.2 * wt)) END")} AS saliency
  FROM (SELECT *, CAST(coalesce({_map(V.SALIENCY)}[role], 0.3) AS DOUBLE) AS wt FROM b JOIN sz USING (capture_id)))"""
SIDES = f"""sn AS {_one("snapshot_nodes", "snapshot_id, node_id")},
hd AS (SELECT snapshot_id, max(page_key) AS page_key, max(captured_at) AS captured_at FROM graph_snapshots GROUP BY snapshot_id),
pp AS (SELECT * FROM (SELECT lag(snapshot_id) OVER (PARTITION BY page_key ORDER BY captured_at, snapshot_id) AS base_id, snapshot_id AS pair FROM hd) WHERE base_id IS NOT NULL),
bb AS (SELECT pair, sn.* FROM pp JOIN sn ON sn.snapshot_id = base_id), tt AS (SELECT pair, sn.* FROM pp JOIN sn ON sn.snapshot_id = pair)"""
NAMED = f"na AS (SELECT b.*, a.name FROM b LEFT JOIN (SELECT capture_id, backend_dom_source_id AS node_id, min(name) AS name FROM {AX} WHERE backend_dom_source_id IS NOT NULL GROUP BY ALL) a USING (capture_id, node_id))"
SAN = "regexp_replace(replace(replace({0}, '<<<UNTRUSTED_UI_CONTENT>>>', '[untrusted-marker-removed]'), '<<<END_UNTRUSTED_UI_CONTENT>>>', '[untrusted-marker-removed]'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
VIEWN = _one("view_nodes", "view_node_id")
_WHITE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{200b}\x{200c}\x{200d}\x{feff}]+"
_U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_PLAIN = ["kind", "parent_node_id", "role", "name", "text", "color", "font_size_css_px"]
_CHANGED = " OR ".join(f"bb.{c} IS DISTINCT FROM tt.{c}" for c in _PLAIN)
_RECTBAD = "NOT isfinite({0}.x) OR NOT isfinite({0}.y) OR NOT isfinite({0}.width) OR NOT isfinite({0}.height) OR {0}.width < 0 OR {0}.height < 0 OR {0}.x IS NULL OR {0}.y IS NULL OR {0}.width IS NULL OR {0}.height IS NULL"
_RECTFAR = "abs({0}.x) > 1e7 OR abs({0}.y) > 1e7 OR abs({0}.width) > 1e7 OR abs({0}.height) > 1e7"


def _rect(src: str, col: str) -> str:
    return f"SELECT * FROM (SELECT capture_id, CASE WHEN {col} IS NULL THEN NULL WHEN {_RECTBAD.format(col)} THEN 'non_finite' WHEN {_RECTFAR.format(col)} THEN 'overflow' END AS code, source_id FROM {src}) WHERE code IS NOT NULL"


_HINTS = " UNION ALL ".join(f"SELECT capture_id, source_id AS node_id, '{k}' AS kind, attributes['{a}'] AS value, '{s}' AS scope, {u} AS uniqueness, {st} AS stability FROM d WHERE attributes['{a}'] <> ''" for a, k, s, u, st in V.HINTS)

SQL = {
    "normalize_geometry": f"WITH {NORM} SELECT capture_id, source_id, {r6('dx')} AS doc_x, {r6('dy')} AS doc_y, {r6('dw')} AS doc_width, {r6('dh')} AS doc_height, {r6('vx')} AS view_x, {r6('vy')} AS view_y, CASE WHEN vx IS NOT NULL THEN {r6('dw')} END AS view_width, CASE WHEN vx IS NOT NULL THEN {r6('dh')} END AS view_height, CASE WHEN inside THEN {r6('vx / vw')} END AS norm_x, CASE WHEN inside THEN {r6('vy / vh')} END AS norm_y, CASE WHEN inside THEN {r6('dw / vw')} END AS norm_width, CASE WHEN inside THEN {r6('dh / vh')} END AS norm_height, visibility FROM nm",
    "css_color": f"SELECT original, {color('original')} AS canonical FROM (SELECT DISTINCT e.value.s AS original FROM (SELECT unnest(map_entries(style_facts)) AS e FROM dom_nodes) WHERE regexp_matches(e.key, '(?i)colou?r') AND e.value.s IS NOT NULL)",
    "css_length": f"WITH {STYLE} SELECT capture_id, source_id, property, {r6('px')} AS value_css_px FROM st WHERE NOT regexp_matches(property, '(?i)colou?r')",
    "match_text": f"SELECT capture_id, source_id, lower(trim(regexp_replace(nfc_normalize(text), '{_WHITE}', ' ', 'g'))) AS match_text FROM {RUNS}",
    "token_estimate": f"SELECT doc_id, CAST(ceil({_U16.format('text')} / 4.0) AS BIGINT) AS tokens FROM documents",
    "patch_tokens": f"SELECT capture_id, CAST(ceil(viewport.width_css_px / 16) * ceil(viewport.height_css_px / 16) AS BIGINT) AS tokens_16, CAST(ceil(viewport.width_css_px / 28) * ceil(viewport.height_css_px / 28) AS BIGINT) AS tokens_28 FROM {CAPS}",
    "sanitize_text": f"SELECT doc_id, sha256({SAN.format('text')}) AS digest FROM documents",
    "implicit_role": f"SELECT capture_id, source_id, CASE WHEN trim(attributes['role']) <> '' THEN attributes['role'] WHEN lower(tag) IN ('a', 'area') THEN CASE WHEN attributes['href'] IS NOT NULL THEN 'link' END WHEN lower(tag) = 'input' THEN CASE WHEN lower(coalesce(attributes['type'], 'text')) IN ('search', 'text') AND attributes['list'] IS NOT NULL THEN 'combobox' ELSE {_map(V.INPUT_ROLES)}[lower(coalesce(attributes['type'], 'text'))] END WHEN lower(tag) = 'select' THEN CASE WHEN attributes['multiple'] IS NOT NULL OR coalesce(TRY_CAST(attributes['size'] AS DOUBLE), 1) > 1 THEN 'listbox' ELSE 'combobox' END WHEN lower(tag) = 'section' THEN CASE WHEN attributes['aria-label'] IS NOT NULL OR attributes['aria-labelledby'] IS NOT NULL THEN 'region' END ELSE {_map(V.TAG_ROLES)}[lower(tag)] END AS implied FROM {DOM}",
    "durable_attributes": f"SELECT capture_id, source_id, e.key AS attribute, e.value AS value FROM (SELECT capture_id, source_id, unnest(map_entries(attributes)) AS e FROM {DOM}) WHERE e.key IN {_in(V.DURABLE)} AND e.value <> ''",
    "url_identity": f"""SELECT capture_id, f.frame_id AS frame_id, CASE WHEN p = '' THEN '/' ELSE p END || q AS route, 'cap_' || CASE WHEN slug = '' THEN 'page' ELSE slug END AS slug
      FROM (SELECT capture_id, f, substr(regexp_replace(regexp_replace(regexp_replace(f.url, '^[A-Za-z]+://', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 96) AS slug, regexp_extract(f.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(f.url, '^[^?#]*(\\?[^#]*)', 1) AS q FROM (SELECT capture_id, unnest(frames) AS f FROM {CAPS}))""",
    "text_back_references": f"SELECT capture_id, dom_source_id, string_agg(source_id, ',' ORDER BY ord, source_id) AS text_source_ids FROM {RUNS} WHERE dom_source_id IS NOT NULL GROUP BY ALL",
    "fuse_claims": f"WITH {CLAIMS} SELECT capture_id, entity, count(DISTINCT source_id) AS sources, count(*) FILTER (trim(role) <> '') + count(*) FILTER (trim(name) <> '') + count(*) FILTER (trim(text) <> '') AS claims FROM cl GROUP BY ALL",
    "fuse_facts": f"WITH {CLAIMS}, {FACTS} SELECT capture_id, entity, fact, value, {r6('CASE WHEN conflict THEN top * 0.5 ELSE top END')} AS confidence, conflict FROM fc",
    "derived_best_match": f"WITH {CLAIMS} SELECT capture_id, source_id, dom_id AS dom_source_id, {r6('iou')} AS iou FROM bi",
    "containment_parent": f"WITH {BOX}, {PARENT} SELECT * FROM par",
    "hierarchy_depth": f"WITH RECURSIVE {BOX}, {PARENT}, {ANC} SELECT par.capture_id, par.node_id, CAST(coalesce(max(distance), 0) AS INTEGER) AS depth FROM par LEFT JOIN anc USING (capture_id, node_id) GROUP BY ALL",
    "descendants": f"WITH RECURSIVE {BOX}, {PARENT}, {ANC} SELECT capture_id, ancestor_id AS node_id, count(*) AS n_descendants FROM anc GROUP BY ALL",
    "region_promotion": f"WITH RECURSIVE {BOX}, {PARENT}, {ANC}, rr AS (SELECT *, CASE role WHEN 'group' THEN 'list' WHEN 'document' THEN 'main' WHEN 'tab' THEN 'grid' WHEN 'combobox' THEN 'form' ELSE role END AS r2 FROM b), rk AS (SELECT *, CASE {' '.join(f'WHEN r2 IN {_in(v)} THEN {chr(39)}{k}{chr(39)}' for k, v in V.REGIONS.items())} END AS region_kind FROM rr) SELECT capture_id, root_id, region_kind, n + 1 AS member_count, CASE WHEN region_kind IN ('list', 'table') THEN kids END AS item_count FROM (SELECT rk.capture_id, rk.node_id AS root_id, region_kind, count(anc.node_id) AS n, count(*) FILTER (distance = 1) AS kids FROM rk LEFT JOIN anc ON anc.capture_id = rk.capture_id AND anc.ancestor_id = rk.node_id WHERE region_kind IS NOT NULL GROUP BY rk.capture_id, rk.node_id, region_kind)",
    "repeated_regions": f"WITH {BOX}, {PARENT}, {SIGS} SELECT capture_id, parent_id, signature, count(*) AS item_count, count(*) FILTER (visibility IN ('visible', 'clipped')) AS visible_item_count, min(node_id) AS first_id, 'sha256:' || sha256(signature) AS pattern_hash FROM sg GROUP BY capture_id, parent_id, signature HAVING count(*) >= 3",
    "reading_next": f"WITH {BOX}, {PARENT}, {NEXT} SELECT * FROM rn",
    "overlaps": f"WITH {BOX}, {PAIRS}, {OVER} SELECT capture_id, from_id, to_id, {r6('iou')} AS iou FROM ov",
    "aligned": f"WITH {BOX}, {PARENT}, {SIGS}, {PAIRS}, {ALIGN} SELECT * FROM al",
    "near_knn": f"WITH {BOX}, {PAIRS}, {NEAR} SELECT * FROM nr",
    "relation_counts": f"WITH {GRAPH} SELECT capture_id, kind, count(*) AS n FROM ed GROUP BY ALL",
    "edge_degree": f"WITH {GRAPH}, {DEG} SELECT * FROM dg",
    "graph_metrics": f"WITH {GRAPH}, {DEG} SELECT n.*, coalesce(e.edges, 0) AS edges, coalesce(m.max_degree, 0) AS max_degree FROM (SELECT capture_id, count(*) AS nodes, count(*) FILTER (role IN {_in(V.INTERACTIVE_ROLES)}) AS interactive, count(x) AS with_geometry FROM b GROUP BY ALL) n LEFT JOIN (SELECT capture_id, count(*) AS edges FROM ed GROUP BY ALL) e USING (capture_id) LEFT JOIN (SELECT capture_id, max(degree) AS max_degree FROM dg GROUP BY ALL) m USING (capture_id)",
    "node_identity": f"""WITH RECURSIVE {CLAIMS}, {FACTS}, {ENTITIES}, b AS (SELECT capture_id, candidate_id AS node_id, frame_id, dx AS x, dy AS y, dw AS w, dh AS h, kind, linkage FROM ec), {PARENT},
      ow AS (SELECT b.capture_id, b.node_id, parent_id, '{{"frameKey":"' || frame_id || '","kind":"' || kind || '","normalizedAncestorIdentity":"' AS head, '","preferredSourceLinkage":["' || array_to_string(linkage, '","') || '"]}}' AS tail FROM b JOIN par USING (capture_id, node_id)),
      id AS (SELECT capture_id, node_id, substr(sha256(head || 'root' || tail), 1, 16) AS identity FROM ow WHERE parent_id IS NULL UNION ALL SELECT ow.capture_id, ow.node_id, substr(sha256(head || id.identity || tail), 1, 16) FROM ow JOIN id ON id.capture_id = ow.capture_id AND id.node_id = ow.parent_id) SELECT capture_id, node_id AS candidate_id, identity FROM id""",
    "node_kind": f"SELECT capture_id, source_id, CASE WHEN lower(role) = 'document' THEN 'document' WHEN lower(role) = 'img' OR lower(tag) = 'img' THEN 'image' WHEN lower(tag) = 'canvas' THEN 'canvas' WHEN lower(role) IN {_in(V.INTERACTIVE_ROLES)} THEN 'control' ELSE 'element' END AS node_kind, CASE WHEN role IS NOT NULL THEN coalesce({_map(V.AFFORDANCE_VERBS)}[role], 'focus') END AS verb FROM {DOM}",
    "locator_hints": f"""WITH d AS {DOM}, hi AS ({_HINTS} UNION ALL SELECT capture_id, source_id, 'role_name', concat_ws(':', frame_id, role, attributes['aria-label']), 'route_version', 0.85, 0.8 FROM d WHERE role IS NOT NULL AND attributes['aria-label'] IS NOT NULL
      UNION ALL SELECT capture_id, source_id, 'structural_path', concat_ws('/', frame_id, coalesce(parent_source_id, 'root'), source_id), 'route_version', 0.9, 0.6 FROM d)
      SELECT capture_id, node_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, kind, value, scope, CAST(uniqueness AS DOUBLE) AS uniqueness, CAST(stability AS DOUBLE) AS stability FROM hi WINDOW w AS (PARTITION BY capture_id, node_id ORDER BY stability DESC, uniqueness DESC, kind, value, scope) QUALIFY row_number() OVER w <= 8""",
    "token_match": f"WITH {STYLE}, {TOKENS}, {MATCH} SELECT capture_id, source_id, property, category, token_ref, status, {r6('delta')} AS delta FROM tm",
    "token_summary": f"WITH {STYLE}, {TOKENS}, {MATCH} SELECT capture_id, count(*) FILTER (status IN ('exact', 'within_tolerance')) AS authoritative, 0 AS advisory, count(*) FILTER (status = 'drift') AS drift, 0 AS excepted FROM tm GROUP BY ALL",
    "token_exceptions": f"WITH {STYLE}, {TOKENS}, {MATCH}, te AS (SELECT capture_id, CASE WHEN status = 'drift' AND (category = 'spacing' AND source_id = 'dom_5' OR category = 'radii') THEN 'excepted' ELSE status END AS status FROM tm) SELECT capture_id, 0 AS authoritative, count(*) FILTER (status IN ('exact', 'within_tolerance', 'excepted')) AS advisory, count(*) FILTER (status = 'drift') AS drift, count(*) FILTER (status = 'excepted') AS excepted FROM te GROUP BY ALL",
    "violations": f"WITH {STYLE}, {TOKENS}, {MATCH}, vi AS (SELECT capture_id, source_id, property, tm.category, tm.token_ref, delta, {r6('CASE WHEN delta IS NOT NULL AND value_num > 0 THEN 0.9 * (0.5 + 0.5 * least(1.0, delta / value_num)) ELSE 0.9 END')} AS severity FROM tm LEFT JOIN tk ON tk.token_ref = tm.token_ref WHERE status = 'drift') SELECT capture_id, source_id, property, category, token_ref, {r6('delta')} AS delta, severity, CAST(row_number() OVER w AS INTEGER) AS rank FROM vi WINDOW w AS (PARTITION BY capture_id ORDER BY severity DESC, source_id, category, property) QUALIFY row_number() OVER w <= 20",
    "saliency": f"WITH {BOX}, {SALIENCY} SELECT * FROM sl",
    "action_map": f"WITH {BOX}, {NAMED} SELECT capture_id, node_id, CAST(row_number() OVER w AS INTEGER) AS rank, role, {_map(V.AFFORDANCE_VERBS)}[role] AS verb, {SAN.format('name')} AS name FROM na WHERE role IN {_in(V.AFFORDANCE_ROLES)} AND visibility IN ('visible', 'clipped') WINDOW w AS (PARTITION BY capture_id ORDER BY node_id) QUALIFY row_number() OVER w <= 40",
    "summary_view": f"WITH RECURSIVE {BOX}, {PARENT}, {ANC}, de AS (SELECT par.capture_id, par.node_id, CAST(coalesce(max(distance), 0) AS INTEGER) AS depth FROM par LEFT JOIN anc USING (capture_id, node_id) GROUP BY ALL), nn AS (SELECT b.*, depth, coalesce(role IN {_in(V.AFFORDANCE_ROLES)}, false) AS act FROM b JOIN de USING (capture_id, node_id)), pa AS (SELECT capture_id, 'affordance' AS part, row_number() OVER (PARTITION BY capture_id ORDER BY node_id) AS rank, node_id, role, depth FROM nn WHERE act UNION ALL SELECT capture_id, 'outline', row_number() OVER (PARTITION BY capture_id ORDER BY depth, node_id), node_id, role, depth FROM nn WHERE NOT act AND depth <= 2) SELECT * FROM pa WHERE rank <= 40",
    "focus_view": f"""WITH {GRAPH}, fe AS (SELECT capture_id, from_id, to_id FROM ed UNION SELECT capture_id, to_id, from_id FROM ed),
      f0 AS (SELECT DISTINCT capture_id, node_id, 0 AS distance FROM b WHERE role = 'checkbox'), f1 AS (SELECT DISTINCT fe.capture_id, fe.to_id AS node_id, 1 AS distance FROM f0 JOIN fe ON fe.capture_id = f0.capture_id AND fe.from_id = f0.node_id),
      f2 AS (SELECT DISTINCT fe.capture_id, fe.to_id AS node_id, 2 AS distance FROM f1 JOIN fe ON fe.capture_id = f1.capture_id AND fe.from_id = f1.node_id), al2 AS (SELECT capture_id, node_id, min(distance) AS distance FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL)
      SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM al2 WINDOW w AS (PARTITION BY capture_id ORDER BY distance, node_id) QUALIFY row_number() OVER w <= 120""",
    "view_budget": f"""WITH {BOX}, {NAMED}, rw AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY node_id) AS rank, concat_ws(' ', node_id, role, {SAN.format('name')}) AS text FROM na WHERE role IN {_in(V.AFFORDANCE_ROLES)}),
      su AS (SELECT capture_id, budget, sum(ceil({_U16.format('text')} / 4.0)) AS tokens, count(*) AS included FROM rw, (VALUES (64), (32), (16), (8), (4), (2), (1)) t(budget) WHERE rank <= budget GROUP BY ALL)
      SELECT capture_id, CAST(max(budget) AS INTEGER) AS budget, CAST(arg_max(tokens, budget) AS BIGINT) AS tokens, arg_max(included, budget) AS included FROM su WHERE tokens <= 120 OR budget = 1 GROUP BY capture_id""",
    "withheld_nodes": f"SELECT view_node_id, CASE WHEN NOT hide THEN name END AS name, CASE WHEN NOT hide THEN text END AS text, hide AS withheld FROM (SELECT *, coalesce(list_has_any(sensitivity, {V.WITHHELD}), false) AS hide FROM {VIEWN})",
    "sensitive_digest": f"SELECT snapshot_ref, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(candidate_id), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM {VIEWN} WHERE list_has_any(sensitivity, {V.FAIL_CLOSED}) AND (trim(coalesce(name, '')) <> '' OR trim(coalesce(text, '')) <> '') GROUP BY ALL",
    "delta_encode": f"WITH {SIDES}, de AS (SELECT coalesce(bb.pair, tt.pair) AS pair, coalesce(bb.node_id, tt.node_id) AS node_id, CASE WHEN tt.node_id IS NULL THEN 'remove_node' ELSE 'upsert_node' END AS op FROM bb FULL JOIN tt ON bb.pair = tt.pair AND bb.node_id = tt.node_id WHERE bb.node_id IS NULL OR tt.node_id IS NULL OR {_CHANGED}) SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY op, node_id) - 1 AS INTEGER) AS seq, op, node_id FROM de",
    "delta_apply": f"WITH {SIDES} SELECT pair, node_id, {', '.join(_PLAIN)} FROM tt",
    "issues": f"""WITH c0 AS (SELECT *, length(capture_id) + ascii(right(capture_id, 1)) AS n FROM {CAPS}),
      c AS (SELECT capture_id, CASE WHEN n % 7 = 0 THEN '2.0.0' ELSE schema_version END AS schema_version, capture_version, repo_owner, repo_name, CASE WHEN n % 5 = 0 THEN ' ' ELSE route END AS route, CASE WHEN n % 6 = 0 THEN 0.0 ELSE viewport.width_css_px END AS vw, viewport, CASE WHEN n % 4 = 0 THEN NULL ELSE redaction.policy_version END AS policy FROM c0),
      d AS (SELECT capture_id, source_id, bounds.x AS x, bounds.y AS y, CASE ord % 50 WHEN 7 THEN -1.0 WHEN 8 THEN 1e9 ELSE bounds.width END AS w, bounds.height AS h FROM {DOM} WHERE bounds IS NOT NULL),
      i0 AS (SELECT *, CASE WHEN item_ord = 3 THEN 'dom_1' ELSE source_id END AS sid FROM derived_items WHERE capture_id IS NOT NULL AND source_id IS NOT NULL),
      i AS (SELECT * FROM i0 QUALIFY row_number() OVER (PARTITION BY capture_id, sid ORDER BY received_at DESC) = 1)
      SELECT capture_id, 'missing_field' AS code, NULL AS source_id FROM c WHERE {' OR '.join(f"trim(coalesce({k}, '')) = ''" for k in ('schema_version', 'capture_version', 'repo_owner', 'repo_name', 'route'))}
      UNION ALL SELECT capture_id, 'unsupported_major', NULL FROM c WHERE split_part(schema_version, '.', 1) <> '1'
      UNION ALL SELECT capture_id, 'invalid_viewport', NULL FROM c WHERE NOT coalesce(vw > 0 AND viewport.height_css_px > 0 AND viewport.device_scale_factor > 0, false)
      UNION ALL SELECT capture_id, 'missing_redaction', NULL FROM c WHERE trim(coalesce(policy, '')) = ''
      UNION ALL SELECT capture_id, CASE WHEN w < 0 OR h < 0 OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'non_finite' ELSE 'overflow' END, source_id FROM d WHERE w < 0 OR h < 0 OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL OR abs(x) > 1e7 OR abs(y) > 1e7 OR w > 1e7 OR h > 1e7
      UNION ALL {_rect(RUNS, 'bounds')} UNION ALL SELECT capture_id, code, sid FROM (SELECT *, CASE WHEN rect_image_px IS NULL THEN NULL WHEN {_RECTBAD.format('rect_image_px')} THEN 'non_finite' WHEN {_RECTFAR.format('rect_image_px')} THEN 'overflow' END AS code FROM i) WHERE code IS NOT NULL
      UNION ALL SELECT capture_id, 'invalid_confidence', sid FROM i WHERE item_ord = 1 OR confidence IS NULL OR NOT isfinite(confidence) OR confidence NOT BETWEEN 0 AND 1
      UNION ALL SELECT capture_id, 'missing_provider', sid FROM i WHERE item_ord = 2 OR trim(coalesce(provider, '')) = '' OR trim(coalesce(provider_version, '')) = ''
      UNION ALL SELECT capture_id, 'invalid_artifact_ref', sid FROM i WHERE item_ord = 4
      UNION ALL SELECT capture_id, 'duplicate_source_id', source_id FROM (SELECT capture_id, source_id FROM {DOM} UNION ALL SELECT capture_id, source_id FROM {AX} UNION ALL SELECT capture_id, source_id FROM {RUNS} UNION ALL SELECT capture_id, sid FROM i) GROUP BY capture_id, source_id HAVING count(*) > 1""",
    "issues_parent": f"WITH d AS (SELECT * FROM {DOM} WHERE ord <> 5) SELECT capture_id, 'missing_parent' AS code, source_id FROM d WHERE parent_source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d p WHERE p.capture_id = d.capture_id AND p.source_id = d.parent_source_id)",
    "issues_cycle": f"WITH RECURSIVE d AS (SELECT capture_id, source_id, CASE ord WHEN 13 THEN 'dom_14' WHEN 14 THEN 'dom_13' ELSE parent_source_id END AS p FROM {DOM}), ok AS (SELECT capture_id, source_id FROM d WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM d q WHERE q.capture_id = d.capture_id AND q.source_id = d.p) UNION SELECT d.capture_id, d.source_id FROM d JOIN ok ON ok.capture_id = d.capture_id AND ok.source_id = d.p) SELECT capture_id, 'parent_cycle' AS code, source_id FROM d WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.capture_id = d.capture_id AND ok.source_id = d.source_id)",
    "cohort_reduction": f"SELECT source AS cohort, {r6('1 - sum(c) / sum(b)')} AS reduction FROM (SELECT source, octet_length(encode(text)) AS b, octet_length(encode(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS c FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "stability_probe": f"WITH {BOX} SELECT capture_id, count(*) AS boxes, CAST(sum(CAST('0x' || substr(sha256(concat_ws(',', node_id, CAST(floor(x * 10 + 0.5) AS BIGINT), CAST(floor(y * 10 + 0.5) AS BIGINT), CAST(floor(w * 10 + 0.5) AS BIGINT), CAST(floor(h * 10 + 0.5) AS BIGINT))), 1, 12) AS BIGINT) % 1000000007) AS BIGINT) AS digest FROM b WHERE x IS NOT NULL GROUP BY ALL",
}

SQL |= {
    "fused_nodes": f"WITH {CLAIMS}, {FACTS}, {ENTITIES} SELECT ec.capture_id, candidate_id, ec.entity, kind, role, name, {r6('coalesce(confidence, CASE WHEN vx IS NOT NULL THEN 0.6 ELSE 0.4 END)')} AS confidence, coalesce(flags, '') AS flags, evidence, visibility FROM ec LEFT JOIN wf USING (capture_id, entity)",
    "mcnemar": """WITH c AS (SELECT source, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only FROM (SELECT source, coalesce(accepted, false) AS a, coalesce(votes > 0, false) AS b FROM documents WHERE source IS NOT NULL) GROUP BY source)
      SELECT source, a_only, b_only, floor(least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) + (a_only + b_only) * ln(0.5))))) * 1e6 + 0.5001) / 1e6 AS p_value FROM c""",
    "evidence_plan": f"""WITH {BOX}, {SALIENCY}, vp AS (SELECT capture_id, viewport.width_css_px AS vw, viewport.height_css_px AS vh FROM {CAPS}),
      c1 AS (SELECT b.capture_id, b.node_id, x, y, w, h, saliency, vp.vw AS vw, vp.vh AS vh, greatest(x, 0.0) AS cx, greatest(y, 0.0) AS cy, least(x + w, vp.vw) - greatest(x, 0.0) AS cw, least(y + h, vp.vh) - greatest(y, 0.0) AS ch FROM b JOIN sl USING (capture_id, node_id) JOIN vp USING (capture_id) WHERE w > 0 AND h > 0),
      c2 AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY saliency DESC, cw * ch, node_id) - 1 AS priority FROM c1 WHERE cw > 0 AND ch > 0),
      c3 AS (SELECT *, greatest(cx - 24, 0.0) AS px, greatest(cy - 24, 0.0) AS py, least(cx + cw + 24, vw) - greatest(cx - 24, 0.0) AS pw, least(cy + ch + 24, vh) - greatest(cy - 24, 0.0) AS ph FROM c2 WHERE priority < 4)
      SELECT capture_id, node_id, CAST(priority AS INTEGER) AS priority, CASE WHEN big THEN 'full_screenshot' ELSE 'crop' END AS kind, {r6('CASE WHEN big THEN 0.0 ELSE px END')} AS x, {r6('CASE WHEN big THEN 0.0 ELSE py END')} AS y, {r6('CASE WHEN big THEN vw ELSE pw END')} AS w, {r6('CASE WHEN big THEN vh ELSE ph END')} AS h,
        concat_ws(',', 'requested_refs', CASE WHEN w * h < 1024 THEN 'small_or_dense_target' END, CASE WHEN saliency >= 0.7 THEN 'high_saliency' END) AS reasons FROM (SELECT *, pw * ph > 0.8 * vw * vh AS big FROM c3)""",
}

_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda t: t <> ''))"
_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_STR = "to_json({0})"


def _json(pairs: list[tuple[str, str, str]]) -> str:
    """A JSON object of (key, column, text) in SQL, without the keys of null columns."""
    return "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '\"{k}\":' || {t} END" for k, c, t in pairs) + ") || '}'"


_PAIRS = f"""{SIDES}, bt AS (SELECT *, {_TOK.format('name')} AS nt FROM bb), tg AS (SELECT *, {_TOK.format('name')} AS nt FROM tt),
ls AS (SELECT b.pair, b.node_id AS base_id, t.node_id AS target_id, floor((0.35 * CAST(coalesce(b.element_ref = t.element_ref, false) AS INTEGER) + 0.15 * CASE WHEN b.role IS NULL AND t.role IS NULL THEN 0.5 ELSE CAST(b.role IS NOT DISTINCT FROM t.role AS INTEGER) END
  + 0.2 * CASE WHEN coalesce(b.name = t.name, false) THEN 1.0 WHEN len(b.nt) = 0 AND len(t.nt) = 0 THEN 0.5 WHEN len(b.nt) = 0 OR len(t.nt) = 0 THEN 0.0 ELSE len(list_intersect(b.nt, t.nt)) / CAST(len(b.nt) + len(t.nt) - len(list_intersect(b.nt, t.nt)) AS DOUBLE) END
  + 0.15 * coalesce(CASE WHEN i > 0 THEN i / (b.viewport_rect.width * b.viewport_rect.height + t.viewport_rect.width * t.viewport_rect.height - i) ELSE 0.0 END, 0.0)
  + 0.1 * CASE WHEN b.parent_node_id IS NULL AND t.parent_node_id IS NULL THEN 0.5 ELSE CAST(b.parent_node_id IS NOT DISTINCT FROM t.parent_node_id AS INTEGER) END + 0.05 * CAST(b.kind IS NOT DISTINCT FROM t.kind AS INTEGER)) * 1e6 + 0.5) / 1e6 AS score
  FROM (SELECT b, t, greatest(0, least(b.viewport_rect.x + b.viewport_rect.width, t.viewport_rect.x + t.viewport_rect.width) - greatest(b.viewport_rect.x, t.viewport_rect.x)) * greatest(0, least(b.viewport_rect.y + b.viewport_rect.height, t.viewport_rect.y + t.viewport_rect.height) - greatest(b.viewport_rect.y, t.viewport_rect.y)) AS i FROM bt b JOIN tg t ON b.pair = t.pair))"""
SQL["lineage_scores"] = f"WITH {_PAIRS} SELECT * FROM ls WHERE score > 0"
_RECT_JSON = "'{\"height\":' || " + _NUM.format("viewport_rect.height") + " || ',\"width\":' || " + _NUM.format("viewport_rect.width") + " || ',\"x\":' || " + _NUM.format("viewport_rect.x") + " || ',\"y\":' || " + _NUM.format("viewport_rect.y") + " || '}'"
_NODE = [("color", "color", _STR.format("color")), ("elementRef", "ref", _STR.format("ref")), ("flags", "flags", _STR.format("flags")), ("fontSizeCssPx", "font_size_css_px", _NUM.format("font_size_css_px")), ("kind", "kind", _STR.format("kind")), ("name", "name", _STR.format("name")), ("nodeId", "node_id", _STR.format("node_id")), ("parentNodeId", "parent_node_id", _STR.format("parent_node_id")), ("role", "role", _STR.format("role")), ("text", "text", _STR.format("text")), ("viewportRect", "viewport_rect", _RECT_JSON)]
_WHOLE = "'{\"nodes\":[' || string_agg(@, ',' ORDER BY node_id) || '],\"schemaVersion\":\"1.0.0\"}'"
_SEAL = f"""sn AS {_one("snapshot_nodes", "snapshot_id, node_id")}, s1 AS (SELECT snapshot_id, sha256({_WHOLE.replace('@', _json([x for x in _NODE if x[0] != 'elementRef']))}) AS scope FROM sn GROUP BY snapshot_id),
  s2 AS (SELECT sn.*, s1.scope, 'ug:' || substr(s1.scope, 1, 8) || ':' || (row_number() OVER (PARTITION BY snapshot_id ORDER BY node_id) - 1) AS ref FROM sn JOIN s1 USING (snapshot_id))"""
SQL["seal_headers"] = f"WITH {_SEAL}, s3 AS (SELECT snapshot_id, scope, sha256({_WHOLE.replace('@', _json(_NODE))}) AS h FROM s2 GROUP BY ALL) SELECT snapshot_id, 'sha256:' || h AS content_hash, 'ugs_1_' || h AS sealed_id, 'sha256:' || scope AS scope_digest FROM s3"
SQL["seal_refs"] = f"WITH {_SEAL} SELECT snapshot_id, node_id, ref AS sealed_ref FROM s2"
SQL["ax_outline"] = f"""WITH RECURSIVE a AS (SELECT *, printf('%07d:%s', coalesce(ord, 0), source_id) AS own FROM {AX} WHERE NOT ignored), tr AS (
  SELECT capture_id, source_id, role, name, 0 AS depth, own AS path FROM a WHERE parent_source_id IS NULL OR parent_source_id = source_id OR NOT EXISTS (SELECT 1 FROM a q WHERE q.capture_id = a.capture_id AND q.source_id = a.parent_source_id)
  UNION ALL SELECT a.capture_id, a.source_id, a.role, a.name, tr.depth + 1, tr.path || '/' || a.own FROM a JOIN tr ON tr.capture_id = a.capture_id AND tr.source_id = a.parent_source_id AND a.source_id <> a.parent_source_id)
  SELECT capture_id, source_id, depth, path, repeat('  ', depth) || coalesce(role, 'generic') || CASE WHEN trim(coalesce(name, '')) <> '' THEN ' "' || {SAN.format('name')} || '"' ELSE '' END AS line FROM tr"""

_IMUL = "((({0}) * (({1}) & 65535) + (((({0}) * (({1}) >> 16)) & 65535) << 16)) & 4294967295)"
_A = "((42 + (k & 4294967295) * 1831565813) & 4294967295)"
SQL["bootstrap_ci"] = f"""WITH m AS (SELECT coalesce(source, 'none') AS cohort, doc_id, CAST(octet_length(encode(text)) AS DOUBLE) AS b, CAST(octet_length(encode(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS DOUBLE) AS c FROM documents WHERE text IS NOT NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY doc_id) - 1 AS j, count(*) OVER (PARTITION BY cohort) AS n FROM m),
  d AS (SELECT cohort, i, n, i * n + j + 1 AS k FROM p, (SELECT unnest(generate_series(0, 1999)) AS i)),
  d0 AS (SELECT cohort, i, n, {_A} AS a FROM d), d1 AS (SELECT cohort, i, n, {_IMUL.format('xor(a, a >> 15)', 'a | 1')} AS t FROM d0),
  d2 AS (SELECT cohort, i, n, xor(t, (t + {_IMUL.format('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS t FROM d1), d3 AS (SELECT cohort, i, CAST(floor(xor(t, t >> 14) / 4294967296.0 * n) AS BIGINT) AS j FROM d2),
  r AS (SELECT d3.cohort, i, CASE WHEN sum(b) > 0 THEN 1 - sum(c) / sum(b) ELSE 0.0 END AS v FROM d3 JOIN p ON p.cohort = d3.cohort AND p.j = d3.j GROUP BY ALL),
  q AS (SELECT cohort, v, row_number() OVER (PARTITION BY cohort ORDER BY v) - 1 AS pos FROM r)
  SELECT cohort, (SELECT {r6('1 - sum(c) / sum(b)')} FROM p WHERE p.cohort = q.cohort) AS point, {r6('max(v) FILTER (pos = 49)')} AS lower, {r6('max(v) FILTER (pos = 1949)')} AS upper, (SELECT count(*) FROM p WHERE p.cohort = q.cohort) AS pairs FROM q GROUP BY cohort"""
SQL["resolve_refs"] = f"""WITH {_SEAL}, cl AS (SELECT snapshot_id, element_ref AS ref FROM sn UNION ALL SELECT snapshot_id, ref FROM s2)
  SELECT snapshot_id, CASE WHEN NOT coalesce(regexp_matches(ref, '^ug:[0-9a-f]{{8}}:[0-9]+$'), false) THEN 'malformed_ref' WHEN (snapshot_id, ref) IN (SELECT snapshot_id, ref FROM s2) THEN 'ok' ELSE 'ref_not_in_snapshot' END AS resolution, count(*) AS n FROM cl GROUP BY ALL"""
