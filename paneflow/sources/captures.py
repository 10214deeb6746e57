"""Sources and sinks of captures: JSON and Parquet tables, raw layout payloads, and a generator of synthetic pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow import schemas as S
from paneflow.functions.geometry import rect, round_half_up
from paneflow.operators.observe import durable_attributes, implicit_role

# Fixed values of the capture side: tags without rendered content, the styles that are read and the facts that they
# become, values that say that a style was never set, states that are kept, roles that only repeat a text.
SKIPPED_TAGS = ["base", "head", "link", "meta", "noscript", "script", "style", "template", "title"]
STYLE_FACTS = {
    "color": "color", "background-color": "backgroundColor", "font-family": "fontFamily", "font-size": "fontSize", "font-weight": "fontWeight", "line-height": "lineHeight", "opacity": "opacity", "display": "display", "position": "position",
    "border-top-left-radius": "borderRadiusTopLeft", "border-top-right-radius": "borderRadiusTopRight", "border-bottom-right-radius": "borderRadiusBottomRight", "border-bottom-left-radius": "borderRadiusBottomLeft",
    "margin-top": "marginTop", "margin-right": "marginRight", "margin-bottom": "marginBottom", "margin-left": "marginLeft", "padding-top": "paddingTop", "padding-right": "paddingRight", "padding-bottom": "paddingBottom", "padding-left": "paddingLeft", "row-gap": "rowGap", "column-gap": "columnGap",
}
INERT_STYLES = {"lineHeight": "normal", "rowGap": "normal", "columnGap": "normal"}
AX_STATES = ["checked", "disabled", "expanded", "focusable", "focused", "haspopup", "invalid", "level", "modal", "multiline", "multiselectable", "pressed", "readonly", "required", "selected", "valuemax", "valuemin", "valuetext"]
TEXT_LEAF_ROLES = ["StaticText", "InlineTextBox", "LineBreak"]
MASK = "[redacted]"


def read_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of JSON lines under its fixed schema; unknown fields are dropped, missing ones null, broken lines left out."""
    return spark.read.schema(S.TABLES[name]).option("mode", "DROPMALFORMED").json(path)


def write_views(df: DataFrame, path: str, by: str = "snapshot_id", form: str = "json") -> None:
    df.write.mode("overwrite").partitionBy(by).format(form).save(path)


def decode_layout(raw: DataFrame, non_rendered: bool = False) -> DataFrame:
    """Elements of raw layout payloads: parallel arrays with a string table and sparse columns, to rows.

    raw: capture_id, doc_ord, strings array<string>, node_type array<int>, node_name array<int>, parent array<int>,
    backend array<bigint>, layout_node array<int>, layout_bounds array<array<double>>, visibility array<int>.
    Of several layout rows of a node the first counts. Elements of skipped tags, or without layout (unless ``non_rendered``), give no row.
    """
    string = lambda i: F.when(i >= 0, F.get("strings", i))
    node = raw.select("capture_id", "doc_ord", "strings", F.posexplode(F.arrays_zip("node_type", "node_name", "parent", "backend")).alias("idx", "n"))
    node = node.select("capture_id", "doc_ord", "idx", F.col("n.node_type").alias("node_type"), F.lower(string(F.col("n.node_name"))).alias("tag"), F.col("n.parent").alias("parent_idx"), F.col("n.backend").alias("backend_id"))
    lay = raw.select("capture_id", "doc_ord", "strings", F.posexplode(F.arrays_zip("layout_node", "layout_bounds", "visibility")).alias("l", "y"))
    lay = lay.groupBy("capture_id", "doc_ord", F.col("y.layout_node").alias("idx")).agg(F.min_by(F.struct(F.col("y.layout_bounds").alias("b"), string(F.col("y.visibility")).alias("v")), "l").alias("box"))
    kept = node.where((F.col("node_type") == 1) & ~F.col("tag").isin(*SKIPPED_TAGS) & F.col("backend_id").isNotNull()).join(lay, ["capture_id", "doc_ord", "idx"], "left" if non_rendered else "inner")
    at = lambda i: round_half_up(F.get("box.b", F.lit(i)), 2)
    shown = (at(2) > 0) & (at(3) > 0) & ~F.coalesce(F.col("box.v"), F.lit("")).isin("hidden", "collapse")
    return kept.select("capture_id", "doc_ord", "idx", "tag", "parent_idx", "backend_id", F.when(F.col("box.b").isNotNull(), rect(at(0), at(1), at(2), at(3))).alias("bounds"), F.coalesce(shown, F.lit(False)).alias("visible"))


def emitted(elements: DataFrame, budget: int = 4000) -> DataFrame:
    """Elements within the capture's budget in document order, with source ids by ordinal: the budget bounds each group."""
    order = W.partitionBy("capture_id").orderBy("doc_ord", "idx")
    return elements.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < budget).withColumn("source_id", F.concat(F.lit("dom_"), F.col("ord").cast("string")))


def over_budget(elements: DataFrame, budget: int = 4000, reason: str = "node_budget") -> DataFrame:
    """Captures whose elements exceed the budget, with the reason for being partial."""
    return elements.groupBy("capture_id").agg(F.count("*").alias("n")).where(F.col("n") > budget).select("capture_id", F.lit(reason).alias("reason"))


def style_projection(styles: Column) -> Column:
    """Style facts by their names, without empty values and those that say that the style was never set. ``styles`` maps CSS names to values."""
    named = F.transform_keys(F.map_filter(styles, lambda k, v: k.isin(*STYLE_FACTS)), lambda k, v: F.element_at(F.create_map(*[F.lit(x) for kv in STYLE_FACTS.items() for x in kv]), k))
    inert = lambda k, v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in INERT_STYLES.items() for x in kv]), k) == v, F.lit(False))
    return F.map_filter(named, lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~inert(k, v))


def state_projection(state: Column) -> Column:
    """Accessibility states of the allowed names, scalars only."""
    return F.map_filter(state, lambda k, v: k.isin(*AX_STATES) & v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))


def recombine_text(boxes: DataFrame) -> DataFrame:
    """Text runs from line boxes: capture_id, text_node, start, length, text, x, y, w, h -> one row per node.

    The run is the slice from the least start to the greatest end, white space collapsed; empty runs are left out.
    """
    g = boxes.groupBy("capture_id", "text_node").agg(
        F.min("start").alias("a"), F.max(F.col("start") + F.col("length")).alias("z"), F.first("text", ignorenulls=True).alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
    )
    run = F.trim(F.regexp_replace(F.substring("text", F.col("a") + 1, F.col("z") - F.col("a")), r"\s+", " "))
    return g.select("capture_id", "text_node", run.alias("text"), rect(F.col("x"), F.col("y"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("bounds")).where("text <> ''")


def redact(runs: DataFrame, redacted: DataFrame) -> DataFrame:
    """Runs of redacted elements (capture_id, dom_source_id; their descendants included by the caller) with the mask for text."""
    hit = redacted.select("capture_id", "dom_source_id").distinct().withColumn("hit", F.lit(True))
    return runs.join(hit, ["capture_id", "dom_source_id"], "left").withColumn("text", F.when(F.col("hit"), F.lit(MASK)).otherwise(F.col("text"))).drop("hit")


def frame_offsets(documents: DataFrame, owners: DataFrame) -> DataFrame:
    """Child frames with parent frame and offset: documents (capture_id, frame_id, owner_backend_id) and the boxes of the
    elements that own them (capture_id, backend_id, frame_id, bounds)."""
    o = owners.select("capture_id", F.col("backend_id").alias("owner_backend_id"), F.col("frame_id").alias("parent_frame_id"), "bounds")
    j = documents.join(o, ["capture_id", "owner_backend_id"], "left")
    t = F.when(F.col("bounds").isNotNull(), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("bounds.x"), F.col("bounds.y")))
    return j.select("capture_id", "frame_id", "parent_frame_id", t.alias("transform_to_parent"))


def nearest_emitted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """capture_id, idx, ancestor_idx: the nearest ancestor of each kept row that is kept, at any depth; rows without one are left out."""
    up = _paths(rows)
    known = kept.select("capture_id", F.col("idx").alias("at"))
    best = up.join(known, ["capture_id", "at"]).groupBy("capture_id", "idx").agg(F.min_by("at", "d").alias("ancestor_idx"))
    return best.join(kept.select("capture_id", "idx"), ["capture_id", "idx"], "left_semi")


def _paths(rows: DataFrame) -> DataFrame:
    """capture_id, idx, d, at: the ancestors of each row of a tree by index; -1 and null are no parents."""
    from paneflow.operators.structure import paths

    tree = rows.select("capture_id", F.col("idx").cast("string").alias("node_id"), F.when(F.col("parent_idx") >= 0, F.col("parent_idx").cast("string")).alias("parent_id"))
    up = paths(tree).select("capture_id", F.col("node_id").cast("int").alias("idx"), F.posexplode("path").alias("d", "at"))
    return up.withColumn("at", F.col("at").cast("int"))


def redacted_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """capture_id, idx of the rows (capture_id, idx, parent_idx, backend_id) that are a redacted root (capture_id, backend_id) or below one."""
    hit = rows.join(roots.select("capture_id", "backend_id").distinct(), ["capture_id", "backend_id"], "left_semi").select("capture_id", "idx")
    below = _paths(rows).join(hit.withColumnRenamed("idx", "at"), ["capture_id", "at"], "left_semi").select("capture_id", "idx")
    return hit.unionByName(below).distinct()


def frame_ids(frames: DataFrame) -> DataFrame:
    """capture_id, frame_id, path, place of each frame (capture_id, frame_id, parent_frame_id, ord) in pre-order of the tree of frames."""
    from paneflow.operators.structure import paths

    own = frames.select("capture_id", "frame_id", F.format_string("%09d", F.coalesce("ord", F.lit(0))).alias("own"))
    up = paths(frames.select("capture_id", F.col("frame_id").alias("node_id"), F.col("parent_frame_id").alias("parent_id"))).select("capture_id", F.col("node_id").alias("frame_id"), F.posexplode_outer("path").alias("d", "at"))
    above = up.join(own.select("capture_id", F.col("frame_id").alias("at"), F.col("own").alias("o")), ["capture_id", "at"], "left").groupBy("capture_id", "frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "o"))), lambda x: x["o"]), "/").alias("above"))
    p = own.join(above, ["capture_id", "frame_id"]).select("capture_id", "frame_id", F.concat_ws("/", F.nullif("above", F.lit("")), "own").alias("path"))
    return p.withColumn("place", F.row_number().over(W.partitionBy("capture_id").orderBy("path", "frame_id")) - 1)


def collect_ax(trees: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, reasons): accessibility rows of all frames' trees with ids that name their frame; a reason for each frame that gave no tree."""
    rows = trees.withColumns({"source_id": F.concat_ws("_", "frame_id", "source_id"), "parent_source_id": F.when(F.col("parent_source_id").isNotNull(), F.concat_ws("_", "frame_id", "parent_source_id"))})
    lost = frames.select("capture_id", "frame_id").join(trees.select("capture_id", "frame_id").distinct(), ["capture_id", "frame_id"], "left_anti")
    return rows, lost.select("capture_id", F.concat(F.lit("accessibility tree unavailable for frame "), "frame_id").alias("reason"))


def join_accessibility(ax: DataFrame, dom: DataFrame) -> DataFrame:
    """Accessibility rows (capture_id, frame_id, ord, source_id, parent_source_id, role, name, description, state, ignored, backend_id) joined to elements by backend id.

    Rows of no element that are ignored, or only repeat a text, are dropped; a parent stays only if its row does. Ids
    count the rows that stay, in their order.
    """
    known = dom.select("capture_id", "backend_id", F.col("source_id").alias("backend_dom_source_id"))
    j = ax.join(known, ["capture_id", "backend_id"], "left")
    kept = j.where(F.col("backend_dom_source_id").isNotNull() | (~F.coalesce("ignored", F.lit(False)) & ~F.coalesce("role", F.lit("")).isin(*TEXT_LEAF_ROLES)))
    n = kept.withColumn("id", F.concat(F.lit("ax_"), (F.row_number().over(W.partitionBy("capture_id").orderBy("ord", "source_id")) - 1).cast("string")))
    up = n.select("capture_id", F.col("source_id").alias("parent_source_id"), F.col("id").alias("parent"))
    out = n.join(up, ["capture_id", "parent_source_id"], "left")
    return out.select("capture_id", "frame_id", "ord", F.col("id").alias("source_id"), F.col("parent").alias("parent_source_id"), "role", "name", "description", state_projection(F.col("state")).alias("state"), "ignored", "backend_dom_source_id")


def capture_tables(raw: DataFrame, texts: DataFrame, ax: DataFrame, roots: DataFrame, max_nodes: int = 4000, max_text_runs: int = 4000, non_rendered: bool = False) -> dict[str, DataFrame]:
    """dom_nodes, text_runs, ax_nodes, reasons and redacted ids from raw payloads, in one plan.

    raw: as for ``decode_layout``, one document for each capture and doc_ord, with ``attributes`` (map) and ``styles``
    (map) by node in arrays of the same length; texts: line boxes as for ``recombine_text`` with parent_idx and doc_ord;
    ax: as for ``join_accessibility``; roots: (capture_id, backend_id) of redacted elements, whose descendants are
    redacted too. The budgets are shared by the documents of a capture, and a capture beyond one is partial.
    """
    each = decode_layout(raw, non_rendered)
    at = F.col("doc_ord").cast("bigint") * (1 << 24)
    tree = raw.select("capture_id", "doc_ord", F.posexplode(F.arrays_zip("parent", "backend")).alias("i", "n")).select("capture_id", (at + F.col("i")).cast("int").alias("idx"), F.when(F.col("n.parent") >= 0, at + F.col("n.parent")).cast("int").alias("parent_idx"), F.col("n.backend").alias("backend_id"))
    facts = raw.select("capture_id", "doc_ord", F.posexplode(F.arrays_zip("attributes", "styles")).alias("idx", "f"))
    e = emitted(each, max_nodes).join(facts, ["capture_id", "doc_ord", "idx"], "left").withColumn("idx", (at + F.col("idx")).cast("int"))
    parents = nearest_emitted(tree, e.select("capture_id", "idx")).join(e.select("capture_id", F.col("idx").alias("ancestor_idx"), F.col("source_id").alias("parent_source_id")), ["capture_id", "ancestor_idx"])
    attributes = F.coalesce("f.attributes", F.create_map().cast("map<string,string>"))
    frame = F.concat(F.lit("frame_"), F.col("doc_ord").cast("string"))
    dom = e.join(parents.select("capture_id", "idx", "parent_source_id"), ["capture_id", "idx"], "left").select(
        "capture_id", frame.alias("frame_id"), "ord", "idx", "backend_id", "source_id", "parent_source_id", implicit_role(F.col("tag"), attributes).alias("role"), "tag", durable_attributes(attributes).alias("attributes"), "bounds", "visible",
        F.transform_values(style_projection(F.coalesce("f.styles", F.create_map().cast("map<string,string>"))), lambda k, v: F.struct(v.alias("s"), F.lit(None).cast("double").alias("n"))).alias("style_facts"),
    )
    hidden = redacted_rows(tree, roots)
    runs = recombine_text(texts.withColumn("text_node", (at + F.col("text_node")).cast("int")))
    owner = texts.select("capture_id", (at + F.col("text_node")).cast("int").alias("text_node"), (at + F.col("parent_idx")).cast("int").alias("idx"), "doc_ord").distinct()
    runs = runs.join(owner, ["capture_id", "text_node"]).join(dom.select("capture_id", "idx", F.col("source_id").alias("dom_source_id")), ["capture_id", "idx"], "left").join(hidden.withColumn("hit", F.lit(True)), ["capture_id", "idx"], "left")
    placed = runs.withColumn("ord", F.row_number().over(W.partitionBy("capture_id").orderBy("text_node")) - 1)
    kept = placed.where(F.col("ord") < max_text_runs)
    text = kept.select("capture_id", F.concat(F.lit("frame_"), F.col("doc_ord").cast("string")).alias("frame_id"), "ord", F.concat(F.lit("text_"), F.col("ord").cast("string")).alias("source_id"), F.when(F.col("hit"), MASK).otherwise(F.col("text")).alias("text"), "dom_source_id", "bounds", F.coalesce("hit", F.lit(False)).alias("redacted"))
    reasons = over_budget(each, max_nodes).unionByName(over_budget(placed, max_text_runs, "text_run_budget"))
    return {"dom_nodes": dom.drop("idx"), "text_runs": text.drop("redacted"), "ax_nodes": join_accessibility(ax, dom), "reasons": reasons, "redacted": text.where("redacted").select("capture_id", "source_id")}


def stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """capture_id, stable, reason of two probes (capture_id, digest) of each page: unstable where they differ, unverified where one is missing."""
    j = first.select("capture_id", F.col("digest").alias("a")).join(second.select("capture_id", F.col("digest").alias("b")), "capture_id", "full")
    told = F.when(F.col("a").isNull() | F.col("b").isNull(), "stability unverified").when(F.col("a") != F.col("b"), "layout changed between probes")
    return j.select("capture_id", told.isNull().alias("stable"), told.alias("reason"))


def synthetic_pages(spark: SparkSession, captures: int, nav: int = 6, cards: int = 6, rows: int = 24, fields: int = 4) -> DataFrame:
    """DOM rows of synthetic pages: banner, navigation, cards, a table, a form, a footer. ``captures`` is the scale knob."""
    one: list[tuple] = [("body", None, 0, 0, 1440, 1100), ("header", None, 0, 0, 1440, 72), ("a", "link", 24, 20, 140, 32), ("nav", None, 190, 12, 700, 48)]
    one += [("a", "link", 200 + 112 * i, 20, 100, 32) for i in range(nav)] + [("button", "link", 1264, 18, 152, 36), ("main", None, 0, 72, 1440, 960), ("h1", None, 24, 88, 600, 40), ("ul", None, 24, 140, 1392, 170)]
    for i in range(cards):
        one += [("li", None, 24 + 228 * i, 144, 216, 160), ("a", "link", 36 + 228 * i, 260, 120, 28)]
    one += [("table", None, 24, 336, 1344, 28 * (rows + 1))]
    for r in range(rows):
        one += [("tr", None, 24, 336 + 28 * r, 1344, 28)] + [("td", None, 24 + 448 * c, 336 + 28 * r, 440, 28) for c in range(3)]
    one += [("form", None, 24, 1040, 700, 50)] + [("input", "textbox", 32 + 160 * i, 1046, 150, 36) for i in range(fields)] + [("button", "button", 680, 1046, 100, 36), ("footer", None, 0, 1096, 1440, 60)]
    shape = spark.createDataFrame([(i, t, r, float(x), float(y), float(w), float(h)) for i, (t, r, x, y, w, h) in enumerate(one)], "ord int, tag string, role string, x double, y double, w double, h double")
    ids = spark.range(captures).select(F.format_string("cap_%07d", "id").alias("capture_id"))
    page = ids.crossJoin(F.broadcast(shape))  # the page is a constant of some 130 rows
    return page.select("capture_id", F.lit("main").alias("frame_id"), "ord", F.concat(F.lit("dom_"), F.col("ord").cast("string")).alias("source_id"), F.when(F.col("ord") > 0, "dom_0").alias("parent_source_id"), F.coalesce("role", implicit_role(F.col("tag"), F.create_map(F.lit("href"), F.lit("/")))).alias("role"), "tag", F.create_map().cast("map<string,string>").alias("attributes"), rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bounds"), F.lit(True).alias("visible"))
