"""From observation tables to normalized, fused nodes (sources, projections, normalization, fusion)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow import schemas as S
from paneflow.functions import geometry as G
from paneflow.functions.text import canonical_color, css_length_px
from paneflow.session import small
from paneflow.sources.tables import latest

#: What fusion reads of a derived row.
DERIVED = ["obs_ord", "item_ord", "kind", "provider", "provider_version", "source_image_ref", "rect_image_px", "text", "confidence"]


def lookup(table: dict, key: Column, default=None) -> Column:
    m = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return m if default is None else F.coalesce(m, F.lit(default))


def rows_of(df: DataFrame, *keys: str, carry: list[str] | None = None) -> DataFrame:
    """The latest delivery of each observation, with the columns ``carry`` or all; a table without delivery times is taken as it is."""
    keys = list(keys) or ["capture_id", "source_id"]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    return latest(known, keys, "received_at", carry=carry).drop("received_at") if "received_at" in df.columns else known


def implicit_role(tag: Column, attributes: Column) -> Column:
    """The explicit role attribute, else what tag and attributes imply; null where neither says.

    A link needs an address, a section a name; an input with a list of its own is a combobox; a select of several rows
    is a listbox; headers and footers depend on where they stand, so they say nothing.
    """
    t = F.lower(tag)
    has = lambda name: F.element_at(attributes, name).isNotNull()
    kind = F.lower(F.coalesce(F.element_at(attributes, "type"), F.lit("text")))
    own = F.element_at(attributes, "role")
    rows = F.coalesce(F.trim(F.element_at(attributes, "size")).try_cast("double"), F.lit(1.0))
    implied = (
        F.when(t.isin("a", "area"), F.when(has("href"), "link"))
        .when(t == "input", F.when(kind.isin("search", "text") & has("list"), "combobox").otherwise(lookup(S.INPUT_ROLES, kind)))
        .when(t == "select", F.when(has("multiple") | (rows > 1), "listbox").otherwise("combobox"))
        .when(t == "section", F.when(has("aria-label") | has("aria-labelledby"), "region"))
        .otherwise(lookup(S.TAG_ROLES, t))
    )
    return F.coalesce(F.when(F.trim(own) != "", own), implied)


def durable_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: k.isin(*S.DURABLE_ATTRIBUTES) & (v != ""))


def normalize_dom(dom: DataFrame, captures: DataFrame) -> DataFrame:
    """DOM rows with document, viewport and normalized rectangle and visibility. Rows of unknown captures are left out."""
    caps = rows_of(captures, "capture_id").select("capture_id", "viewport", "frames")
    d = rows_of(dom).join(small(caps), "capture_id")
    v = F.col("viewport")
    doc = F.when(F.col("bounds").isNotNull(), G.transform_rect(G.frame_transform(F.col("frames"), F.col("frame_id")), F.col("bounds")))
    d = d.withColumn("document_rect", doc).withColumn("viewport_rect", G.translate(F.col("document_rect"), -v["scroll_x_css_px"], -v["scroll_y_css_px"]))
    d = d.withColumn("viewport_rect", F.when(F.col("document_rect").isNotNull(), F.col("viewport_rect")))
    return d.withColumn("normalized_rect", G.normalized_in_viewport(F.col("viewport_rect"), v["width_css_px"], v["height_css_px"])).withColumn("visibility", G.visibility(F.col("viewport_rect"), v["width_css_px"], v["height_css_px"], F.col("visible"))).drop("frames")


def normalize_runs(runs: DataFrame, captures: DataFrame) -> DataFrame:
    """Text runs with document and viewport rectangle, visibility, match key, and whether they are redacted. Rows of unknown captures are left out."""
    caps = rows_of(captures, "capture_id").select("capture_id", "viewport", "frames", F.col("redaction.redacted_source_ids").alias("redacted_ids"))
    r = rows_of(runs)
    r = r if "bounds" in r.columns else r.withColumn("bounds", F.lit(None).cast(G.RECT_TYPE))
    r = r.join(small(caps), "capture_id")
    v = F.col("viewport")
    r = r.withColumn("document_rect", F.when(F.col("bounds").isNotNull(), G.transform_rect(G.frame_transform(F.col("frames"), F.col("frame_id")), F.col("bounds"))))
    r = r.withColumn("viewport_rect", F.when(F.col("document_rect").isNotNull(), G.translate(F.col("document_rect"), -v["scroll_x_css_px"], -v["scroll_y_css_px"])))
    r = r.withColumn("redacted", F.coalesce(F.array_contains("redacted_ids", F.col("source_id")), F.lit(False)))
    return r.withColumn("visibility", G.visibility(F.col("viewport_rect"), v["width_css_px"], v["height_css_px"], F.lit(True))).drop("frames", "redacted_ids")


def styles_of(dom: DataFrame) -> DataFrame:
    """Typed style of each DOM row, one row per fact: colours in canonical form, lengths in CSS px."""
    facts = rows_of(dom).select("capture_id", "source_id", F.explode("style_facts").alias("property", "fact"))
    color = F.col("property").rlike("(?i)colou?r")
    return facts.select("capture_id", "source_id", "property", F.when(color, canonical_color(F.col("fact.s"))).alias("color"), F.when(~color, css_length_px(F.col("fact.s"), F.col("fact.n"))).alias("value_css_px"))


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with a null string for each named column that it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns}) if set(names) - set(df.columns) else df


def derived_boxes(derived: DataFrame, captures: DataFrame) -> DataFrame:
    """Vision and OCR rows with box (CSS px, null without a scale), viewport, frames and the frame that the image shows.

    The image is of the page, so its frame is the one without parent. Rows of unknown captures are kept, without a box.
    """
    caps = rows_of(captures, "capture_id").select("capture_id", "viewport", "frames")
    i = rows_of(with_columns(derived, DERIVED), carry=DERIVED).where("kind in ('vision_parser', 'ocr')").join(small(caps), "capture_id", "left")
    r, dsf = F.col("rect_image_px"), F.col("viewport.device_scale_factor")
    page = F.get(F.filter("frames", lambda f: f["parent_frame_id"].isNull()), F.lit(0))["frame_id"]
    box = F.when((dsf > 0) & r.isNotNull(), G.rect(r["x"] / dsf, r["y"] / dsf, r["width"] / dsf, r["height"] / dsf))
    return i.withColumns({"box": box, "frame_id": F.coalesce(page, F.lit("root"))})


def visual_geometry(derived: DataFrame, captures: DataFrame) -> DataFrame:
    """Geometry of derived rows that stand alone: the box through the chain of frames, less the scroll, as the reference has it."""
    v = F.col("viewport")
    w, h = v["width_css_px"], v["height_css_px"]
    d = derived_boxes(derived, captures).where("box is not null").withColumn("document_rect", G.transform_rect(G.frame_transform(F.col("frames"), F.col("frame_id")), F.col("box")))
    d = d.withColumn("viewport_rect", G.translate(F.col("document_rect"), -v["scroll_x_css_px"], -v["scroll_y_css_px"]))
    r = F.col("viewport_rect")
    shown = G.visible_part(r, w, h)
    cut = (shown["width"] < r["width"] - G.EDGE_EPSILON) | (shown["height"] < r["height"] - G.EDGE_EPSILON)
    normalized = G.rect(F.try_divide(r["x"], w), F.try_divide(r["y"], h), F.try_divide(r["width"], w), F.try_divide(r["height"], h))
    return d.select("capture_id", "source_id", "document_rect", "viewport_rect", normalized.alias("normalized_rect"), F.when(shown.isNull(), "offscreen").when(cut, "clipped").otherwise("visible").alias("visibility"), "viewport")


def derived_best_match(derived: DataFrame, dom_norm: DataFrame, captures: DataFrame, threshold: float = 0.5, cell: float = 128.0, include_hidden: bool = False) -> DataFrame:
    """capture_id, source_id, dom_source_id, iou: the DOM row that overlaps each derived row most, if by ``threshold``.

    Rows meet in the cells of a grid that both cover, so nothing that overlaps is missed. Ties go to DOM order.
    """
    caps = rows_of(captures, "capture_id").select("capture_id", F.col("viewport.device_scale_factor").alias("dsf"))
    r = F.col("rect_image_px")
    item = rows_of(with_columns(derived, DERIVED), carry=DERIVED).where("kind in ('vision_parser', 'ocr')").join(small(caps), "capture_id").where("dsf > 0").select("capture_id", "source_id", G.rect(r["x"] / F.col("dsf"), r["y"] / F.col("dsf"), r["width"] / F.col("dsf"), r["height"] / F.col("dsf")).alias("box"))
    page = dom_norm.where("viewport_rect is not null" if include_hidden else "visible and viewport_rect is not null").select("capture_id", F.col("source_id").alias("dom_source_id"), F.col("ord"), F.col("viewport_rect").alias("rect"))
    cells = lambda df, c: grid_cells(df, F.col(c), cell)
    pairs = cells(item, "box").join(cells(page, "rect"), ["capture_id", "gx", "gy"]).withColumn("iou", G.iou(F.col("box"), F.col("rect"))).where(F.col("iou") >= threshold)
    best = pairs.groupBy("capture_id", "source_id").agg(F.max(F.struct("iou", -F.col("ord"), "dom_source_id")).alias("b"))
    return best.select("capture_id", "source_id", "b.dom_source_id", "b.iou")


def grid_cells(df: DataFrame, r: Column, cell: Column | float) -> DataFrame:
    """One row for each grid cell (gx, gy) that a rectangle touches."""
    c = cell if isinstance(cell, Column) else F.lit(cell)
    df = df.withColumn("gx", F.explode(F.sequence(F.floor(r["x"] / c), F.floor((r["x"] + r["width"]) / c))))
    return df.withColumn("gy", F.explode(F.sequence(F.floor(r["y"] / c), F.floor((r["y"] + r["height"]) / c))))
