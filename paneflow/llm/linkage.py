"""Matching entities across sources without keys, by a label model.

Derived rows (vision boxes, read text) and page elements of a capture meet in a hierarchical grid. Heuristic matching
functions vote on each candidate pair: 1, -1 or nothing. A generative model learns, from the votes alone, how often each
function is right and how correlated ones vote together, and gives the posterior that a pair is a match. Each item is
fused with its best element if the posterior says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.functions import geometry as G
from paneflow.llm.text_forms import Forms, build_table, normalized
from paneflow.session import cut, release, small, small_rows
from paneflow.sources.tables import latest

# Words of detectors for kinds of widgets, and what pages call them.
CLASS_GROUPS = {
    "button": "button btn cta push_button",
    "link": "link hyperlink anchor",
    "cell": "cell table_cell td",
    "heading": "heading title header_text",
    "tab": "tab tab_item nav_item",
    "textbox": "textbox input text_field form-input",
    "checkbox": "checkbox check tick_box",
    "combobox": "combobox combo select dropdown",
    "img": "img image picture icon",
    "overlay": "popup toast container bar legend",
}
TAG_GROUPS = {"button": "button", "a": "link", "td": "cell", "th": "cell", "h1": "heading", "h2": "heading", "h3": "heading", "input": "textbox", "textarea": "textbox", "select": "combobox", "img": "img", "div": "tab"}
WIDGET_TAGS = ("button", "a", "td", "th", "h1", "h2", "h3", "h4", "input", "textarea", "select", "img", "label", "summary", "option", "li")


# Texts that a busy widget shows in place of its own.
BUSY = "^(?:loading|please wait|working|wait|busy|saving|[^\\p{L}\\p{N}]*)[.…]*$"


@dataclass(frozen=True)
class LinkSpec:
    cell_width: float = 256.0
    cell_height: float = 128.0
    #: Each level's cells are four times as wide and high as those of the one below.
    levels: int = 8
    margin: float = 16.0
    rounds: int = 60
    #: Posterior from which a pair is a match.
    accept: float = 0.5


#: Votes, in blocks within which the model learns all correlations; blocks are independent given the truth.
BLOCKS = (("overlap", "offset", "size"), ("text",), ("role", "widget"))


def _lookup(groups: dict[str, str], word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for g, ws in groups.items() for w in ws.split() for x in (w, g)]), F.lower(word))


def elements(dom: DataFrame, ax: DataFrame, runs: DataFrame, captures: DataFrame) -> DataFrame:
    """Visible elements with document rectangle, group of role and the texts that name them.

    The latest delivery of each element holds; of rows that name elements, all deliveries count and repeats count once.
    Elements that are hidden, without bounds or without area cannot be shown.
    """
    caps = latest(captures.where("capture_id is not null").select("capture_id", "received_at", "frames"), ["capture_id"], "received_at", ["frames"]).select("capture_id", "frames")
    slim = dom.where("capture_id is not null and source_id is not null").withColumns({"label": F.element_at("attributes", "aria-label"), "input_type": F.element_at("attributes", "type")})
    d = latest(slim, ["capture_id", "source_id"], "received_at", ["frame_id", "ord", "parent_source_id", "role", "tag", "label", "input_type", "bounds", "visible"]).drop("received_at")
    # a box around a widget has other elements than icons inside it
    boxes = d.where("parent_source_id is not null and lower(coalesce(tag, '')) <> 'svg'").select("capture_id", F.col("parent_source_id").alias("source_id"), F.lit(True).alias("box")).distinct()
    d = d.where("visible and bounds.width > 0 and bounds.height > 0 and lower(coalesce(tag, '')) not in ('body', 'html', 'canvas')")
    d = d.join(small(caps), "capture_id", "left").withColumn("rect", F.when(F.col("frames").isNull(), F.col("bounds")).otherwise(G.transform_rect(G.frame_transform(F.col("frames"), F.col("frame_id")), F.col("bounds"))))
    # repeated deliveries of an accessibility row or a run say the same, so what they say of an element needs no latest one
    a = ax.where("capture_id is not null and source_id is not null and backend_dom_source_id is not null")
    a = a.groupBy("capture_id", F.col("backend_dom_source_id").alias("source_id")).agg(F.min("role").alias("ax_role"), F.min(F.when(F.trim("name") != "", F.col("name"))).alias("ax_name"))
    r = runs.where("capture_id is not null and source_id is not null and dom_source_id is not null and text is not null and text <> '[redacted]'").groupBy("capture_id", F.col("dom_source_id").alias("source_id")).agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("run_text"))
    e = d.join(a, ["capture_id", "source_id"], "left").join(r, ["capture_id", "source_id"], "left").join(boxes, ["capture_id", "source_id"], "left")
    tag = F.lower(F.coalesce("tag", F.lit("")))
    label = F.col("label")
    group = F.coalesce(
        F.when(tag == "input", F.when(F.lower(F.coalesce("role", "ax_role", F.col("input_type"), F.lit(""))).isin("checkbox", "radio", "switch"), "checkbox").otherwise("textbox")),
        F.element_at(F.create_map(*[F.lit(x) for kv in TAG_GROUPS.items() for x in kv]), F.when(tag != "div", tag)),
        _lookup(CLASS_GROUPS, F.coalesce("role", "ax_role")),
        F.when(tag == "div", "tab"),
    )
    named = F.coalesce(F.col("ax_name"), label, F.col("run_text")).isNotNull()
    widget = F.when(tag == "svg", -1).when(tag.isin(*WIDGET_TAGS) | named | F.col("ax_role").isNotNull() | F.col("role").isNotNull() | F.col("box").isNull(), 1).otherwise(-1)
    return e.select("capture_id", F.col("source_id").alias("dom_source_id"), "ord", "rect", group.alias("group"), F.coalesce("ax_role", "role").alias("role"), F.coalesce("ax_name", label, "run_text").alias("name"), widget.alias("widget"), F.array_compact(F.array("ax_name", label, "run_text")).alias("names"))


def items(derived: DataFrame, captures: DataFrame) -> DataFrame:
    """Vision and read-text rows with rectangle in document CSS px; the image shows the viewport, scrolled, at the device scale."""
    view = latest(captures.where("capture_id is not null").select("capture_id", "received_at", "viewport"), ["capture_id"], "received_at", ["viewport"]).select("capture_id", "viewport")
    one = latest(derived.where("capture_id is not null and source_id is not null and kind in ('vision_parser', 'ocr')"), ["capture_id", "source_id"], "received_at", ["kind", "rect_image_px", "class", "text", "confidence", "provider"])
    r, v = F.col("rect_image_px"), F.col("viewport")
    s = F.when(v["device_scale_factor"] > 0, v["device_scale_factor"])
    box = G.rect(r["x"] / s + F.coalesce(v["scroll_x_css_px"], F.lit(0.0)), r["y"] / s + F.coalesce(v["scroll_y_css_px"], F.lit(0.0)), r["width"] / s, r["height"] / s)
    return one.join(small(view), "capture_id").withColumn("box", box).where("box.width > 0 and box.height > 0").select("capture_id", F.col("source_id").alias("item_source_id"), "kind", "box", F.col("class").alias("item_class"), F.col("text").alias("item_text"), F.col("confidence").alias("item_confidence"), "provider")


def candidates(found: DataFrame, page: DataFrame, spec: LinkSpec = LinkSpec()) -> DataFrame:
    """Pairs of an item and each element of its capture over whose surroundings the item's centre lies.

    An element is entered at the level of the grid where it covers a few cells, an item with its centre at every level;
    so nothing is missed, no element is entered many times, and a capture with a third of all rows is spread by cell.
    """
    m, cw, ch = spec.margin, spec.cell_width, spec.cell_height
    r = F.col("rect")
    # one row for each level in use, at most ``levels`` of them
    level = F.least(F.lit(spec.levels), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((r["width"] + 2 * m) / cw, (r["height"] + 2 * m) / ch)) / 2)).cast("int"))
    used = sorted(x[0] for x in page.select(level.alias("level")).distinct().collect()) or [0]
    e = page.withColumn("level", level).withColumn("k", F.pow(F.lit(4.0), F.col("level")))
    cells = lambda lo, hi, c: F.sequence(F.floor(lo / (F.col("k") * c)), F.floor(hi / (F.col("k") * c)))
    e = e.withColumn("gx", F.explode(cells(r["x"] - m, r["x"] + r["width"] + m, cw))).withColumn("gy", F.explode(cells(r["y"] - m, r["y"] + r["height"] + m, ch))).drop("k")
    b = F.col("box")
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    i = found.withColumn("level", F.explode(F.array(*[F.lit(x) for x in used]))).withColumn("gx", F.floor(cx / (cw * F.pow(F.lit(4.0), F.col("level"))))).withColumn("gy", F.floor(cy / (ch * F.pow(F.lit(4.0), F.col("level")))))
    near = (cx >= r["x"] - m) & (cx <= r["x"] + r["width"] + m) & (cy >= r["y"] - m) & (cy <= r["y"] + r["height"] + m)
    return i.join(e, ["capture_id", "level", "gx", "gy"]).where(near).drop("level", "gx", "gy")


def _with_loose_runs(page: DataFrame, runs: DataFrame, captures: DataFrame, spec: LinkSpec) -> DataFrame:
    """Elements with the texts of runs that lost their link: each goes to the smallest widget that holds its centre."""
    caps = latest(captures.where("capture_id is not null").select("capture_id", "received_at", "frames"), ["capture_id"], "received_at", ["frames"]).select("capture_id", "frames")
    unlinked = "capture_id is not null and source_id is not null and dom_source_id is null and text is not null and text <> '[redacted]' and bounds.width > 0 and bounds.height > 0"
    r = latest(runs.where(unlinked), ["capture_id", "source_id"], "received_at", ["frame_id", "text", "bounds"]).join(small(caps), "capture_id")
    r = r.select("capture_id", F.col("source_id").alias("run"), "text", G.transform_rect(G.frame_transform(F.col("frames"), F.col("frame_id")), F.col("bounds")).alias("box"))
    held = candidates(r, page.where("widget > 0").select("capture_id", "dom_source_id", "rect"), spec)
    b, e = F.col("box"), F.col("rect")
    held = held.where((G.intersection_area(b, e) >= 0.8 * G.area(b)) & (b["height"] < e["height"] + 4))
    owner = held.groupBy("capture_id", "run").agg(F.min_by(F.struct("dom_source_id", "text"), F.struct(G.area(e), "dom_source_id")).alias("o"))
    texts = cut(owner.groupBy("capture_id", F.col("o.dom_source_id").alias("dom_source_id")).agg(F.array_sort(F.collect_set("o.text")).alias("loose")))
    return page.join(small_rows(texts), ["capture_id", "dom_source_id"], "left").withColumn("names", F.concat("names", F.coalesce("loose", F.array().cast("array<string>")))).withColumn("name", F.coalesce("name", F.get("loose", F.lit(0)))).drop("loose")


def lower_forms(table: dict[str, str]):
    """A function of an array of texts: the distinct looks and displays of all of them, in lower case. No row leaves its place for it."""

    @F.pandas_udf("array<string>")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Forms(table)
        for s in parts:
            yield s.map(lambda names: list(dict.fromkeys(x.lower() for n in names if n is not None for x in (f.all(n)[1], f.all(n)[0]))) if names is not None else [])

    return forms


def vote(pairs: DataFrame) -> DataFrame:
    """The votes of each matching function, and a score that breaks ties between elements of equal posterior."""
    b, r = F.col("box"), F.col("rect")
    read = F.col("kind") == "ocr"
    overlap = G.iou(b, r)
    held = F.try_divide(G.intersection_area(b, r), G.area(b))
    dx, dy = F.abs(b["x"] + b["width"] / 2 - r["x"] - r["width"] / 2), F.abs(b["y"] + b["height"] / 2 - r["y"] - r["height"] / 2)
    left = b["x"] - r["x"]
    wide, high = F.try_divide(b["width"], r["width"]), F.try_divide(b["height"], r["height"])
    three = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    near = lambda a, n: F.lit(1.0) - F.levenshtein(a, n) / F.greatest(F.length(a), F.length(n), F.lit(1))
    # text that was read may break off: its like is then the beginning of the name
    begun = lambda a, n: F.when((F.length(a) >= 4) & (F.length(n) > F.length(a)), near(a, F.substring(n, 1, F.length(a))) - 0.1).otherwise(0.0)
    similar = F.array_max(F.transform("names", lambda n: F.greatest(*[F.coalesce(f(F.col(c), n), F.lit(0.0)) for c in ("said", "shown") for f in (near, begun)])))
    out = pairs.withColumn("similar", F.when(~F.col("said").rlike(BUSY), similar)).withColumn("overlap_share", F.when(read, held).otherwise(overlap))
    group = _lookup(CLASS_GROUPS, F.col("item_class"))
    return out.withColumns(
        {
            "v_overlap": F.when(read, three(held >= 0.8, held < 0.5)).otherwise(three(overlap >= 0.5, overlap < 0.25)),
            "v_offset": F.when(read, three((dy <= 0.2 * r["height"] + 3) & left.between(-6.0, 40.0), (dy > 0.45 * r["height"] + 4) | (left < -14) | (left > 60))).otherwise(three((dx <= 0.06 * r["width"] + 10) & (dy <= 0.35 * r["height"] + 3), (dx > 0.15 * r["width"] + 24) | (dy > 0.6 * r["height"] + 6))),
            "v_size": F.when(read, three(high.between(0.28, 0.85) & (wide <= 1.1), (high < 0.2) | (high > 1.3) | (wide > 1.4))).otherwise(three(wide.between(0.8, 1.25) & high.between(0.8, 1.25), (wide < 0.6) | (wide > 1.7) | (high < 0.6) | (high > 1.7))),
            "v_text": F.coalesce(three(F.col("similar") >= 0.6, F.col("similar") < 0.4), F.lit(0)),
            "v_role": F.when(group.isNull() | F.col("group").isNull(), 0).when(group == F.col("group"), 1).otherwise(-1),
            "v_widget": F.col("widget"),
            "score": F.coalesce("similar", F.lit(0.5)) + F.when(read, held - dy / (r["height"] + 1)).otherwise(overlap),
        }
    )


class LabelModel:
    """Truth and votes: P(match), and P(votes of a block | match or not), learned by expectation maximization.

    It starts from the majority of the votes. The number of vote patterns is bounded (three to the number of
    functions), whatever the number of pairs.
    """

    def __init__(self, blocks: tuple[tuple[int, ...], ...]):
        self.blocks = blocks

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Posterior of a match for each row of votes (patterns x functions)."""
        if not len(patterns):
            return np.zeros(0)
        codes = []
        for block in self.blocks:
            _, code = np.unique(patterns[:, block], axis=0, return_inverse=True)
            codes.append(code.ravel())
        total = patterns.sum(1) + 0.5 * (patterns > 0).all(1)
        p = 1 / (1 + np.exp(-1.5 * (total - 1.0)))
        n = counts.astype(float)
        self.tables = []
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            logit = np.full(len(p), np.log(prior / (1 - prior)))
            self.tables = []
            for code in codes:
                size = code.max() + 1
                yes, no = np.bincount(code, n * p, size) + 0.1, np.bincount(code, n * (1 - p), size) + 0.1
                yes, no = yes / yes.sum(), no / no.sum()
                self.tables.append((yes, no))
                logit += np.log(yes[code] / no[code])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return p


def match(derived: DataFrame, dom: DataFrame, ax: DataFrame, runs: DataFrame, captures: DataFrame, spec: LinkSpec = LinkSpec()) -> tuple[DataFrame, DataFrame]:
    """(matches, elements): capture_id, dom_source_id, item_source_id, confidence; and the elements matched against.

    An item has one element at most: the one of greatest posterior, ties by score, then by order. Null keys, boxes
    without area and captures without viewport match nothing; repeated rows count once; empty tables give no rows.
    """
    spark = derived.sparkSession
    table = build_table(spark)
    # only captures with derived rows can have matches: the others' rows leave before the first shuffle
    busy = small(derived.where("capture_id is not null and kind in ('vision_parser', 'ocr')").select("capture_id").distinct())
    dom, ax, runs = (t.join(busy, "capture_id", "left_semi") for t in (dom, ax, runs))
    page = cut(elements(dom, ax, runs, captures))
    release(spark)
    page = _with_loose_runs(page, runs, captures, spec)
    release(spark)
    # the texts are compared by look and by display, in lower case
    slim = page.select("capture_id", "dom_source_id", "ord", "rect", "group", "widget", lower_forms(table)("names").alias("names"))
    found = items(derived, captures)
    read = normalized(found.select("item_text").where("item_text is not null").distinct(), "item_text", table, "tf").select("item_text", F.lower("tf.look").alias("said"), F.when(F.lower("tf.display") != F.lower("tf.look"), F.lower("tf.display")).alias("shown"))
    found = found.select("capture_id", "item_source_id", "kind", "box", "item_class", "item_text").join(small(read), "item_text", "left").drop("item_text").na.fill("", ["said"])
    votes = [f"v_{x}" for b in BLOCKS for x in b]
    voted = cut(vote(candidates(found, slim, spec)).select("capture_id", "item_source_id", "dom_source_id", "ord", "kind", "score", *votes))
    at = iter(range(len(votes)))
    blocks = tuple(tuple(next(at) for _ in b) for b in BLOCKS)
    counted = voted.groupBy("kind", *votes).count().collect()  # at most two times three to the number of functions
    rows = []
    for kind in ("vision_parser", "ocr"):
        mine = sorted((tuple(r[n] for n in votes), r["count"]) for r in counted if r["kind"] == kind)
        post = LabelModel(blocks).fit(np.asarray([m[0] for m in mine]).reshape(len(mine), len(votes)), np.asarray([m[1] for m in mine]), spec.rounds)
        rows += [(kind, *m[0], float(p)) for m, p in zip(mine, post)]
    posterior = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{n} int" for n in votes) + ", confidence double")
    scored = voted.join(F.broadcast(posterior), ["kind", *votes]).where(F.col("confidence") >= spec.accept)
    best = scored.groupBy("capture_id", "item_source_id").agg(F.max(F.struct("confidence", "score", -F.col("ord"), "dom_source_id")).alias("m"))
    return best.select("capture_id", F.col("m.dom_source_id").alias("dom_source_id"), "item_source_id", F.col("m.confidence").alias("confidence")), page


def link(derived: DataFrame, dom: DataFrame, ax: DataFrame, runs: DataFrame, captures: DataFrame, spec: LinkSpec = LinkSpec()) -> DataFrame:
    """Fused matches: capture_id, dom_source_id, item_source_id, role, name, viewport_rect, evidence, confidence.

    evidence holds both rows with their own confidence. Cases as in ``match``.
    """
    matches, page = match(derived, dom, ax, runs, captures, spec)
    own = items(derived, captures).select("capture_id", "item_source_id", "kind", "item_text", "item_confidence")
    full = matches.join(page.select("capture_id", "dom_source_id", "role", "name", "rect"), ["capture_id", "dom_source_id"]).join(own, ["capture_id", "item_source_id"])
    claim = lambda kind, i, c: F.struct(kind.alias("source_type"), i.alias("source_id"), c.alias("confidence"))
    return full.select(
        "capture_id", "dom_source_id", "item_source_id", "role", F.coalesce("name", "item_text").alias("name"), F.col("rect").alias("viewport_rect"),
        F.array(claim(F.lit("dom"), F.col("dom_source_id"), F.lit(0.9)), claim(F.col("kind"), F.col("item_source_id"), F.col("item_confidence"))).alias("evidence"), "confidence",
    )
