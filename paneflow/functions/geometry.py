"""Column kernels over rectangles and affine transforms (a, b, c, d, e, f: x' = ax + cy + e, y' = bx + dy + f)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_COORD = 1e7
EDGE_EPSILON = 1e-6
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
RECT_TYPE = "struct<x:double,y:double,width:double,height:double>"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable instead of the expression in many places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("width"), h.cast("double").alias("height"))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity, never giving a negative zero."""
    k = 10.0**digits
    return F.floor(c * k + F.lit(0.5)) / F.lit(k) + F.lit(0.0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def in_bounds(c: Column) -> Column:
    return finite(c) & (F.abs(c) <= MAX_COORD)


def rect_issue(r: Column) -> Column:
    """'non_finite' for a missing, infinite or negative number, else 'overflow' beyond the coordinate limit, else null."""
    nums = [r[n] for n in ("x", "y", "width", "height")]
    bad = reduce(lambda a, b: a | b, [~finite(n) for n in nums]) | (r["width"] < 0) | (r["height"] < 0)
    far = reduce(lambda a, b: a | b, [F.abs(n) > MAX_COORD for n in nums])
    return F.when(r.isNull(), None).when(bad, "non_finite").when(far, "overflow")


def valid_affine(t: Column) -> Column:
    """Six finite numbers; only the translation is bounded."""
    return (F.size(t) == 6) & F.forall(t, finite) & in_bounds(F.get(t, F.lit(4))) & in_bounds(F.get(t, F.lit(5)))


def affine(*values: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def compose(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner`` first."""

    def product(pair: Column) -> Column:
        o = [F.get(pair["o"], F.lit(i)) for i in range(6)]
        n = [F.get(pair["n"], F.lit(i)) for i in range(6)]
        return F.array(
            o[0] * n[0] + o[2] * n[1],
            o[1] * n[0] + o[3] * n[1],
            o[0] * n[2] + o[2] * n[3],
            o[1] * n[2] + o[3] * n[3],
            o[0] * n[4] + o[2] * n[5] + o[4],
            o[1] * n[4] + o[3] * n[5] + o[5],
        )

    return bind(F.struct(outer.alias("o"), inner.alias("n")), product)


def transform_rect(t: Column, r: Column) -> Column:
    """Bounding box of the four mapped corners."""

    def box(v: Column) -> Column:
        a, b, c, d, e, f = (F.get(v["t"], F.lit(i)) for i in range(6))
        xs, ys = (v["r"]["x"], v["r"]["x"] + v["r"]["width"]), (v["r"]["y"], v["r"]["y"] + v["r"]["height"])
        px = [a * x + c * y + e for x in xs for y in ys]
        py = [b * x + d * y + f for x in xs for y in ys]
        return rect(F.least(*px), F.least(*py), F.greatest(*px) - F.least(*px), F.greatest(*py) - F.least(*py))

    return bind(F.struct(t.alias("t"), r.alias("r")), box)


def translate(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["width"], r["height"])


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    i = intersection_area(a, b)
    return F.when(i > 0, F.try_divide(i, area(a) + area(b) - i)).otherwise(0.0)


def encloses(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x"] + outer["width"] >= inner["x"] + inner["width"]) & (outer["y"] + outer["height"] >= inner["y"] + inner["height"])


def within_tolerance(value: Column, reference: Column) -> Column:
    """Apart by at most two pixels or half a percent of the reference, whichever is more."""
    return F.abs(value - reference) <= F.greatest(F.lit(2.0), F.abs(reference) * 0.005)


def size_bucket(c: Column) -> Column:
    """The nearest ten."""
    return (F.floor(c / 10 + F.lit(0.5)) * 10).cast("bigint")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def visibility(r: Column, vw: Column, vh: Column, shown: Column) -> Column:
    """hidden, offscreen (nothing of it in the viewport), visible or clipped, of a rectangle relative to the viewport."""
    w = F.least(r["x"] + r["width"], vw) - F.greatest(r["x"], F.lit(0.0))
    h = F.least(r["y"] + r["height"], vh) - F.greatest(r["y"], F.lit(0.0))
    whole = (w >= r["width"] - EDGE_EPSILON) & (h >= r["height"] - EDGE_EPSILON)
    return F.when(~F.coalesce(shown, F.lit(True)) | r.isNull(), "hidden").when((w <= 0) | (h <= 0), "offscreen").when(whole, "visible").otherwise("clipped")


def visible_part(r: Column, vw: Column, vh: Column) -> Column:
    """The part of a rectangle inside the viewport, or null."""
    x0, y0 = F.greatest(r["x"], F.lit(0.0)), F.greatest(r["y"], F.lit(0.0))
    x1, y1 = F.least(r["x"] + r["width"], vw), F.least(r["y"] + r["height"], vh)
    return F.when((x1 > x0) & (y1 > y0), rect(x0, y0, x1 - x0, y1 - y0))


def normalized_in_viewport(r: Column, vw: Column, vh: Column) -> Column:
    """The rectangle in shares of the viewport, if all of them lie in [0, 1]."""
    n = rect(F.try_divide(r["x"], vw), F.try_divide(r["y"], vh), F.try_divide(r["width"], vw), F.try_divide(r["height"], vh))
    ok = reduce(lambda a, b: a & b, [n[k].between(0.0, 1.0) for k in ("x", "y", "width", "height")])
    return F.when(ok, n)


def _climb(frames: Column, frame_id: Column) -> Column:
    """Struct (at, t, lost) after climbing from a frame through an array of frames: where it ended (null at the top), the transform so far, whether a frame was unknown."""
    start = F.struct(frame_id.alias("at"), affine(*IDENTITY).alias("t"), F.lit(False).alias("lost"))

    def up(acc: Column, _: Column) -> Column:
        def step(f: Column) -> Column:
            own = F.coalesce(f["transform_to_parent"], affine(*IDENTITY))
            return F.struct(f["parent_frame_id"].alias("at"), F.when(f.isNotNull(), compose(own, acc["t"])).otherwise(acc["t"]).alias("t"), (acc["lost"] | f.isNull()).alias("lost"))

        return F.when(acc["at"].isNull(), acc).otherwise(bind(F.get(F.filter(frames, lambda x: x["frame_id"] == acc["at"]), F.lit(0)), step))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(frames))), start, up)


def frame_transform(frames: Column, frame_id: Column) -> Column:
    """Transform from a frame to the document, composed up the chain of parents in an array of frames.

    A frame without transform stands where its parent does; an unknown parent stands at the document. A frame that is
    unknown, or whose chain runs in a cycle, has the identity.
    """
    return bind(_climb(frames, frame_id), lambda done: F.when(done["at"].isNull(), done["t"]).otherwise(affine(*IDENTITY)))


def frame_cycle(frames: Column, frame_id: Column) -> Column:
    """Whether the chain of parents of a frame runs in a cycle."""
    return bind(_climb(frames, frame_id), lambda done: done["at"].isNotNull() & ~done["lost"])
