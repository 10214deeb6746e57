"""Design-token projection, saliency, evidence planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow import schemas as S
from paneflow.operators.observe import lookup

#: Style properties and the category of tokens they are held against.
CATEGORY = {"color": "color", "background-color": "color", "font-size": "typography", "line-height": "typography", "border-radius": "radii", "margin-top": "spacing", "padding-left": "spacing"}


def design_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.DESIGN_TOKENS, "token_ref string, category string, value_str string, value_num double")


def observations(styles: DataFrame) -> DataFrame:
    """Style facts that tokens speak about, one per row, with their category."""
    return styles.withColumn("category", lookup(CATEGORY, F.col("property"))).where("category is not null")


def match_tokens(styles: DataFrame, tokens: DataFrame, exceptions: DataFrame | None = None, absolute: float = 0.5, relative: float = 0.02) -> DataFrame:
    """capture_id, source_id, property, category, token_ref, status, delta of each observation whose category has tokens.

    Colours match exactly (first token by name) or drift; numbers go to the nearest token (ties by name): exact,
    within_tolerance (half a px or 2 % of the observed value) or drift. Unreadable observations give no row. The
    profile is a bounded design artefact: it is collapsed to one sorted array per category and broadcast.
    """
    obs = observations(styles)
    by = tokens.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("token_ref", "value_str", "value_num"))).alias("tokens"))
    j = obs.join(F.broadcast(by), "category")
    color = F.col("category") == "color"
    same = F.get(F.filter("tokens", lambda t: t["value_str"] == F.col("color")), F.lit(0))["token_ref"]
    nearest = F.array_min(F.transform("tokens", lambda t: F.struct(F.abs(t["value_num"] - F.col("value_css_px")).alias("delta"), t["token_ref"].alias("token_ref"))))
    j = j.where(F.when(color, F.col("color").isNotNull()).otherwise(F.col("value_css_px").isNotNull())).withColumn("n", F.when(~color, nearest))
    delta = F.when(~color, F.col("n.delta"))
    tol = F.greatest(F.lit(absolute), F.abs("value_css_px") * relative)
    status = F.when(color, F.when(same.isNotNull(), "exact").otherwise("drift")).otherwise(F.when(delta == 0, "exact").when(delta <= tol, "within_tolerance").otherwise("drift"))
    out = j.select("capture_id", "source_id", "property", "category", F.when(color, F.coalesce(same, F.lit("category:color"))).otherwise(F.col("n.token_ref")).alias("token_ref"), status.alias("status"), delta.alias("delta"))
    if exceptions is None:
        return out
    # rules are few: the first that applies (null means any) turns drift into excepted
    rules = exceptions.agg(F.array_sort(F.collect_list(F.struct("rule_ord", "category", "source_id", "reason"))).alias("rules"))
    hit = F.get(F.filter("rules", lambda r: F.coalesce(r["category"] == F.col("category"), F.lit(True)) & F.coalesce(r["source_id"] == F.col("source_id"), F.lit(True))), F.lit(0))
    return out.crossJoin(F.broadcast(rules)).withColumn("rule", hit).withColumn("status", F.when((F.col("status") == "drift") & F.col("rule").isNotNull(), "excepted").otherwise(F.col("status"))).drop("rules", "rule")


def token_summary(matches: DataFrame, authoritative: bool) -> DataFrame:
    """Counts of each capture: authoritative or advisory matches, drift, excepted."""
    ok = F.col("status").isin("exact", "within_tolerance", "excepted")
    return matches.groupBy("capture_id").agg(F.count_if(ok & F.lit(authoritative)).alias("authoritative"), F.count_if(ok & ~F.lit(authoritative)).alias("advisory"), F.count_if(F.col("status") == "drift").alias("drift"), F.count_if(F.col("status") == "excepted").alias("excepted"))


def violations(matches: DataFrame, tokens: DataFrame, confidence: float = 0.9, budget: int | None = None) -> DataFrame:
    """Drift ranked within each capture: severity (confidence, scaled by delta against the token) desc, then id, category."""
    canonical = F.broadcast(tokens.select("token_ref", "value_num"))
    d = matches.where("status = 'drift'").join(canonical, "token_ref", "left")
    severity = F.when(F.col("delta").isNotNull() & (F.col("value_num") > 0), confidence * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("delta") / F.col("value_num")))).otherwise(F.lit(confidence))
    d = d.withColumn("severity", F.floor(severity * 1e6 + 0.5) / 1e6)
    cols = ["capture_id", "source_id", "property", "category", "token_ref", "delta", "severity"]
    if budget is None:
        return d.select(*cols)
    rank = F.row_number().over(W.partitionBy("capture_id").orderBy(F.desc("severity"), "source_id", "category", "property"))
    return d.withColumn("rank", rank).where(F.col("rank") <= budget).select(*cols, "rank")


def saliency(nodes: DataFrame) -> DataFrame:
    """capture_id, node_id, saliency: high on the page, central, large and of a telling role scores more.

    The viewport is the greatest extent of the capture's rectangles, 1 px at least.
    """
    size = nodes.groupBy("capture_id").agg(F.greatest(F.lit(1.0), F.max(F.col("x") + F.col("w"))).alias("vw"), F.greatest(F.lit(1.0), F.max(F.col("y") + F.col("h"))).alias("vh"))
    n = nodes.join(size, "capture_id")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    weight = lookup(S.SALIENCY_WEIGHTS, F.col("role"), 0.3)
    top = clamp(1 - F.col("y") / F.col("vh"))
    middle = clamp(1 - F.abs((F.col("x") + F.col("w") / 2) / F.col("vw") - 0.5) * 2)
    large = clamp(F.sqrt(F.col("w") * F.col("h") / F.greatest(F.lit(1.0), F.col("vw") * F.col("vh"))))
    score = F.when(F.col("x").isNull(), clamp(0.1 + 0.1 * weight)).otherwise(clamp(0.35 * top + 0.2 * middle + 0.25 * large + 0.2 * weight))
    return n.select("capture_id", "node_id", (F.floor(score * 1e6 + 0.5) / 1e6).alias("saliency"))


def evidence_plan(nodes: DataFrame, viewports: DataFrame, padding: float = 24.0, top: int = 4, full: float = 0.8) -> DataFrame:
    """Crops to ask for: the ``top`` nodes of each capture by saliency, then small area, then id.

    A rectangle is clipped to the viewport, padded and clipped again; a crop of more than ``full`` of it is the whole
    screenshot. Nodes without area, or outside the viewport, are refused.
    """
    n = nodes.where("w > 0 and h > 0").join(saliency(nodes), ["capture_id", "node_id"]).join(viewports, "capture_id")
    clip = lambda x, y, w, h: (F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0)), F.least(x + w, F.col("view_w")), F.least(y + h, F.col("view_h")))
    x0, y0, x1, y1 = clip(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    n = n.withColumns({"cx": x0, "cy": y0, "cw": x1 - x0, "ch": y1 - y0}).where("cw > 0 and ch > 0")
    rank = F.row_number().over(W.partitionBy("capture_id").orderBy(F.desc("saliency"), F.col("cw") * F.col("ch"), "node_id"))
    n = n.withColumn("priority", rank - 1).where(F.col("priority") < top)
    p = padding
    a, b, c, d = clip(F.col("cx") - p, F.col("cy") - p, F.col("cw") + 2 * p, F.col("ch") + 2 * p)
    n = n.withColumns({"px": a, "py": b, "pw": c - a, "ph": d - b})
    whole = F.col("pw") * F.col("ph") > full * F.col("view_w") * F.col("view_h")
    reasons = F.concat_ws(",", F.lit("requested_refs"), F.when(F.col("w") * F.col("h") < 1024, F.lit("small_or_dense_target")), F.when(F.col("saliency") >= 0.7, F.lit("high_saliency")))
    pick = lambda c, z: F.when(whole, z).otherwise(F.col(c))
    return n.select("capture_id", "node_id", "priority", F.when(whole, "full_screenshot").otherwise("crop").alias("kind"), pick("px", F.lit(0.0)).alias("x"), pick("py", F.lit(0.0)).alias("y"), pick("pw", F.col("view_w")).alias("w"), pick("ph", F.col("view_h")).alias("h"), reasons.alias("reasons"))
