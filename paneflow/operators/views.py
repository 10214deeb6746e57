"""Pieces of views over a capture's nodes: summary, focus, action map, outlines, hints, and what they withhold. ``query`` answers whole requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow import schemas as S
from paneflow.functions.text import sanitize, token_estimate
from paneflow.operators.observe import lookup
from paneflow.session import cut


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each capture, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("capture_id").orderBy(*order))).where(F.col("rank") <= k)


def affordance(role: Column, disabled: Column | None = None) -> Column:
    verb = F.when(role.isNotNull(), lookup(S.AFFORDANCE_VERBS, role, "focus"))
    return verb if disabled is None else F.when(~F.coalesce(disabled, F.lit(False)), verb)


def node_kind(role: Column, tag: Column, kind: Column) -> Column:
    r, t = F.lower(role), F.lower(tag)
    return F.when(r == "document", "document").when((r == "img") | (t == "img"), "image").when(t == "canvas", "canvas").when(kind == "text", "text").when(kind == "visual", "visual_candidate").when(r.isin(*S.INTERACTIVE_ROLES), "control").otherwise("element")


def action_map(nodes: DataFrame, k: int = 40) -> DataFrame:
    """Visible affordances of each capture by id, k at most: role, verb, sanitised name, normalized rectangle."""
    n = nodes.where(F.col("role").isin(*S.AFFORDANCE_ROLES) & F.col("visibility").isin("visible", "clipped"))
    return top_k(n, k, "node_id").select("capture_id", "node_id", "rank", "role", affordance(F.col("role")).alias("verb"), sanitize(F.col("name")).alias("name"))


def summary_view(nodes: DataFrame, depth: DataFrame, k: int = 40) -> DataFrame:
    """Affordances (k by id) and, without them, the outline down to depth 2 (k by depth and id) of each capture."""
    n = nodes.join(depth.select("capture_id", "node_id", "depth"), ["capture_id", "node_id"])
    acts = F.col("role").isin(*S.AFFORDANCE_ROLES)
    a = top_k(n.where(acts), k, "node_id").withColumn("part", F.lit("affordance"))
    o = top_k(n.where(~F.coalesce(acts, F.lit(False)) & (F.col("depth") <= 2)), k, "depth", "node_id").withColumn("part", F.lit("outline"))
    return a.unionByName(o).select("capture_id", "part", "rank", "node_id", "role", "depth")


def reach(edges: DataFrame, start: DataFrame, radius: int = 2) -> DataFrame:
    """capture_id, node_id, distance of the nodes within ``radius`` edges of the start, in any direction. Each step joins the newly reached nodes only."""
    e = cut(edges.select("capture_id", "from_id", "to_id").distinct())
    seen = front = cut(start.select("capture_id", "node_id").distinct().withColumn("distance", F.lit(0)))
    for d in range(1, radius + 1):
        there, back = (front.select("capture_id", F.col("node_id").alias(a)).join(e, ["capture_id", a]).select("capture_id", F.col(b).alias("node_id")) for a, b in (("from_id", "to_id"), ("to_id", "from_id")))
        step = there.unionByName(back).distinct()
        front = cut(step.join(seen.select("capture_id", "node_id"), ["capture_id", "node_id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def focus_view(edges: DataFrame, refs: DataFrame, radius: int = 2, budget: int = 120) -> DataFrame:
    """capture_id, node_id, distance, rank: nodes within ``radius`` edges of the refs, nearest first to ``budget``."""
    return top_k(reach(edges, refs, radius), budget, "distance", "node_id").select("capture_id", "node_id", "distance", "rank")


def locator_hints(nodes: DataFrame, k: int = 8) -> DataFrame:
    """Hints to find a node again, those that outlive the session, by stability, uniqueness and kind; k at most.

    Input: capture_id, node_id, frame_id, parent_id, role, name, text, attributes.
    """
    attr = [F.when(F.element_at("attributes", a) != "", F.struct((-F.lit(s)).alias("s"), (-F.lit(u)).alias("u"), F.lit(kind).alias("kind"), F.element_at("attributes", a).alias("value"), F.lit(scope).alias("scope"))) for a, kind, scope, u, s in S.ATTRIBUTE_HINTS]
    hint = lambda kind, value, u, s: F.struct((-F.lit(s)).alias("s"), (-F.lit(u)).alias("u"), F.lit(kind).alias("kind"), value.alias("value"), F.lit("route_version").alias("scope"))
    own = [
        F.when(F.col("role").isNotNull() & F.col("name").isNotNull(), hint("role_name", F.concat_ws(":", "frame_id", "role", "name"), 0.85, 0.8)),
        F.when(F.col("text") != "", hint("text", F.concat(F.lit("sha256:"), F.substring(F.sha2("text", 256), 1, 32)), 0.55, 0.5)),
        hint("structural_path", F.concat_ws("/", "frame_id", F.coalesce("parent_id", F.lit("root")), "node_id"), 0.9, 0.6),
    ]
    best = F.slice(F.array_sort(F.array_compact(F.array(*attr, *own))), 1, k)
    out = nodes.select("capture_id", "node_id", F.posexplode(best).alias("rank", "h"))
    return out.select("capture_id", "node_id", "rank", "h.kind", "h.value", "h.scope", (-F.col("h.u")).alias("uniqueness"), (-F.col("h.s")).alias("stability"))


def withheld(rows: DataFrame, labels: str = "sensitivity") -> DataFrame:
    """Name and text blanked where the labels say so, with the flag for it."""
    hide = F.coalesce(F.arrays_overlap(F.col(labels), F.array(*[F.lit(x) for x in S.WITHHELD])), F.lit(False))
    return rows.withColumns({"name": F.when(~hide, F.col("name")), "text": F.when(~hide, F.col("text")), "withheld": hide})


def sensitive_digest(rows: DataFrame, group: str) -> DataFrame:
    """Nodes whose labels forbid it but that still carry text: count and a digest of their ids, per group."""
    bad = rows.where(F.arrays_overlap(F.col("sensitivity"), F.array(*[F.lit(x) for x in S.FAIL_CLOSED])) & ((F.trim(F.coalesce("name", F.lit(""))) != "") | (F.trim(F.coalesce("text", F.lit(""))) != "")))
    # order-free, so that no group is gathered in one place: the sum of the ids' hashes
    h = F.conv(F.substring(F.sha2(F.col("candidate_id"), 256), 1, 8), 16, 10).cast("bigint")
    return bad.groupBy(group).agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def budget_of(sizes: DataFrame, max_tokens: int, max_nodes: int) -> DataFrame:
    """The largest of the halved node budgets whose text fits: every budget is tried at once.

    Input: capture_id, rank, text of rows in order; budgets are max_nodes, half of it, and so on down to 1.
    """
    budgets = [max_nodes]
    while budgets[-1] > 1:
        budgets.append(max(1, budgets[-1] // 2))
    t = sizes.withColumn("tokens", token_estimate(F.col("text"))).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("rank <= budget")
    sums = t.groupBy("capture_id", "budget").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("included"))
    return sums.where((F.col("tokens") <= max_tokens) | (F.col("budget") == 1)).groupBy("capture_id").agg(F.max(F.struct("budget", "tokens", "included")).alias("b")).select("capture_id", "b.budget", "b.tokens", "b.included")


def ax_outline(ax: DataFrame) -> DataFrame:
    """capture_id, source_id, depth, path, line of the accessibility tree, indented by depth; by path the lines are in pre-order.

    Ignored nodes are left out and their children become roots; so does a node that names itself its parent. Ties of order go by id.
    """
    from paneflow.operators.observe import rows_of
    from paneflow.operators.structure import ancestors

    n = cut(rows_of(ax).where("not ignored").select("capture_id", F.col("source_id").alias("node_id"), F.col("parent_source_id").alias("p"), "role", "name", F.format_string("%07d:%s", F.coalesce("ord", F.lit(0)), "source_id").alias("own")))
    known = n.select("capture_id", F.col("node_id").alias("p"), F.lit(True).alias("k"))
    parents = n.join(known, ["capture_id", "p"], "left").select("capture_id", "node_id", F.when(F.col("k") & (F.col("p") != F.col("node_id")), F.col("p")).alias("parent_id"))
    above = ancestors(parents).join(n.select("capture_id", F.col("node_id").alias("ancestor_id"), "own"), ["capture_id", "ancestor_id"])
    path = above.groupBy("capture_id", "node_id").agg(F.concat_ws("/", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "own"))), lambda x: x["own"])).alias("up"), F.max("distance").alias("depth"))
    out = n.join(path, ["capture_id", "node_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("role", F.lit("generic")), F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.concat(F.lit(' "'), sanitize(F.col("name")), F.lit('"'))).otherwise(""))
    return out.select("capture_id", F.col("node_id").alias("source_id"), "depth", F.concat_ws("/", "up", "own").alias("path"), line.alias("line"))
