"""Hierarchy and regions, relations between nodes, and the metrics of a capture's graph.

Input is a node table: capture_id, node_id, frame_id, x, y, w, h (any may be null), role, kind, visibility. Rectangles meet in
grid cells, so work is spread by cell and a capture of any share of the rows is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow import schemas as S
from paneflow.operators.observe import lookup
from paneflow.operators.ordering import ordinal
from paneflow.session import cut, default_parallelism, once, ship_package, small

LEVELS = 16


def containment_parent(nodes: DataFrame, cell: float = 64.0) -> DataFrame:
    """capture_id, node_id, parent_id: the smallest rectangle of the same frame that encloses the node and is strictly
    larger (ties: the lower id); null at the top.

    An enclosing rectangle is entered at the level of the grid where it covers few cells; a node probes the cell of its
    corner at every level.
    """
    g = nodes.where("x is not null and y is not null and w is not null and h is not null")
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("w"), F.col("h"), F.lit(1.0)) / cell))).cast("int"))
    k = F.pow(F.lit(2.0), F.col("level")) * cell
    outer = g.select("capture_id", "frame_id", F.col("node_id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh"), level.alias("level")).withColumn("gx", F.explode(F.sequence(F.floor(F.col("ox") / k), F.floor((F.col("ox") + F.col("ow")) / k)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("oy") / k), F.floor((F.col("oy") + F.col("oh")) / k))))
    inner = g.select("capture_id", "frame_id", "node_id", "x", "y", "w", "h").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("gx", F.floor(F.col("x") / k)).withColumn("gy", F.floor(F.col("y") / k))
    held = (F.col("ox") <= F.col("x")) & (F.col("oy") <= F.col("y")) & (F.col("ox") + F.col("ow") >= F.col("x") + F.col("w")) & (F.col("oy") + F.col("oh") >= F.col("y") + F.col("h")) & (F.col("ow") * F.col("oh") > F.col("w") * F.col("h")) & (F.col("o_id") != F.col("node_id"))
    pairs = inner.join(outer, ["capture_id", "frame_id", "level", "gx", "gy"]).where(held)
    best = pairs.groupBy("capture_id", "node_id").agg(F.min(F.struct((F.col("ow") * F.col("oh")).alias("a"), "o_id")).alias("b")).select("capture_id", "node_id", F.col("b.o_id").alias("parent_id"))
    return nodes.select("capture_id", "node_id").join(best, ["capture_id", "node_id"], "left")


def paths(parents: DataFrame) -> DataFrame:
    """capture_id, node_id, path: the ancestors of each node, nearest first, by doubling: after k rounds a path has 2^k of them.

    A node that is its own parent is a root. A path that runs into a cycle ends before it repeats itself.
    """
    known = parents.select("capture_id", "node_id", F.when(F.col("parent_id") != F.col("node_id"), F.col("parent_id")).alias("p"))
    state = cut(known.select("capture_id", "node_id", F.when(F.col("p").isNotNull(), F.array("p")).otherwise(F.array().cast("array<string>")).alias("path"), F.col("p").isNull().alias("done")))
    while not state.where("not done").isEmpty():
        more = state.where("size(path) > 0").select("capture_id", F.col("node_id").alias("at"), F.col("path").alias("more"))
        far = state.where("not done").withColumn("at", F.element_at("path", -1)).join(more, ["capture_id", "at"], "left")
        whole = F.concat("path", F.coalesce("more", F.array().cast("array<string>")))
        # up to the first element that is the node itself or came before
        ends = F.array_min(F.filter(F.transform(whole, lambda x, i: F.when((x == F.col("node_id")) | (F.array_position(whole, x) <= i), i)), lambda i: i.isNotNull()))
        far = once(far, "end", ends).select("capture_id", "node_id", F.when(F.col("end").isNotNull(), F.slice(whole, F.lit(1), F.col("end"))).otherwise(whole).alias("path"), (F.col("end").isNotNull() | F.col("more").isNull()).alias("done"))
        state = cut(state.where("done").unionByName(far))
    return state.select("capture_id", "node_id", "path")


def ancestors(parents: DataFrame) -> DataFrame:
    """capture_id, node_id, ancestor_id, distance: the transitive closure. In a cycle each pair counts once, at its least distance."""
    return closure_of(paths(parents))


def closure_of(known: DataFrame) -> DataFrame:
    """As ``ancestors``, of paths that are known already."""
    return known.select("capture_id", "node_id", F.posexplode("path").alias("d", "ancestor_id")).select("capture_id", "node_id", "ancestor_id", (F.col("d") + 1).alias("distance"))


def depths(parents: DataFrame) -> DataFrame:
    """capture_id, node_id, parent_id, depth: 0 at the top."""
    return parents.join(paths(parents).select("capture_id", "node_id", F.size("path").alias("depth")), ["capture_id", "node_id"])


def region_kind(role: Column) -> Column:
    return lookup({r: k for k, rs in S.REGION_ROLES.items() for r in rs}, role)


def promoted_regions(nodes: DataFrame, parents: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Regions of landmark, form, list and table roles: root, kind, number of members, direct children as items."""
    roots = nodes.withColumn("region_kind", region_kind(F.col("role"))).where("region_kind is not null").select("capture_id", F.col("node_id").alias("root_id"), "region_kind")
    members = (ancestors(parents) if closure is None else closure).withColumnRenamed("ancestor_id", "root_id").groupBy("capture_id", "root_id").agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 1).alias("children"))
    out = roots.join(members, ["capture_id", "root_id"], "left")
    return out.select("capture_id", "root_id", "region_kind", (F.coalesce("n", F.lit(0)) + 1).alias("member_count"), F.when(F.col("region_kind").isin("list", "table"), F.coalesce("children", F.lit(0))).alias("item_count"))


def signature() -> Column:
    b = lambda c: (F.floor(F.col(c) / 10 + 0.5) * 10).cast("bigint").cast("string")
    size = F.when(F.col("w").isNull() | F.col("h").isNull(), F.lit("na")).otherwise(F.concat(b("w"), F.lit("x"), b("h")))
    return F.concat_ws("|", F.coalesce("role", F.lit("_")), F.coalesce("kind", F.lit("_")), size)


def repeated_regions(nodes: DataFrame, parents: DataFrame, threshold: int = 3) -> DataFrame:
    """Siblings alike in role, kind and size to ten px, at least ``threshold`` of them; the top level of all frames is one."""
    n = nodes.join(parents, ["capture_id", "node_id"]).withColumn("signature", signature())
    out = n.groupBy("capture_id", "parent_id", "signature").agg(F.count("*").alias("item_count"), F.count_if(F.col("visibility").isin("visible", "clipped")).alias("visible_item_count"), F.min("node_id").alias("first_id"))
    return out.where(F.col("item_count") >= threshold).withColumn("pattern_hash", F.concat(F.lit("sha256:"), F.sha2("signature", 256)))


def region_members(nodes: DataFrame, parents: DataFrame, threshold: int = 3, closure: DataFrame | None = None) -> DataFrame:
    """capture_id, region, node_id of all regions."""
    roots = nodes.where(region_kind(F.col("role")).isNotNull()).select("capture_id", F.col("node_id").alias("ancestor_id"))
    inside = (ancestors(parents) if closure is None else closure).join(roots, ["capture_id", "ancestor_id"]).select("capture_id", F.concat(F.lit("role:"), "ancestor_id").alias("region"), "node_id")
    own = roots.select("capture_id", F.concat(F.lit("role:"), "ancestor_id").alias("region"), F.col("ancestor_id").alias("node_id"))
    n = nodes.join(parents, ["capture_id", "node_id"]).withColumn("signature", signature())
    big = n.groupBy("capture_id", "parent_id", "signature").count().where(F.col("count") >= threshold).drop("count")
    p, q = n.alias("p"), big.alias("q")
    rep = p.join(q, (F.col("p.capture_id") == F.col("q.capture_id")) & F.col("p.parent_id").eqNullSafe(F.col("q.parent_id")) & (F.col("p.signature") == F.col("q.signature"))).select("p.capture_id", F.concat(F.lit("rep:"), F.coalesce("p.parent_id", F.lit("root")), F.lit(":"), "p.signature").alias("region"), "p.node_id")
    return inside.unionByName(own).unionByName(rep)


def node_cap(nodes: DataFrame, parents: DataFrame, max_nodes: int, threshold: int = 3) -> DataFrame:
    """capture_id, node_id of the nodes kept when captures over ``max_nodes`` summarize repeated regions.

    Captures within the cap pass through. Others go, one by one, through the sequential rule: regions in order keep
    their first member and drop whole subtrees of the next ones until the cap is met. Only ids and parents of the
    over-cap captures travel to it; capture itself bounds the nodes of a capture (4,000 unless set otherwise).
    """
    import pandas as pd

    sizes = nodes.groupBy("capture_id").count()
    over = sizes.where(F.col("count") > max_nodes).select("capture_id")
    fine = nodes.join(over, "capture_id", "left_anti").select("capture_id", "node_id")
    rows = nodes.join(parents, ["capture_id", "node_id"]).join(over, "capture_id").withColumn("signature", signature()).select("capture_id", "node_id", "parent_id", "signature")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        kids: dict[str, list[str]] = {}
        groups: dict[tuple[str, str], list[str]] = {}
        for node, parent, sig in pdf[["node_id", "parent_id", "signature"]].itertuples(index=False, name=None):
            p = parent if isinstance(parent, str) else ""
            kids.setdefault(p, []).append(node)
            groups.setdefault((p, sig), []).append(node)
        gone: set[str] = set()
        for key in sorted(groups):
            if len(groups[key]) < threshold:
                continue
            for member in groups[key][1:]:
                if len(pdf) - len(gone) <= max_nodes:
                    break
                todo = [member]
                while todo:
                    m = todo.pop()
                    gone.add(m)
                    todo += kids.get(m, [])
        return pdf[~pdf["node_id"].isin(gone)][["capture_id", "node_id"]]

    return fine.unionByName(rows.groupBy("capture_id").applyInPandas(keep, "capture_id string, node_id string"))


def reading_next(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges from each node to the next of its siblings by (y, x, id)."""
    n = nodes.where("x is not null and y is not null").join(parents, ["capture_id", "node_id"]).select("capture_id", F.coalesce("parent_id", F.lit("")).alias("p"), "node_id", "x", "y")
    placed = ordinal(n, ["capture_id", "p"], [F.floor(F.col("y") / 256)], [F.col("y"), F.col("x"), F.col("node_id")], "i").select("capture_id", "p", "node_id", "i")
    nxt = placed.select("capture_id", "p", F.col("node_id").alias("to_id"), (F.col("i") - 1).alias("i"))
    return placed.join(nxt, ["capture_id", "p", "i"]).select("capture_id", F.col("node_id").alias("from_id"), "to_id")


def grid(nodes: DataFrame) -> DataFrame:
    """The nodes with a rectangle, and the cells x0 to x1 and y0 to y1 of their capture's grid that it covers.

    A cell is a twentieth of the capture's extent, 50 px at least. Relations hold between nodes that share a cell.
    """
    g = nodes.where("x is not null and y is not null and w is not null and h is not null").select("capture_id", "node_id", "x", "y", "w", "h")
    span = g.groupBy("capture_id").agg(F.greatest(F.lit(100.0), F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))).alias("span"))
    g = g.join(small(span), "capture_id").withColumn("cell", F.greatest(F.lit(50.0), F.col("span") / 20)).drop("span")
    for c, s in (("x", "w"), ("y", "h")):
        g = g.withColumn(f"{c}0", F.floor(F.col(c) / F.col("cell"))).withColumn(f"{c}1", F.floor((F.col(c) + F.col(s)) / F.col("cell")))
    return g.drop("cell")


def _sided(df: DataFrame, side: str, shared: list[str]) -> DataFrame:
    return df.select(*shared, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in shared])


def _iou() -> Column:
    iw = F.greatest(F.lit(0.0), F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - F.greatest("a_x", "b_x"))
    ih = F.greatest(F.lit(0.0), F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")) - F.greatest("a_y", "b_y"))
    i = iw * ih
    return F.when(i > 0, F.try_divide(i, F.col("a_w") * F.col("a_h") + F.col("b_w") * F.col("b_h") - i)).otherwise(0.0)


def overlaps(nodes: DataFrame, threshold: float = 0.1, cell: float = 64.0) -> DataFrame:
    """Pairs of a capture whose intersection over union is ``threshold`` at least, which must be over 0.

    Rectangles that intersect share a cell of any grid, so they meet in a finer one than ``grid``: each is entered at the
    level whose cells are as long as its longer side. The longer sides of a pair differ by a factor of 1 / threshold at
    most, so a rectangle looks at that many levels and no more. A pair is emitted in the first cell that both cover.
    """
    if not threshold > 0:
        raise ValueError("threshold must be over 0")
    up = int(math.log2(1 / min(threshold, 1.0)) + 1e-6) + 1
    g = nodes.where("x is not null and y is not null and w > 0 and h > 0").select("capture_id", "node_id", "x", "y", "w", "h")
    g = g.withColumn("own", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("w", "h") / cell))).cast("int"))

    def cells(df: DataFrame, side: str) -> DataFrame:
        k = F.pow(F.lit(2.0), F.col("level")) * cell
        df = df.withColumns({"x0": F.floor(F.col("x") / k), "y0": F.floor(F.col("y") / k), "x1": F.floor((F.col("x") + F.col("w")) / k), "y1": F.floor((F.col("y") + F.col("h")) / k)})
        df = df.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1"))).drop("x1", "y1")
        return _sided(df, side, ["capture_id", "level", "gx", "gy"])

    a = cells(g.withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + up))), "a")
    b = cells(g.withColumn("level", F.col("own")), "b")
    first = (F.col("gx") == F.greatest("a_x0", "b_x0")) & (F.col("gy") == F.greatest("a_y0", "b_y0"))
    # of one level, each pair would come twice
    once_ = (F.col("a_own") < F.col("b_own")) | (F.col("a_node_id") < F.col("b_node_id"))
    met = a.join(b, ["capture_id", "level", "gx", "gy"]).where(first & once_ & (F.col("a_node_id") != F.col("b_node_id"))).withColumn("iou", _iou())
    return met.where(F.col("iou") >= threshold).select("capture_id", F.least("a_node_id", "b_node_id").alias("from_id"), F.greatest("a_node_id", "b_node_id").alias("to_id"), "iou")


def aligned(nodes: DataFrame, members: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Pairs of a common region that share a cell of the grid and whose left edges, centres or right edges are within tolerance.

    A pair meets by region, band of the edge's place and row of the grid, so only what is nearly aligned is compared. It is
    emitted in the first row of cells and the first region that both have.
    """
    band, slack = max(8 * tolerance, 1.0), tolerance * 1.01 + 1e-3
    regions = members.groupBy("capture_id", "node_id").agg(F.collect_set("region").alias("r"))
    n = grid(nodes).join(regions, ["capture_id", "node_id"])
    # the regions are compared only where a node has several
    n = n.select("capture_id", "node_id", "x", "w", "x0", "x1", "y0", "y1", F.when(F.size("r") > 1, F.col("r")).alias("r"), F.explode("r").alias("region"))
    n = n.select("*", F.explode(F.array(*[F.struct(F.lit(f"aligned_{k}").alias("kind"), (F.col("x") + F.col("w") * part).alias("at")) for k, part in (("start", 0.0), ("center", 0.5), ("end", 1.0))])).alias("e")).select("*", "e.kind", "e.at").drop("e", "x", "w")
    n = n.withColumn("gy", F.explode(F.sequence("y0", "y1"))).drop("y1")
    shared = ["capture_id", "region", "kind", "band", "gy"]
    a = _sided(n.withColumn("band", F.floor(F.col("at") / band)), "a", shared)
    b = _sided(n.withColumn("band", F.explode(F.sequence(F.floor((F.col("at") - slack) / band), F.floor((F.col("at") + slack) / band)))), "b", shared)
    first = (F.col("gy") == F.greatest("a_y0", "b_y0")) & (F.col("a_r").isNull() | F.col("b_r").isNull() | (F.array_min(F.array_intersect("a_r", "b_r")) == F.col("region")))
    near = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.abs(F.col("a_at") - F.col("b_at")) <= tolerance)
    return a.join(b, shared).where((F.col("a_node_id") < F.col("b_node_id")) & near & first).select("capture_id", F.col("a_node_id").alias("from_id"), F.col("b_node_id").alias("to_id"), "kind")


#: Nodes of a tile, about. A capture of twice as many at most is one tile.
TILE_NODES = 512


def near_knn(nodes: DataFrame, k: int = 4, tile_nodes: int = TILE_NODES) -> DataFrame:
    """Edges to the k nearest by centre among the nodes that share a cell of the grid (ties by id), each pair once.

    A capture is cut into tiles of about ``tile_nodes`` centres, each with a margin of half a tile from its neighbours. A
    node whose k nearest are nearer than the end of the margin has them in its tile; any other, if there is one, is
    compared with all nodes that share a cell with it.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    # the table comes twice: for the tiles' size and for the tiles
    g = grid(nodes).withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    ends = g.groupBy("capture_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("cx", "cy") for f in (F.min, F.max)])
    wide, high, share = F.col("cx_max") - F.col("cx_min"), F.col("cy_max") - F.col("cy_min"), tile_nodes / F.col("n")
    size = F.when(F.col("n") > 2 * tile_nodes, F.greatest(F.lit(1.0), F.sqrt(wide * high * share), wide * share, high * share))
    ends = ends.select("capture_id", "cx_min", "cy_min", size.alias("tile"), F.floor(wide / size).alias("cx_last"), F.floor(high / size).alias("cy_last"))
    g = g.join(small(ends), "capture_id")
    for c in ("cx", "cy"):
        at = lambda d: F.coalesce(F.greatest(F.lit(0), F.least(F.col(f"{c}_last"), F.floor((F.col(c) - F.col(f"{c}_min")) / F.col("tile") + d))), F.lit(0))  # noqa: B023, E731
        g = g.withColumns({f"{c}_own": at(0.0), f"{c}_tile": F.explode(F.sequence(at(-0.5), at(0.5)))})
    place = ["capture_id", "cx_tile", "cy_tile"]
    # how far it is from a node to the end of what its tile knows; beyond the outermost tiles there is nothing
    low = lambda c: F.when(F.col(f"{c}_tile") > 0, F.col(c) - F.col(f"{c}_min") - (F.col(f"{c}_tile") - 0.5) * F.col("tile"))
    high_ = lambda c: F.when(F.col(f"{c}_tile") < F.col(f"{c}_last"), (F.col(f"{c}_tile") + 1.5) * F.col("tile") - F.col(c) + F.col(f"{c}_min"))
    known = F.coalesce(F.least(low("cx"), high_("cx"), low("cy"), high_("cy")), F.lit(float("inf")))
    own = (F.col("cx_own") == F.col("cx_tile")) & (F.col("cy_own") == F.col("cy_tile"))
    g = g.select(*place, "node_id", "x", "y", "w", "h", "x0", "x1", "y0", "y1", own.alias("own"), known.alias("known"), F.col("tile").isNull().alias("whole"))
    tiles = g.repartition(default_parallelism(spark), *place).sortWithinPartitions(*place, "node_id")
    found = cut(tiles.mapInPandas(_tiles_nearest(k), "capture_id string, from_id string, to_id string, whole boolean"))
    pairs = found.where("to_id is not null").select("capture_id", "from_id", "to_id", "whole")
    left = found.where("to_id is null").select("capture_id", F.col("from_id").alias("node_id"))
    if not left.isEmpty():
        pairs = pairs.unionByName(_nearest_in_cells(nodes, left, k).withColumn("whole", F.lit(False)))
    # a tile that is the whole capture has each pair once
    several = pairs.where("not whole").select("capture_id", "from_id", "to_id").distinct()
    return pairs.where("whole").select("capture_id", "from_id", "to_id").unionByName(several)


def _nearest_in_cells(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """As ``near_knn``, for some nodes only: each is compared with all that share a cell with it."""
    cells = grid(nodes.join(asked.select("capture_id").distinct(), "capture_id", "left_semi")).withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1")))
    shared = ["capture_id", "gx", "gy"]
    p = _sided(cells.join(asked, ["capture_id", "node_id"], "left_semi"), "p", shared).join(_sided(cells, "q", shared), shared)
    p = p.where((F.col("gx") == F.greatest("p_x0", "q_x0")) & (F.col("gy") == F.greatest("p_y0", "q_y0")) & (F.col("p_node_id") != F.col("q_node_id")))
    # the difference is taken from the lower id to the higher, so that a pair has one distance
    apart = lambda c, s: F.when(F.col("p_node_id") < F.col("q_node_id"), F.col(f"p_{c}") + F.col(f"p_{s}") / 2 - F.col(f"q_{c}") - F.col(f"q_{s}") / 2).otherwise(F.col(f"q_{c}") + F.col(f"q_{s}") / 2 - F.col(f"p_{c}") - F.col(f"p_{s}") / 2)
    p = p.select("capture_id", F.col("p_node_id").alias("n"), F.col("q_node_id").alias("m"), apart("x", "w").alias("dx"), apart("y", "h").alias("dy")).withColumn("d", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    best = p.withColumn("r", F.row_number().over(W.partitionBy("capture_id", "n").orderBy("d", "m"))).where(F.col("r") <= k)
    return best.select("capture_id", F.least("n", "m").alias("from_id"), F.greatest("n", "m").alias("to_id"))


def _tiles_nearest(k: int, block: int = 1 << 20):
    """Over rows sorted by tile and id: the pairs of the tiles' own nodes with their nearest, and without a second id the nodes whose nearest may lie beyond."""
    import numpy as np
    import pandas as pd

    def nearest(tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(tile["x"])
        owned, every = np.flatnonzero(tile["own"]), np.arange(n)
        lo, hi, open_ = [], [], []
        step = max(1, block // max(1, n))
        for at in range(0, len(owned), step):
            o = owned[at : at + step]
            d = np.zeros((len(o), n))
            shares = o[:, None] != every
            for c, s in (("x", "w"), ("y", "h")):
                p, half, c0, c1 = tile[c], tile[s] / 2, tile[f"{c}0"], tile[f"{c}1"]
                far = p + half
                # the difference is taken from the lower id to the higher, so that a pair has one distance
                diff = np.where(o[:, None] < every, far[o][:, None] - p - half, far - p[o][:, None] - half[o][:, None])
                d += diff * diff
                shares &= (c0[o][:, None] <= c1) & (c0 <= c1[o][:, None])
            d[~shares] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(o), np.inf)
            margin = tile["known"][o] * (1 - 1e-9) - 1e-6
            sure = np.isinf(tile["known"][o]) | (last < margin * margin) & (margin > 0)
            open_.append(o[~sure])
            r, c = np.nonzero((d <= last[:, None]) & shares & sure[:, None])
            order = np.lexsort((c, d[r, c], r))
            r, c = r[order], c[order]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            lo.append(np.minimum(o[r[top]], c[top]))
            hi.append(np.maximum(o[r[top]], c[top]))
        pairs = np.unique(np.concatenate(lo) * n + np.concatenate(hi)) if lo else np.zeros(0, dtype=np.int64)
        return pairs // n, pairs % n, np.concatenate(open_) if open_ else np.zeros(0, dtype=np.int64)

    numbers = ("x", "y", "w", "h", "x0", "x1", "y0", "y1", "own", "known")

    def run(parts):
        held: list[pd.DataFrame] = []

        def close(frames: list[pd.DataFrame]) -> pd.DataFrame:
            """The results of whole tiles."""
            pdf = frames[0] if len(frames) == 1 else pd.concat(frames)
            starts = [*begins(pdf), len(pdf)]
            cols, ids, capture, whole = {c: pdf[c].to_numpy() for c in numbers}, pdf["node_id"].to_numpy(), pdf["capture_id"].to_numpy(), pdf["whole"].to_numpy()
            froms, tos = [], []
            for s, e in zip([0, *starts[:-1]], starts):
                lo, hi, open_ = nearest({c: v[s:e] for c, v in cols.items()})
                froms += [lo + s, open_ + s]
                tos += [hi + s, np.full(len(open_), -1)]
            f, t = np.concatenate(froms), np.concatenate(tos)
            return pd.DataFrame({"capture_id": capture[f], "from_id": ids[f], "to_id": np.where(t < 0, None, ids[t]), "whole": whole[f]})

        def begins(pdf: pd.DataFrame) -> np.ndarray:
            """Where tiles begin, but for the first."""
            new = np.zeros(max(0, len(pdf) - 1), dtype=bool)
            for c in ("capture_id", "cx_tile", "cy_tile"):
                v = pdf[c].to_numpy()
                new |= v[1:] != v[:-1]
            return np.flatnonzero(new) + 1

        for pdf in parts:
            if not len(pdf):
                continue
            starts = begins(pdf)
            if held and tuple(held[-1][["capture_id", "cx_tile", "cy_tile"]].iloc[-1]) != tuple(pdf[["capture_id", "cx_tile", "cy_tile"]].iloc[0]):
                yield close(held)
                held = []
            if len(starts):
                yield close([*held, pdf.iloc[: starts[-1]]])
                held = []
            held.append(pdf.iloc[starts[-1] :] if len(starts) else pdf)
        if held:
            yield close(held)

    return run


def relations(nodes: DataFrame, parents: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """All edges before the cap: capture_id, kind, from_id, to_id, weight. ``members`` are those of the regions, if they are known already."""
    members = region_members(nodes, parents) if members is None else members
    w = S.EDGE_WEIGHTS
    edge = lambda df, kind, weight: df.select("capture_id", (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), "from_id", "to_id", (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"))
    return (
        edge(parents.where("parent_id is not null").select("capture_id", F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id")), "contains", w["contains"])
        .unionByName(edge(reading_next(nodes, parents), "reading_next", w["reading_next"]))
        .unionByName(edge(overlaps(nodes), "overlaps", F.col("iou")))
        .unionByName(edge(aligned(nodes, members), F.col("kind"), w["aligned"]))
        .unionByName(edge(near_knn(nodes), "near", w["near"]))
    )


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("capture_id", F.explode(F.array("from_id", "to_id")).alias("node_id")).groupBy("capture_id", "node_id").agg(F.count("*").alias("degree"))


def edge_cap(edges: DataFrame, max_degree: int = 32) -> DataFrame:
    """Edges kept when nodes over ``max_degree`` drop their lightest edges (never containment), in order of weight and id.

    The rule walks a capture's edges from the lightest and drops each that has an end over the cap at that time. A node is
    over the cap until its first edges, as many as it has too many, are dropped, and while it is, all of them are. So it
    keeps containment and as many of its last edges as the cap leaves room for, an edge stays if both its ends keep it,
    and no capture is walked as a whole. An edge comes once.
    """
    ids = ["capture_id", "kind", "from_id", "to_id", "weight", "edge_key"]
    e = edges.withColumn("edge_key", F.substring(F.sha2(F.concat_ws(":", "kind", "from_id", "to_id"), 256), 1, 16)).select(*ids)
    held = F.col("kind") == "contains"
    ends = e.select("*", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    last = W.partitionBy("capture_id", "node_id").orderBy(held.desc(), F.col("weight").desc(), F.col("edge_key").desc())
    stay = ends.withColumn("r", F.row_number().over(last)).where((F.col("r") <= max_degree) & ~held)
    both = stay.groupBy(*ids).agg(F.count("*").alias("ends")).where("ends = 2").drop("ends")
    return e.where(held).unionByName(both)


def graph_metrics(nodes: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Counts of each capture's graph: nodes, edges, greatest degree, interactive nodes, nodes with a rectangle."""
    n = nodes.groupBy("capture_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("role").isin(*S.INTERACTIVE_ROLES)).alias("interactive"), F.count_if(F.col("x").isNotNull()).alias("with_geometry"))
    # an edge counts at both its ends
    d = degrees(edges).groupBy("capture_id").agg((F.sum("degree") / 2).cast("bigint").alias("edges"), F.max("degree").alias("max_degree"))
    return n.join(d, "capture_id", "left").na.fill(0, ["edges", "max_degree"])
