"""Relations against plain loops over all pairs, and that they never write or walk what grows as the square of a capture."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from paneflow.operators import evaluate as E
from paneflow.operators import structure as R
from paneflow.operators import views as Q
from paneflow.session import cut

SHAPE = "capture_id string, node_id string, frame_id string, x double, y double, w double, h double, role string, kind string, visibility string"


def page(capture, boxes, role=None):
    return [(capture, f"n{i:04d}", "f", *map(float, b), role, "div", "visible") for i, b in enumerate(boxes)]


def drawn(seed, n, wide=900, high=900, side=200):
    r = random.Random(seed)
    return [(r.randrange(0, wide, 3), r.randrange(0, high, 3), r.randrange(0, side), r.randrange(0, side)) for _ in range(n)]


def sharing(rows):
    """Pairs of rows of a capture that share a cell of its grid, the lower id first."""
    for c in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        cell = max(50.0, max([100.0, *(r[3] + r[5] for r in own), *(r[4] + r[6] for r in own)]) / 20)
        cells = lambda p, s: (math.floor(p / cell), math.floor((p + s) / cell))  # noqa: B023, E731
        near = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if near(cells(a[3], a[5]), cells(b[3], b[5])) and near(cells(a[4], a[6]), cells(b[4], b[6])):
                    yield a, b


def nearest(rows, k=4):
    found = {}
    for a, b in sharing(rows):
        dx, dy = a[3] + a[5] / 2 - b[3] - b[5] / 2, a[4] + a[6] / 2 - b[4] - b[6] / 2
        for n, m in ((a, b), (b, a)):
            found.setdefault(n[:2], []).append((dx * dx + dy * dy, m[1]))
    return {(c, *sorted((n, m))) for (c, n), ms in found.items() for _, m in sorted(ms)[:k]}


@pytest.fixture(scope="module")
def pages():
    # a page of scattered boxes, a tall column, boxes on one place, and far ones that share a cell with a few only
    far = [(0, 0, 5000, 10), *[(i * 1200, 4000, 5, 5) for i in range(4)], *[(10 + i, 3, 4, 4) for i in range(40)]]
    return [*page("a", drawn(1, 60)), *page("b", [(24, 40 * i, 200 + 300 * (i % 5 == 0), 36) for i in range(90)]), *page("c", [(50, 50, 20, 20)] * 50), *page("d", far)]


def edges(df):
    rows = [(r.capture_id, r.from_id, r.to_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_aligned_pairs_meet_by_region(spark, pages):
    r = random.Random(5)
    held = {(p[0], p[1], f"r{r.randrange(3)}") for p in pages for _ in range(r.randrange(3))}
    df = R.aligned(spark.createDataFrame(pages, SHAPE), spark.createDataFrame(sorted(held), "capture_id string, node_id string, region string"))
    want = set()
    of = lambda n: {g for c, i, g in held if (c, i) == n[:2]}
    for a, b in sharing(pages):
        if of(a) & of(b):
            want |= {(a[0], a[1], b[1], f"aligned_{k}") for k, p in (("start", 0.0), ("center", 0.5), ("end", 1.0)) if abs(a[3] + a[5] * p - b[3] - b[5] * p) <= 4}
    rows = [(x.capture_id, x.from_id, x.to_id, x.kind) for x in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_aligned_ends_at_the_grid_as_in_the_golden_scene(spark):
    """The published ordered edge set has no aligned edge from a to c, though both are of one region and start at one place."""
    rows = page("s", [(0, 0, 400, 400), (10, 10, 200, 40), (10, 60, 200, 40), (10, 110, 200, 40), (10, 160, 200, 40)])
    members = spark.createDataFrame([(r[0], r[1], "reg1") for r in rows], "capture_id string, node_id string, region string")
    got = {(r.from_id, r.to_id, r.kind) for r in R.aligned(spark.createDataFrame(rows, SHAPE), members).collect()}
    assert got == {(a, b, f"aligned_{k}") for a, b in (("n0001", "n0002"), ("n0002", "n0003"), ("n0003", "n0004")) for k in ("start", "center", "end")}


@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
def test_overlaps_meet_in_a_fine_grid(spark, pages, threshold):
    want = set()
    for a, b in sharing(pages):
        i = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        if i > 0 and i / (a[5] * a[6] + b[5] * b[6] - i) >= threshold:
            want.add((a[0], a[1], b[1]))
    assert edges(R.overlaps(spark.createDataFrame(pages, SHAPE), threshold)) == want and want
    with pytest.raises(ValueError):
        R.overlaps(spark.createDataFrame(pages, SHAPE), 0.0)


@pytest.mark.parametrize("tile", [3, 12, 512])
def test_nearest_in_tiles(spark, pages, tile):
    """Small tiles leave nodes whose nearest lie beyond, which are decided apart; the edges are the same."""
    assert edges(R.near_knn(spark.createDataFrame(pages, SHAPE), tile_nodes=tile)) == nearest(pages)


def walked(rows, cap):
    """The rule as it is told: from the lightest edge on, drop what has an end over the cap at that time."""
    degree = {}
    for r in rows:
        for n in (r.from_id, r.to_id):
            degree[r.capture_id, n] = degree.get((r.capture_id, n), 0) + 1
    gone = set()
    for r in sorted(rows, key=lambda r: (r.weight, r.edge_key)):
        ends = [(r.capture_id, n) for n in (r.from_id, r.to_id)]
        if r.kind != "contains" and any(degree[e] > cap for e in ends):
            gone.add((r.capture_id, r.edge_key))
            for e in ends:
                degree[e] -= 1
    return {(r.capture_id, r.edge_key) for r in rows} - gone


def test_edge_cap_by_ranks_equals_the_walk(spark):
    r = random.Random(3)
    kinds = ["contains", "near", "aligned_start", "overlaps", "reading_next"]
    found = {(f"c{r.randrange(3)}", r.choice(kinds), f"n{min(r.randrange(12), r.randrange(40))}", f"n{r.randrange(12)}") for _ in range(900)}
    df = spark.createDataFrame([(*x, r.choice([0.3, 0.5, 0.7])) for x in sorted(found)], "capture_id string, kind string, from_id string, to_id string, weight double")
    all_ = R.edge_cap(df, 10**6).collect()
    assert len(all_) == len(found)
    for cap in (1, 5, 17, 40):
        kept = R.edge_cap(df, cap)
        assert {(x.capture_id, x.edge_key) for x in kept.collect()} == walked(all_, cap)
    assert "InPandas" not in kept._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tall(spark):
    """A page of 4,000 boxes in a column: nearly 400,000 pairs share a cell."""
    n = cut(spark.createDataFrame(page("t", [(20, 40 * i, 100 + i % 997, 30) for i in range(4000)]), SHAPE))
    return n, cut(n.select("capture_id", "node_id", F.lit(None).cast("string").alias("parent_id")))


def written(spark, work):
    at = spark._jvm.java.net.URI(spark.sparkContext._jsc.sc().getCheckpointDir().get()).getPath()
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs)
    before = size()
    work()
    return size() - before


def test_relations_write_no_pairs(spark, tall):
    assert written(spark, lambda: R.relations(*tall).groupBy("kind").count().collect()) < 8_000_000


def test_degrees_write_no_pairs(spark, tall):
    got = {}
    assert written(spark, lambda: got.update({r.node_id: r.degree for r in R.degrees(R.relations(*tall)).collect()})) < 8_000_000
    assert len(got) == 4000


def test_metrics_count_each_edge_once(spark, tall):
    n, p = tall
    e = R.relations(n, p)
    degree, known = {}, [(r.from_id, r.to_id) for r in e.collect()]
    for ends in known:
        for x in ends:
            degree[x] = degree.get(x, 0) + 1
    rows = []
    assert written(spark, lambda: rows.extend(R.graph_metrics(n, R.relations(n, p), p).collect())) < 8_000_000
    assert [(r.nodes, r.edges, r.max_degree) for r in rows] == [(4000, len(known), max(degree.values()))]
    (none,) = R.graph_metrics(n, e.limit(0), p).collect()
    assert (none.edges, none.max_degree) == (0, 0)


def test_focus_writes_a_pair_of_nodes_once(spark):
    """Edges of several kinds between two nodes, in either direction, are one way to go."""
    rows = [("c", kind, f"n{i:05d}", f"n{i + 1:05d}", 0.5) for i in range(20000) for kind in ("aligned_start", "aligned_end", "near")]
    e = spark.createDataFrame(rows, "capture_id string, kind string, from_id string, to_id string, weight double")
    got = []
    start = spark.createDataFrame([("c", "n00009")], "capture_id string, node_id string")
    assert written(spark, lambda: got.extend(Q.focus_view(e, start).collect())) < 1_800_000
    assert {(r.node_id, r.distance) for r in got} == {("n00007", 2), ("n00008", 1), ("n00009", 0), ("n00010", 1), ("n00011", 2)}


@pytest.mark.parametrize("block", [7, 23, 1 << 20])
def test_bootstrap_takes_cohorts_by_blocks(spark, block):
    """Draws are made in the task that sums them, so none is a row, whatever the block of pairs."""
    pairs = {c: [(float(10 + i * 7 % 13), float(i * 5 % 9)) for i in range(n)] for c, n in (("one", 1), ("few", 23), ("some", 61))}
    df = spark.createDataFrame([(c, i, b, x) for c, ps in pairs.items() for i, (b, x) in enumerate(ps)], "cohort string, key bigint, base double, candidate double")
    got = E.bootstrap_exact(df, 200, block=block)
    for r in got.collect():
        want = E.bootstrap_ratio(pairs[r.cohort], 200)
        assert (r.point, r.lower, r.upper, r.pairs) == pytest.approx((want["point"], want["lower"], want["upper"], len(pairs[r.cohort])))
    assert got.count() == 3
