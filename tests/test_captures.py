"""Capture operators: golden scenes, laws of the kernels, identity, and SQL on the small tables."""

import math
import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneflow.functions import geometry as G
from paneflow.functions import text as X
from paneflow.functions.canonical import canonical, number_text
from paneflow.operators import evaluate as E
from paneflow.operators import identity as I
from paneflow.operators import observe as O
from paneflow.operators import structure as R
from paneflow.operators import validate as V
from paneflow.operators import views as Q
from paneflow.plans import reference, registry
from paneflow.sources.captures import decode_layout, emitted, synthetic_pages
from pyspark.sql import functions as F

NODES = "capture_id string, node_id string, frame_id string, x double, y double, w double, h double, role string, kind string, visibility string"


def scene(spark):
    rows = [("c", "root", 0.0, 0.0, 400.0, 400.0), *[("c", k, 10.0, 10.0 + 50 * i, 200.0, 40.0) for i, k in enumerate("abcd")]]
    return spark.createDataFrame([(c, n, "main", x, y, w, h, None, "dom", "visible") for c, n, x, y, w, h in rows], NODES)


def test_relation_scene(spark):
    n = scene(spark)
    p = R.containment_parent(n)
    assert {(r.node_id, r.parent_id) for r in p.collect()} == {("root", None), *((k, "root") for k in "abcd")}
    edges = {(r.kind, r.from_id, r.to_id) for r in R.relations(n, p).collect()}
    by = lambda k: {(a, b) for kind, a, b in edges if kind == k}
    assert by("reading_next") == {("a", "b"), ("b", "c"), ("c", "d")} and by("overlaps") == set() and len(by("contains")) == 4
    # a and c share no cell of the grid: near is not the true nearest neighbours
    assert by("near") == {("a", "b"), ("b", "c"), ("c", "d"), *((k, "root") for k in "abcd")}


def test_depth_regions_and_caps(spark):
    n = scene(spark)
    p = R.containment_parent(n)
    assert {r.node_id: r.depth for r in R.depths(p).collect()} == {"root": 0, "a": 1, "b": 1, "c": 1, "d": 1}
    (r,) = R.repeated_regions(n, p).collect()
    assert (r.item_count, r.first_id, r.signature) == (4, "a", "_|dom|200x40")
    assert {r.node_id for r in R.node_cap(n, p, 3).collect()} == {"root", "a", "d"}
    kept = R.edge_cap(R.relations(n, p), 4)
    assert max(r.degree for r in R.degrees(kept).collect()) <= 4 and kept.where("kind = 'contains'").count() == 4


def test_cycles_and_missing_parents(spark):
    rows = [("c", "a", None), ("c", "b", "a"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y"), ("c", "m", "none")]
    d = spark.createDataFrame(rows, "capture_id string, source_id string, parent_source_id string")
    assert {r.source_id for r in V.cycle_issues(d).collect()} == {"x", "y", "z"}
    assert {r.source_id for r in V.parent_issues(d).collect()} == {"m"}
    assert V.cycle_issues(d.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("#FfF", "#ffffff"), ("#0a0b0cff", "#0a0b0c"), ("#0a0b0c80", "#0a0b0c80"), ("rgb(255, 0, 0)", "#ff0000"), ("rgba(0,0,0,0.5)", "#00000080"), ("white", "#ffffff"), ("transparent", "#00000000"), ("not-a-color", None), ("constructor", None), ("", None), (None, None)])
def test_colors(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.canonical_color(F.col("t")).alias("c")).first().c == want


num = st.floats(-1e3, 1e3)


@settings(max_examples=15, deadline=None)
@given(st.lists(num, min_size=6, max_size=6), st.lists(num, min_size=6, max_size=6), st.tuples(num, num, st.floats(0, 1e3), st.floats(0, 1e3)))
def test_affine_laws(spark, a, b, r):
    df = spark.range(1).select(G.affine(*a).alias("a"), G.affine(*b).alias("b"), G.rect(*[F.lit(v) for v in r]).alias("r"))
    one = df.select(G.compose(F.col("a"), G.affine(*G.IDENTITY)).alias("i"), G.transform_rect(G.affine(*G.IDENTITY), F.col("r")).alias("same"), G.transform_rect(F.col("a"), F.col("r")).alias("t")).first()
    assert one.i == pytest.approx(a) and one.t.width >= 0 and one.t.height >= 0
    assert tuple(one.same) == pytest.approx(r, abs=1e-6)


def test_frame_chain_and_cycle(spark):
    frames = [("main", None, None, None), ("f1", "main", None, [1.0, 0.0, 0.0, 1.0, 0.0, 100.0]), ("f2", "f1", None, [2.0, 0.0, 0.0, 2.0, 5.0, 0.0]), ("x", "y", None, [1.0, 0.0, 0.0, 1.0, 9.0, 9.0]), ("y", "x", None, None)]
    df = spark.createDataFrame([(frames,)], "f array<struct<frame_id:string,parent_frame_id:string,url:string,transform_to_parent:array<double>>>")
    got = df.select(*[G.frame_transform(F.col("f"), F.lit(k)).alias(k) for k in ("main", "f1", "f2", "x", "unknown")]).first()
    assert got.f2 == [2.0, 0.0, 0.0, 2.0, 5.0, 100.0] and got.f1[5] == 100.0 and got.x == list(G.IDENTITY) == got.main == got.unknown


def test_canonical_json():
    assert [number_text(x) for x in (1.0, 1e21, 1e-7, 0.1, -0.0, 1e20, 5e-324, 0.001)] == ["1", "1e+21", "1e-7", "0.1", "0", "100000000000000000000", "5e-324", "0.001"]
    assert canonical({"b": [1, "é\n"], "a": None}) == '{"a":null,"b":[1,"é\\n"]}'
    with pytest.raises(ValueError):
        canonical(math.inf)


def test_seal_and_verify():
    s = I.seal({"schemaVersion": "1.0.0", "nodes": [{"nodeId": "b"}, {"nodeId": "a"}], "edges": []})
    I.verify(s)
    again = I.seal({"schemaVersion": "1.0.0", "edges": [], "nodes": [{"nodeId": "a"}, {"nodeId": "b"}]})
    assert again == s and s["nodes"][0]["elementRef"].endswith(":0") and s["snapshotId"].startswith("ugs_1_")
    with pytest.raises(I.IdentityError):
        I.verify({**s, "schemaVersion": "1.0.1"})
    with pytest.raises(I.IdentityError):
        I.seal({"nodes": [{"nodeId": "a"}, {"nodeId": "a"}]})


def test_delta_round_trip(spark):
    schema = "pair string, node_id string, v string, n double"
    base = spark.createDataFrame([("p", "a", "x", 1.0), ("p", "b", None, 2.0), ("p", "c", "z", None)], schema)
    target = spark.createDataFrame([("p", "a", "x", 1.0), ("p", "b", "y", 2.0), ("p", "d", None, None)], schema)
    ops = I.delta_encode(base, target, "node_id", ["v", "n"])
    assert [(r.op, r.node_id) for r in ops.orderBy("seq").collect()] == [("remove_node", "c"), ("upsert_node", "b"), ("upsert_node", "d")]
    rows, issues = I.delta_apply(base, ops, "node_id", ["v", "n"], "v string, n double")
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in target.collect()} and issues.count() == 0
    assert I.delta_encode(base, base, "node_id", ["v", "n"]).count() == 0
    bad = spark.createDataFrame([("p", 0, "remove_node", "none", None)], "pair string, seq int, op string, node_id string, payload string")
    assert I.delta_apply(base, bad, "node_id", ["v", "n"], "v string, n double")[1].count() == 1


def test_lineage(spark):
    schema = "pair string, node_id string, ref string, role string, kind string, name string, region string, x double, y double, w double, h double"
    n = lambda i, name, x=0.0: ("p", i, None, "button", "dom", name, None, x, 0.0, 10.0, 10.0)
    base = spark.createDataFrame([n("a", "Save"), n("b", "Open", 900.0), n("c", "Quit", 50.0)], schema)
    target = spark.createDataFrame([n("a", "Save"), n("z", "Other", 400.0), n("q", "Quit", 52.0)], schema)
    got = {r.base_id: (r.outcome, r.target_id) for r in I.lineage_match(I.lineage_scores(base, target), base).collect()}
    # an equal node id is no identity across snapshots: only references and stable hints are
    assert got["a"] == ("abstained", None) and got["b"][0] == "abstained" and got["c"][0] == "abstained"
    hinted = lambda df: df.withColumn("hints", F.array(F.concat(F.lit("stable_dom_id:"), "name")))
    got = {r.base_id: (r.outcome, r.target_id) for r in I.lineage_match(I.lineage_scores(hinted(base), hinted(target)), base).collect()}
    assert got["a"] == ("matched", "a") and got["c"] == ("matched", "q")


def greedy(base, scores, high=0.7, margin=0.1, low=0.25):
    """The reference's matcher on all scores {base: {target: score}}: (outcome, target, score) of each base node."""
    ranked = {b: sorted((-s, t) for t, s in scores.get(b, {}).items() if s > 0) for b in base}
    taken, out = set(), {}
    for b in sorted(base, key=lambda b: (ranked[b][0][0] if ranked[b] else 0.0, b)):
        left = [(-s, t) for s, t in ranked[b] if t not in taken]
        s, t = left[0] if left else (None, None)
        lead = s - (left[1][0] if len(left) > 1 else 0.0) if left else 0.0
        kind = "removed" if s is None or s < low else "abstained" if s < high else "matched" if lead >= margin else "ambiguous"
        if kind == "matched":
            taken.add(t)
        out[b] = (kind, t if kind == "matched" else None, s)
    return out


LINEAGE = "pair string, node_id string, ref string, role string, kind string, name string, region string, x double, y double, w double, h double"


def test_lineage_scores_all_pairs(spark):
    n = lambda i, name, x=0.0, ref=None, role="button": ("p", i, ref, role, "dom", name, None, x, 0.0, 10.0, 10.0)
    base = spark.createDataFrame([n("a", "Save", ref="ug:1:1"), n("b", "Open", 900.0), n("r", "Help", 300.0, "ug:1:0")], LINEAGE)
    target = spark.createDataFrame([n("a", "Save", ref="ug:1:1"), n("z", "Other", 400.0), n("moved", "Help", 700.0, "ug:1:0")], LINEAGE)
    scores = I.lineage_scores(base, target)
    assert scores.count() == 9
    got = {r.base_id: (r.outcome, r.target_id, r.score) for r in I.lineage_match(scores, base).collect()}
    # the best of b shares role, kind and place only; r is found by its reference under another id
    assert got == {"a": ("matched", "a", 1.0 - 0.05), "b": ("abstained", None, 0.25), "r": ("matched", "moved", 0.8)}


def test_lineage_equals_greedy_on_all_pairs(spark):
    rng = random.Random(3)
    node = lambda p, i: (p, f"n{i}", rng.choice([None, f"ug:{rng.randrange(9)}"]), rng.choice(["button", "link", None]), rng.choice(["dom", "text"]), rng.choice([None, "Save", "Save all", "Open file"]), rng.choice([None, "r1", "r2"]), 40.0 * rng.randrange(4), 0.0, 50.0, 20.0)
    sides = [[node(f"p{p}", i) for p in range(6) for i in rng.sample(range(30), 14)] for _ in range(2)]
    base, target = (spark.createDataFrame(x, LINEAGE) for x in sides)
    scores: dict = {}
    for r in I.lineage_scores(base, target).collect():
        scores.setdefault(r.pair, {}).setdefault(r.base_id, {})[r.target_id] = r.score
    want = {(p, b): v for p in scores for b, v in greedy([x[1] for x in sides[0] if x[0] == p], scores[p]).items()}
    got = {(r.pair, r.base_id): (r.outcome, r.target_id, r.score) for r in I.lineage_match(I.lineage_scores(base, target), base).collect()}
    assert got == want and {v[0] for v in want.values()} >= {"matched", "ambiguous", "abstained"}


def test_statistics():
    assert E.mcnemar_exact(5, 1) == pytest.approx(0.21875) and E.mcnemar_exact(10, 0) == pytest.approx(2 / 1024) and E.mcnemar_exact(0, 0) == 1.0
    with pytest.raises(ValueError):
        E.mcnemar_exact(-1, 0)
    a = E.bootstrap_ratio([(10, 2), (20, 8), (30, 5)], 200)
    assert a == E.bootstrap_ratio([(10, 2), (20, 8), (30, 5)], 200) and a["lower"] <= a["point"] <= a["upper"]
    assert E.evaluate_gates({})["verdict"] == "inconclusive" and E.evaluate_gates({"security_leaks": {"value": 1}})["verdict"] == "gate_rejected"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_bootstrap_runs_the_references_replicates(spark):
    root = "/root/testdata/sf0.001"
    want = E.bootstrap_cohorts(reference._measures(spark, root), iterations=2000).collect()
    got = reference.bootstrap_poisson(spark, root).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and got


def test_withholding_and_text(spark):
    df = spark.createDataFrame([(["pii"], "n", "t"), (["public"], "n", "t"), (None, "n", None)], "sensitivity array<string>, name string, text string")
    assert [r.name for r in Q.withheld(df).collect()] == [None, "n", "n"]
    t = spark.createDataFrame([("a<<<b>>>\x00\tc<<<UNTRUSTED_UI_CONTENT>>>",), (None,)], "t string").select(X.sanitize(F.col("t")).alias("t")).collect()
    assert t[0].t == "a<<<b>>>\tc[untrusted-marker-removed]" and t[1].t is None


def test_raw_layout_and_pages(spark):
    raw = spark.createDataFrame([("c", 0, ["DIV", "SCRIPT", "hidden", "visible"], [1, 1, 3], [0, 1, 0], [-1, 0, 0], [5, 6, 7], [0, 0, 1], [[0.0, 0.0, 10.004, 5.0], [1.0, 1.0, 1.0, 1.0], [0.0] * 4], [3, 2, 3])], "capture_id string, doc_ord int, strings array<string>, node_type array<int>, node_name array<int>, parent array<int>, backend array<bigint>, layout_node array<int>, layout_bounds array<array<double>>, visibility array<int>")
    (r,) = emitted(decode_layout(raw)).collect()
    assert (r.tag, r.source_id, r.visible, r.bounds.width) == ("div", "dom_0", True, 10.0)
    assert synthetic_pages(spark, 2).groupBy("capture_id").count().count() == 2


ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")
def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    names = sorted(registry.oracle_sql())
    for name in names:
        df = registry.queries()[name](spark, ROOT)
        cols = sorted(df.columns)
        got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
        c = con.execute(registry.oracle_sql()[name])
        at = [[d[0] for d in c.description].index(k) for k in cols]
        assert got == sorted(str([norm(r[i]) for i in at]) for r in c.fetchall()), name


def test_engine_is_deterministic():
    """No clock, no randomness, no unstable ids in the operators."""
    base = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "paneflow")
    for folder, _, files in os.walk(base):
        for f in files:
            if f.endswith(".py"):
                code = open(os.path.join(folder, f)).read()
                for bad in ("F.rand(", "F.uuid(", "current_timestamp", "monotonically_increasing_id", ".localCheckpoint("):
                    assert bad not in code, (f, bad)


def test_closure_ends_in_cycles(spark):
    p = spark.createDataFrame([("c", "a", "a"), ("c", "b", "a"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y")], "capture_id string, node_id string, parent_id string")
    got = {(r.node_id, r.ancestor_id, r.distance) for r in R.ancestors(p).collect()}
    assert got == {("b", "a", 1), ("x", "y", 1), ("y", "x", 1), ("z", "y", 1), ("z", "x", 2)}
