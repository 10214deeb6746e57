"""Snapshot changes against brute force, and edge cases."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paneflow.operators.snapshot_changes import ChangeSpec, SnapshotIndex, changes_between, snapshot_pairs

T0 = datetime(2025, 1, 1)
HEAD = "snapshot_id string, page_key string, content_hash string, captured_at timestamp, received_at timestamp"
NODE = "snapshot_id string, node_id string, kind string, parent_node_id string, role string, name string, text string, viewport_rect struct<x:double,y:double,width:double,height:double>, color string, font_size_css_px double, received_at timestamp, change string"


def head(s, page, day, hash_="h", got=0):
    return (s, page, hash_, T0 + timedelta(days=day), T0 + timedelta(days=day + got))


def node(s, n, name="a", x=0.0, got=0, role=None, rect=True):
    return (s, n, "text", None, role, name, None, (x, 0.0, 10.0, 10.0) if rect else None, None, None, T0 + timedelta(days=got), "clash")


def found(spark, heads, nodes):
    df = changes_between(spark.createDataFrame(heads, HEAD), spark.createDataFrame(nodes, NODE))
    return {(r.base_snapshot_id, r.target_snapshot_id, r.node_id, r.change) for r in df.collect()}


def test_kinds_of_change(spark):
    heads = [head("s2", "p", 40), head("s1", "p", 1), head("s1", "p", 1, None, 3), head("other", "q", 5)]
    nodes = [node("s1", "same"), node("s2", "same", x=0.5), node("s1", "moved"), node("s2", "moved", x=0.51), node("s1", "gone"), node("s2", "new"), node("s1", "null"), node("s2", "null", role="x"), node("s1", "rect"), node("s2", "rect", rect=False), node("other", "z")]
    assert found(spark, heads, nodes) == {("s1", "s2", "moved", "changed"), ("s1", "s2", "gone", "removed"), ("s1", "s2", "new", "added"), ("s1", "s2", "null", "changed"), ("s1", "s2", "rect", "changed")}


def test_latest_delivery_holds_and_repeats_count_once(spark):
    heads = [head("s1", "p", 1), head("s2", "p", 2), head("s2", "p", 2, "h", 5)]
    nodes = [node("s1", "a", "x"), node("s2", "a", "wrong", got=1), node("s2", "a", "x", got=9), node("s2", "a", "x", got=9)]
    assert found(spark, heads, nodes) == set()


def test_empty_snapshot_and_empty_tables(spark):
    heads = [head("s1", "p", 1), head("s2", "p", 2), head("s3", "p", 3)]
    assert found(spark, heads, [node("s1", "a"), node("s3", "a")]) == {("s1", "s2", "a", "removed"), ("s2", "s3", "a", "added")}
    assert found(spark, [], []) == set()
    assert found(spark, heads, [(None, "a", *node("s", "a")[2:]), node("s1", None)]) == set()


def test_pairs_follow_capture_time_over_buckets(spark):
    heads = [head(f"s{d:03d}", "p", d) for d in (1, 70, 33, 400, 2)] + [head("t1", "q", 3), (None, "q", "h", T0, T0), ("n", None, "h", T0, T0)]
    got = {(r.base_snapshot_id, r.target_snapshot_id) for r in snapshot_pairs(spark.createDataFrame(heads, HEAD)).collect()}
    assert got == {("s001", "s002"), ("s002", "s033"), ("s033", "s070"), ("s070", "s400")}


def test_values_are_fetched_for_changes(spark):
    df = changes_between(spark.createDataFrame([head("s1", "p", 1), head("s2", "p", 2)], HEAD), spark.createDataFrame([node("s1", "a", "x"), node("s2", "a", "y"), node("s1", "b"), node("s2", "b")], NODE), with_values=True)
    (r,) = df.collect()
    assert (r.old.name, r.new.name) == ("x", "y")


def test_index_is_swapped_after_each_snapshot(spark, tmp_path):
    index = SnapshotIndex(str(tmp_path), ChangeSpec(buckets=4))
    entry = "series string, key string, n int, h bigint, x double, y double, width double, height double"
    rows = lambda *r: spark.createDataFrame([(s, k, 0, h, 0.0, 0.0, 1.0, 1.0) for s, k, h in r], entry)
    due = lambda *r: spark.createDataFrame(list(r), "series string, follows boolean").withColumn("last", F.lit(0))
    got = lambda df: {(r.series, r.key, r.change) for r in df.collect()}
    assert got(index.advance(rows(("p", "a", 1), ("p", "b", 2), ("q", "z", 1)), due(("p", False), ("q", False)))) == set()
    first = index.current(spark)
    # q is not delivered and keeps its entries
    assert got(index.advance(rows(("p", "a", 9), ("p", "c", 3)), due(("p", True)))) == {("p", "a", "changed"), ("p", "b", "removed"), ("p", "c", "added")}
    assert index.current(spark) != first and not os.path.exists(f"{first}/changed=false")
    assert got(index.advance(rows(("p", "a", 9), ("p", "c", 3)), due(("p", True), ("q", True)))) == {("q", "z", "removed")}
    # another session, which does not know the tables, goes on where this one ended
    other = spark.newSession()
    last = SnapshotIndex(str(tmp_path), ChangeSpec(buckets=4))
    spark.sql(f"DROP TABLE {last._name(last.current(spark))}")
    moved = other.createDataFrame([("p", "a", 0, 9, 0.6, 0.0, 1.0, 1.0), ("p", "c", 0, 3, 0.5, 0.0, 1.0, 1.0)], entry)
    assert got(last.advance(moved, other.createDataFrame([("p", True, 0)], "series string, follows boolean, last int"))) == {("p", "a", "changed")}


def test_a_probe_shuffles_nothing(spark, tmp_path):
    index = SnapshotIndex(str(tmp_path), ChangeSpec(buckets=4))
    df = spark.createDataFrame([("p", f"k{i}", 0, i, 0.0, 0.0, 1.0, 1.0) for i in range(50)], "series string, key string, n int, h bigint, x double, y double, width double, height double")
    a = index.receive(df)
    from pyspark.sql import Window as W

    plan = a.withColumn("p", F.lag("n").over(W.partitionBy("series", "key").orderBy("n")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    heads = [head(f"s{p}{i}", f"p{p}", i) for p in range(3) for i in range(4)]
    nodes = [node(h[0], f"n{k}", r.choice("ab"), r.choice([0.0, 0.4, 0.6, 2.0])) for h in heads for k in range(8) if r.random() < 0.7]
    by = {}
    for n in nodes:
        by.setdefault(n[0], {})[n[1]] = n
    want = set()
    for p in range(3):
        for i in range(3):
            a, b = by.get(f"s{p}{i}", {}), by.get(f"s{p}{i + 1}", {})
            for k in {*a, *b}:
                c = "added" if k not in a else "removed" if k not in b else "changed" if a[k][5] != b[k][5] or abs(a[k][7][0] - b[k][7][0]) > 0.5 else None
                if c:
                    want.add((f"s{p}{i}", f"s{p}{i + 1}", k, c))
    assert found(spark, heads, nodes) == want
