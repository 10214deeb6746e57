"""Schema drift, rescue ingestion and units."""

import json
from datetime import datetime

import pytest

from paneflow.functions.lengths import parse_length, to_css_px
from paneflow.operators import units
from paneflow.operators.schema_drift import Field, drift, rescue_ingest
from paneflow.operators.units import UnitModelSpec, normalize_lengths
from pyspark.sql import functions as F

RAW = "record_id bigint, feed string, file_no int, file_name string, payload string, kind string"


def raw(spark, files, broken=()):
    rows, k = [], 0
    for (feed, no), objs in files.items():
        for o in objs:
            rows.append((k, feed, no, f"{feed}/part-{no:05d}.jsonl", o if isinstance(o, str) else json.dumps(o), "clash"))
            k += 1
    return spark.createDataFrame(rows, RAW)


def found(df):
    return {(r.feed, r.file_no, r.kind, r.path, r.new_path) for r in drift(df).collect()}


P = "#/properties/"


def test_changes_of_each_kind(spark):
    a = [{"nodeId": f"n{i}", "name": f"x{i}", "w": i + 0.5, "old": True, "g": {"x": i, "h": f"{i}"}} for i in range(10)]
    b = [{"nodeId": f"n{i}", "label": f"x{i}", "w": str(i), "fresh": i, "g": {"x": i, "height": f"{i}"}} for i in range(10)]
    got = found(raw(spark, {("f", 1): a, ("f", 4): b}))
    assert got == {("f", 4, "renamed_property", P + "name", P + "label"), ("f", 4, "type_changed", P + "w", ""), ("f", 4, "removed_property", P + "old", ""), ("f", 4, "added_property", P + "fresh", ""), ("f", 4, "renamed_property", P + "g/properties/h", P + "g/properties/height")}


def test_a_tenth_of_the_lines_and_broken_lines(spark):
    a = [{"nodeId": f"n{i}"} for i in range(20)]
    b = [{"nodeId": f"n{i}", **({"rare": 1} if i < 1 else {}), **({"some": None} if i < 2 else {})} for i in range(20)]
    got = found(raw(spark, {("f", 1): [*a, '{"nodeId":', '{"a":1} x', '{"a":1},{"b":2}', "[1]", "null", ""], ("f", 2): b}))
    assert got == {("f", 2, "added_property", P + "some", "")}


def test_empty_table_one_file_and_nulls(spark):
    assert found(raw(spark, {}).limit(0)) == set()
    assert found(raw(spark, {("f", 1): [{"nodeId": "a"}]})) == set()
    odd = spark.createDataFrame([(1, None, 1, None, "{}", ""), (2, "f", None, "f/part-00003.jsonl", '{"a":1}', ""), (3, "f", 1, None, '{"b":1}', ""), (4, "f", 1, None, None, "")], RAW)
    assert found(odd) == {("f", 3, "added_property", P + "a", ""), ("f", 3, "removed_property", P + "b", "")}


def test_rescue_and_replay(spark):
    df = raw(spark, {("f", 1): [{"schemaVersion": "1.0.0", "nodeId": "a", "name": "x", "w": 1.5}], ("f", 2): [{"schemaVersion": "2.0.0", "nodeId": "b", "label": "y", "w": "bad", "new": {"k": 1}}, '{"nodeId"']})
    target = [Field("node_id", P + "nodeId", "string"), Field("name", P + "name", "string"), Field("w", P + "w", "double")]
    before = {r.node_id: r for r in rescue_ingest(df, target).collect()}
    assert before["a"]._rescued is None and before["a"].w == 1.5 and before["b"].name is None
    assert json.loads(before["b"]._rescued) == {P + "label": "y", P + "w": "bad", P + "new": {"k": 1}}
    renames = spark.createDataFrame([("f", 2, P + "name", P + "label")], "feed string, file_no int, path string, new_path string")
    after = {r.node_id: r for r in rescue_ingest(df, target, renames).collect()}
    assert after["b"].name == "y" and json.loads(after["b"]._rescued) == {P + "w": "bad", P + "new": {"k": 1}} and after["b"].source_schema_version == "2.0.0"


@pytest.mark.parametrize(
    ("text", "unit", "px"),
    [("16px", None, 16), ("1in", None, 96), ("  1.5PC ", None, 24), ("82,55mm", None, 312), ("5/8in", None, 60), ("1 3/4 in", None, 168), ("1.2e+1pt", None, 16), ("about 14 CSS px", None, 14), ("ca. 12 pts wide", None, 16), ('approx. 0.5 "', None, 48), ("24", None, 24), ("9.52", "MM", 9.52 * 96 / 25.4), ("30 physical pixels", None, 15), ("30dpx", None, 15), ("30", "image_px", 15), ("20px", "mm", 20), ("1.5em", None, None), ("50%", None, None), ("calc(100% - 8px)", None, None), ("auto", None, None), ("", "px", None), (None, "px", None), ("5constructor", None, None), ("-4px", None, -4), ("40 quarter-millimetres", None, 40 * 96 / 101.6), ("1,234.5px", None, 1234.5)],
)
def test_lengths(spark, text, unit, px):
    df = spark.createDataFrame([(text, unit)], "t string, u string").select(parse_length(F.col("t"), F.col("u")).alias("p"))
    got = df.select(to_css_px(F.col("p.value"), F.when(F.col("p.source") == "none", "px").otherwise(F.col("p.unit")), F.lit(2.0)).alias("v")).first().v
    assert got is None if px is None else got == pytest.approx(px)


def test_readings_against_the_page(spark):
    t = datetime(2025, 1, 1)
    caps = spark.createDataFrame([("c", (100.0, 100.0, 2.0, 0.0, 0.0), t)], "capture_id string, viewport struct<width_css_px:double,height_css_px:double,device_scale_factor:double,scroll_x_css_px:double,scroll_y_css_px:double>, received_at timestamp")
    facts = {"width": ("96px", None), "height": (None, 10.0), "margin": ("2em", None)}
    dom = spark.createDataFrame([("c", "d", {k: v for k, v in facts.items()}, t, 7)], "capture_id string, source_id string, style_facts map<string,struct<s:string,n:double>>, received_at timestamp, value int")
    rows = [(1, "c", "d", "width", "p", "1in", None), (2, "c", "d", "width", "p", "91", "px"), (3, "c", "d", "width", "p", "92px", None), (4, "c", "d", "height", "p", "20 device px", None), (5, "c", "d", "height", "p", "20", None), (6, "c", "d", "margin", "p", "9px", None), (7, "x", "d", "width", "p", "9px", None), (8, "c", "d", "width", "p", None, None), (8, "c", "d", "width", "p", None, None)]
    reads = spark.createDataFrame([(*r, t) for r in rows], "reading_id bigint, capture_id string, source_id string, property string, provider string, original string, unit string, received_at timestamp")
    out = {r.reading_id: r for r in normalize_lengths(reads, dom, caps, UnitModelSpec(trees=2)).collect()}
    assert {k for k, r in out.items() if r.contradicts} == {2, 5} and len(out) == 8
    assert out[5].unit_source == "convention" and out[5].route in ("assigned", "review") and out[8].route is None and out[6].style_css_px is None
    assert normalize_lengths(reads.limit(0), dom.limit(0), caps.limit(0)).count() == 0


def test_forest_learns_missing_units(spark):
    """Held-out: units hidden from readings whose style facts give the ratio away."""
    t = datetime(2025, 1, 1)
    caps = spark.createDataFrame([("c", (100.0, 100.0, 2.0, 0.0, 0.0), t)], "capture_id string, viewport struct<width_css_px:double,height_css_px:double,device_scale_factor:double,scroll_x_css_px:double,scroll_y_css_px:double>, received_at timestamp")
    dom = spark.createDataFrame([("c", f"d{i}", {"width": (None, 20.0 + i)}, t) for i in range(300)], "capture_id string, source_id string, style_facts map<string,struct<s:string,n:double>>, received_at timestamp")
    factor = {"px": 1.0, "pt": 96 / 72, "mm": 96 / 25.4}
    truth, rows = {}, []
    for i in range(300):
        u = list(factor)[i % 3]
        truth[i] = u
        rows.append((i, "c", f"d{i}", "width", f"p{i % 3}", f"{(20.0 + i) / factor[u]:.4f}", u if i % 5 else None, t))
    reads = spark.createDataFrame(rows, "reading_id bigint, capture_id string, source_id string, property string, provider string, original string, unit string, received_at timestamp")
    out = normalize_lengths(reads, dom, caps, UnitModelSpec(trees=8), bare_unit=None).where("predicted_unit is not null").collect()
    assert len(out) == 60 and sum(r.predicted_unit == truth[r.reading_id] for r in out) >= 54


def bare_page(spark, bare, stated=300):
    """Stated readings in px, pt and mm that fit the page, and bare ones of the given value where the page has 40 px and the provider states points."""
    t = datetime(2025, 1, 1)
    caps = spark.createDataFrame([("c", (100.0, 100.0, 2.0, 0.0, 0.0), t)], "capture_id string, viewport struct<width_css_px:double,height_css_px:double,device_scale_factor:double,scroll_x_css_px:double,scroll_y_css_px:double>, received_at timestamp")
    factor = {"px": 1.0, "pt": 96 / 72, "mm": 96 / 25.4}
    rows = [(i, "c", f"d{i}", "width", f"p{i % 3}", f"{(20.0 + i) / factor[u]:.4f}", u, t) for i in range(stated) for u in [list(factor)[i % 3]]]
    rows += [(10_000 + k, "c", "b", "width", "p1", v, None, t) for k, v in enumerate(bare)]
    dom = spark.createDataFrame([("c", f"d{i}", {"width": (None, 20.0 + i)}, t) for i in range(stated)] + [("c", "b", {"width": (None, 40.0)}, t)], "capture_id string, source_id string, style_facts map<string,struct<s:string,n:double>>, received_at timestamp")
    return spark.createDataFrame(rows, "reading_id bigint, capture_id string, source_id string, property string, provider string, original string, unit string, received_at timestamp"), dom, caps


def test_contradictions_come_through_the_forest(spark, monkeypatch):
    """30 would be points by provider and ratio; under the convention it is px, and the forest is to know that."""
    page, spec, seen = bare_page(spark, ["30"] * 20 + ["40"] * 20), UnitModelSpec(trees=8), []
    predict = units.predict_units
    monkeypatch.setattr(units, "predict_units", lambda *a, **k: seen.append(predict(*a, **k)) or seen[-1])
    assert {r.reading_id for r in units.contradictions(*page, spec=spec).collect()} == set(range(10_000, 10_020))
    assert len(seen) == 1 and [r.predicted_unit for r in seen[0].collect()] == ["px"] * 40
    out = normalize_lengths(*page, spec).where("unit_source = 'convention'").collect()
    assert {r.route for r in out} == {"assigned"} and {r.unit for r in out} == {"px"}


@pytest.mark.parametrize("stated", [0, 1, 300])
def test_the_convention_answers_the_review(spark, monkeypatch, stated):
    """A forest that is sure of another unit, or none at all, changes no row; without a convention an unsure reading has no unit."""
    page = bare_page(spark, ["30", "40"], stated)
    if stated == 300:
        monkeypatch.setattr(units, "predict_units", lambda rows, *a: rows.where("unit_source = 'none'").select("reading_id", F.lit("pt").alias("predicted_unit"), F.lit(1.0).alias("unit_confidence")))
    assert [r.reading_id for r in units.contradictions(*page).collect()] == [10_000]
    assert {r.route for r in normalize_lengths(*page).where("unit_source = 'convention'").collect()} == {"review"}
    if stated < 300:
        assert units.contradictions(*page, bare_unit=None).count() == 0


def test_odd_numbers_do_not_stop_the_forest(spark):
    """Scales and lengths that are no finite numbers, nulls and zero among the readings that the forest sees."""
    reads, dom, caps = bare_page(spark, ["30", "40", "0", "1e308"])
    t, nan, inf = datetime(2025, 1, 1), float("nan"), float("inf")
    caps = caps.unionByName(spark.createDataFrame([(c, (1.0, 1.0, s, 0.0, 0.0), t) for c, s in (("n", nan), ("i", inf), ("z", 0.0), ("m", None))], caps.schema))
    dom = dom.unionByName(spark.createDataFrame([(c, "e", {"width": ("40 device px", None), "height": ("1e308in", None)}, t) for c in "nizm"], dom.schema))
    odd = [(20_000 + 10 * i + k, c, "e", p, v, o, None, t) for i, c in enumerate(["n", "i", "z", "m", None]) for k, (p, v, o) in enumerate([("width", "p1", "30"), ("height", None, "30"), (None, "p1", "30pt"), ("width", "p2", "30 device px")])]
    out = [r.reading_id for r in units.contradictions(reads.unionByName(spark.createDataFrame(odd, reads.schema)), dom, caps, spec=UnitModelSpec(trees=4)).collect()]
    # 40 device px at an infinite scale are 0 px, from which 30 differs
    assert sorted(out) == [10_000, 10_002, 10_003, 20_010]
