"""Contracts, evaluation and the capture side, by hand-made cases."""

import pytest

from paneflow.operators import contracts as C
from paneflow.operators import evaluate as E
from paneflow.operators import identity as I
from paneflow.session import ship_package
from paneflow.sources import captures as K
from pyspark.sql import functions as F


def test_schema_changes_have_their_kinds():
    old = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "pattern": "^x"}, "b": {"const": 1}, "c": {"enum": [1, 2]}, "gone": {}}, "$defs": {"d": {"type": "string"}, "e": {}}}
    new = {"type": "object", "required": ["a", "b", "must"], "properties": {"a": {"type": "number", "pattern": "^y"}, "b": {"const": 2}, "c": {"enum": [2, 3]}, "may": {}, "must": {}}, "$defs": {"d": {"type": "null"}}}
    assert C.diff_json_schema(old, new) == [
        ("type_changed", "#/properties/a"), ("pattern_changed", "#/properties/a"), ("const_changed", "#/properties/b"), ("property_made_required", "#/properties/b"), ("removed_enum_value", "#/properties/c"), ("added_enum_value", "#/properties/c"),
        ("removed_property", "#/properties/gone"), ("added_optional_property", "#/properties/may"), ("added_required_property", "#/properties/must"), ("type_changed", "#/$defs/d"), ("removed_property", "#/$defs/e"),
    ]
    assert C.diff_json_schema(old, old) == [] == C.diff_json_schema(True, old)


@pytest.mark.parametrize(("kind", "new", "ok"), [("removed_property", "1.3.0", False), ("removed_property", "2.0.0", True), ("added_enum_value", "1.2.9", False), ("added_optional_property", "1.3.0", True), (None, "1.2.0", True)])
def test_version_steps(kind, new, ok):
    assert C.check_version_bump("1.2.0", new, [(kind, "#")] if kind else [])["ok"] is ok
    with pytest.raises(ValueError):
        C.check_version_bump("1.2", new, [])


def test_migration_and_readers():
    blob = {"schemaVersion": "1.0.0", "nodes": []}
    got = C.migrate_to_current(blob)
    assert got == {"snapshot": blob, "sourceSchemaVersion": "1.0.0", "migrated": False} and got["snapshot"] is not blob
    assert C.reader_supports_major(1) and not C.reader_supports_major(0) and not C.reader_supports_major(3)
    with pytest.raises(ValueError):
        C.migrate_to_current({"schemaVersion": "3.0.0"})


def test_references_are_members_or_refused():
    s = I.seal({"schemaVersion": "1.0.0", "nodes": [{"nodeId": "a"}, {"nodeId": "b"}]})
    claim, ref = (s["snapshotId"], s["contentHash"]), s["nodes"][1]["elementRef"]
    assert C.resolve_ref(s, claim, ref) == "ok" and C.resolve_ref(s, claim, "ptr:1") == "malformed_ref"
    assert C.resolve_ref(s, claim, ref[:-1] + "7") == "ref_not_in_snapshot" and C.resolve_ref(s, (claim[0], "x"), ref) == "wrong_snapshot_identity"
    assert C.resolve_ref({**s, "nodes": s["nodes"][:1]}, claim, ref) == "snapshot_identity_invalid"


def test_closed_schemas_and_self_description():
    schema = {"type": "object", "additionalProperties": False, "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^a"}, "n": {"type": "number", "minimum": 0, "maximum": 1}, "list": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/x"}}}, "$defs": {"x": {"enum": [1, 2]}}}
    assert C.closed_issues({"id": "ab", "n": 1, "list": [1]}, schema) == []
    assert C.closed_issues({"id": "b", "n": 2, "list": [3], "odd": 1}, schema) == ["/id must match ^a", "/n is out of bounds", "/list/0 must be one of [1, 2]", "/odd is unknown"]
    assert C.closed_issues({"list": []}, schema) == ["/id is required", "/list has too few items"] and C.closed_issues(True, {"type": "number"}) == ["/ must be number"]
    d = C.capability_descriptor()
    assert C.descriptor_issues(d) == [] and C.descriptor_digest(d) == C.descriptor_digest(dict(reversed(d.items())))
    assert "not_representation_only" in C.descriptor_issues({**d, "kind": "agent"}) and C.compare_shadow("c", "a", "b")["differs"]


def test_exact_bootstrap_equals_the_sequential_one(spark):
    draw = E.mulberry32(42)
    first = [draw() for _ in range(6)]
    assert first[:2] == pytest.approx([0.6011037519201636, 0.44829055899754167])
    got = spark.range(1, 7).select(E.nth_draw(F.col("id"), 42).alias("d")).collect()
    assert [r.d for r in got] == first
    pairs = [(float(10 + i * 7 % 13), float(i * 5 % 9)) for i in range(23)]
    df = spark.createDataFrame([("c", i, b, c) for i, (b, c) in enumerate(pairs)], "cohort string, key bigint, base double, candidate double")
    want = E.bootstrap_ratio(pairs, 300)
    (r,) = E.bootstrap_exact(df, 300).collect()
    assert (r.point, r.lower, r.upper, r.pairs) == pytest.approx((want["point"], want["lower"], want["upper"], 23))
    assert E.bootstrap_exact(df.limit(0), 10).count() == 0


def test_gates_fail_closed():
    full = {"token_reduction": {"ci_lower": 0.8}, "focus_view_p95_text_tokens": {"value": 900}, "repeated_review_cost_reduction": {"value": 0.7}, "valid_ref_rate": {"value": 1.0}, "grounding_recall_at_1": {"value": 0.5}, "cross_snapshot_match_precision": {"value": 0.99}, "coord_transform_error": {"value": 4.0, "shorter_side": 900}, "delta_hash_match_rate": {"value": 1.0}, "finding_quality_retention": {"value": 1.0, "precision_loss": 0.5}, "cohort_regression": {"value": 0}, "security_leaks": {"value": 0}}
    assert E.evaluate_gates(full)["promote"] and len(E.GATES) == 11 and E.evaluate_gates({})["verdict"] == "inconclusive"
    assert E.evaluate_gates({**full, "security_leaks": {"value": 1}})["verdict"] == "gate_rejected"
    assert E.evaluate_gates({**full, "token_reduction": {"ci_lower": 0.9, "diagnostic_only": True}})["verdict"] == "inconclusive"
    assert E.evaluate_gates({**full, "coord_transform_error": {"value": 4.6, "shorter_side": 900}})["verdict"] == "gate_rejected"
    assert E.evaluate_gates({**full, "finding_quality_retention": {"value": 1.0, "precision_loss": 0.5, "blocker_missed": True}})["verdict"] == "gate_rejected"
    assert E.decision_report(full, "m")["reportId"] == E.decision_report(dict(reversed(full.items())), "m")["reportId"]


def test_manifests_notice_changes():
    fixtures = [{"fixture_id": i, "cohorts": ["clean"], "content": {"v": i}, "provenance": {"source": "made"}} for i in ("b", "a")]
    m = E.freeze_manifest(fixtures)
    assert E.manifest_issues(m, fixtures) == [] and m == E.freeze_manifest(fixtures[::-1])
    assert E.manifest_issues(m, [{**fixtures[0], "content": {}}]) == ["missing_fixture:a", "content_changed:b"]
    assert E.manifest_issues({**m, "version": "2"}, fixtures) == ["manifest_id_mismatch"]


def test_representations_are_compared_where_both_are_there(spark):
    ship_package(spark)
    t = lambda *r: spark.createDataFrame(list(r), "fixture string, text string")
    shots = spark.createDataFrame([("x", 56.0, 28.0)], "fixture string, width double, height double")
    rows = E.representation_rows(t(("x", "a" * 400), ("y", "b" * 40)), t(("x", "a" * 80)), shots, t(("x", "g" * 800)), t(("x", "f" * 100)))
    got = {(r.fixture, r.representation): r for r in rows.collect()}
    assert len(got) == 12 and got["x", "b2_screenshot"].visual_tokens == 2 and not got["y", "b5_focused_view"].available and got["x", "b0_raw_capture"].text_tokens == 100 and got["x", "b0_raw_capture"].deflated < 30
    (r,) = E.compare_representations(rows, spark.createDataFrame([("x", "c"), ("y", "c")], "fixture string, cohort string")).collect()
    assert (r.cohort, r.pairs, r.reduction) == ("c", 1, 0.75)
    assert E.markdown([{"a": 0.5, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 0.5 |  |\n"


def test_a_raw_payload_becomes_tables(spark):
    """html > div#root(redacted) > p with text, and a script that is skipped; one deep chain."""
    raw = spark.createDataFrame([("c", 0, ["HTML", "DIV", "P", "SCRIPT", "visible"], [1, 1, 1, 1, 3], [0, 1, 2, 3, 2], [-1, 0, 1, 1, 2], [1, 2, 3, 4, 5], [0, 1, 2, 3], [[0.0, 0.0, 100.0, 100.0], [0.0, 0.0, 50.0, 50.0], [1.0, 1.0, 10.0, 10.0], [0.0] * 4], [4, 4, 4, 4], [{}, {"id": "root", "class": "x"}, {}, {}, {}], [{"color": "red", "line-height": "normal", "float": "left"}, {}, {}, {}, {}])],
        "capture_id string, doc_ord int, strings array<string>, node_type array<int>, node_name array<int>, parent array<int>, backend array<bigint>, layout_node array<int>, layout_bounds array<array<double>>, visibility array<int>, attributes array<map<string,string>>, styles array<map<string,string>>")
    texts = spark.createDataFrame([("c", 0, 4, 2, 0, 3, "one  two", 1.0, 1.0, 5.0, 5.0), ("c", 0, 4, 2, 3, 5, "one  two", 1.0, 6.0, 5.0, 5.0)], "capture_id string, doc_ord int, text_node int, parent_idx int, start int, length int, text string, x double, y double, w double, h double")
    ax = spark.createDataFrame([("c", "frame_0", 0, "A", None, "RootWebArea", None, None, {"haspopup": "true", "odd": "1"}, False, 1), ("c", "frame_0", 1, "B", "A", "StaticText", "one", None, {}, False, 99), ("c", "frame_0", 2, "D", "B", "paragraph", None, None, {}, True, 3)], "capture_id string, frame_id string, ord int, source_id string, parent_source_id string, role string, name string, description string, state map<string,string>, ignored boolean, backend_id bigint")
    roots = spark.createDataFrame([("c", 2)], "capture_id string, backend_id bigint")
    t = K.capture_tables(raw, texts, ax, roots)
    dom = {r.tag: r for r in t["dom_nodes"].collect()}
    assert set(dom) == {"html", "div", "p"} and dom["p"].parent_source_id == dom["div"].source_id == "dom_1" and dom["div"].attributes == {"id": "root"} and dom["html"].role == "document"
    assert list(dom["html"].style_facts) == ["color"]
    (run,) = t["text_runs"].collect()
    assert (run.text, run.dom_source_id, run.bounds.height) == (K.MASK, "dom_2", 10.0) and t["redacted"].count() == 1 and t["reasons"].count() == 0
    rows = {r.role: r for r in t["ax_nodes"].collect()}
    assert set(rows) == {"RootWebArea", "paragraph"} and rows["paragraph"].parent_source_id is None and rows["RootWebArea"].state == {"haspopup": "true"}
    assert {r.reason for r in K.capture_tables(raw, texts, ax, roots, max_nodes=1)["reasons"].collect()} == {"node_budget"}


def test_frames_trees_and_probes(spark):
    frames = spark.createDataFrame([("c", "a", None, 0), ("c", "b", "a", 2), ("c", "d", "b", 0), ("c", "e", "a", 1)], "capture_id string, frame_id string, parent_frame_id string, ord int")
    assert [r.frame_id for r in K.frame_ids(frames).orderBy("place").collect()] == ["a", "e", "b", "d"]
    trees = spark.createDataFrame([("c", "a", "1", None), ("c", "b", "1", "0")], "capture_id string, frame_id string, source_id string, parent_source_id string")
    rows, lost = K.collect_ax(trees, frames)
    assert {(r.source_id, r.parent_source_id) for r in rows.collect()} == {("a_1", None), ("b_1", "b_0")} and lost.count() == 2
    probe = lambda *r: spark.createDataFrame(list(r), "capture_id string, digest string")
    got = {r.capture_id: r.stable for r in K.stability(probe(("x", "1"), ("y", "1"), ("z", "1")), probe(("x", "1"), ("y", "2"))).collect()}
    assert got == {"x": True, "y": False, "z": False}
    chain = spark.createDataFrame([("c", i, i - 1) for i in range(200)], "capture_id string, idx int, parent_idx int")
    kept = chain.where("idx in (0, 199)").select("capture_id", "idx")
    assert [(r.idx, r.ancestor_idx) for r in K.nearest_emitted(chain, kept).collect()] == [(199, 0)]
