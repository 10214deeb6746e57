"""Builds, seals and views against published figures of the synthetic dashboard, and small cases by hand."""

import json

import pytest

from paneflow.functions.canonical import canonical
from paneflow.operators import assemble as A
from paneflow.operators import deltas as D
from paneflow.operators import identity as I
from paneflow.operators import observe as O
from paneflow.operators import query as Q
from paneflow.operators import structure as R
from paneflow.operators.requests import RequestError, ViewSpec
from paneflow.session import ship_package
from paneflow.sources.bundles import DASHBOARD_TOKENS, dashboard, input_hashes, tables_of
from pyspark.sql import functions as F

OPTIONS = A.BuildOptions(builder_version="builder@1")
PROFILE = A.Profile("synthetic-dna@1", "sha256:" + "5" * 64, "approved", DASHBOARD_TOKENS)
WIDE = dict(max_text_tokens=1_000_000, max_nodes=10_000, max_edges=10_000)


def build(spark, bundles, profile=None, options=OPTIONS):
    ship_package(spark)
    df = spark.createDataFrame([(json.dumps(b),) for b in bundles], "bundle string")
    t = tables_of(df)
    return A.build_snapshots(t["captures"], t["dom_nodes"], t["ax_nodes"], t["text_runs"], t["derived_items"], t["screenshots"], profile, options, input_hashes(df, options.json(), profile.json() if profile else None))


def page(capture_id="c", dom=(), ax=(), runs=(), **more):
    return {"schemaVersion": "1.0.0", "captureId": capture_id, "captureVersion": "v", "repository": {"owner": "o", "name": "n"}, "route": "/", "viewport": {"widthCssPx": 1000, "heightCssPx": 1000, "deviceScaleFactor": 2, "scrollXCssPx": 0, "scrollYCssPx": 0},
            "documents": [{"frameId": "main", "url": "https://a.test/", "domLayoutNodes": list(dom), "accessibilityNodes": list(ax), "textRuns": list(runs)}], "pageHealth": {"stable": True, "partial": False, "reasons": []}, "redaction": {"policyVersion": "1", "applied": False, "redactedSourceIds": []}, **more}


def button(i, x, y, w=100, h=20, **more):
    return {"sourceId": f"d{i}", "frameId": "main", "tag": "button", "role": "button", "bounds": {"x": x, "y": y, "width": w, "height": h}, "visible": True, **more}


@pytest.fixture(scope="module")
def board(spark):
    return build(spark, [dashboard()], PROFILE)


def test_dashboard_has_the_published_size(board):
    b = dashboard()
    assert [len(b["documents"][0][k]) for k in ("domLayoutNodes", "accessibilityNodes", "textRuns")] == [130, 130, 93]
    (h,) = board.headers.collect()
    assert (h.n_nodes, h.n_edges, h.n_regions, h.n_conflicts) == (130, 400, 35, 1) and board.issues.count() == 0


@pytest.mark.parametrize(("kind", "size", "tokens", "n"), [("summary", 31425, 7857, 118), ("actionMap", 3394, 849, 14), ("violations", 20355, 5089, 85), ("focus", 4155, 1039, 9), ("patchContext", 1439, 360, 1)])
def test_views_have_the_published_sizes(board, kind, size, tokens, n):
    refs = board.nodes.where("name = 'New review'").select("snapshot_id", F.col("element_ref").alias("ref")) if kind in ("focus", "patchContext") else None
    (v,) = Q.query_view(board, ViewSpec(kind, **WIDE), refs).collect()
    assert (v.serialized_bytes, v.estimated_text_tokens, len(v.included_node_ids), v.truncated) == (size, tokens, n, False)


def test_budget_is_halved_until_the_text_fits(board):
    (v,) = Q.query_view(board, ViewSpec("summary", max_text_tokens=1000, max_nodes=400, max_edges=400)).collect()
    assert v.estimated_text_tokens == 644 and len(v.included_node_ids) == 6
    assert v.reasons == ["text_token_budget: node budget reduced 400 → 3", "node_budget: 119 nodes omitted", "region_budget: 32 regions omitted"]


def test_foreign_references_refuse_a_request(board, spark):
    refs = board.headers.select("snapshot_id", F.lit("ug:00000000:0").alias("ref"))
    with pytest.raises(RequestError):
        Q.query_view(board, ViewSpec("focus", **WIDE), refs)
    with pytest.raises(RequestError):
        Q.query_view(board, ViewSpec("patchContext", **WIDE))


def test_diff_of_a_page_with_itself(board):
    (h,) = board.headers.collect()
    pairs = board.headers.select("snapshot_id", F.col("snapshot_id").alias("target_snapshot_id"))
    (v,) = Q.query_view(board, ViewSpec("diff", comparison_snapshot_id=h.snapshot_id, comparison_content_hash=h.content_hash, **WIDE), target=board, pairs=pairs).collect()
    told = json.loads(v.text)
    assert told["added"] == told["removed"] == [] and len(told["matched"]) + len(told["ambiguous"]) + told["abstainedCount"] == 130
    assert {m["changeKind"] for m in told["matched"]} == {"unchanged"} and all(m["baseRef"] == m["targetRef"] for m in told["matched"])


def test_evidence_is_planned_where_a_screenshot_is_named(board):
    (v,) = Q.query_view(board, ViewSpec("actionMap", max_crops=2, screenshot="artifact://shot/1", **WIDE)).collect()
    asked = json.loads(v.evidence_requests)
    assert [a["priority"] for a in asked] == [0, 1] and all(a["kind"] == "crop" and a["requestId"].startswith("uge_") for a in asked)


def test_sealed_tables_give_the_hash_of_their_json(board):
    (h,) = board.headers.collect()
    rows = board.pieces.orderBy("section", "key").collect()
    whole = {"schemaVersion": "1.0.0"}
    for r in rows:
        if r.section in A.ARRAYS:
            whole.setdefault(r.section, [])
            if r.text is not None:
                whole[r.section].append(json.loads(r.text) if r.tail is None else {**json.loads(r.text), **json.loads(r.tail)})
        else:
            whole[r.section] = json.loads(r.text)
    sealed = I.seal(whole)
    assert sealed["contentHash"] == h.content_hash and sealed["snapshotId"] == h.snapshot_id
    assert {n["nodeId"]: n["elementRef"] for n in sealed["nodes"]} == {r.node_id: r.element_ref for r in board.nodes.collect()}
    I.verify(sealed)


def test_order_of_rows_and_partitions_does_not_count(board):
    heads, refs, _ = A.seal_pieces(board.pieces.repartition(3, "text").sortWithinPartitions(F.desc("key")))
    assert heads.first().content_hash == board.headers.first().content_hash and refs.count() == 130


@pytest.fixture(scope="module")
def mixed(spark):
    ok = page("ok", [button(0, 10, 10), button(1, 10, 100, visible=False), button(2, 10, 200)], [{"sourceId": "a0", "frameId": "main", "role": "link", "name": "Go", "ignored": False, "backendDomSourceId": "d0"}, {"sourceId": "a1", "frameId": "main", "role": "button", "name": "Loose", "ignored": False}], [{"sourceId": "t0", "frameId": "main", "text": "Zebra", "domSourceId": "d0"}, {"sourceId": "t1", "frameId": "main", "text": "apple", "domSourceId": "d0"}])
    bad = page("bad", [button(0, 10, 10, w=1e9)])
    twice = page("twice", [button(0, 10, 10), button(0, 10, 50)])
    shot = {"artifactRef": "uiart:sha256/abc", "frameId": "main", "widthImagePx": 2000, "heightImagePx": 2000, "deviceScaleFactor": 2}
    item = lambda i, x, y, text, p: {"sourceId": f"o{i}", "rectImagePx": {"x": x, "y": y, "width": 200, "height": 40}, "text": text, "confidence": p}
    obs = [{"kind": "ocr", "provider": "p", "providerVersion": "1", "sourceImageRef": "uiart:sha256/abc", "runs": [item(0, 20, 20, "5ave", 0.7), item(1, 900, 900, "Open", 0.9)]}]
    read = page("read", [button(0, 10, 10)], [], [{"sourceId": "t", "frameId": "main", "text": "Save", "domSourceId": "d0"}], screenshotEvidence=[shot], derivedObservations=obs)
    many = page("many", [button(i, 10, 30 * i) for i in range(8)])
    drift = page("drift", [button(0, 10, 10, styleFacts={"fontSizeCssPx": 17, "color": "#123456"})])
    rules = ({"route": "/", "category": "scale", "reason": "legacy"}, {"route": "/other", "reason": "no"})
    return build(spark, [ok, bad, twice, page("empty"), read, many, drift], A.Profile("v", "sha256:0", "approved", DASHBOARD_TOKENS, exceptions=rules), A.BuildOptions(max_nodes=5))


def test_facts_hidden_rows_and_captures_with_issues(mixed):
    assert {(r.capture_id, r.code) for r in mixed.issues.collect()} == {("bad", "overflow"), ("twice", "duplicate_source_id")}
    n = {(r.capture_id, r.candidate_id): r for r in mixed.nodes.where("capture_id in ('ok', 'empty', 'bad', 'twice')").collect()}
    assert {c for c, _ in n} == {"ok", "empty"} and len(n) == 4
    first = n["ok", "cand_0000"]
    assert (first.role, first.name, first.text, first.confidence, first.flags) == ("link", "Go", "Zebra", 0.4, ["conflict:role", "conflict:text"])
    assert [e.sourceId for e in first.evidence] == ["d0", "a0", "t0", "t1"] and n["empty", "cand_0000"].role == "document"
    assert {r.kind for r in mixed.nodes.where("name = 'Loose'").collect()} == {"control"}


def test_derived_rows_join_by_overlap_or_stand_alone(mixed):
    n = {r.kind: r for r in mixed.nodes.where("capture_id = 'read'").collect()}
    assert n["control"].text == "Save" and [e.sourceType for e in n["control"].evidence] == ["dom", "text_run", "ocr"] and n["control"].flags == ["conflict:text"]
    assert n["visual_candidate"].text == "Open" and n["visual_candidate"].evidence[0].artifactRef == "uiart:sha256/abc"


def test_node_cap_keeps_one_of_each_pattern(mixed):
    many = lambda df: df.where("capture_id = 'many'")
    assert many(mixed.nodes).count() == 5 and "node_cap_exceeded" in {json.loads(r.json)["code"] for r in many(mixed.warnings).collect()}
    assert many(mixed.regions).first().item_count == 8 and len(many(mixed.regions).first().member_node_ids) == 5


def test_exceptions_turn_drift_into_excepted(mixed):
    assert {(m.category, m.status, m.method) for m in mixed.nodes.where("capture_id = 'drift'").first().dna_matches} == {("token", "drift", "exact_value"), ("scale", "excepted", "rule_evaluation")}


def test_options_and_profiles_are_checked(spark):
    assert A.BuildOptions(builder_version=" ", max_nodes=0, schema_version="2.0.0").issues() == ["missing_version", "unsupported_output_schema", "invalid_limit"]
    with pytest.raises(RequestError):
        build(spark, [page()], options=A.BuildOptions(max_nodes=-1))
    with pytest.raises(RequestError):
        build(spark, [page()], A.Profile("v", "d", "draft", {}, use_mode=None))


@pytest.mark.parametrize(("tag", "attributes", "role"), [("a", {}, None), ("a", {"href": "/"}, "link"), ("header", {}, None), ("body", {}, None), ("html", {}, "document"), ("section", {}, None), ("section", {"aria-label": "x"}, "region"), ("input", {}, "textbox"), ("input", {"list": "l"}, "combobox"), ("input", {"type": "password"}, None), ("input", {"type": "RANGE"}, "slider"), ("select", {"multiple": ""}, "listbox"), ("select", {"size": "1"}, "combobox"), ("p", {}, "paragraph"), ("TH", {}, "columnheader"), ("div", {"role": "tab"}, "tab"), ("summary", {}, "button")])
def test_implicit_roles(spark, tag, attributes, role):
    df = spark.createDataFrame([(tag, attributes)], "t string, a map<string,string>")
    assert df.select(O.implicit_role(F.col("t"), F.col("a")).alias("r")).first().r == role


def test_paths_by_doubling(spark):
    rows = [("c", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y"), ("c", "s", "s")]
    got = {r.node_id: r.path for r in R.paths(spark.createDataFrame(rows, "capture_id string, node_id string, parent_id string")).collect()}
    assert got["n39"] == [f"n{i}" for i in range(38, -1, -1)] and got["n0"] == [] == got["s"] and got["z"] == ["y", "x"] and got["x"] == ["y"]


def test_canonical_input_hash_is_of_the_json(spark):
    ship_package(spark)
    b = page()
    df = spark.createDataFrame([(json.dumps(b, indent=2),), ("{}",), (None,)], "bundle string")
    from paneflow.functions.canonical import sha256_text

    (r,) = input_hashes(df, OPTIONS.json()).collect()
    assert r.input_hash == sha256_text(canonical({"capture": b, "options": OPTIONS.json()})) and tables_of(df)["captures"].count() == 1


def test_deltas_round_trip_and_fail_closed(mixed, spark):
    """The page of eight buttons turned into the page with a read box, through all collections."""
    hashes = {r.capture_id: r.content_hash for r in mixed.headers.collect()}
    pairs = spark.createDataFrame([("p", "many", "read"), ("same", "ok", "ok")], "pair string, base string, target string")
    ids = lambda base: spark.createDataFrame([("p", hashes["many"], base, hashes["read"]), ("same", hashes["ok"], hashes["ok"], hashes["ok"])], "pair string, base_hash string, declared_base_hash string, declared_target_hash string")
    ops = spark.createDataFrame(D.encode(mixed.pieces, mixed.pieces, pairs).collect(), "pair string, seq int, op string, key string, text string, tail string")
    told = [r.op for r in ops.orderBy("seq").collect()]
    assert told == sorted(told, key=list(D.OPERATIONS).index) and {"replace_header", "remove_node", "upsert_node", "remove_edge", "remove_region", "replace_metrics", "replace_warnings"} <= set(told)
    heads, outcomes = D.apply(mixed.pieces, ops, pairs, ids(hashes["many"]))
    assert {(r.pair, r.outcome) for r in outcomes.collect()} == {("p", "applied"), ("same", "applied")}
    assert {r.pair: r.content_hash for r in heads.collect()} == {"p": hashes["read"], "same": hashes["ok"]}
    seq = lambda df: D._sequenced(df.drop("seq"))
    first = ops.where("op = 'remove_node'").orderBy("seq").first().key
    bad = {
        "delta_base_mismatch": (ops, ids("sha256:0")),
        "bad_sequence": (ops.where("seq <> 1"), ids(hashes["many"])),
        "missing_node": (seq(ops.withColumn("key", F.when((F.col("op") == "remove_node") & (F.col("key") == first), "n_x").otherwise(F.col("key")))), ids(hashes["many"])),
        "incident_edge": (seq(ops.where("op <> 'remove_edge'")), ids(hashes["many"])),
        "unknown_operation": (ops.withColumn("op", F.when(F.col("seq") == 0, "drop_all").otherwise(F.col("op"))), ids(hashes["many"])),
    }
    for code, (o, i) in bad.items():
        assert code in {r.code for r in D.delta_issues(mixed.pieces, o, pairs, i).collect()}, code
    heads, outcomes = D.apply(mixed.pieces, seq(ops.where("op <> 'replace_metrics'")), pairs, ids(hashes["many"]))
    assert {(r.pair, r.outcome, tuple(r.codes)) for r in outcomes.collect()} == {("p", D.FALLBACK, ("target_mismatch",)), ("same", "applied", ())} and heads.where("pair = 'p'").count() == 0
