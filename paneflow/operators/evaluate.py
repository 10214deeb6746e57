"""Measures of representations, statistics over them, and the gates that a decision passes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.functions.canonical import canonical, deflated_size, sha256_text
from paneflow.functions.text import patch_tokens, token_estimate
from paneflow.operators.ordering import ordinal
from paneflow.session import cut, default_parallelism, ship_package

#: What each surface may ask for.
SURFACE_VIEWS = {"gate": ["violations", "patchContext", "focus"], "mcp_review": ["violations", "patchContext", "focus"], "pointer": ["focus", "diff"], "interactive_review": ["actionMap"]}


def mulberry32(seed: int):
    """A 32-bit generator of doubles in [0, 1)."""
    a = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal a
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296.0

    return draw


def bootstrap_ratio(pairs: Iterable[tuple[float, float]], iterations: int = 2000, seed: int = 42, level: float = 0.95) -> dict:
    """Percentile interval of 1 - sum(candidate) / sum(base) over resampled (base, candidate) pairs; exact generator."""
    data = np.asarray(list(pairs), dtype=float)
    if not len(data):
        raise ValueError("an empty sample cannot be resampled")
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    stat = lambda s: 0.0 if s[:, 0].sum() <= 0 else 1 - s[:, 1].sum() / s[:, 0].sum()
    draw = mulberry32(seed)
    reps = sorted(stat(data[[int(draw() * len(data)) for _ in range(len(data))]]) for _ in range(iterations))
    at = lambda q: reps[int(math.floor(q * (iterations - 1)))]
    a = 1 - level
    return {"point": stat(data), "lower": at(a / 2), "upper": at(1 - a / 2), "level": level, "iterations": iterations, "seed": seed, "pairs": len(data)}


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in parts that fit 64 bits."""
    low = a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return low.bitwiseAND(F.lit(0xFFFFFFFF))


def nth_draw(k: Column, seed: int) -> Column:
    """The k-th draw (from 1) of ``mulberry32``: its state is a counter, so any draw is a function of its number."""
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    a = (F.lit(seed & 0xFFFFFFFF) + k.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(0xFFFFFFFF))
    first = lambda x: _imul(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(0xFFFFFFFF)))
    return bind(bind(bind(a, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0))


#: Pairs of a cohort that a task of ``bootstrap_exact`` holds at once, and draws that it makes, about.
BLOCK_PAIRS, TASK_DRAWS = 1 << 20, 20_000_000


def bootstrap_exact(measures: DataFrame, iterations: int = 2000, seed: int = 42, level: float = 0.95, block: int = BLOCK_PAIRS) -> DataFrame:
    """cohort, point, lower, upper, pairs of 1 - sum(candidate) / sum(base): the interval of ``bootstrap_ratio`` for each cohort, with its very draws.

    Each draw is computed from its number, so replicates are spread over tasks. A task holds the numbers of ``block``
    pairs at most, makes all draws of its replicates and sums those that fall into its block. The work is iterations x
    pairs, as resampling has it, for each block; ``bootstrap_cohorts`` is the cheaper estimate for large cohorts. Pairs
    stand in the order of their key (a number).
    """
    ship_package(measures.sparkSession)
    measures = cut(measures.select("cohort", "key", "base", "candidate"))
    rows = ordinal(measures.where("cohort is not null"), ["cohort"], [F.floor(F.col("key") / 4096)], [F.col("key")], "j").select("cohort", "j", "base", "candidate")
    sizes = measures.groupBy("cohort").agg(F.count("*").alias("n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        return pd.DataFrame({"cohort": [pdf["cohort"].iloc[0]], "at": [int(pdf["j"].iloc[0])], **{c: [pdf[c].to_numpy(dtype="<f8").tobytes()] for c in ("base", "candidate")}})

    packed = rows.withColumn("part", F.floor(F.col("j") / block)).groupBy("cohort", "part").applyInPandas(pack, "cohort string, at bigint, base binary, candidate binary")
    tasks = default_parallelism(measures.sparkSession)
    step = F.greatest(F.lit(1), F.ceil(F.lit(iterations) / F.greatest(F.lit(1), F.least(F.lit(2 * tasks), F.ceil(F.col("n") * iterations / TASK_DRAWS))))).cast("int")
    work = packed.join(sizes, "cohort").withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.col("step")))).repartition(tasks)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for cohort, at, base, candidate, n, step, first in pdf[["cohort", "at", "base", "candidate", "n", "step", "first"]].itertuples(index=False, name=None):
                sums = [_replicate(np.frombuffer(base, "<f8"), np.frombuffer(candidate, "<f8"), at, n, i, seed) for i in range(first, min(first + step, iterations))]
                yield pd.DataFrame({"cohort": cohort, "i": np.arange(first, first + len(sums)), "b": [b for b, _ in sums], "c": [c for _, c in sums]})

    sums = work.mapInPandas(draw, "cohort string, i int, b double, c double").groupBy("cohort", "i").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    reps = sums.withColumn("v", F.when(F.col("b") > 0, 1 - F.col("c") / F.col("b")).otherwise(0.0)).groupBy("cohort").agg(F.array_sort(F.collect_list("v")).alias("v"))
    a = 1 - level
    at = lambda q: F.get("v", F.lit(int(math.floor(q * (iterations - 1)))))
    return reps.join(reduction(measures), "cohort").join(sizes, "cohort").select("cohort", F.col("reduction").alias("point"), at(a / 2).alias("lower"), at(1 - a / 2).alias("upper"), F.col("n").alias("pairs"))


def _replicate(base: np.ndarray, candidate: np.ndarray, at: int, n: int, i: int, seed: int, chunk: int = 1 << 16) -> tuple[float, float]:
    """The sums of replicate ``i`` over a cohort of ``n`` pairs, of which these stand from place ``at`` on: ``nth_draw`` for its n numbers."""
    b = c = 0.0
    for s in range(0, n, chunk):
        a = (np.arange(i * n + s + 1, i * n + min(s + chunk, n) + 1, dtype=np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        a = a * np.uint32(0x6D2B79F5) + np.uint32(seed & 0xFFFFFFFF)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        j = ((t ^ (t >> np.uint32(14))) / 4294967296.0 * n).astype(np.int64) - at
        if len(base) < n:
            j = j[(j >= 0) & (j < len(base))]
        b += float(base[j].sum())
        c += float(candidate[j].sum())
    return b, c


def bootstrap_cohorts(measures: DataFrame, iterations: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """cohort, point, lower, upper of 1 - sum(candidate) / sum(base), over any number of pairs.

    Poisson bootstrap: each pair counts Poisson(1) times in each replicate, drawn by a hash of its key, so replicates
    are sums that combine on the map side and no cohort is gathered.
    """
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    u = lambda r: (F.pmod(F.xxhash64("key", F.lit(seed), r), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def weight(r):
        w = F.lit(0)
        for s in steps:
            w = w + (u(r) > s).cast("int")
        return w

    rows = measures.select("cohort", "key", "base", "candidate", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("r"))
    rows = rows.withColumn("w", weight(F.col("r")))
    reps = rows.groupBy("cohort", "r").agg(F.sum(F.col("w") * F.col("base")).alias("b"), F.sum(F.col("w") * F.col("candidate")).alias("c")).withColumn("v", F.when(F.col("b") > 0, 1 - F.col("c") / F.col("b")).otherwise(0.0))
    a = 1 - level
    ends = reps.groupBy("cohort").agg(F.array_sort(F.collect_list("v")).alias("v"))
    at = lambda q: F.get("v", F.floor(F.lit(q) * (F.size("v") - 1)).cast("int"))
    return ends.join(reduction(measures), "cohort").select("cohort", F.col("reduction").alias("point"), at(a / 2).alias("lower"), at(1 - a / 2).alias("upper"))


def reduction(measures: DataFrame) -> DataFrame:
    """cohort, reduction: 1 - sum(candidate) / sum(base), 0 where nothing was to reduce."""
    s = measures.groupBy("cohort").agg(F.sum("base").alias("b"), F.sum("candidate").alias("c"))
    return s.select("cohort", F.when(F.col("b") > 0, 1 - F.col("c") / F.col("b")).otherwise(0.0).alias("reduction"))


def mcnemar_exact(a_only: int, b_only: int) -> float:
    """Two-sided exact p of discordant pairs, in log space."""
    if a_only < 0 or b_only < 0 or int(a_only) != a_only or int(b_only) != b_only:
        raise ValueError("counts must be non-negative integers")
    n = a_only + b_only
    if n == 0:
        return 1.0
    half = n * math.log(0.5)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + half) for i in range(min(a_only, b_only) + 1))
    return min(1.0, 2 * tail)


@F.pandas_udf(T.DoubleType())
def mcnemar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_exact(int(x), int(y)) for x, y in zip(a, b)])


#: Gates (fixed values): name, how the evidence is compared, threshold. Losses are in percentage points.
GATES = [
    ("token_reduction", "at_least", 0.70), ("focus_view_p95_text_tokens", "at_most", 1500.0), ("repeated_review_cost_reduction", "at_least", 0.60), ("valid_ref_rate", "at_least", 0.995), ("grounding_recall_at_1", "at_most", 1.0),
    ("cross_snapshot_match_precision", "at_least", 0.98), ("coord_transform_error", "at_most", 2.0), ("delta_hash_match_rate", "at_least", 1.0), ("finding_quality_retention", "at_most", 2.0), ("cohort_regression", "at_most", 0.0), ("security_leaks", "at_most", 0.0),
]


def evaluate_gates(evidence: dict[str, dict]) -> dict:
    """Each of the 11 gates passes, fails or lacks evidence; promotion needs all to pass.

    evidence by gate: ``value``; token_reduction takes ``ci_lower`` and no diagnostic rows; coord_transform_error also
    takes ``shorter_side``, half a percent of which is allowed if that is more; finding_quality_retention ``value``
    (recall loss), ``precision_loss`` (1 point at most) and ``blocker_missed``.
    """
    results = []
    for name, direction, limit in GATES:
        e = evidence.get(name, {})
        value = e.get("ci_lower") if name == "token_reduction" else e.get("value")
        lacking = value is None or math.isnan(value) or bool(e.get("diagnostic_only"))
        if name == "coord_transform_error":
            lacking, limit = lacking or e.get("shorter_side") is None, max(limit, 0.005 * (e.get("shorter_side") or 0.0))
        ok = not lacking and (value >= limit if direction == "at_least" else value <= limit)
        if name == "finding_quality_retention" and not lacking:
            lacking = e.get("precision_loss") is None
            ok = ok and not lacking and e["precision_loss"] <= 1.0 and not e.get("blocker_missed", False)
        results.append({"gate": name, "state": "insufficient" if lacking else "pass" if ok else "fail", "value": value, "limit": limit})
    states = {r["state"] for r in results}
    verdict = "gate_rejected" if "fail" in states else "inconclusive" if "insufficient" in states else "gate_met"
    return {"results": results, "promote": verdict == "gate_met", "verdict": verdict}


def decision_report(evidence: dict[str, dict], manifest_id: str) -> dict:
    """The decision with its evidence, addressed by its content."""
    body = {"manifestId": manifest_id, "decision": evaluate_gates(evidence), "evidence": evidence}
    return {**body, "reportId": "ugr_1_" + sha256_text(canonical(body))[7:39]}


def freeze_manifest(fixtures: list[dict], version: str = "1") -> dict:
    """A catalogue of fixtures (fixture_id, cohorts, content, provenance), each with the hash of its content, addressed by its own."""
    rows = sorted(({"fixtureId": f["fixture_id"], "cohorts": sorted(f.get("cohorts", [])), "provenance": f.get("provenance", {}), "contentHash": sha256_text(canonical(f["content"]))} for f in fixtures), key=lambda r: r["fixtureId"])
    body = {"version": version, "fixtures": rows}
    return {**body, "manifestId": "ugm_1_" + sha256_text(canonical(body))[7:39]}


def manifest_issues(manifest: dict, fixtures: list[dict]) -> list[str]:
    """What does not hold of a frozen catalogue: its id, repeated, missing or changed fixtures, provenance that is not stated."""
    body = {k: v for k, v in manifest.items() if k != "manifestId"}
    out = [] if manifest.get("manifestId") == "ugm_1_" + sha256_text(canonical(body))[7:39] else ["manifest_id_mismatch"]
    ids = [f["fixtureId"] for f in manifest["fixtures"]]
    out += [f"duplicate_fixture:{i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    now = {f["fixture_id"]: sha256_text(canonical(f["content"])) for f in fixtures}
    for f in manifest["fixtures"]:
        i = f["fixtureId"]
        out += [f"missing_fixture:{i}"] if i not in now else [f"content_changed:{i}"] if now[i] != f["contentHash"] else []
        out += [f"missing_provenance:{i}"] if not str(f["provenance"].get("source", "")).strip() else []
    return out


#: Representations that are measured against one another; the whole graph is for diagnosis only.
REPRESENTATIONS = ("b0_raw_capture", "b1_ax_outline", "b2_screenshot", "b3_screenshot_outline", "b4_full_graph", "b5_focused_view")


def representation_rows(raw: DataFrame, outline: DataFrame, shots: DataFrame, graph: DataFrame, focus: DataFrame, patch: int = 28) -> DataFrame:
    """fixture, representation, available, bytes, deflated, text_tokens, visual_tokens of each fixture's six representations.

    raw, outline, graph and focus: (fixture, text); shots: (fixture, width, height). A representation whose part is
    missing is not available; visual tokens are the patches of the image.
    """
    def rows(name: str, text: DataFrame | None, image: DataFrame | None) -> DataFrame:
        j = raw.select("fixture")
        j = j.join(text.select("fixture", "text"), "fixture", "left") if text is not None else j.withColumn("text", F.lit(""))
        j = j.join(image.select("fixture", patch_tokens(F.col("width"), F.col("height"), patch).alias("v")), "fixture", "left") if image is not None else j.withColumn("v", F.lit(0).cast("bigint"))
        ok = F.col("text").isNotNull() & F.col("v").isNotNull()
        return j.select("fixture", F.lit(name).alias("representation"), ok.alias("available"), F.when(ok, F.octet_length("text")).alias("bytes"), F.when(ok, deflated_size("text")).alias("deflated"), F.when(ok, token_estimate(F.col("text"))).alias("text_tokens"), F.when(ok, F.col("v")).alias("visual_tokens"))

    parts = [(raw, None), (outline, None), (None, shots), (outline, shots), (graph, None), (focus, None)]
    out = None
    for name, (text, image) in zip(REPRESENTATIONS, parts):
        one = rows(name, text, image)
        out = one if out is None else out.unionByName(one)
    return out


def compare_representations(measured: DataFrame, cohorts: DataFrame, candidate: str = "b5_focused_view", baseline: str = "b0_raw_capture", metric: str = "text_tokens") -> DataFrame:
    """cohort, pairs, reduction of the candidate against the baseline over the fixtures where both are available; cohorts: (fixture, cohort)."""
    side = lambda r, n: measured.where((F.col("representation") == r) & F.col("available")).select("fixture", F.col(metric).cast("double").alias(n))
    pairs = side(baseline, "base").join(side(candidate, "candidate"), "fixture").join(cohorts, "fixture")
    return pairs.groupBy("cohort").agg(F.count("*").alias("pairs")).join(reduction(pairs), "cohort")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a report: numbers as they are, nothing for null, rows in the order given."""
    cell = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"
