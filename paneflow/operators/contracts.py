"""Contracts between producers and consumers of snapshots: references, schemas and their versions, migration, shadow runs, self-description.

Specs, schemas and single snapshots are small records, so these are plain Python; references of whole tables resolve by joins.
"""

from __future__ import annotations

import copy
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions.canonical import canonical, sha256_text
from paneflow.operators.evaluate import SURFACE_VIEWS
from paneflow.operators.identity import IdentityError, verify

REF = r"^ug:[0-9a-f]{8}:[0-9]+$"
CURRENT_MAJOR = 1
#: Kinds of schema changes that break readers (fixed values); all others add.
BREAKING = {"removed_property", "added_required_property", "property_made_required", "type_changed", "const_changed", "pattern_changed", "removed_enum_value"}


def resolve_ref(snapshot: dict, claimed: tuple[str, str], ref: str) -> str:
    """'ok', or why a reference is refused: malformed_ref, snapshot_identity_invalid, wrong_snapshot_identity, ref_not_in_snapshot.

    The snapshot's own identity is recomputed; the short scope in a reference is no authority.
    """
    if not isinstance(ref, str) or not re.fullmatch(REF.strip("^$"), ref):
        return "malformed_ref"
    try:
        verify(snapshot)
    except (IdentityError, KeyError, ValueError):
        return "snapshot_identity_invalid"
    if tuple(claimed) != (snapshot["snapshotId"], snapshot["contentHash"]):
        return "wrong_snapshot_identity"
    return "ok" if any(n["elementRef"] == ref for n in snapshot["nodes"]) else "ref_not_in_snapshot"


def resolve_refs(claims: DataFrame, headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """claims (snapshot_id, content_hash, ref, any others) with column resolution, against sealed tables (whose identity is that of their content)."""
    h = headers.select("snapshot_id", F.col("content_hash").alias("__hash"))
    n = nodes.select("snapshot_id", F.col("element_ref").alias("ref"), F.lit(True).alias("__in")).distinct()
    j = claims.join(h, "snapshot_id", "left").join(n, ["snapshot_id", "ref"], "left")
    told = F.when(~F.coalesce(F.col("ref").rlike(REF), F.lit(False)), "malformed_ref").when(~F.coalesce(F.col("__hash") == F.col("content_hash"), F.lit(False)), "wrong_snapshot_identity").when(F.col("__in").isNull(), "ref_not_in_snapshot").otherwise("ok")
    return j.withColumn("resolution", told).drop("__hash", "__in")


def may_request(surface: str, view: str) -> bool:
    return view in SURFACE_VIEWS.get(surface, [])


def compare_shadow(capture_id: str, graph_hash: str, current_hash: str) -> dict:
    return {"captureId": capture_id, "graphBackedPromptHash": graph_hash, "currentPromptHash": current_hash, "differs": graph_hash != current_hash}


def diff_json_schema(old: object, new: object, path: str = "#") -> list[tuple[str, str]]:
    """(kind, path) of every change between two JSON schemas, in their order."""
    if not isinstance(old, dict) or not isinstance(new, dict):
        return []
    same = lambda k: json.dumps(old.get(k)) == json.dumps(new.get(k))
    out = [(f"{k}_changed", path) for k in ("type", "const", "pattern") if ((k in old) or (k in new)) and not same(k)]
    if isinstance(old.get("enum"), list) and isinstance(new.get("enum"), list):
        a, b = ([json.dumps(v) for v in s["enum"]] for s in (old, new))
        out += [("removed_enum_value", path) for v in dict.fromkeys(a) if v not in b] + [("added_enum_value", path) for v in dict.fromkeys(b) if v not in a]
    was, now = (set(s.get("required") or []) for s in (old, new))
    before, after = (s.get("properties") if isinstance(s.get("properties"), dict) else {} for s in (old, new))
    for k, v in before.items():
        at = f"{path}/properties/{k}"
        if k not in after:
            out.append(("removed_property", at))
            continue
        out += diff_json_schema(v, after[k], at)
        out += [("property_made_required", at)] if k in now and k not in was else []
    out += [("added_required_property" if k in now else "added_optional_property", f"{path}/properties/{k}") for k in after if k not in before]
    out += diff_json_schema(old.get("items"), new.get("items"), f"{path}/items")
    for branch in ("$defs", "definitions"):
        x, y = old.get(branch), new.get(branch)
        if isinstance(x, dict) and isinstance(y, dict):
            for k, v in x.items():
                at = f"{path}/{branch}/{k}"
                out += diff_json_schema(v, y[k], at) if k in y else [("removed_property", at)]
    return out


def _semver(version: str) -> tuple[int, ...]:
    if not (m := re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version)):
        raise ValueError(f"schema version must be semver, got {version}")
    return tuple(map(int, m.groups()))


def check_version_bump(old: str, new: str, changes: list[tuple[str, str]]) -> dict:
    """Whether a version step is large enough: breaking changes need a major one, additions a minor one."""
    breaking = [c for c in changes if c[0] in BREAKING]
    additive = [c for c in changes if c[0] not in BREAKING]
    a, b = _semver(old), _semver(new)
    needs = "major" if breaking else "minor" if additive else "none"
    ok = b[0] > a[0] if needs == "major" else b[0] != a[0] or b[1] > a[1] if needs == "minor" else True
    return {"ok": ok, "requires": needs, "breaking": breaking, "additive": additive}


def reader_supports_major(major: int) -> bool:
    """The current major and one before it."""
    return isinstance(major, int) and major >= 1 and major in (CURRENT_MAJOR, CURRENT_MAJOR - 1)


def migrate_to_current(blob: dict) -> dict:
    """A copy of a stored snapshot under the current major, with the version that it came in; the stored one is left alone."""
    major = _semver(blob["schemaVersion"])[0]
    if not reader_supports_major(major):
        raise ValueError(f"schema major {major} is outside the supported window")
    return {"snapshot": copy.deepcopy(blob), "sourceSchemaVersion": blob["schemaVersion"], "migrated": major != CURRENT_MAJOR}


def closed_issues(value: object, schema: dict, path: str = "") -> list[str]:
    """What breaks a closed JSON schema (type, const, enum, pattern, bounds, required, unknown properties, items, local $ref)."""
    return _closed(value, schema, schema, path)


def _closed(v: object, s: dict, root: dict, path: str) -> list[str]:
    if "$ref" in s:
        target: object = root
        for part in s["$ref"].lstrip("#/").split("/"):
            target = target[part]  # type: ignore[index]
        return _closed(v, target, root, path)  # type: ignore[arg-type]
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    is_a = lambda k: isinstance(v, kinds[k]) and not (isinstance(v, bool) and k in ("number", "integer"))
    told = s.get("type")
    if told and not any(is_a(k) for k in ([told] if isinstance(told, str) else told)):
        return [f"{path or '/'} must be {told}"]
    out = [f"{path or '/'} must be {s['const']}"] if "const" in s and v != s["const"] else []
    out += [f"{path or '/'} must be one of {s['enum']}"] if "enum" in s and v not in s["enum"] else []
    if isinstance(v, str):
        out += [f"{path} must match {s['pattern']}"] if "pattern" in s and not re.search(s["pattern"], v) else []
        out += [f"{path} is too short"] if len(v) < s.get("minLength", 0) else []
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        out += [f"{path} is out of bounds"] if v < s.get("minimum", v) or v > s.get("maximum", v) else []
    if isinstance(v, list):
        out += [f"{path} has too few items"] if len(v) < s.get("minItems", 0) else []
        out += [x for i, e in enumerate(v) for x in _closed(e, s.get("items", {}), root, f"{path}/{i}")]
    if isinstance(v, dict):
        out += [f"{path}/{k} is required" for k in s.get("required", []) if k not in v]
        for k, e in v.items():
            if k in s.get("properties", {}):
                out += _closed(e, s["properties"][k], root, f"{path}/{k}")
            elif s.get("additionalProperties") is False:
                out.append(f"{path}/{k} is unknown")
            elif isinstance(s.get("additionalProperties"), dict):
                out += _closed(e, s["additionalProperties"], root, f"{path}/{k}")
    for part in s.get("allOf", []):
        if "if" not in part or not _closed(v, part["if"], root, path):
            out += _closed(v, part.get("then", {}) if "if" in part else part, root, path)
    return out


def capability_descriptor() -> dict:
    """What the engine is and what it never does; content-addressed by ``descriptor_digest``."""
    body = {"kind": "representation", "schemaMajor": CURRENT_MAJOR, "views": sorted({v for vs in SURFACE_VIEWS.values() for v in vs} | {"summary"}), "surfaces": {k: sorted(v) for k, v in SURFACE_VIEWS.items()}, "never": ["execute_actions", "fetch_network", "publish", "write_source"]}
    return body


def descriptor_digest(descriptor: dict) -> str:
    return sha256_text(canonical(descriptor))


def descriptor_issues(descriptor: dict) -> list[str]:
    """A descriptor that claims more than representation is refused."""
    out = [] if descriptor.get("kind") == "representation" else ["not_representation_only"]
    lacks = set(capability_descriptor()["never"]) - set(descriptor.get("never", []))
    return out + sorted(f"missing_restriction:{x}" for x in lacks) + (["unsupported_major"] if not reader_supports_major(descriptor.get("schemaMajor")) else [])
