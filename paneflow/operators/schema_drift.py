"""Schemas that drift between files: rescue-column ingestion into one table, and the report of each change.

Ingestion enforces a target schema on each record: a property of the target's path and JSON type is typed, anything
else is rescued as JSON. The report is read off the same ingestion: what was typed and what was rescued, by file, tells
which properties a file has; a rescued property is a rename if replaying its values into the property that went
reproduces them for the same ids. Approved renames are then promoted and replayed into the typed columns.

Payloads nest to any depth, so they are walked by a vectorized Python function, once for the table or the report; what
leaves it for the report are counts, combined for each batch of lines.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow.operators.snapshot_changes import lag_in_series
from paneflow.session import cut, ship_package, small_rows, spread

KINDS = ("array", "boolean", "number", "object", "string")
_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): None}


def _no_constant(_: str) -> None:
    raise ValueError("no JSON")


_read = json.JSONDecoder(parse_constant=_no_constant).decode


def complete_object(payload: str | None) -> dict | None:
    """The object of a line that is exactly one complete JSON object, else None. Of repeated names the last counts."""
    if not payload or "{" not in payload:
        return None
    try:
        v = _read(payload)
    except (ValueError, RecursionError):
        return None
    return v if type(v) is dict else None


def walk(value: dict, parent: str = "#") -> Iterator[tuple[str, str, object]]:
    """(parent, path, value) of each property: paths read '#/properties/a/properties/b'. Objects inside arrays belong to the array's value."""
    todo = [(value, parent)]
    while todo:
        obj, at = todo.pop()
        for key, v in obj.items():
            path = f"{at}/properties/{key}"
            yield at, path, v
            if type(v) is dict:
                todo.append((v, path))


@dataclass(frozen=True)
class Field:
    """A column of the target table: its path in the payload and its Spark type."""

    name: str
    path: str
    type: str

    @property
    def kind(self) -> str:
        """The JSON type that the column enforces."""
        return "string" if self.type == "string" else "boolean" if self.type == "boolean" else "array" if self.type.startswith("array") else "number"


def enforce(obj: dict, target: dict[str, str]) -> Iterator[tuple[str, str, object, str | None, bool]]:
    """(parent, path, value, JSON type, typed) of each property: typed if the target has its path with its JSON type, else rescued."""
    for parent, path, v in walk(obj):
        kind = _KIND[type(v)]
        yield parent, path, v, kind, kind is not None and target.get(path) == kind


@dataclass(frozen=True)
class DriftSpec:
    feed: str = "feed"
    file_no: str = "file_no"
    payload: str = "payload"
    id_path: str = "#/properties/nodeId"
    #: A property belongs to a file if at least one line in so many carries it.
    presence: int = 10
    #: Share of the common ids on which a renamed property must have kept its value (single odd records aside).
    same_values: float = 0.75


def _located(records: DataFrame, spec: DriftSpec) -> DataFrame:
    """feed, file_no, payload: lines of no feed or file are left out. A missing file number is taken from the digits at the end of file_name, if any."""
    number = F.col(spec.file_no).cast("bigint")
    if "file_name" in records.columns:
        number = F.coalesce(number, F.expr("try_cast(regexp_extract(file_name, '([0-9]+)[^0-9]*$', 1) as bigint)"))
    rows = records.select(F.col(spec.feed).alias("feed"), number.alias("file_no"), F.col(spec.payload).alias("payload"))
    return rows.where("payload is not null and feed is not null and file_no is not null")


def ingest_profile(records: DataFrame, target: list[Field], spec: DriftSpec) -> DataFrame:
    """feed, file_no, parent, path, n, typed, and a count for each JSON type, of what ingestion types and rescues in each file; path '#' counts the lines."""
    ship_package(records.sparkSession)
    enforced = {f.path: f.kind for f in target}

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, int] = defaultdict(int)

        def told() -> pd.DataFrame:
            rows: dict[tuple, list] = {}
            for (feed, no, parent, path, kind, typed), n in counts.items():
                r = rows.setdefault((feed, no, parent, path), [0] * (2 + len(KINDS)))
                r[0] += n
                r[1] += n * typed
                if kind is not None:
                    r[2 + KINDS.index(kind)] += n
            counts.clear()
            return pd.DataFrame([(*k, *r) for k, r in rows.items()], columns=["feed", "file_no", "parent", "path", "n", "typed", *KINDS])

        for pdf in parts:
            for feed, no, payload in pdf.itertuples(index=False, name=None):
                obj = complete_object(payload)
                if obj is None:
                    continue
                counts[feed, no, None, "#", None, False] += 1
                for parent, path, _, kind, typed in enforce(obj, enforced):
                    counts[feed, no, parent, path, kind, typed] += 1
            if len(counts) > 100_000:
                yield told()
        yield told()

    schema = "feed string, file_no bigint, parent string, path string, n bigint, typed bigint, " + ", ".join(f"{k} bigint" for k in KINDS)
    part = _located(records, spec).mapInPandas(scan, schema)  # lines of a file mostly come together, so their counts do
    return part.groupBy("feed", "file_no", "parent", "path").agg(*[F.sum(c).alias(c) for c in ("n", "typed", *KINDS)])


def file_schemas(profile: DataFrame, spec: DriftSpec) -> DataFrame:
    """feed, file_no, parent, path, type of the properties that belong to each file; path '#' for the file itself.

    The type is that of most non-null values (ties: the first by name), null where all values are null.
    """
    lines = F.max(F.when(F.col("path") == "#", F.col("n"))).over(W.partitionBy("feed", "file_no"))
    most = F.greatest(*KINDS)
    kind = F.when(most > 0, F.coalesce(*[F.when(F.col(k) == most, F.lit(k)) for k in KINDS]))
    return profile.withColumn("n_lines", lines).where(F.col("n") * spec.presence >= F.col("n_lines")).select("feed", "file_no", "parent", "path", kind.alias("type"))


def drift(records: DataFrame, target: list[Field] = [], spec: DriftSpec = DriftSpec()) -> DataFrame:
    """feed, file_no, kind, path, new_path of each difference between a file and the feed's preceding file.

    An empty table, or a feed with one file, gives no rows. A file without a complete line counts as absent. The report
    does not depend on ``target``: what the target does not type is rescued, and both are counted. The payloads are read
    twice: once for what each file has, once for the values of properties that may be renamed.
    """
    schema = cut(file_schemas(ingest_profile(records, target, spec), spec))
    files = schema.where("path = '#'").select("feed", "file_no")
    steps = lag_in_series(files, "feed", ["file_no"], F.floor(F.col("file_no") / 4096), ["file_no"]).where("previous is not null").select("feed", "file_no", F.col("previous.file_no").alias("base_no"))
    # each schema row is the later side of one step and the earlier side of another: one aggregation by (step, path)
    sides = steps.select("feed", F.col("file_no").alias("step"), F.explode(F.array(F.struct(F.col("base_no").alias("no"), F.lit(0).alias("side")), F.struct(F.col("file_no").alias("no"), F.lit(1).alias("side")))).alias("s")).select("feed", "step", F.col("s.no").alias("file_no"), "s.side")
    compared = schema.join(sides, ["feed", "file_no"]).groupBy("feed", "step", "parent", "path").agg(
        F.max(F.col("side") == 0).alias("was"),
        F.max(F.col("side") == 1).alias("is"),
        F.max(F.when(F.col("side") == 0, F.col("type"))).alias("old_type"),
        F.max(F.when(F.col("side") == 1, F.col("type"))).alias("new_type"),
        F.max(F.when(F.col("side") == 0, F.col("file_no"))).alias("base_no"),
    )
    kind = F.when(~F.col("was"), "added_property").when(~F.col("is"), "removed_property").when(F.col("old_type") != F.col("new_type"), "type_changed")
    raw = cut(compared.withColumn("kind", kind).where("kind is not null").select("feed", "step", "parent", "path", "kind", "base_no"))
    renamed = cut(_replayed(records, raw, spec))
    plain = raw.select("feed", "step", "kind", "path", F.lit("").alias("new_path"))
    gone = renamed.select("feed", "step", F.explode(F.array(F.struct(F.lit("removed_property").alias("kind"), F.col("path")), F.struct(F.lit("added_property").alias("kind"), F.col("new_path").alias("path")))).alias("g")).select("feed", "step", "g.kind", "g.path")
    rest = plain.join(gone, ["feed", "step", "kind", "path"], "left_anti")
    return rest.unionByName(renamed.select("feed", "step", F.lit("renamed_property").alias("kind"), "path", "new_path")).select("feed", F.col("step").cast("bigint").alias("file_no"), "kind", "path", "new_path")


def _said(v: object) -> int:
    """A hash of a value's text: a number and a string of the same digits say the same."""
    text = v if type(v) is str else json.dumps(v, sort_keys=True, separators=(",", ":"))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _replayed(records: DataFrame, raw: DataFrame, spec: DriftSpec) -> DataFrame:
    """feed, step, path, new_path of properties that went and came with the same values for the same ids.

    The values of each property that came are replayed into each one of the same parent that went; a rename reproduces
    the old values. Only lines of files with such a pair are read again, and only these properties of them.
    """
    both = raw.where("kind in ('removed_property', 'added_property')")
    w = W.partitionBy("feed", "step", "parent")
    wanted = (
        both.withColumn("r", F.max(F.col("kind") == "removed_property").over(w)).withColumn("a", F.max(F.col("kind") == "added_property").over(w)).where("r and a")
        # the number of the preceding file is known from any property of the parent that went
        .withColumn("base", F.max("base_no").over(w))
        .select("feed", F.col("step").cast("bigint").alias("step"), "path", F.col("kind").alias("kind"), F.when(F.col("kind") == "removed_property", F.col("base")).otherwise(F.col("step")).alias("file_no"))
    )
    per_file = cut(wanted.groupBy("feed", "file_no").agg(F.collect_set(F.struct("path", "step", "kind")).alias("wanted")))
    lines = _located(records, spec).join(small_rows(per_file), ["feed", "file_no"])
    id_name = spec.id_path.rsplit("/", 1)[-1]

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for feed, payload, asked in zip(pdf["feed"], pdf["payload"], pdf["wanted"]):
                obj = complete_object(payload)
                key = obj.get(id_name) if obj is not None else None
                if key is None:
                    continue
                key = key if type(key) is str else json.dumps(key, sort_keys=True)
                for x in asked:
                    v: object = obj
                    names = x["path"].split("/properties/")[1:]
                    for name in names:
                        v = v.get(name) if type(v) is dict else None
                    if v is not None:
                        rows.append((feed, int(x["step"]), x["path"].rsplit("/properties/", 1)[0], key, x["path"], x["kind"], _said(v)))
            yield pd.DataFrame(rows, columns=["feed", "step", "parent", "id", "path", "kind", "said"])

    values = lines.select("feed", "payload", "wanted").mapInPandas(pick, "feed string, step bigint, parent string, id string, path string, kind string, said bigint")
    one = values.groupBy("feed", "step", "parent", "id", "path", "kind").agg(F.min("said").alias("said"))
    old = one.where("kind = 'removed_property'").select("feed", "step", "parent", "id", "path", F.col("said").alias("old"))
    new = one.where("kind = 'added_property'").select("feed", "step", "parent", "id", F.col("path").alias("new_path"), F.col("said").alias("new"))
    matched = old.join(new, ["feed", "step", "parent", "id"]).groupBy("feed", "step", "path", "new_path").agg(F.count("*").alias("both"), F.count_if(F.col("old") == F.col("new")).alias("same"))
    matched = matched.where((F.col("same") >= F.least(F.lit(2), F.col("both"))) & (F.col("same") >= F.col("both") * spec.same_values))
    best = lambda side, other: F.row_number().over(W.partitionBy("feed", "step", side).orderBy(F.desc("same"), F.asc("both"), F.asc(other)))
    return matched.withColumn("i", best("path", "new_path")).withColumn("j", best("new_path", "path")).where("i = 1 and j = 1").select("feed", "step", "path", "new_path")


def _cast(v: object, kind: str):
    """A value in a column of the target, None where it cannot be cast without loss of meaning."""
    t = type(v)
    if kind == "string":
        return v if t is str else None if t in (dict, list) else json.dumps(v)
    if kind == "boolean":
        return v if t is bool else {"true": True, "false": False}.get(v.strip().lower()) if t is str else None
    if kind.startswith("array"):
        return [x if type(x) is str else json.dumps(x) for x in v] if t is list and not any(type(x) in (dict, list) for x in v) else None
    if t is str:
        try:
            v = float(v) if kind == "double" else int(v)
        except ValueError:
            return None
    elif t not in (int, float):
        return None
    if kind == "double":
        v = float(v) if abs(v) < 1.8e308 else math.inf
        return v if math.isfinite(v) else None
    return int(v) if v == int(v) and -(1 << 63) <= v < 1 << 63 else None


def rescue_ingest(records: DataFrame, target: list[Field], renames: DataFrame | None = None, spec: DriftSpec = DriftSpec(), keep: tuple[str, ...] = ("record_id",), version_path: str = "$.schemaVersion") -> DataFrame:
    """One row for each complete line: keep, feed, file_no, source_schema_version, the target columns and ``_rescued``.

    The target schema is enforced: a value that cannot be cast, and every field outside the target, stays in
    ``_rescued``, a JSON object of path to value (null if nothing was rescued). ``renames`` (feed, file_no, path,
    new_path; as ``drift`` reports them, after approval) promotes fields: a rescued value of a renamed field is replayed
    into the typed column of its first name, in every file of the feed; a value under the target's own name goes first.
    Broken lines give no row, lines of no feed or file do. Nulls are null columns and not rescued.
    """
    ship_package(records.sparkSession)
    kinds = dict(records.dtypes)
    base = records.select(*keep, F.col(spec.feed).alias("feed"), F.col(spec.file_no).cast("bigint").alias("file_no"), F.col(spec.payload).alias("payload")).where("payload is not null")
    if renames is not None:
        of_feed = cut(renames.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_no", "path", "new_path"))).alias("renames")))
        base = base.join(small_rows(of_feed), "feed", "left")
    base = spread(base.select(*keep, "feed", "file_no", "payload", *(["renames"] if renames is not None else [])))
    version = version_path.split(".")[1:]
    # objects that only hold target fields are walked into, not rescued whole
    opened = {"/properties/".join(f.path.split("/properties/")[:k]) for f in target for k in range(2, f.path.count("/properties/") + 1)}
    apart = "#" + "".join(f"/properties/{x}" for x in version)
    fields = [(f.name, f.path, f.type) for f in target]
    at = {p: i for i, (_, p, _) in enumerate(fields)}

    def first_names(steps) -> dict[str, str]:
        first: dict[str, str] = {}
        for r in steps if steps is not None else ():
            first[r["new_path"]] = first.get(r["path"], r["path"])
        return first

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, dict[str, str]] = {}
        for pdf in parts:
            rows = []
            if "renames" in pdf.columns:
                for feed, steps in zip(pdf["feed"], pdf["renames"]):
                    if feed not in known:
                        known[feed] = first_names(steps)
            for *own, feed, no, payload in pdf[[*keep, "feed", "file_no", "payload"]].itertuples(index=False, name=None):
                obj = complete_object(payload)
                if obj is None:
                    continue
                first = known.get(feed, {})
                typed: list = [None] * len(fields)
                rescued: dict[str, object] = {}
                later: list[tuple[int, str, object]] = []
                todo = [(obj, "#")]
                while todo:
                    o, parent = todo.pop()
                    for key, v in o.items():
                        path = f"{parent}/properties/{key}"
                        if path == apart:
                            continue
                        if path in opened and type(v) is dict:
                            todo.append((v, path))
                        elif path in at:
                            got = _cast(v, fields[at[path]][2]) if v is not None else None
                            typed[at[path]] = got
                            if got is None and v is not None:
                                rescued[path] = v
                        elif first.get(path) in at:
                            later.append((at[first[path]], path, v))
                        else:
                            rescued[path] = v
                for i, path, v in later:
                    got = _cast(v, fields[i][2]) if v is not None and typed[i] is None and fields[i][1] not in rescued else None
                    if got is not None:
                        typed[i] = got
                    elif v is not None:
                        rescued[path] = v
                told: object = obj
                for x in version:
                    told = told.get(x) if type(told) is dict else None
                rows.append((*own, feed, no, told if type(told) is str else None if told is None else json.dumps(told), *typed, json.dumps(rescued, ensure_ascii=False, separators=(",", ":")) if rescued else None))
            yield pd.DataFrame(rows, columns=[*keep, "feed", "file_no", "source_schema_version", *[n for n, _, _ in fields], "_rescued"], dtype=object)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keep], "feed string, file_no bigint, source_schema_version string", *[f"{n} {t}" for n, _, t in fields], "_rescued string"])
    return base.mapInPandas(scan, schema)
