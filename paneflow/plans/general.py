"""Queries of the general data problems: snapshot changes (p4), schema drift (p5), units (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.operators.schema_drift import Field, drift, rescue_ingest
from paneflow.operators.snapshot_changes import changes_between
from paneflow.operators.units import contradictions, normalize_lengths, read_lengths, withheld_units
from paneflow.session import cut
from paneflow.sources.tables import latest, table

#: The target schema of raw_records: names of the capture schema, with the types they have there.
RECORD_FIELDS = [
    *[Field(n, f"#/properties/{n}", "string") for n in ("nodeId", "name", "text", "role", "kind", "description", "provider", "elementRef", "frameId", "builtAt")],
    *[Field(n, f"#/properties/{n}", "double") for n in ("confidence", "weight")],
    *[Field(n, f"#/properties/{n}", "bigint") for n in ("depth", "paintOrder")],
    Field("focusable", "#/properties/focusable", "boolean"),
    Field("flags", "#/properties/flags", "array<string>"),
    Field("sensitivity", "#/properties/sensitivity", "array<string>"),
    *[Field(f"geometry_{n}", f"#/properties/geometry/properties/{n}", "double") for n in ("x", "y", "width", "height", "occlusion")],
    Field("geometry_clipped", "#/properties/geometry/properties/clipped", "boolean"),
    Field("style_color", "#/properties/style/properties/color", "string"),
    *[Field(f"style_{n}", f"#/properties/style/properties/{n}", "double") for n in ("fontSizeCssPx", "opacity")],
    *[Field(f"style_{n}", f"#/properties/style/properties/{n}", "bigint") for n in ("zIndex", "fontWeight")],
]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return changes_between(table(spark, root, "graph_snapshots"), table(spark, root, "snapshot_nodes")).select("base_snapshot_id", "target_snapshot_id", "node_id", "change")


def p4_changes(spark: SparkSession, root: str) -> DataFrame:
    out = changes_between(table(spark, root, "graph_snapshots"), table(spark, root, "snapshot_nodes"), with_values=True)
    return out.select("base_snapshot_id", "target_snapshot_id", "base_content_hash", "target_content_hash", "node_id", "change", F.to_json("old").alias("old_values"), F.to_json("new").alias("new_values"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return drift(table(spark, root, "raw_records"), RECORD_FIELDS)


def p5_records(spark: SparkSession, root: str) -> DataFrame:
    """All records in one table; every reported rename is approved."""
    records = latest(table(spark, root, "raw_records"), ["record_id"], "delivered_at")
    renames = drift(records, RECORD_FIELDS).where("kind = 'renamed_property'").select("feed", "file_no", "path", "new_path")
    return rescue_ingest(records, RECORD_FIELDS, cut(renames))


_P6 = ("length_readings", "dom_nodes", "captures")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return contradictions(*[table(spark, root, n) for n in _P6])


def p6_lengths(spark: SparkSession, root: str) -> DataFrame:
    return normalize_lengths(*[table(spark, root, n) for n in _P6])


def p6_units(spark: SparkSession, root: str) -> DataFrame:
    """Stated units, kept from the model, and what it says of them."""
    return withheld_units(cut(read_lengths(*[table(spark, root, n) for n in _P6])))


QUERIES = {"p4_found": p4_found, "p4_changes": p4_changes, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_lengths": p6_lengths, "p6_units": p6_units}

_P4 = """
WITH n AS (
  SELECT snapshot_id, node_id, arg_max({'kind': kind, 'parent': parent_node_id, 'role': role, 'name': name, 'text': text, 'color': color,
         'size': font_size_css_px, 'r': viewport_rect}, received_at) AS v
  FROM snapshot_nodes WHERE snapshot_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL
), s AS (
  SELECT snapshot_id, max(page_key) AS page_key, max(captured_at) AS captured_at FROM graph_snapshots GROUP BY snapshot_id
), p AS (
  SELECT * FROM (SELECT lag(snapshot_id) OVER (PARTITION BY page_key ORDER BY captured_at, snapshot_id) AS base_snapshot_id, snapshot_id AS target_snapshot_id FROM s)
  WHERE base_snapshot_id IS NOT NULL
), b AS (SELECT p.*, n.node_id, n.v FROM p JOIN n ON n.snapshot_id = p.base_snapshot_id),
   t AS (SELECT p.*, n.node_id, n.v FROM p JOIN n ON n.snapshot_id = p.target_snapshot_id),
   j AS (
  SELECT coalesce(b.base_snapshot_id, t.base_snapshot_id) AS base_snapshot_id, coalesce(b.target_snapshot_id, t.target_snapshot_id) AS target_snapshot_id,
         coalesce(b.node_id, t.node_id) AS node_id,
         CASE WHEN b.node_id IS NULL THEN 'added' WHEN t.node_id IS NULL THEN 'removed'
              WHEN b.v.kind IS DISTINCT FROM t.v.kind OR b.v.parent IS DISTINCT FROM t.v.parent OR b.v.role IS DISTINCT FROM t.v.role
                OR b.v.name IS DISTINCT FROM t.v.name OR b.v.text IS DISTINCT FROM t.v.text OR b.v.color IS DISTINCT FROM t.v.color
                OR b.v.size IS DISTINCT FROM t.v.size
                OR coalesce(abs(b.v.r.x - t.v.r.x) > 0.5, (b.v.r.x IS NULL) <> (t.v.r.x IS NULL))
                OR coalesce(abs(b.v.r.y - t.v.r.y) > 0.5, (b.v.r.y IS NULL) <> (t.v.r.y IS NULL))
                OR coalesce(abs(b.v.r.width - t.v.r.width) > 0.5, (b.v.r.width IS NULL) <> (t.v.r.width IS NULL))
                OR coalesce(abs(b.v.r.height - t.v.r.height) > 0.5, (b.v.r.height IS NULL) <> (t.v.r.height IS NULL)) THEN 'changed' END AS change
  FROM b FULL JOIN t ON b.target_snapshot_id = t.target_snapshot_id AND b.node_id = t.node_id
)
SELECT * FROM j WHERE change IS NOT NULL
"""

SQL = {"p4_found": _P4}
