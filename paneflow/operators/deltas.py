"""Deltas between sealed snapshots over all their collections, and their strict application.

Both work on the pieces of snapshots (see ``assemble.seal_pieces``): a delta is a keyed difference of pieces, applied by
the last operation of each key, sealed again, and accepted only if the result has the declared identity. A pair that
fails anywhere gives no rows of the result, only its issues, and falls back to the full snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.operators.assemble import ARRAYS, seal_pieces
from paneflow.operators.ordering import ordinal
from paneflow.session import cut, small

#: Operations in the order in which a delta has them, and the section that each one touches (fixed values).
OPERATIONS = {"replace_header": "header", "remove_edge": "edges", "remove_node": "nodes", "remove_region": "regions", "upsert_node": "nodes", "upsert_edge": "edges", "upsert_region": "regions", "replace_dna_projection": "dnaProjection", "replace_metrics": "metrics", "replace_warnings": "warnings"}
HEADER = ("build", "coordinateSpaces", "source")
FALLBACK = "full_checkpoint_fallback"


def _rank(op: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(OPERATIONS) for x in (k, i)]), op)


def _of_pair(pieces: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return pieces.join(small(pairs.select("pair", F.col(side).alias("capture_id"))), "capture_id").select("pair", "section", "key", "text", "tail")


def encode(base: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, seq, op, key, text, tail: the operations that turn the base of each pair (pair, base, target) into its target.

    Removals of edges, nodes and regions come before upserts, each by id; what has not changed gives no operation.
    Nodes are compared without their references, which sealing gives. ``text`` and ``tail`` are the new piece; for
    replaced parts ``text`` is their JSON.
    """
    b = _of_pair(base, pairs, "base").where("text is not null").withColumnsRenamed({"text": "old", "tail": "old_tail"})
    t = _of_pair(target, pairs, "target").where("text is not null")
    j = cut(t.join(b, ["pair", "section", "key"], "full").where("not (text <=> old and tail <=> old_tail)"))
    verb = F.when(F.col("text").isNull(), "remove_").otherwise("upsert_")
    items = j.where(F.col("section").isin("nodes", "edges", "regions")).select("pair", F.concat(verb, F.regexp_replace("section", "s$", "")).alias("op"), "key", "text", "tail")
    parts = {"metrics": "replace_metrics", "dnaProjection": "replace_dna_projection"}
    plain = j.where(F.col("section").isin(*parts)).select("pair", F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("section")).alias("op"), F.lit("").alias("key"), "text", F.lit(None).cast("string").alias("tail"))
    out = items.unionByName(plain)
    for op, sections in (("replace_header", HEADER), ("replace_warnings", ("warnings",))):
        touched = j.where(F.col("section").isin(*sections)).select("pair").distinct()
        whole = t.where(F.col("section").isin(*sections)).groupBy("pair").agg(F.to_json(F.array_sort(F.collect_list(F.struct("section", "key", "text")))).alias("text"))
        out = out.unionByName(touched.join(whole, "pair", "left").select("pair", F.lit(op).alias("op"), F.lit("").alias("key"), F.coalesce("text", F.lit("[]")).alias("text"), F.lit(None).cast("string").alias("tail")))
    return _sequenced(out)


def _sequenced(ops: DataFrame) -> DataFrame:
    """Operations with their place: by kind, then by key; keys are banded by their beginning up to the ordinal's last two digits."""
    head = F.regexp_extract("key", r"^(n_.*_\d*?)\d{0,2}_[0-9a-f]{16}$", 1)
    band = F.when(head == "", F.substring("key", 1, 4)).otherwise(head)
    return ordinal(ops.withColumn("__op", _rank(F.col("op"))), ["pair"], [F.col("__op"), band], [F.col("key")], "seq").select("pair", "seq", "op", "key", "text", "tail")


def delta_issues(base: DataFrame, ops: DataFrame, pairs: DataFrame, identities: DataFrame) -> DataFrame:
    """pair, code: unknown_operation, bad_sequence, delta_base_mismatch, missing_<thing>, incident_edge.

    ``identities``: pair, base_hash (of the base at hand), declared_base_hash.
    """
    say = lambda df, code: df.select("pair", (code if isinstance(code, Column) else F.lit(code)).alias("code"))
    out = say(ops.where(~F.col("op").isin(*OPERATIONS)), "unknown_operation")
    counted = ops.groupBy("pair").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.max("seq").alias("m"), F.min("seq").alias("lo"))
    out = out.unionByName(say(counted.where("n <> d or m <> n - 1 or lo <> 0"), "bad_sequence"))
    out = out.unionByName(say(identities.where("not (base_hash <=> declared_base_hash)"), "delta_base_mismatch"))
    here = _of_pair(base, pairs, "base").where("text is not null")
    section = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), F.col("op"))
    steps = ops.withColumn("section", section)
    gone = steps.where(F.col("op").startswith("remove_"))
    # a removal finds what the base has, or an earlier operation put there, and no earlier removal took
    earlier = steps.select("pair", "section", "key", F.col("seq").alias("s"), F.col("op").alias("o"))
    before = gone.join(earlier, ["pair", "section", "key"]).where("s < seq").groupBy("pair", "section", "key", "seq").agg(F.max_by("o", "s").alias("last"))
    held = gone.join(here.select("pair", "section", "key", F.lit(True).alias("there")), ["pair", "section", "key"], "left").join(before, ["pair", "section", "key", "seq"], "left")
    there = F.when(F.col("last").isNotNull(), F.col("last").startswith("upsert_")).otherwise(F.coalesce("there", F.lit(False)))
    out = out.unionByName(say(held.where(~there), F.concat(F.lit("missing_"), F.regexp_replace("op", "remove_", ""))))
    # edges that still touch a node when it goes
    ends = lambda c: F.explode(F.array(F.get_json_object(c, "$.fromNodeId"), F.get_json_object(c, "$.toNodeId")))
    lost = gone.where("op = 'remove_edge'").select("pair", F.col("key").alias("edge"), F.col("seq").alias("lost_at"))
    old = here.where("section = 'edges'").select("pair", F.col("key").alias("edge"), ends("text").alias("node"), F.lit(-1).alias("from_seq"))
    new = steps.where("op = 'upsert_edge'").select("pair", F.col("key").alias("edge"), ends("text").alias("node"), F.col("seq").alias("from_seq"))
    nodes = gone.where("op = 'remove_node'").select("pair", F.col("key").alias("node"), "seq")
    live = old.unionByName(new).join(nodes, ["pair", "node"]).where("from_seq < seq").join(lost, ["pair", "edge"], "left").where("lost_at is null or lost_at > seq")
    return out.unionByName(say(live, "incident_edge")).distinct()


def apply(base: DataFrame, ops: DataFrame, pairs: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, outcomes) of the rebuilt targets: pair with content hash, snapshot id and size; and each pair's outcome and issues.

    ``identities``: pair, base_hash, declared_base_hash, declared_target_hash. Nothing of a pair with an issue, or whose
    rebuilt hash is not the declared one, is returned: its outcome is the fallback to the full snapshot.
    """
    issues = cut(delta_issues(base, ops, pairs, identities))
    sound = pairs.join(issues.select("pair").distinct(), "pair", "left_anti")
    ops = ops.join(issues.select("pair").distinct(), "pair", "left_anti")
    here = _of_pair(base, sound, "base")
    section = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), F.col("op"))
    last = ops.withColumn("section", section).groupBy("pair", "section", "key").agg(F.max_by(F.struct("op", "text", "tail"), "seq").alias("o"))
    items = last.where(F.col("section").isin("nodes", "edges", "regions"))
    kept = here.join(items.select("pair", "section", "key"), ["pair", "section", "key"], "left_anti")
    put = items.where("o.op like 'upsert_%'").select("pair", "section", "key", "o.text", "o.tail")
    swapped = last.where(~F.col("section").isin("nodes", "edges", "regions"))
    none = F.lit(None).cast("string")
    parts = swapped.where(F.col("section").isin("header", "warnings")).select("pair", F.explode(F.from_json("o.text", "array<struct<section:string,key:string,text:string>>")).alias("p")).select("pair", "p.section", "p.key", "p.text", none.alias("tail"))
    plain = swapped.where(F.col("section").isin("metrics", "dnaProjection") & F.col("o.text").isNotNull()).select("pair", "section", "key", "o.text", none.alias("tail"))
    over = swapped.select("pair", F.explode(F.when(F.col("section") == "header", F.array(*[F.lit(x) for x in HEADER])).otherwise(F.array("section"))).alias("section"))
    marks = F.col("section").isin(*ARRAYS) & F.col("text").isNull()
    kept = kept.where(marks).unionByName(kept.where(~marks).join(over, ["pair", "section"], "left_anti"))
    rows = kept.unionByName(put).unionByName(parts).unionByName(plain).withColumnRenamed("pair", "capture_id")
    heads, _, _ = seal_pieces(cut(rows.select("capture_id", "section", "key", "text", "tail")))
    told = heads.withColumnRenamed("capture_id", "pair").join(identities.select("pair", "declared_target_hash"), "pair")
    good = cut(told.where("content_hash = declared_target_hash").drop("declared_target_hash"))
    wrong = issues.groupBy("pair").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = pairs.select("pair").join(good.select("pair", F.lit("applied").alias("ok")), "pair", "left").join(wrong, "pair", "left")
    codes = F.when(F.col("ok").isNotNull(), F.array().cast("array<string>")).otherwise(F.coalesce("codes", F.array(F.lit("target_mismatch"))))
    return good, out.select("pair", F.coalesce("ok", F.lit(FALLBACK)).alias("outcome"), codes.alias("codes"))
