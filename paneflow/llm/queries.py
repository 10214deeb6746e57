"""Queries of the language-model problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.llm.encoding import encode_corpus
from paneflow.llm.languages import detect, wrong_labels
from paneflow.llm.leakage import leaks
from paneflow.llm.linkage import link, match
from paneflow.llm.pii import find_personal_data
from paneflow.llm.text_forms import match_key, normalized, shown_labels
from paneflow.sources.tables import latest, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return shown_labels(table(spark, root, "text_runs"), table(spark, root, "ui_labels")).select("capture_id", "source_id", "label_id")


def p1_forms(spark: SparkSession, root: str) -> DataFrame:
    """NormalizedText of every run."""
    runs = latest(table(spark, root, "text_runs"), ["capture_id", "source_id"], "received_at", ["text"])
    return normalized(runs, "text").select("capture_id", "source_id", "forms.display", match_key(F.col("forms.look")).alias("match_key"), "forms.skeleton")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return wrong_labels(table(spark, root, "documents")).select("doc_id", "lang")


def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    found = detect(table(spark, root, "documents"))
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.ordinal", "s.lang", "s.confidence", "s.words", F.length("s.text").alias("n_chars"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p7_ids": p7_ids, "p8_found": p8_found, "p8_passages": p8_passages, "p9_found": p9_found, "p9_segments": p9_segments}
SQL: dict[str, str] = {}


LINK_TABLES = ("derived_items", "dom_nodes", "ax_nodes", "text_runs", "captures")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return match(*[table(spark, root, n) for n in LINK_TABLES])[0].select("capture_id", "dom_source_id", "item_source_id")


def p2_matches(spark: SparkSession, root: str) -> DataFrame:
    return link(*[table(spark, root, n) for n in LINK_TABLES]).withColumn("evidence", F.to_json("evidence")).withColumn("viewport_rect", F.to_json("viewport_rect"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = find_personal_data(table(spark, root, "view_nodes"))
    return found.select("view_node_id", "field", F.explode("found").alias("f")).select("view_node_id", "field", "f.kind").distinct()


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    return find_personal_data(table(spark, root, "view_nodes")).select("view_node_id", "field", "redacted", F.size("found").alias("n_found"))


QUERIES |= {"p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_redacted": p3_redacted}
