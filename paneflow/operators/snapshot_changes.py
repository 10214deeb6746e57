"""What changed between full snapshots.

The index of a snapshot maps each key to a 64-bit hash of its compared columns (and to the four rectangle numbers,
which have a tolerance and so cannot be hashed), bucketed by key on shared storage. The rows of the next snapshot probe
it, old and new values are fetched for changed keys only, and the indexes are swapped.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow.operators.ordering import ordinal
from paneflow.session import SMALL_ROWS, Storage, cut, default_parallelism, ensure_checkpoint_dir
from paneflow.sources.tables import latest, latest_numbers, null_safe_hash

RECT = ("x", "y", "width", "height")


@dataclass(frozen=True)
class ChangeSpec:
    """Which columns count: ``exact`` null-safely equal, the numbers of ``rect`` within ``tolerance``."""

    key: str = "node_id"
    exact: tuple[str, ...] = ("kind", "parent_node_id", "role", "name", "text", "color", "font_size_css_px")
    rect: str = "viewport_rect"
    tolerance: float = 0.5
    #: Buckets of an index; a probe has so many tasks. None: as many as the session's shuffles have partitions.
    buckets: int | None = None


def _exact_hash(spec: ChangeSpec) -> Column:
    return null_safe_hash(*spec.exact)


ENTRY = ("h", *RECT)


def _entries(spec: ChangeSpec) -> list[Column]:
    """An index entry: the hash and the four numbers."""
    return [_exact_hash(spec).alias("h"), *[F.col(f"{spec.rect}.{c}").alias(c) for c in RECT]]


def _differs(old: Column, new: Column, tolerance: float) -> Column:
    """Whether two index entries differ. A missing number differs from a present one; NaN equals NaN."""
    out = old.getField("h") != new.getField("h")
    for c in RECT:
        a, b = old.getField(c), new.getField(c)
        moved = F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).when(F.isnan(a) & F.isnan(b), False).otherwise(F.abs(a - b) > tolerance)
        out = out | moved
    return out


def lag_in_series(df: DataFrame, series: str, order: list[str], bucket: Column, take: list[str]) -> DataFrame:
    """Each row with struct ``previous`` (columns ``take`` of the row before it in its series, or null).

    A series may hold any share of the rows: rows are ordered within (series, bucket) and only the last row of each
    bucket is carried over to the next one. ``bucket`` must not decrease along ``order``.
    """
    rows = df.withColumn("__b", bucket)
    inner = W.partitionBy(series, "__b").orderBy(*order)
    me = F.struct(*take)
    rows = rows.withColumn("__prev", F.lag(me).over(inner))
    ends = rows.groupBy(series, "__b").agg(F.max_by(me, F.struct(*order)).alias("__last"))
    carried = ends.withColumn("__carry", F.lag("__last").over(W.partitionBy(series).orderBy("__b"))).drop("__last")
    carried = carried.withColumnsRenamed({series: "__s2", "__b": "__b2"})
    joined = rows.join(carried, F.col(series).eqNullSafe(F.col("__s2")) & F.col("__b").eqNullSafe(F.col("__b2")), "left")
    return joined.withColumn("previous", F.coalesce("__prev", "__carry")).drop("__b", "__prev", "__carry", "__s2", "__b2")


def snapshot_pairs(headers: DataFrame, series: str = "page_key", snapshot: str = "snapshot_id", at: str = "captured_at", received: str = "received_at") -> DataFrame:
    """(series, base, target) of consecutive snapshots, by capture time, whatever the order of delivery.

    Repeated headers count once; the hash is that of the latest delivery that has one. Snapshots without an id, a
    series or a capture time belong to no pair. Equal capture times are ordered by id.
    """
    known = headers.where(F.col(snapshot).isNotNull() & F.col(series).isNotNull() & F.col(at).isNotNull())
    one = _headers(known, series, snapshot, at, received)
    lagged = lag_in_series(one, series, [at, snapshot], F.date_trunc("month", F.col(at)), [snapshot, "content_hash"])
    return lagged.where(F.col("previous").isNotNull()).select(
        series,
        F.col(f"previous.{snapshot}").alias("base_snapshot_id"),
        F.col(snapshot).alias("target_snapshot_id"),
        F.col("previous.content_hash").alias("base_content_hash"),
        F.col("content_hash").alias("target_content_hash"),
    )


def _headers(known: DataFrame, series: str, snapshot: str, at: str, received: str) -> DataFrame:
    """One row for each snapshot: series, snapshot, time, content_hash."""
    return known.groupBy(snapshot).agg(
        F.max_by(F.struct(series, at), F.struct(received, at, series)).alias("r"),
        F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), F.struct(received, "content_hash"))).alias("content_hash"),
    ).select(snapshot, F.col(f"r.{series}").alias(series), F.col(f"r.{at}").alias(at), "content_hash")


def changes_between(headers: DataFrame, nodes: DataFrame, spec: ChangeSpec = ChangeSpec(), with_values: bool = False) -> DataFrame:
    """Added, removed and changed keys of every consecutive pair of snapshots, by way of a ``SnapshotIndex``.

    Columns: base_snapshot_id, target_snapshot_id, base_content_hash, target_content_hash, the key, change and, with
    ``with_values``, structs ``old`` and ``new`` (null for changes without them).

    The snapshots of all series are delivered to one index, which is bucketed by key; each bucket goes through its keys'
    history in one pass, in the order of the snapshots.

    Of repeated rows of one (snapshot, key) the latest ``received_at`` holds; rows with a null key are left out. A
    snapshot without rows is an empty one: everything was removed in it and added after it. Empty tables give no rows.
    """
    spark, key = nodes.sparkSession, spec.key
    known = headers.where("snapshot_id is not null and page_key is not null and captured_at is not null")
    one = ordinal(_headers(known, "page_key", "snapshot_id", "captured_at", "received_at"), ["page_key"], [F.date_trunc("month", F.col("captured_at"))], [F.col("captured_at"), F.col("snapshot_id")], "n")
    one = cut(one.select("snapshot_id", F.col("page_key").alias("series"), "n", "content_hash"))
    hint = F.broadcast if one.count() <= SMALL_ROWS else lambda df: df
    slim = nodes.where(F.col("snapshot_id").isNotNull() & F.col(key).isNotNull()).select("snapshot_id", F.col(key).alias("key"), "received_at", *_entries(spec))
    entries = latest_numbers(slim, ["snapshot_id", "key"], "received_at", list(ENTRY)).join(hint(one.select("snapshot_id", "series", "n")), "snapshot_id")
    index = SnapshotIndex(f"{ensure_checkpoint_dir(spark)}/snapshot-index-{spark.sparkContext.applicationId}-{next(_RUN)}", spec)
    # an empty snapshot is a delivery too: the headers say how many a series has
    due = one.groupBy("series").agg(F.max("n").alias("last"), F.lit(False).alias("follows"))
    changed = index.advance(index.receive(entries.select("series", "key", "n", *ENTRY)), hint(due))
    before = one.select("series", (F.col("n") + 1).alias("n"), F.col("snapshot_id").alias("base_snapshot_id"), F.col("content_hash").alias("base_content_hash"))
    pairs = one.select("series", "n", F.col("snapshot_id").alias("target_snapshot_id"), F.col("content_hash").alias("target_content_hash")).join(hint(before), ["series", "n"])
    out = changed.join(hint(pairs), ["series", "n"])
    out = out.select("base_snapshot_id", "target_snapshot_id", "base_content_hash", "target_content_hash", F.col("key").alias(key), "change")
    if not with_values:
        return out
    # values are fetched for changed keys only: the rows of other keys leave before any of their values is shuffled
    for side, at in (("old", "base_snapshot_id"), ("new", "target_snapshot_id")):
        asked = out.select(F.col(at).alias("snapshot_id"), key).distinct()
        rows = latest(nodes.join(asked, ["snapshot_id", key], "left_semi"), ["snapshot_id", key], "received_at", [*spec.exact, spec.rect])
        out = out.join(rows.select(F.col("snapshot_id").alias(at), key, F.struct(*spec.exact, spec.rect).alias(side)), [at, key], "left")
    return out.select("base_snapshot_id", "target_snapshot_id", "base_content_hash", "target_content_hash", key, "change", "old", "new")


_RUN = itertools.count()


@dataclass
class SnapshotIndex:
    """The key-to-entry index of the last snapshot of each series, on shared storage, bucketed by (series, key).

    ``advance`` probes it with the rows of one or more next snapshots. The probe's one pass gives the changes and the next
    index, which is written beside the old one; then the pointer is swapped by a rename, so a job that is lost leaves the
    old index in force, and of the old index only its changes stay. Rows that arrive are bucketed alike, so a key's
    entries meet in its bucket, and a series that holds any share of the rows lies in all buckets. Values are not kept
    in the index: whoever wants them fetches them for the changed keys.
    """

    root: str
    spec: ChangeSpec = field(default_factory=ChangeSpec)

    def _storage(self, spark: SparkSession) -> Storage:
        return Storage(spark, self.root)

    def _state(self, spark: SparkSession) -> dict:
        text = self._storage(spark).read("CURRENT")
        return json.loads(text) if text else {"round": 0, "path": None}

    def current(self, spark: SparkSession) -> str | None:
        """Folder of the index in force."""
        return self._state(spark)["path"]

    def _buckets(self, spark: SparkSession) -> int:
        """An index keeps the number of buckets that it began with."""
        return self._state(spark).get("buckets") or self.spec.buckets or default_parallelism(spark)

    def _write(self, df: DataFrame, path: str, *parts: str) -> DataFrame:
        """Write a bucketed table to a folder and open it."""
        name = self._name(path)
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        writer = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(self._buckets(df.sparkSession), "series", "key").sortBy("series", "key")
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        return df.sparkSession.table(name)

    def _name(self, path: str) -> str:
        return "paneflow_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]

    def _open(self, spark: SparkSession, path: str) -> DataFrame:
        """The bucketed table of a folder; a session that does not know it yet is told."""
        name = self._name(path)
        if not spark.catalog.tableExists(name):
            state = self._state(spark)
            spark.sql(f"CREATE TABLE {name} ({state['schema']}) USING parquet PARTITIONED BY (changed) CLUSTERED BY (series, key) SORTED BY (series, key) INTO {state['buckets']} BUCKETS LOCATION '{path}'")
            spark.sql(f"MSCK REPAIR TABLE {name}")
        return spark.table(name)

    def receive(self, rows: DataFrame) -> DataFrame:
        """Rows (series, key, n, entry) as a bucketed table: shuffled once."""
        n = self._state(rows.sparkSession)["round"]
        return self._write(rows.repartition(self._buckets(rows.sparkSession), "series", "key"), f"{self.root}/arrived/{n}")

    def advance(self, rows: DataFrame, due: DataFrame) -> DataFrame:
        """series, key, n, change of the delivered snapshots against the index and one another; then the swap.

        ``rows`` has series, key, n and the entry of each row of the delivered snapshots, which count from 0 in their
        series; ``due`` the series that were delivered, the ``last`` n of each, and with ``follows`` whether the index has
        a snapshot of theirs (a first one changes nothing). Series that were not delivered keep their entries.
        """
        spark, state = rows.sparkSession, self._state(rows.sparkSession)
        turn = state["round"] + 1
        cols = ["series", "key", "n", *ENTRY]
        new = rows.select(*cols)
        if state["path"]:
            new = self._open(spark, state["path"]).where("held").withColumn("n", F.lit(-1)).select(*cols).unionByName(new)
        known = new.join(due.select("series", "last", "follows"), "series", "left")
        w = W.partitionBy("series", "key").orderBy("n")
        entry = F.struct("n", *ENTRY)
        seen = known.withColumns({"e": entry, "before": F.lag(entry).over(w), "after": F.lead("n").over(w)})
        e, before, n = F.col("e"), F.col("before"), F.col("n")
        stays = before["n"] == n - 1
        came = F.when((n == 0) & ~F.col("follows") | (n < 0), None).when(stays, F.when(_differs(before, e, self.spec.tolerance), "changed")).otherwise("added")
        went = F.when((F.coalesce("after", F.col("last") + 1) > n + 1) & (n < F.col("last")), "removed")
        held = F.col("last").isNull() | (n == F.col("last"))
        row = lambda ok, n, change: F.when(ok, F.struct(n.alias("n"), change.cast("string").alias("change"), ok.alias("changed")))
        said = F.array_compact(F.array(row(came.isNotNull(), n, came), row(went.isNotNull(), n + 1, went), F.when(held, F.struct(n.alias("n"), F.lit(None).cast("string").alias("change"), F.lit(False).alias("changed")))))
        told = seen.select("series", "key", *ENTRY, F.explode(said).alias("s")).select("series", "key", *ENTRY, "s.n", "s.change", (~F.col("s.changed")).alias("held"), "s.changed")
        path = f"{self.root}/probe/round={turn}"
        self._write(told, path, "changed")
        self._storage(spark).replace("CURRENT", json.dumps({"round": turn, "path": path, "buckets": self._buckets(spark), "schema": _ddl(told)}))
        if state["path"]:
            spark.sql(f"DROP TABLE IF EXISTS {self._name(state['path'])}")
            self._storage(spark).delete(f"probe/round={turn - 1}/changed=false")
        spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{self.root}/arrived/{turn - 1}')}")
        self._storage(spark).delete(f"arrived/{turn - 1}")
        return self.changes(spark).where(F.col("round") == turn).drop("round")

    def changes(self, spark: SparkSession) -> DataFrame:
        """series, key, n, change, round of all deliveries so far."""
        state = self._state(spark)
        if not state["path"]:
            return spark.createDataFrame([], "series string, key string, n int, change string, round int")
        rows = spark.read.schema(f"{state['schema']}, round int").parquet(f"{self.root}/probe")
        return rows.where("changed").select("series", "key", "n", "change", "round")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)
