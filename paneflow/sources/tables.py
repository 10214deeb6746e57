"""Readers of Parquet table directories, with defined results for late and repeated deliveries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a directory of tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def null_safe_hash(*cols: Column | str) -> Column:
    """64-bit hash in which null is a value of its own (``xxhash64`` alone skips nulls)."""
    parts: list[Column] = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def latest(df: DataFrame, keys: list[str], by: str, values: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``by`` (nulls first); ties are broken by the row's content.

    Rows are pre-aggregated on the map side, so a key that holds many rows costs one row per task in the shuffle.
    Rows with a null in a key stay a group of their own. An empty table gives an empty table. ``carry`` names the values
    that are returned, if not all; it does not change which row is picked.
    """
    values = [c for c in df.columns if c not in keys and c != by] if values is None else values
    kinds = dict(df.dtypes)
    plain = [F.map_entries(c) if kinds[c].startswith("map") else F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in values]
    order = F.struct(F.col(by).isNotNull().alias("p"), F.col(by).alias("t"), null_safe_hash(*plain).alias("h")) if values else F.struct(F.col(by).isNotNull(), F.col(by))
    values = values if carry is None else carry
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(by, *values), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in [by, *values]])


def latest_numbers(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """As ``latest`` for values that are numbers, without ``by`` in the result.

    The order is one decimal (time, then hash), so all buffers have a fixed width: the aggregation hashes and never sorts.
    """
    far = Decimal(10**19)
    h = F.abs(null_safe_hash(*values).cast("decimal(19,0)"))
    order = F.coalesce(F.unix_micros(by), F.lit(-(10**18) + 1)).cast("decimal(18,0)") * F.lit(far) + h
    rows = df.select(*keys, *values, order.cast("decimal(38,0)").alias("__o"))
    return rows.groupBy(*keys).agg(*[F.max_by(v, "__o").alias(v) for v in values])
