"""Ordinals within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ordinal(df: DataFrame, group: list[str], coarse: list[Column], order: list[Column], to: str = "ordinal") -> DataFrame:
    """``df`` with the 0-based place of each row in its group's total order.

    ``coarse`` are ascending (nulls last) leading parts of the order, such as bands of a coordinate: rows are sorted
    within (group, coarse) only, and the counts of the bands give each band its offset. So a group that holds a third of
    all rows is sorted in as many tasks as it has bands.
    """
    names = [f"__c{i}" for i in range(len(coarse))]
    # a null sorts last: a flag before each value keeps that in joins and orders alike
    rows = df.withColumns({n: F.struct(c.isNull().alias("a"), c.alias("b")) for n, c in zip(names, coarse)})
    inner = rows.withColumn("__r", F.row_number().over(W.partitionBy(*group, *names).orderBy(*order)))
    counts = rows.groupBy(*group, *names).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("__o", before).drop("__n")
    plain = lambda d: d.select("*", *[F.to_json(n).alias(f"{n}j") for n in names]).drop(*names)
    keys = [*group, *[f"{n}j" for n in names]]
    return plain(inner).join(plain(offsets), keys).withColumn(to, (F.col("__o") + F.col("__r") - 1).cast("int")).drop("__o", "__r", *[f"{n}j" for n in names])
