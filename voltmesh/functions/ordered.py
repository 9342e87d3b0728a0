"""Numbers and neighbours in a total order, without one task for all rows: range-partitioned rows, and a row for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def placed(df: DataFrame, *order) -> DataFrame:
    """``df`` settled in order: ``_part``, and ``_at`` within it and over all parts."""
    settled = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return settled.withColumn("_part", F.shiftright("_at", 33))


def offsets(rows: DataFrame, value: Column) -> DataFrame:
    """_part and the sum of ``value`` over the parts before (broadcast: a row for each part)."""
    total, out = 0, []
    for r in sorted(rows.groupBy("_part").agg(F.sum(value).alias("n")).collect()):
        out.append((r._part, total))
        total += r.n
    return F.broadcast(rows.sparkSession.createDataFrame(out, "_part long, _before long"))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its place, from 1, in a total order."""
    rows = placed(df, *order)
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(offsets(rows, F.lit(1)), "_part").withColumn(name, within + F.col("_before") + 1).drop("_part", "_at", "_before")


def islands(df: DataFrame, key: Column, name: str, *order) -> DataFrame:
    """``df`` with the number, from 1, of its run of consecutive rows with equal ``key``."""
    rows = placed(df.withColumn("_key", key), *order)
    lasts = rows.groupBy("_part").agg(F.max_by("_key", "_at").alias("_last"))  # a row for each part
    before = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    here = Window.partitionBy("_part").orderBy("_at")
    with_new = rows.join(F.broadcast(before), "_part").withColumn("_new", (~F.coalesce(F.lag("_key").over(here), F.when(F.row_number().over(here) == 1, F.col("_last"))).eqNullSafe(F.col("_key"))).cast("int"))
    with_new = cut(with_new.drop("_last", "_key"))
    return with_new.join(offsets(with_new, F.col("_new")), "_part").withColumn(name, F.sum("_new").over(here) + F.col("_before")).drop("_part", "_at", "_before", "_new")
