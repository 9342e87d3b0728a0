"""Extendible hashing: shards under a byte limit, split only where needed.

A document's address is 60 bits: 32 of MD5(id), then 28 of MD5(text), so equal ids with different texts
still part. The directory starts as one bucket; a bucket over ``limit`` bytes is split on the
next bit until each fits. As a bucket's bytes never grow with depth, a document's shard is its shortest
prefix whose bytes fit. Twelve levels are settled at a time: bytes are summed by the twelve-bit prefix
(combined before the shuffle), coarser levels from finer ones, and only rows of buckets that are
still too large go on to the next twelve bits.

Defined cases: a document over the limit by itself fits at no depth, so it gets a shard of its own at 60 bits, marked ``oversized``; rows
with one address (equal id and text, as a rule) stay together at 60 bits and are dealt into numbered overflow
pages of the limit; null ids address as "null", null texts as empty; empty texts have 0 bytes; an
empty table gives an empty result; extra columns stay in ``write_shards``, which writes the pages of ``assign`` and names its own columns around those there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

LEVELS = 12
BITS = 60


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """id, address (a string of 60 binary digits) and bytes of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = F.concat(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 8), F.substring(F.md5(text), 1, 7))
    return docs.select(F.col(id_col).alias("doc_id"), F.lpad(F.conv(digits, 16, 2), BITS, "0").alias("address"), F.octet_length(text).cast("long").alias("bytes"), *([keep] if keep else []))


def levels(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """For each prefix of ``start + LEVELS`` bits: its shard's depth, bytes and rows, or null depth if none fits yet."""
    end = start + LEVELS
    sums = rows.groupBy(F.substring("address", 1, end).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    for_all = sums.select("prefix", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"), "bytes", "docs").withColumn("shard", F.expr("substring(prefix, 1, depth)"))
    shards = for_all.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
    fits = for_all.join(shards, ["depth", "shard"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("s"))
    return sums.select("prefix").join(fits, "prefix", "left").select("prefix", "s.*")


def assign(docs: DataFrame, limit: int = 64 << 20, keep: str | None = None) -> DataFrame:
    """doc_id, bytes, shard (its bit string), depth, page, shard_bytes, shard_docs and oversized of every row, and its column ``keep``."""
    todo, placed, start = cut(addressed(docs, keep=keep)), [], 0
    kept = [keep] if keep else []
    while True:
        found = cut(levels(todo, start, limit))
        mapped = todo.withColumn("prefix", F.substring("address", 1, start + LEVELS)).join(F.broadcast(found) if start == 0 else found, "prefix").drop("prefix")  # the first table has 2 ** LEVELS rows at most
        placed.append(mapped.where("depth is not null").withColumns({"page": F.lit(0), "oversized": F.lit(False)}))
        start += LEVELS
        if not found.where("depth is null").limit(1).count():
            break
        todo = cut(mapped.where("depth is null").select("doc_id", "address", "bytes", *kept))
        if start == BITS:
            placed.append(overflow(todo, limit, kept))
            break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "address", "bytes", "shard", F.col("depth").cast("int").alias("depth"), F.col("page").cast("int").alias("page"), "shard_bytes", "shard_docs", "oversized", *kept)


def overflow(rows: DataFrame, limit: int, kept: list[str]) -> DataFrame:
    """Rows whose whole address is shared by more bytes than ``limit``: all are equal, so they are numbered and dealt into pages.

    Numbers are given within (address, part of the table) and moved on by the parts before, so no task holds a whole group.
    """
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("address", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("address").orderBy("part")) - F.col("n")).drop("n")
    number = rows.withColumn("inside", F.row_number().over(Window.partitionBy("address", "part").orderBy("doc_id")) - 1).join(before, ["address", "part"])
    page = F.floor((F.col("inside") + F.col("before")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes"))))
    paged = number.withColumn("page", page)
    sums = paged.groupBy("address", "page").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return paged.join(sums, ["address", "page"]).select("doc_id", "address", "bytes", F.lit(BITS).alias("depth"), F.col("address").alias("shard"), "shard_bytes", "shard_docs", "page", (F.col("shard_bytes") > limit).alias("oversized"), *kept)


def directory(assigned: DataFrame) -> DataFrame:
    """shard, page, depth, bytes and rows: the extendible directory's distinct buckets."""
    return assigned.select("shard", "page", "depth", "shard_bytes", "shard_docs", "oversized").distinct()


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20) -> None:
    """Parquet folders by ``shard`` and ``page``, as ``assign`` deals them, with all columns of ``docs``; if it has columns of these names, underscores go before the folders'."""
    shard, page, number = (free_name(docs, x) for x in ("shard", "page", "row_number"))
    held = cut(docs.withColumn(number, F.monotonically_increasing_id()))
    where = assign(held, limit, number).select(number, F.col("shard").alias(shard), F.col("page").alias(page))
    held.join(where, number).drop(number).repartition(shard, page).write.partitionBy(shard, page).mode("overwrite").parquet(path)
