"""The reverse index of a model: what refers to each object, stored in buckets by target and probed without a shuffle.

A row is a target, an attribute, a part and a list of at most about ``most`` referrers in order; a target with more has several parts. The table is bucketed and sorted by
target: a probe of one target reads its bucket alone, and a join with a table of targets moves that table only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions.shared import cut
from .model import Model

MOST_HOT = 100_000


@dataclass(frozen=True)
class InverseIndex:
    spark: SparkSession
    table: str

    @staticmethod
    def build(m: Model, table: str | None = None, buckets: int = 64, most: int = 10_000) -> InverseIndex:
        """Write the index of a model's references as ``table`` (a new name by default).

        Targets with few referrers go to one task a bucket, so a bucket is one file of them; the parts of the others are dealt over all tasks and appended.
        """
        edges = m.references().select("target", "attr", "mrid")
        spark = edges.sparkSession
        name = table or f"inverse_{uuid.uuid4().hex}"
        hot = cut(edges.groupBy("target", "attr").agg(F.count("*").alias("n")).where(F.col("n") > most).select("target", "attr", F.ceil(F.col("n") / most).cast("int").alias("parts")))
        n_hot = hot.count()
        near = F.broadcast(hot) if n_hot <= MOST_HOT else hot

        def store(lists: DataFrame, mode: str) -> None:
            lists.write.bucketBy(buckets, "target").sortBy("target").mode(mode).format("parquet").saveAsTable(name)

        listed = F.array_sort(F.collect_list("mrid")).alias("referrers")
        few = edges.join(near, ["target", "attr"], "left_anti") if n_hot else edges
        store(few.repartition(buckets, "target").groupBy("target", "attr").agg(listed).select("target", "attr", F.lit(0).alias("part"), "referrers"), "overwrite")
        if n_hot:
            dealt = edges.join(near, ["target", "attr"]).withColumn("part", F.pmod(F.xxhash64("mrid"), F.col("parts")).cast("int"))
            store(dealt.groupBy("target", "attr", "part").agg(listed).select("target", "attr", "part", "referrers"), "append")
        return InverseIndex(spark, name)

    def lists(self) -> DataFrame:
        return self.spark.table(self.table)

    def key(self, target: str) -> str:
        """The key of an identifier, however it is spelled."""
        return self.spark.range(1).select(M.parse(F.lit(target))["key"]).first()[0]

    def all_referrers(self, target: str) -> DataFrame:
        """attr and mrid of everything that refers to ``target``; reads one bucket."""
        return self.lists().where(F.col("target") == self.key(target)).select("attr", F.explode("referrers").alias("mrid"))

    def referrers(self, attr: str, target: str) -> DataFrame:
        return self.all_referrers(target).where(F.col("attr") == attr).select("mrid")

    def probe(self, targets: DataFrame) -> DataFrame:
        """target, attr and mrid for a table of targets; the index stays where it is."""
        return self.lists().join(targets.select("target").distinct(), "target").select("target", "attr", F.explode("referrers").alias("mrid"))

    def inverse_of(self, m: Model, attr: str) -> DataFrame:
        """mrid and referrer over the other end of an association."""
        other = m.vocabulary.inverses.where(F.col("attr") == attr).select(F.col("inverse").alias("attr"))
        return self.lists().join(F.broadcast(other), "attr").select(F.col("target").alias("mrid"), F.explode("referrers").alias("referrer"))

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
