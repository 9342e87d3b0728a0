"""Change sets as a stream: statements that arrive in a folder are applied in order to a model that lives in the state store.

The state of an object (its class, and the values of each attribute) starts from a stored base model, so a batch reads and writes the objects it changes alone, whatever the size of
the model. What a batch changes is appended to a log, one folder for each batch: the values of changed attributes, and the class of changed objects. A batch that runs again overwrites its folder, so the result is
exactly-once. ``load`` gives the model after a batch: the base with the last logged state of everything that changed; ``compact`` makes that the base of a new store.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.shared import wide
from ..operators.difference import typed_values, value_text
from ..operators.model import Model
from ..operators.vocabulary import Vocabulary

STATEMENTS = "direction string, seq long, mrid string, class string, defines boolean, attr string, kind string, value string"
#: A value as the state holds it: the columns of a slot, and the text by which statements name it.
HELD = ("ord", "kind", "v_bool", "v_int", "v_dbl", "v_text", "v_ref", "lex", "profiles", "text")
HELD_TYPE = "array<struct<ord:int,kind:string,v_bool:boolean,v_int:bigint,v_dbl:double,v_text:string,v_ref:string,lex:string,profiles:bigint,text:string>>"
CHANGES = "mrid string, attr string, held string, class string, profiles long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def save(m: Model, store: str) -> None:
    """A model as the base of a new store."""
    m.objects.select("mrid", "class", "profiles").write.mode("overwrite").parquet(f"{store}/base/objects")
    m.slots.write.mode("overwrite").parquet(f"{store}/base/slots")


def base(spark: SparkSession, vocabulary: Vocabulary, store: str) -> Model:
    return Model(vocabulary, spark.read.parquet(f"{store}/base/objects"), spark.read.parquet(f"{store}/base/slots"))


def load(spark: SparkSession, vocabulary: Vocabulary, store: str, version: int) -> Model:
    """The model after batch ``version`` (-1: the base)."""
    m = base(spark, vocabulary, store)
    if version < 0:
        return m
    log = spark.read.schema(CHANGES + ", version int").parquet(f"{store}/log").where(F.col("version") <= version)
    last = log.withColumn("n", F.row_number().over(Window.partitionBy("mrid", "attr").orderBy(F.desc("version")))).where("n = 1")
    values = last.where("attr is not null")
    slots = values.select("mrid", "attr", F.inline(F.from_json("held", HELD_TYPE))).drop("text").select(*m.slots.columns)
    kept = m.slots.join(wide(values.select("mrid", "attr")), ["mrid", "attr"], "left_anti").select(*m.slots.columns)
    named = last.where("attr is null")
    objects = m.objects.join(wide(named.select("mrid")), "mrid", "left_anti").unionByName(named.where("class is not null").select("mrid", "class", "profiles"))
    return m.with_(objects=objects, slots=kept.unionByName(slots))


def compact(spark: SparkSession, vocabulary: Vocabulary, store: str, version: int, to: str) -> None:
    save(load(spark, vocabulary, store, version), to)


class Objects(StatefulProcessor):
    """The values of one object by attribute, and its class; rows are statements, or the object's values in the base."""

    def __init__(self, owners: dict[str, str], attrs: dict[str, frozenset], single: frozenset):
        self.owners, self.attrs, self.single = owners, attrs, single

    def init(self, handle):
        self.values = handle.getMapState("values", "attr string", "held string")
        self.own = handle.getValueState("own", "class string, profiles long")

    def handleInitialState(self, key, initialState, timerValues):
        for row in initialState.itertuples(index=False):
            if row.attr is not None:
                self.values.updateValue((row.attr,), (row.held,))
            else:
                self.own.update((row.cls, int(row.profiles)))

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).sort_values("seq", kind="stable")
        own = self.own.get() if self.own.exists() else None
        changed: dict[str, list] = {}

        def of(attr: str) -> list:
            if attr not in changed:
                changed[attr] = json.loads(self.values.getValue((attr,))[0]) if self.values.exists() and self.values.containsKey((attr,)) else []
            return changed[attr]

        asserted = []
        for direction in ("reverse", "forward"):
            for row in found[found["direction"] == direction].itertuples(index=False):
                if row.kind == "class":
                    continue
                held = of(row.attr)
                value = json.loads(row.held)
                if direction == "forward":
                    if row.attr in self.single:
                        held.clear()
                    held.append(value)
                    asserted.append(row.attr)
                    continue
                same = [v for v in held if (v["kind"], v["text"]) == (row.kind, row.value)]
                if same:
                    held.remove(min(same, key=lambda v: (v["ord"], v["lex"] is not None, v["lex"] or "", v["profiles"])))
        names = [c for d, c in zip(found["direction"], found["cls"]) if d == "forward" and c is not None]
        was = own
        if own is not None and names and names[0] != own[0]:
            own = (names[0], own[1])
            kept = self.attrs.get(names[0], frozenset())
            stored = [k[0] for k in self.values.keys()] if self.values.exists() else []
            for attr in set(stored) | set(changed):
                if attr.partition("/")[0] not in kept:
                    of(attr).clear()
        elif own is None and asserted:
            known = [self.owners[a] for a in asserted if a in self.owners]
            own = (names[0] if names else known[0], 0) if names or known else None
        for attr, held in changed.items():
            for i, value in enumerate(held):
                value["ord"] = i
            if held:
                self.values.updateValue((attr,), (json.dumps(held),))
            elif self.values.exists() and self.values.containsKey((attr,)):
                self.values.removeKey((attr,))
        if not self.values.exists() or next(iter(self.values.keys()), None) is None:
            own = None
        if own is None:
            self.own.clear()
        else:
            self.own.update(own)
        out = [(key[0], attr, json.dumps(held), None, None) for attr, held in changed.items()]
        if own != (tuple(was) if was is not None else None):
            out.append((key[0], None, None, own and own[0], own and own[1]))
        if out:
            yield pd.DataFrame(out, columns=["mrid", "attr", "held", "class", "profiles"]).astype({"profiles": "Int64"})

    def close(self):
        pass


def _held() -> F.Column:
    return F.to_json(F.struct(*(F.col(c) for c in HELD)), {"ignoreNullFields": "false"})


def initial(m: Model) -> DataFrame:
    """mrid, attr, held, cls and profiles: the values of each attribute as the state holds them, and each object's class without an attribute."""
    item = F.struct("ord", F.struct(*(F.col(c) if c != "text" else value_text().alias("text") for c in HELD)).alias("x"))
    values = m.slots.groupBy("mrid", "attr").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("lex", F.lit("")).alias("l"), item["x"].alias("x")))), lambda v: v["x"]), {"ignoreNullFields": "false"}).alias("held"))
    none = F.lit(None).cast("string")
    return values.select("mrid", "attr", "held", none.alias("cls"), F.lit(0).cast("long").alias("profiles")).unionByName(m.objects.select("mrid", none.alias("attr"), none.alias("held"), F.col("class").alias("cls"), F.coalesce("profiles", F.lit(0)).cast("long").alias("profiles")))


def apply_stream(spark: SparkSession, vocabulary: Vocabulary, changes: str, store: str, checkpoint: str):
    """Start applying the statement files under ``changes``, a file a batch, to the model in ``store``."""
    owners = {r.attr: r.owner for r in vocabulary.attrs.select("attr", "owner").collect()}  # a vocabulary's attributes
    attrs: dict[str, set] = {}
    for r in vocabulary.class_attrs().select("class", "attr").collect():
        attrs.setdefault(r["class"], set()).add(r.attr)
    single = frozenset(r.attr for r in vocabulary.attrs.where("most = 1").select("attr").collect())
    processor = Objects(owners, {k: frozenset(v) for k, v in attrs.items()}, single)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(STATEMENTS).option("maxFilesPerTrigger", 1).parquet(changes)
    rows = typed_values(stream).withColumn("text", value_text()).select("mrid", "direction", "seq", F.col("class").alias("cls"), "attr", "kind", "value", _held().alias("held"))
    changed = rows.groupBy("mrid").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Update", timeMode="None", initialState=initial(base(spark, vocabulary, store)).groupBy("mrid"))

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/log/version={number}")

    return changed.writeStream.foreachBatch(log).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
