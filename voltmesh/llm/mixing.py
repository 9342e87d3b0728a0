"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3, ... and share as many words as the corpus has; a
source's target stops at ``repeats`` times its size and the excess is shared anew by weight.

Each source's documents are laid end to end in a shuffled order (by MD5 of id and text) and
cut into blocks of ``block`` words. Slot i of the schedule lies at the golden-ratio point frac(i / phi), computed in whole numbers
modulo 2**48; the slot belongs to the source whose interval of cumulative slot weights holds the
point. The k-th slot of a source (ranked by i) takes its block k, starting over after the last block, until its
target is met; its last slot takes the part of a block that is missing. Three times as many points as
slots are needed leave no interval of one slot empty (the gaps of the sequence are below 0.65 of it), so
every target is met exactly, rounded down to words. That holds up to 2**44 slots, 2**54 words of the default block.

Positions, ranks and numbers of sources are running sums in two steps: sums of fixed-size buckets or of parts, then rows
inside one, so no task holds a whole source. The water filling is a loop of aggregates over the table of sources, one for each time that
its level rises; that table, one row a source, is broadcast only if its counted rows are few.

Defined cases: null and empty texts have size 0 and take 0; null ids and repeated rows are rows of their own (equal rows lie in any
order, with equal results up to their exchange); an empty table gives an empty result; a corpus without
words has targets of 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, small

GOLDEN = 173961102589771  # 2**48 / golden ratio, to the next odd number
PERIOD = 1 << 48
LIMB = 15


def running(rows: DataFrame, order: list, value: F.Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, by range-partitioned order: within a part, and over the parts' sums."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_value", value).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sums = sorted(tuple(r) for r in placed.groupBy(part).agg(F.sum("_value")).collect())  # a row for each part
    ends, total = [], 0
    for p, n in sums:
        ends.append((p, total))
        total += n
    before = rows.sparkSession.createDataFrame(ends, "_part long, _before long")
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_part", part).withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_at", "_part", "_before")


def targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """``sizes`` (source, n) with number, weight and target, by water filling over the sources in code-point order, null last.

    Each round shares the words that full sources leave by the weights of the others; a source is full if its share is over
    ``repeats`` times its size. The share a unit of weight only grows, so rounds end when no source becomes full.
    """
    numbered = running(sizes, [F.col("source").isNull(), F.col("source")], F.lit(1), "number")
    s = cut(numbered.withColumn("weight", F.col("number") % 3 + 1))
    first = s.agg(F.sum("n"), F.sum("weight")).first()
    left, shared, n_full = first[0] or 0, first[1] or 1, -1
    total = left
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    while True:
        full = wide(F.lit(left), 19) * wide(F.col("weight"), 2) > wide(repeats * F.col("n"), 19) * wide(F.lit(shared), 18)
        row = s.agg(F.count_if(full), F.sum(F.when(full, repeats * F.col("n")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if row[0] == n_full or not row[0] or not row[2]:
            break
        n_full, left, shared = row[0], total - row[1], row[2]
    return s.withColumn("target", F.when(full, (repeats * F.col("n")).cast("double")).otherwise((F.lit(left) * F.col("weight")).cast("double") / F.lit(float(shared))))


def golden_point(i: F.Column) -> F.Column:
    """floor(2**48 * frac(i / phi)) for i below 2**60: products of GOLDEN and 15 bits of i at a time don't overflow."""
    point = F.lit(0)
    for k in range(4):
        limb = F.shiftright(i, LIMB * k).bitwiseAND((1 << LIMB) - 1)
        kept = max(48 - LIMB * k, 0)  # higher bits leave the period when moved up
        point = point + F.shiftleft((limb * GOLDEN).bitwiseAND((1 << kept) - 1), LIMB * k)
    return point.bitwiseAND(PERIOD - 1)


def sized(docs: DataFrame) -> DataFrame:
    """_id, doc_id, source, size and place (the shuffling hash) of every document, as a table of its own."""
    return cut(docs.select("doc_id", "source", size_of("text").alias("size"), place_of("doc_id", "text").alias("place"), F.monotonically_increasing_id().alias("_id")))


def size_of(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(doc_id: str, text: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def laid_out(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with each document's start on the line of its source ``number``."""
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("int"))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("number").orderBy("bucket")) - F.col("words")).drop("words")
    inside = F.sum("size").over(Window.partitionBy("number", "bucket").orderBy("place", "_id").rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return local.join(before, ["number", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")


def schedule(plan: DataFrame, sources: int, slots: int, chunk: int = 4096) -> DataFrame:
    """Slots that take words: slot, source number, block and words. ``plan`` has a row for each source, with low and high points."""
    cells = max(4096, 1 << (sources - 1).bit_length()) if sources else 4096
    cell = lambda x: F.floor(x / (PERIOD // cells))
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", cell(F.col("point")))
    # a source lies in as many cells as its interval covers: together the sources and `cells` more at most
    spread = plan.where("high > low").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    owned = points.join(small(spread, sources + cells), "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    owned = owned.withColumn("chunk", F.floor(F.col("slot") / chunk))
    counts = owned.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = owned.withColumn("inside", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1).join(before, ["number", "chunk"])
    k = F.col("before") + F.col("inside")
    turn, at = F.floor(k / F.col("blocks")), k % F.col("blocks")
    done = turn * F.col("source_size") + at * F.col("block")
    length = F.least(F.col("block"), F.col("source_size") - at * F.col("block"))
    return ranked.select("slot", "number", at.alias("at"), F.least(length, F.col("goal") - done).cast("long").alias("words"), length.alias("length")).where("words > 0")


def mix(docs: DataFrame, block: int = 1024, repeats: int = 3, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, source_size, target, taken, slots) of every document, and the schedule (slot, source, block number, words). ``slots`` are those that take its first word, in order."""
    return mix_rows(sized(docs), block, repeats, buckets)


def mix_rows(rows: DataFrame, block: int, repeats: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """``mix`` of the rows of ``sized``; the first result has their ``_id`` too."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    goals = targets(sums, repeats).withColumn("goal", F.floor("target").cast("long"))
    # whole turns over the source's blocks, then those of the rest
    n, goal = F.col("n"), F.col("goal")
    blocks = lambda words: F.floor((words + (block - 1)) / block)
    goals = goals.withColumn("slots", F.when(n > 0, F.floor(goal / n) * blocks(n) + blocks(goal % n)).otherwise(0).cast("long"))
    goals = running(goals, [F.col("number")], F.col("slots"), "seen")
    counted = goals.agg(F.count("*"), F.sum("slots"), F.sum("docs")).first()
    sources, needed, total = counted[0], counted[1] or 0, counted[2] or 0
    buckets = buckets or max(64, total // 20_000)
    at = lambda seen: F.expr(f"cast(cast({seen} as decimal(18,0)) * cast({PERIOD} as decimal(18,0)) div {max(needed, 1)} as long)")
    plan_df = cut(goals.select(F.col("number").cast("int").alias("number"), "source", n.alias("source_size"), "target", "goal", F.lit(block).cast("long").alias("block"), F.greatest(F.lit(1), blocks(n)).cast("long").alias("blocks"), at("seen").alias("low"), at("(seen + slots)").alias("high")))
    slots = schedule(plan_df, sources, 3 * needed + 64)
    # a block is taken once a turn, repeats times at most, so its slots are few
    taking = F.transform(F.array_sort(F.collect_list(F.struct("slot", "words"))), lambda s: s)
    per_block = slots.groupBy("number", "at").agg(F.count_if(F.col("words") == F.col("length")).alias("whole"), F.max(F.when(F.col("words") < F.col("length"), F.col("words")).otherwise(0)).alias("part"), taking.alias("taking"))
    named = small(plan_df.select("number", F.col("source").alias("_s"), "source_size", "target", "block"), sources)
    placed = laid_out(rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), buckets)
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block"))
    pieces = placed.where("size > 0").select("_id", "number", "start", end.alias("end"), "block", first.alias("first"), F.explode(F.sequence(first, last)).alias("at")).join(per_block, ["number", "at"])
    lower = F.greatest("start", F.col("at") * F.col("block"))
    upper = F.least("end", (F.col("at") + 1) * F.col("block"))
    part = F.greatest(F.lit(0), F.least("end", F.col("at") * F.col("block") + F.col("part")) - lower)
    # the slots that take a document's first word, in order: where it stands in the mix
    begins = F.max(F.when(F.col("at") == F.col("first"), F.transform(F.filter("taking", lambda s: s["words"] > F.col("start") - F.col("first") * F.col("block")), lambda s: s["slot"])))
    taken = pieces.groupBy("_id").agg(F.sum(F.col("whole") * (upper - lower) + part).alias("taken"), begins.alias("slots"))
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "_id", "left").select("_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))
    return out, slots.join(named.select("number", F.col("_s").alias("source")), "number").select("slot", "source", F.col("at").alias("block"), "words")


def mixed_documents(docs: DataFrame, block: int = 1024, repeats: int = 3) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, up to ``repeats`` times, numbered from 0 in ``copy``.

    A document of which a part is taken in its last turn stands once more if its source's words stay nearest the
    target so: the cut of that turn falls in at least half of it. Documents without words stand once. A column ``copy`` of
    ``docs`` is replaced.
    """
    name = free_name(docs, "copy_number")
    held = cut(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_id")))
    rows = held.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), size_of("_row.text").alias("size"), place_of("_row.doc_id", "_row.text").alias("place"), "_id")
    counts = mix_rows(cut(rows), block, repeats, None)[0].select("_id", "slots", F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int").alias("n")).where("n > 0")
    out = held.join(counts.drop("slots"), "_id").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("_row.*", name)
    return out.drop("copy").withColumnRenamed(name, "copy")
