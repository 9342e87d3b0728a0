"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find. The
corpus then tells which other terms give an entity away: for an entity c and a term t that stands within
``window`` words of it,

    PMI(c; t)  = log2( P(t | c) / P(t) )        IC(c) = -log2 P(c)
    disclosure = PMI(c; t) / IC(c)

Everything is counted in one unit, distinct texts: a text counts once however often it is copied, for an entity, for a term, and for a term near an entity. The same words around an entity in several texts are one
context, and several contexts in one text are one as well, so near copies don't make support. P(t | c) is the lower confidence bound (Wilson, ``z`` deviations) of the share of the entity's contexts that hold t; so a
disclosure is 1 at most, when the term tells as much as the entity itself, and one context never tells that much.

Rare words stand near an address by chance, too. Evidence is pooled over all entities: of the ``df`` texts with t, S have it near any. If terms stood near entities as often as all terms do (p, the share of all
pairs of text and term), S or more of df would have a probability below exp(-df * KL(S / df, p)); times the number of terms this is how many terms chance alone lets through. Terms where that is over ``chance`` aren't told;
a word seen once never is.

Terms that reach ``generalise_at`` are replaced by the entity's kind, those that reach ``remove_at`` are removed, in every document. Pattern matches are always replaced by their kind.

Secrets (keys, tokens) are protected entities as well. They have no pattern of their own: a run of ``SECRET_LENGTH`` letters and
digits or more is one if it holds both, a fifth of it or more in digits, and its characters have ``SECRET_BITS`` bits of entropy each or more, which
words don't.

Counts cover the whole corpus and are sums over keys (entity, term, context), combined before each
shuffle. All terms are counted in all documents, so the work grows with the corpus alone, and those near entities are joined back. The list of disclosing terms is broadcast only after its rows are counted, and joined by term otherwise.

Defined cases: null and empty texts have no spans; null ids and repeated rows are answered row by row; texts and terms of any length are
read whole; equal spans of a term or secret and a pattern: the pattern's stays; overlapping term spans cannot arise; of terms with equal disclosure by several
entities the greatest entity names it; an empty table gives an empty result; extra columns pass through, but columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_batches, slices, small, values_of

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE = KINDS[:4]
SECRET, TERM = 4, 5
SECRET_LENGTH, SECRET_BITS = 24, 3.0
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9]{{{SECRET_LENGTH},}}+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_TERM = re.compile(r"\w+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
REMOVED, GENERALISED = "removed", "generalised"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of every pattern match, by kind and start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            found.append((0, start, done))
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def entropy(text: str) -> float:
    """Bits of information in each character of a text, by its own frequencies."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def secret_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of secrets that no span in ``taken`` overlaps."""
    found = []
    for m in _SECRET.finditer(text):
        run = m.group()
        digits = len(run) - len(_DIGITS.sub("", run))
        if digits < len(run) and 5 * digits >= len(run) and entropy(run) >= SECRET_BITS and not any(s < m.end() and m.start() < e for _, s, e in taken):
            found.append((SECRET, m.start(), m.end()))
    return found


def entity_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return base + secret_spans(text, base)


def entity(kind: int, matched: str) -> str:
    """One spelling of an entity."""
    return f"{KINDS[kind]}:" + (matched.lower() if kind < 2 else matched if kind == SECRET else _NOT_DIGIT.sub("", matched))


def words_near(text: str, start: int, end: int, window: int) -> tuple[list[str], list[str]]:
    """The last ``window`` words of ``text`` before ``start`` and the first ones from ``end`` on."""
    reach = 16 * window
    while True:  # a word at the border may be cut, so one more than needed must be in reach
        left = text[max(0, start - reach) : start].split()
        if len(left) > window or reach >= start:
            break
        reach *= 4
    reach = 16 * window
    while True:
        right = text[end : end + reach].split()
        if len(right) > window or end + reach >= len(text):
            return left[-window:], right[:window]
        reach *= 4


def terms_of(text: str) -> list[str]:
    """The lower-case words of a text but numbers."""
    return [t for t in _TERM.findall(text.lower()) if not t.isdigit()]


def context(text: str, start: int, end: int, window: int) -> list[str]:
    """The lower-case terms among the ``window`` words on either side; words that themselves are numbers or addresses are left out."""
    left, right = words_near(text, start, end, window)
    return [t for w in (*left, *right) if "@" not in w for t in terms_of(w) if not secret_spans(t, [])]


def evidence(docs: DataFrame, window: int) -> DataFrame:
    """entity, context number, text number and terms of each mention; documents without mentions give no row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ent, ctx, place, terms = [], [], [], []
        for t, number in zip(values_of(batch.column(0)), values_of(batch.column(1))):
            for kind, s, e in entity_spans(t or ""):
                near = context(t, s, e, window)
                ent.append(entity(kind, t[s:e]))
                ctx.append(int.from_bytes(hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest(), "little", signed=True))
                place.append(number)
                terms.append(sorted(set(near)))
        return pa.RecordBatch.from_arrays([pa.array(ent, pa.string()), pa.array(ctx, pa.int64()), pa.array(place, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["entity", "context", "place", "terms"])

    return map_batches(docs.where("text is not null").select("text", F.xxhash64("text").alias("place")), run, "entity string, context long, place long, terms array<string>")


def document_frequency(docs: DataFrame) -> tuple[DataFrame, float]:
    """term and df, the number of distinct texts that hold it, over all documents, and how many distinct texts there are. The term ``""`` has the sum over all terms.

    Each of k equal texts counts as 1 / k, so the sums need no shuffle of texts.
    """
    texts = docs.select("text").where("text is not null").withColumn("hash", F.xxhash64("text"))
    copies = cut(texts.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"))
    repeated = copies.agg(F.count("*"), F.sum("copies")).first()
    distinct = texts.count() - (repeated[1] or 0) + repeated[0]
    weighted = texts.join(small(copies, repeated[0]), "hash", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))

    def run(batches):
        counts: dict[str, float] = {}
        chars = 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.float64())], names=["term", "n"])
        for batch in batches:
            for text, weight in zip(values_of(batch.column(0)), values_of(batch.column(1))):
                seen = 0
                for t in set(_TERM.findall(text.lower())):
                    if t in counts:
                        counts[t] += weight
                    elif not t.isdigit():
                        counts[t] = weight
                        chars += len(t)
                    else:
                        continue
                    seen += 1
                counts[""] = counts.get("", 0.0) + weight * seen
                if len(counts) > 100_000 or chars > 2_000_000:
                    yield rows()
                    counts.clear()
                    chars = 0
        if counts:
            yield rows()

    return weighted.mapInArrow(run, "term string, n double").groupBy("term").agg(F.sum("n").alias("df")), distinct


def disclosing_terms(docs: DataFrame, window: int = 8, generalise_at: float = 0.8, remove_at: float = 0.95, z: float = 1.0, chance: float = 0.05) -> DataFrame:
    """term, entity, support, disclosure and action of the terms over the thresholds."""
    seen = cut(evidence(docs, window))
    empty = docs.sparkSession.createDataFrame([], "term string, entity string, support long, disclosure double, action string")
    units = F.least(F.countDistinct("context"), F.countDistinct("place"))
    near = cut(seen.select("entity", "context", "place", F.explode("terms").alias("term")).distinct())
    n_terms = near.select("term").distinct().count()
    if not n_terms:
        return empty
    pooled = near.groupBy("term").agg(units.alias("pooled"), F.countDistinct("place").alias("texts"))
    totals = seen.groupBy("entity").agg(units.alias("contexts"))
    pairs = near.groupBy("entity", "term").agg(units.alias("support")).join(totals, "entity").join(pooled.drop("texts"), "term")
    counted, n = document_frequency(docs)
    wanted = near.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    known = cut(counted.join(wanted, "term", "left_semi"))
    every = known.where("term = ''").first().df
    p = F.lit(min(0.5, pooled.agg(F.sum("texts")).first()[0] / every))
    df = F.greatest("df", F.col("pooled"))
    q = F.col("pooled") / df
    gap = F.when(q > p, q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)).otherwise(0.0)
    # terms near entities are about p of all terms, so n_terms / p terms could have come near by chance
    beyond = F.log(n_terms / p) - df * gap <= F.lit(math.log(chance))
    share = F.least(df / F.lit(float(n)), F.lit(1.0))
    m, k = F.col("contexts").cast("double"), F.col("support") / F.col("contexts")
    lower = (k + z * z / (2 * m) - z * F.sqrt(k * (1 - k) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    ic = -F.log2(F.least(m / F.lit(float(n)), F.lit(0.5)))
    measured = pairs.join(known, "term").where(beyond & (F.col("support") > 0)).withColumn("disclosure", F.round(F.log2(lower / share) / ic, 9))
    best = measured.where(F.col("disclosure") >= generalise_at).groupBy("term").agg(F.max(F.struct("disclosure", "entity", "support")).alias("b"))
    return cut(best.select("term", "b.entity", "b.support", "b.disclosure", F.when(F.col("b.disclosure") >= remove_at, REMOVED).otherwise(GENERALISED).alias("action")))


def spans_of(text: str, action: dict[str, str]) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, action) of all spans of a text, patterns first; ``action`` tells that of each disclosing term."""
    rows = [(k, s, e, GENERALISED) for k, s, e in entity_spans(text)]
    if action:
        taken, k = sorted((s, e) for _, s, e, _ in rows), 0
        for m in _TERM.finditer(text):
            told = action.get(m.group().lower())
            if told is None:
                continue
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if not (k < len(taken) and taken[k][0] < m.end()):
                rows.append((TERM, m.start(), m.end(), told))
    return rows


def with_actions(docs: DataFrame, terms: DataFrame | None, most: int):
    """``docs`` with a column of the terms found in each text, its name, and a function of its value that gives their actions.

    A list of at most ``most`` terms is broadcast and the column is null; a longer one is joined to the terms of the texts.
    """
    name = free_name(docs, "told")
    n = terms.count() if terms is not None else 0
    if n <= most:
        known = docs.sparkSession.sparkContext.broadcast({r.term: r.action for r in terms.select("term", "action").collect()} if n else {})
        return docs.withColumn(name, F.lit(None).cast("array<string>")), name, lambda told: known.value

    def run(batch: pa.RecordBatch):
        for some in slices(batch, 1):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([sorted(set(terms_of(t or ""))) for t in values_of(some.column(1))], pa.list_(pa.string()))], names=["key", "terms"])

    key = F.xxhash64("doc_id", "text")
    listed = map_batches(docs.select(key.alias("key"), "text"), run, "key long, terms array<string>")
    hits = listed.select("key", F.explode("terms").alias("term")).join(terms.select("term", "action"), "term")
    per_doc = hits.groupBy("key").agg(F.collect_set(F.concat_ws("\t", "term", "action")).alias(name)).withColumnRenamed("key", f"{name}_key")
    joined = docs.join(per_doc, key == per_doc[f"{name}_key"], "left").drop(f"{name}_key")
    return joined, name, lambda told: dict(x.split("\t") for x in told) if told is not None else {}


def find(docs: DataFrame, terms: DataFrame | None = None, keep_text: bool = True, most: int = 100_000) -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end, action), by kind and start; ends exclusive, in code points."""
    src, name, actions = with_actions(docs.drop("spans"), terms, most)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("action", pa.string())])

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,action:string>>")
    def spans(texts: pa.Array, told: pa.Array) -> pa.Array:
        rows = ([{"kind": KINDS[k], "start": s, "end": e, "action": a} for k, s, e, a in spans_of(t or "", actions(x))] for t, x in zip(values_of(texts), values_of(told)))
        return pa.array(rows, pa.list_(item))

    return src.withColumn("spans", spans("text", name)).drop(name, *([] if keep_text else ["text"]))


def replaced(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    parts, at = [], 0
    for k, start, end, action in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], "" if action == REMOVED else f"[{KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, terms: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in square brackets, or removed."""
    src, name, actions = with_actions(docs, terms, most)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, told: pa.Array) -> pa.Array:
        return pa.array((t and replaced(t, spans_of(t, actions(x))) for t, x in zip(values_of(texts), values_of(told))), pa.string())

    return src.withColumn("text", clean("text", name)).select(*docs.columns)


def digest(docs: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Counts and span lists of every row."""
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("at")))
    listed = find(docs, terms, keep_text=False).withColumn("shown", shown)
    only = lambda keep: F.array_join(F.transform(F.filter("shown", keep), lambda s: s["at"]), ",")
    count = lambda kind: F.size(F.filter("shown", lambda s: s["kind"] == kind)).cast("long")
    return listed.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(only(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"),
        only(lambda s: F.lit(True)).alias("spans"),
        F.exists("shown", lambda s: s["kind"] != KINDS[TERM]).alias("has_private"),
    )
