"""Secret scans: patterns, and Markov models of characters, in DataFrame operations only.

Patterns find assignments to names like ``password``, access keys, and long hexadecimal runs. Secrets without such signs are told by how
their characters follow each other. Two first-order Markov models over letters and digits are trained from labelled samples, one of random
strings and one of ordinary identifiers; for a token of ``least`` letters, digits, ``+``, ``/``, ``_`` and ``-`` or more

    ratio = sum over its neighbours (b after a) of log P(b | a, random) - log P(b | a, ordinary)

where the four signs, which join words in identifiers and mean nothing in random strings, count 0. A token with a ratio over ``over`` (natural logarithm: the odds for "random" must be e ** ``over`` to 1)
and ``each`` a character on average is a secret of kind ``random``, unless a pattern's span overlaps it.

Labelled samples (``labelled``): values that the patterns find and strings drawn from hashes in the usual alphabets are random; other tokens, of four characters or more but too short to be judged, are ordinary. They come from a bounded
sample of ``documents`` documents (the least by a hash of id and text; more if equal rows fall on the bound) and ``drawn`` hashes. Neighbours are counted by a group by, so the driver gets the
counts of pairs of characters alone. A share ``even`` of each probability is spread evenly over all characters, so a pair that the samples lack, as at a change of case, tells a little only.

Places of matches are running sums of the lengths of what lies between them. No row leaves its task: nothing is shuffled but the counts of pairs.

Defined cases: null and empty texts have no spans; null ids and repeated rows are answered row by row; texts and tokens of any length are read whole; an empty table gives
an empty result (the model of ordinary identifiers is even then); extra columns pass through ``find``, but those named like its outputs are replaced; spans with one start are
ordered by kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

#: kind and pattern; what a match must have besides stands in ``holds``.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{24,}"),
)
BASE = tuple(kind for kind, _ in PATTERNS)
RANDOM = "random"
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = r"[A-Za-z0-9+/_-]{%d,}"
SHORT = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,%d}(?![A-Za-z0-9+/_-])"
BLOCK = 256


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is a secret. A match that isn't is dropped, and none begins inside it."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[0][1], 2)) >= 6
    return F.length(match) >= (20 if kind == "access" else 24)


def running_sums(values: Column) -> Column:
    """The sums of an array up to each element: within blocks of BLOCK elements, and over the blocks' sums, so long arrays stay cheap."""
    last = lambda done: F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0).cast("long"))
    within = lambda block: F.aggregate(block, F.array().cast("array<long>"), lambda done, x: F.concat(done, F.array(last(done) + x)))
    number = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), lambda i: i < number), lambda i: within(F.slice(values, i * BLOCK + 1, F.lit(BLOCK))))
    add = lambda done, block: F.struct(F.concat(done["all"], F.array(F.transform(block, lambda x: x + done["sum"]))).alias("all"), (done["sum"] + last(block)).alias("sum"))
    start = F.struct(F.array().cast("array<array<long>>").alias("all"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(blocks, start, add, lambda done: F.flatten(done["all"]))


def with_matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """``df`` with an array of (match, start, end) of the pattern's leftmost non-overlapping matches, in code points, ends exclusive."""
    found, between, sums = (free_name(df, f"{name}_{x}") for x in ("found", "between", "sums"))
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x).cast("long"))))
    # the end of match i is the sum of what lies before and of the matches up to it
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, match: gap + F.length(match))
    df = df.withColumn(sums, F.when(F.size(found) > 0, running_sums(steps)).otherwise(F.array().cast("array<long>")))
    spans = F.zip_with(found, sums, lambda match, end: F.struct(match.alias("match"), (end - F.length(match)).alias("start"), end.alias("end")))
    return df.withColumn(name, spans).drop(found, between, sums)


def base_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with an array of (start, kind number, end) of the patterns' spans, by start and kind."""
    parts = []

    def numbered(part: str, k: int, kind: str) -> Column:
        kept = F.filter(part, lambda s: holds(kind, s["match"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    for k, (kind, pattern) in enumerate(PATTERNS):
        parts.append(free_name(df, f"{name}_{kind}"))
        df = with_matches(df, text, pattern, parts[-1])
        df = df.withColumn(parts[-1], numbered(parts[-1], k, kind))
    return df.withColumn(name, F.array_sort(F.concat(*parts))).drop(*parts)


def sampled(docs: DataFrame, documents: int) -> DataFrame:
    """``docs`` with the ``documents`` least hashes of id and text."""
    key = F.xxhash64("doc_id", "text")
    total = docs.count()
    if total <= documents:
        return docs
    keys = docs.select(key.alias("key"))
    # hashes spread evenly, so about twice as many as are needed lie below a cut, and only these are sorted
    few = keys.where(F.col("key") <= min(2 * documents * (1 << 64) // total - (1 << 63), (1 << 63) - 1)).orderBy("key").limit(documents).agg(F.max("key"), F.count("*")).first()
    return docs.where(key <= few[0]) if few[1] == documents else docs


def drawn_strings(spark: SparkSession, n: int) -> DataFrame:
    """``n`` random strings in each of five alphabets, from hashes of numbers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    shapes = (F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.translate(F.substring(coded, 1, 40), "=", ""), F.translate(F.substring(coded, 1, 40), "+/=", "-_"), F.upper(F.translate(F.substring(coded, 1, 40), "+/=", "")))
    return spark.range(n).select(F.explode(F.array(*shapes)).alias("string"))


def labelled(docs: DataFrame, documents: int, drawn: int, least: int = 20) -> DataFrame:
    """string and whether it is random: labelled samples for ``train``."""
    rows = base_spans(sampled(docs, documents).select(F.coalesce("text", F.lit("")).alias("text")), "text", "base")
    value = lambda s: F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
    found = F.transform("base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(value(s), PATTERNS[0][1], 2)).otherwise(value(s)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", PATTERNS[0][1], " "), PATTERNS[1][1], " "), PATTERNS[2][1], " ")
    random = rows.where(F.size("base") > 0).select(F.explode(found).alias("string")).union(drawn_strings(docs.sparkSession, drawn))
    return random.select("string", F.lit(True).alias("random")).union(rows.select(F.explode(F.regexp_extract_all(rest, F.lit(SHORT % (least - 1)), F.lit(0))).alias("string"), F.lit(False)))


def train(samples: DataFrame, even: float = 0.05) -> list[float]:
    """The log-likelihood ratio of each pair of CHARACTERS, row by row, from labelled ``samples`` (string, random)."""
    chars = F.transform(F.split("string", ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    pairs = samples.select("random", chars.alias("c")).where(F.size("c") > 1)
    n = F.size("c") - 1
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", 1, n), F.slice("c", 2, n), lambda a, b: F.when((a >= 0) & (b >= 0), a * len(CHARACTERS) + b))).alias("pair")).where("pair is not null")
    size = len(CHARACTERS)
    counts = {True: [0.0] * size**2, False: [0.0] * size**2}
    for r in pairs.groupBy("random", "pair").count().collect():  # two models of 62 * 62 pairs at most
        counts[r.random][r.pair] = float(r["count"])
    ratio = []
    for a in range(size):
        log = {}
        for kind, of in counts.items():
            row = of[a * size : (a + 1) * size]
            log[kind] = [math.log((1 - even) * (x / sum(row) if sum(row) else 1 / size) + even / size) for x in row]
        ratio += [r - o for r, o in zip(log[True], log[False])]
    return ratio


def log_ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token, random against ordinary."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    one = lambda c: F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.when((a >= 0) & (b >= 0), F.element_at(table, a * len(CHARACTERS) + b + 1)).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    return F.element_at(F.transform(F.array(places), one), 1)  # the places are made once


def find(docs: DataFrame, model: list[float], least: int = 20, over: float = 10.0, each: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``: an array of (start, kind, end, ratio) by start and kind, ends exclusive, in code points."""
    src = docs.drop("spans")
    text, base, tokens = (free_name(src, x) for x in ("whole_text", "base_spans", "tokens"))
    rows = base_spans(src.withColumn(text, F.coalesce("text", F.lit(""))), text, base)
    rows = with_matches(rows, text, TOKEN % least, tokens)
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    rows = rows.withColumn(tokens, F.transform(free, lambda t: F.struct(t["start"], t["end"], log_ratio(t["match"], model).alias("ratio"))))
    random = F.filter(tokens, lambda t: (t["ratio"] > over) & (t["ratio"] > each * (t["end"] - t["start"])))
    names = F.array(*(F.lit(k) for k in (*BASE, RANDOM)))
    none = F.lit(None).cast("double")
    both = F.concat(
        F.transform(base, lambda s: F.struct(s["start"], s["kind"], s["end"], none.alias("ratio"))),
        F.transform(random, lambda t: F.struct(t["start"], F.lit(len(BASE)).alias("kind"), t["end"], t["ratio"])),
    )
    spans = F.transform(F.array_sort(both), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["ratio"].alias("ratio")))
    return rows.withColumn("spans", spans).drop(text, base, tokens)


def secret_scan(docs: DataFrame, documents: int = 4000, drawn: int = 2000, least: int = 20, over: float = 10.0, each: float = 0.5) -> DataFrame:
    """``docs`` with the ``spans`` of ``find``, by a model trained from them."""
    return find(docs, train(labelled(docs, documents, drawn, least)), least, over, each)


def digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of every row of ``find``."""
    shown = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in (*BASE, RANDOM)), F.sha2(shown(lambda s: s["kind"] != RANDOM), 256).alias("base_sha256"), shown(lambda s: F.lit(True)).alias("spans"))
