"""Each text operator against a plain second version, on odd rows and on the small table."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from voltmesh.llm import common, html_template, mixing, ngram_join, pii, piece_dropout, quality_classifier, quality_rules, queries, sharding, token_files

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "a  b\n\nc \x0b d e ▁ x\x1cy <|endoftext|> it's 12 345"), (4, "same id, other text"),
    (5, "twice"), (5, "twice"), (6, LONG), (7, "x" * 5000), (8, "émail à bob.b@ex-1.example.com, 10.0.0.256 10.0.0.255 4111 1111 1111 1111 +1 (555) 010-9999 \U0001f600"), (9, "@ a@b .c@d.e f@g.h@i.j 1.2.3.4.5 +12 +1234567890123456 4111-1111-1111-1112"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def plain_spans(t):
    """The contract's patterns, as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t or "") if fine(m.group())]
    return out


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_pii_base(spark, odd):
    for docs in (odd.where("doc_id <> 7 or doc_id is null"), documents(spark)):
        rows = {(r.doc_id, r.base_sha256): r for r in pii.digest(docs, None).collect()}
        for r in docs.collect():
            found = plain_spans(r.text)
            got = rows[r.doc_id, hashlib.sha256(",".join(found).encode()).hexdigest()]
            assert got.spans == ",".join(found) and got.n_email == sum(x[0] == "e" for x in found)


def test_pii_terms(spark):
    hint = [(i, f"word{i} other{i * 7 % 11} Zanzibar wrote bob@ex.org yester{i} day{i * 3}") for i in range(20)]
    docs = spark.createDataFrame([*hint, (100, "only Zanzibar, here"), *[(200 + i, f"plain text number{i} wrote") for i in range(300)], (900, None)], "doc_id long, text string")
    terms = pii.disclosing_terms(docs)
    assert {r.term: r.action for r in terms.collect()} == {"zanzibar": pii.REMOVED}
    rows = {r.doc_id: r for r in pii.digest(docs, terms).collect()}
    assert rows[100].spans == "term:5:13" and rows[900].spans == "" and len(rows) == docs.count()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, terms).collect()}
    assert clean[0] == "word0 other0  wrote [EMAIL] yester0 day0" and clean[100] == "only , here" and clean[200] == "plain text number0 wrote"


def named_texts(n: int) -> list[str]:
    return [f"w{i} x{i} Quillfeather said y{i} mail amy@ex.org to z{i}" for i in range(n)]


def plain_terms(texts, window=8, generalise_at=0.8, z=1.0, chance=0.05):
    """The same counts in one process."""
    distinct = sorted({t for t in texts if t is not None})
    near, total, df = {}, {}, Counter()
    for t in distinct:
        df.update(set(pii.terms_of(t)))
        for kind, s, e in pii.entity_spans(t):
            c, words = pii.entity(kind, t[s:e]), pii.context(t, s, e, window)
            total.setdefault(c, set()).add((" ".join(words), t))
            for w in words:
                near.setdefault(w, {}).setdefault(c, set()).add((" ".join(words), t))
    units = lambda seen: min(len({x for x, _ in seen}), len({x for _, x in seen}))
    p = min(0.5, sum(len({t for seen in of.values() for _, t in seen}) for of in near.values()) / max(1, sum(df.values())))
    out = {}
    for w, of in near.items():
        s = units(set().union(*of.values()))
        q = s / df[w]
        gap = (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) if q > p else 0
        if math.log(len(near) / p) - df[w] * gap > math.log(chance):
            continue
        for c, seen in of.items():
            m, k = units(total[c]), units(seen) / units(total[c])
            lower = (k + z * z / (2 * m) - z * math.sqrt(k * (1 - k) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            d = round(math.log2(lower / (df[w] / len(distinct))) / -math.log2(min(m / len(distinct), 0.5)), 9)
            if d >= generalise_at:
                out[w] = max(out.get(w, (0, "", 0)), (d, c, units(seen)))
    return {(w, c, s, d) for w, (d, c, s) in out.items()}


@pytest.mark.parametrize("case", ["one", "some", "near", "table"])
def test_pii_terms_equal_plain_counts(spark, case):
    others = [f"we said mail to us {i}" for i in range(400)]
    texts = {"one": [*named_texts(1), *others], "some": [*named_texts(6), *others, *named_texts(6), "ask Quillfeather now", None, ""], "near": [*[named_texts(1)[0] + " " + "far " * 9 + str(i) for i in range(6)], *others], "table": [r.text for r in documents(spark).collect()]}[case]
    got = pii.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.term, r.entity, r.support, r.disclosure) for r in got} == plain_terms(texts) and all(r.disclosure <= 1 for r in got)
    if case != "table":
        assert {r.term for r in got} == ({"quillfeather"} if case == "some" else set())  # one context, in near copies too, tells nothing


def test_pii_told_by_broadcast_and_by_join(spark):
    docs = spark.createDataFrame([*enumerate(named_texts(6)), *[(10 + i, f"we said mail to us {i}") for i in range(400)], (500, "ask Quillfeather now")], "doc_id long, text string")
    terms = pii.disclosing_terms(docs)
    for most in (100_000, 0):
        spans = pii.find(docs, terms, most=most).where("doc_id in (0, 500)").orderBy("doc_id").collect()
        assert [[(s.kind, s.start, s.end) for s in r.spans] for r in spans] == [[("email", 32, 42), ("term", 6, 18)], [("term", 4, 16)]]


def test_pii_context_is_words_not_characters():
    text = " ".join([f"w{i}" + "x" * 60 for i in range(8)]) + " a@b.c " + "y" * 900 + " last"
    near = pii.context("far " + text, 4 + text.index("a@"), 4 + text.index("a@") + 5, 8)
    assert near == [f"w{i}" + "x" * 60 for i in range(8)] + ["y" * 900, "last"]


def test_pii_copies_of_a_text_count_once(spark):
    texts = ["ask Quillfeather about it", *[f"other text number {i}" for i in range(399)]]
    docs = spark.createDataFrame(list(enumerate([*named_texts(6), *texts])), "doc_id long, text string")
    many = docs.unionByName(spark.createDataFrame([(1000 + i, texts[0]) for i in range(300)], "doc_id long, text string"))
    shown = [{r.term: r.disclosure for r in pii.disclosing_terms(d).collect()} for d in (docs, many)]
    assert shown[0] == shown[1] and "quillfeather" in shown[0]
    df, n = pii.document_frequency(many)
    assert n == 406 and {r.term: round(r.df, 9) for r in df.collect()}["quillfeather"] == 7


def test_pii_secrets(spark):
    secret = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows = [(1, f'token = "{secret}" end', "s"), (2, "x" * 60 + " " + "12345678901234567890123456 " + "abcdefghijklmnopqrstuvwxyzabcdef aaaaaaaaaaaaaaaaaaaaaaa11111111", "s"), (3, f"{secret}@a.bc", "s"), (4, None, "s"), (5, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(docs.select("doc_id", "text"), None).collect()}
    assert (got[1].spans, got[1].n_secret, got[1].has_private) == ("secret:9:49", 1, True) and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == "" and got[3].spans == "email:0:45" and got[4].spans == got[5].spans == ""
    clean = {r.doc_id: r for r in pii.sanitise(docs.withColumn("told", F.lit(1))).collect()}
    assert clean[1].text == 'token = "[SECRET]" end' and clean[1].spans == "s" and clean[1].told == 1 and clean[4].text is None and clean[5].text == ""
    assert pii.find(docs).where("doc_id = 1").first().spans[0].kind == "secret"
    assert pii.disclosing_terms(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_piece_dropout(spark, odd):
    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = odd.unionByName(documents(spark).select("doc_id", "text"))
    for r in piece_dropout.encode(docs, model, dropout=0.0).collect():
        if "▁" not in (r.text or ""):  # the library makes a space of it; here it stays itself, which the round trip below holds
            assert r.ids == (None if r.text is None else sp.encode(r.text))
    varied = piece_dropout.decode(piece_dropout.encode(docs, model, dropout=0.3), model).collect()
    assert all(r.decoded == r.text for r in varied)
    again = piece_dropout.encode(docs.repartition(3), model, dropout=0.3).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.ids or []) for r in varied) == sorted((r.doc_id or -1, r.text or "", r.ids or []) for r in again)
    assert all(r.lossless for r in piece_dropout.round_trip(docs, model).collect())


def test_piece_dropout_batch_equals_agenda():
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        p = piece_dropout.Pieces(f.read(), 0.25, 11, 4)
    parts = [" " + w for w in "international understanding of thndhain onhalyti éauxmentre straße 12345 a".split()] + ["   x", "\n", " "]
    for v in range(4):
        assert p.together(parts, [v] * len(parts)) == [p.agenda(x, v) for x in parts]
    assert p.together(parts[:1], [0]) != p.together(parts[:1], [1]) or p.together(parts[1:2], [0]) != p.together(parts[1:2], [1])


def test_piece_dropout_draws_each_occurrence(spark):
    model = queries.vocabulary("piece_bpe_32k.model")
    with open(model, "rb") as f:
        p = piece_dropout.Pieces(f.read(), 0.1, 7)
    text = " ".join(["international understanding straße 12345 " + "longword" * 12] * 40)
    ids, bounds = p.encode([text, None, text], [3, 4, 5])
    doc = lambda k: piece_dropout.mix_int((k + 7 * piece_dropout._GOLD) & piece_dropout.MASK64)
    for k, a, b in ((3, bounds[0], bounds[1]), (5, bounds[2], bounds[3])):
        want = []
        for i, w in enumerate(p.parts_of(text)):
            want += p.agenda(piece_dropout.part_text(w), piece_dropout.mix_int((doc(k) + i * 0xD6E8FEB86659FD93) & piece_dropout.MASK64))
        assert ids[a:b].tolist() == want
    docs = spark.createDataFrame([(1, "international " * 2000)] * 2, "doc_id long, text string").coalesce(1).withColumn("copy", F.monotonically_increasing_id())
    one, two = (r.ids for r in piece_dropout.encode(docs, model, dropout=0.3).collect())
    assert one != two  # copies differ
    words = set()
    for r in piece_dropout.decode(piece_dropout.encode(docs.limit(1), model, dropout=0.3), model).collect():
        assert r.decoded == r.text
        spelled, word = [p.bytes_of[i] for i in r.ids], []
        for s in spelled:
            if s.startswith(b" ") and word:
                words.add(tuple(word))
                word = []
            word.append(s)
    assert len(words) > 20


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    file = queries.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    docs = odd.unionByName(documents(spark).select("doc_id", "text"))
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs, path, file, files=3)
    want = {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.setdefault((r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)), []).append(ids)
    rows = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and [r.doc_id is not None and r.doc_id for r in rows] == sorted(r.doc_id is not None and r.doc_id for r in rows)
    at = 0
    for r in rows:
        assert r.start == at and (r.doc_id, r.ids_crc32, r.n_tokens) in want
        at += r.n_tokens
    assert token_files.estimated_bytes(documents(spark)) > 0 and token_files.estimated_bytes(spark.createDataFrame(spark.sparkContext.range(3).map(lambda x: (x,)), "x long")) == 0
    # file names go on past five digits
    names = [f"x/part-{p:05d}-c9-c123-0a.b-c{c:03d}.txt" for p in (0, 1023, 1024, 99_999, 100_000, 100_001) for c in (0, 2, 999, 1000)]
    listed = spark.createDataFrame([(n, k, 10 + i) for i, n in enumerate(names) for k in range(2)], "file string, position long, n_tokens long").repartition(3)
    starts = {(r.file, r.position): r.start for r in token_files.with_starts(listed).collect()}
    at = 0
    for i, n in enumerate(names):
        for k in range(2):
            assert starts[n, k] == at
            at += 10 + i
    token_files.write(docs.limit(0), path, file, files=3)
    assert token_files.digest(spark, path).count() == 0


def test_token_files_hot_id(spark, tmp_path):
    file, path = queries.vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/tokens"
    texts = ["same text for all"] * 3000 + [f"other text {i}" for i in range(100)] + ["long " * 60_000] * 2
    docs = spark.createDataFrame([(5, t) for t in texts] + [(None, "none"), (9, "nine")], "doc_id long, text string").repartition(4)
    token_files.write(docs, path, file, files=3, file_blocks=3)
    stored = token_files.read(spark, path).collect()
    rows = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    by_file = {}
    for r in stored:
        by_file.setdefault(r.file, []).append(r)
    assert len(rows) == len(stored) == docs.count() and len(by_file) > 3  # a range rolls to new files
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f, rs in by_file.items() if any(r.doc_id == 5 for r in rs)}) == 3  # one id, several tasks
    in_order = [r for f in sorted(by_file) for r in sorted(by_file[f], key=lambda r: r.position)]
    assert [(r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in in_order] == [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows]
    assert [r.doc_id for r in rows] == [None, *[5] * len(texts), 9]


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(5, np.uint32), rng.integers(0, 50257, 4096, np.uint32), np.array([2**32 - 1, 0, 7], np.uint32), np.append(rng.integers(3, 9, 100, np.uint32), np.uint32(2**31))):
        data = token_files.encode_block(ids)
        assert (token_files.decode_block(memoryview(data), 0) == ids).all()
    assert len(token_files.encode_block(np.append(np.full(4095, 7, np.uint32), np.uint32(2**31)))) < 40  # one outlier doesn't widen a block


def plain_stats(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, odd):
    docs = odd.where("doc_id <> 6 or doc_id is null").unionByName(documents(spark).where("n_chars < 4000").select("doc_id", "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(plain_stats(r.text))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept").count() > 0


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    forest = quality_rules.grow_forest(x)
    assert quality_rules.anomaly(x[:500], forest).mean() + 0.1 < quality_rules.anomaly(np.full((1, 4), 8.0), forest)[0]


def test_path_lengths_equal_plain_walks():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    forest = quality_rules.grow_forest(x, trees=20, subsample=64, seed=3)
    f, v, c, d = (forest[k] for k in ("feature", "value", "child", "depth"))
    for row, score in zip(x[:50], quality_rules.anomaly(x[:50], forest)):
        total = 0.0
        for root in forest["roots"]:
            at = int(root)
            while f[at] >= 0:
                at = int(c[at]) + int(row[f[at]] > v[at])
            total += d[at]
        assert abs(score - 2.0 ** (-total / 20 / float(forest["norm"]))) < 1e-12
    # a leaf's length is its depth and what an unsplit rest would add: no leaf is deeper than the tree's height allows
    assert d[f < 0].max() <= int(forest["top"]) + 2 * (np.log(63) + 0.5772156649015329)
    # the cut keeps the share of good rows that is asked for, and is the one with the largest gain there
    bins = [(100 + i, 10, 0) for i in range(90)] + [(400, 95, 5), (700, 5, 60), (900, 0, 35)]
    cut_at = quality_rules.calibrated_cut(bins, 0.99)
    assert 0.4 < cut_at <= 0.701


def test_ordinal_fit_equals_plain_descent():
    rng = np.random.default_rng(9)
    n, width = 300, 12
    x = np.abs(rng.normal(size=(n, width))) * (rng.random((n, width)) < 0.4)
    z = x @ rng.normal(size=width) * 2
    grades = np.digitize(z + rng.logistic(size=n), [-0.5, 0.7])
    rows, cols = np.nonzero(x)
    w, first, gap = quality_classifier.descend(rows, cols, x[rows, cols], width, grades, 1e-3, 4000)

    def loss(w, first, gap):
        return quality_classifier.loss_and_slopes(x @ w, grades, first, gap)[0] + 1e-3 * np.abs(w).sum()

    best = loss(w, first, gap)
    # plain gradient descent, then no step in any direction helps either
    pw, pf, pg = np.zeros(width), 0.0, 1.0
    for k in range(20_000):
        _, gz, low, high = quality_classifier.loss_and_slopes(x @ pw, grades, pf, pg)
        step = 0.2 if k < 15_000 else 0.02
        pw = pw - step * (x.T @ gz / n + 1e-3 * np.sign(pw))
        pf, pg = pf - step * (low + high).mean(), max(pg - step * high.mean(), 1e-3)
    assert best <= loss(pw, pf, pg) + 1e-5
    for k in range(width):
        for e in (-0.01, 0.01):
            other = w.copy()
            other[k] += e
            assert loss(other, first, gap) >= best - 1e-9
    assert all(loss(w, first + a, gap + b) >= best - 1e-9 for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_quality_classifier_clashing_names_and_ties(spark):
    texts = [(i, f"fine words stand here number {i}", 9, 9.0) for i in range(12)] + [(100 + i, f"trash words stand here number {i}", 9, 9.0) for i in range(12)] + [(200, "fine words", 1, 1.0), (201, "fine words", 2, 2.0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, judged int, _judged double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(100 + i, 0, 0) for i in range(12)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_classifier(docs, labels, bits=16)
    assert out.columns == [*docs.columns, "expected_grade", "p_tail", "keep"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(rows[i].keep for i in range(12)) and not any(rows[100 + i].keep for i in range(12))
    assert rows[200].p_tail == rows[201].p_tail and (rows[200].judged, rows[201]._judged) == (1, 2.0)
    assert quality_classifier.quality_classifier(docs.limit(0), labels, bits=16).count() == 0


def test_quality_classifier(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = labels.where("doc_id % 4 = 0")
    model = quality_classifier.train(docs, labels.where("doc_id % 4 <> 0"), bits=16)
    assert model["thresholds"][0] < model["thresholds"][1]
    judged = quality_classifier.score(docs, model).join(held_out.withColumn("good", quality_classifier.grade_column() == 2), "doc_id").collect()
    right = np.mean([r.keep == r.good for r in judged])
    poor = [r.keep for r in judged if r.quality == 0]
    assert right > 0.9 and np.mean(poor) < 0.1 and np.mean([r.keep for r in judged if r.good]) > 0.95 and all(0 <= r.p_tail <= 1 and r.p_tail <= r.expected_grade <= 2 for r in judged)
    rows = quality_classifier.score(odd.withColumn("keep", odd.doc_id), model).collect()
    assert len(rows) == len(ODD) and all(r.keep is False for r in rows if not (r.text or "").strip())
    assert quality_classifier.quality_classifier(odd, labels.limit(0)).where("keep").count() > 0


def plain_links(texts, threshold=0.8):
    def shingles(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()

    sets = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_join(spark, block):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    base = list(rng.choice(words, 120))
    near = []
    for _ in range(60):
        t = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            t[k] = f"n{rng.integers(1000)}"
        near.append(" ".join(t))
    texts = [*near, near[0], near[0], "one two", "one two", "one three", None, "", *(" ".join(rng.choice(words, 80)) for _ in range(50)), *(r.text for r in documents(spark).limit(120).collect())]
    ids = [i * 3 + 5 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, signature string")
    links = plain_links(texts)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        new = list(label)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    want = {(ids[i], ids[label[i]], sum(i in p for p in links)) for i in range(len(texts))}
    assert {tuple(r) for r in ngram_join.ngram_join(docs, block=block).collect()} == want
    kept = ngram_join.one_of_each(docs, block=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c, _ in want}


def test_ngram_join_odd(spark, odd):
    rows = ngram_join.ngram_join(odd).collect()
    assert len(rows) == len(ODD) and {r.n_links for r in rows if r.doc_id == 5} == {1}
    assert len(ngram_join.one_of_each(odd).collect()) == len(ODD) - 1
    none = spark.createDataFrame([(None, None, 1), (None, None, 2), (1, None, 3), (1, None, 4), (None, "five words of one text", 5), (None, "five words of one text", 6)], "doc_id long, text string, key int")
    kept = ngram_join.one_of_each(none)
    assert kept.columns == none.columns and sorted(r.key for r in kept.collect())[:4] == [1, 2, 3, 4] and kept.count() == 5
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0


def plain_targets(sizes, repeats=3):
    """(source, size, target), by water filling over the sources in order."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = [1 + i % 3 for i in range(len(order))]
    left, free, target = sum(n for _, n in order), set(range(len(order))), [0.0] * len(order)
    while free:
        shared = sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] > repeats * order[i][1] * shared}
        if not full:
            for i in free:
                target[i] = left * weight[i] / shared
            break
        for i in full:
            target[i] = float(repeats * order[i][1])
            left -= repeats * order[i][1]
        free -= full
    return [(s, n, target[i]) for i, (s, n) in enumerate(order)]


def plain_mix(rows, repeats=3):
    """Targets and takes by a loop over shuffled documents."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for n, (_, _, s) in zip(size, rows):
        sums[s] = sums.get(s, 0) + n
    goals = {s: (n, t) for s, n, t in plain_targets(list(sums.items()), repeats)}
    out = []
    for s, (n, t) in goals.items():
        mine = sorted((hashlib.md5(f"{'null' if i is None else i}|{hashlib.md5((x or '').encode()).hexdigest()}".encode()).hexdigest(), k) for k, (i, x, src) in enumerate(rows) if src == s)
        at = 0
        for _, k in mine:
            taken = int(t) // n * size[k] + max(0, min(at + size[k], int(t) % n) - at) if n else 0
            out.append((rows[k][0], size[k], n, t, taken))
            at += size[k]
    return out


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "é", "zz", None], 300, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows] + [(None, None, "a"), (900, "  ", "tiny"), (901, "three words here", "tiny2"), (902, LONG, "big"), (903, "same", "r"), (903, "same", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = lambda rs: sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in rs)
    out, slots = mixing.mix(docs, block=64)
    got = [tuple(r) for r in out.select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert order(got) == order(plain_mix(rows))
    assert all(r[4] <= 3 * r[1] for r in got)
    assert mixing.mix(docs.limit(0))[0].count() == 0
    # sources advance together: half-way through the slots about half of every large source is taken
    listed = sorted(slots.collect())
    half = listed[: len(listed) // 2]
    for s in ("a", "b", "big"):
        part = sum(r.words for r in half if r.source == s) / sum(r.words for r in listed if r.source == s)
        assert 0.4 < part < 0.65


def test_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 7))").alias("text"), F.expr("concat('s', id % 1100)").alias("source"))
    rows = [tuple(r) for r in docs.collect()]
    small = mixing.small
    mixing.small = lambda df, n, most=100_000: df  # as with more sources than are broadcast
    try:
        got = mixing.mix(docs, block=4)[0].select("doc_id", "size", "source_size", "target", "taken").collect()
    finally:
        mixing.small = small
    assert sorted(map(tuple, got)) == sorted(plain_mix(rows))


def test_golden_points(spark):
    for start in (100_000, 2**43 + 17):
        rows = spark.range(start, start + 50).select("id", mixing.golden_point(F.col("id")).alias("p")).collect()
        assert all(r.p == r.id * mixing.GOLDEN % mixing.PERIOD for r in rows)


def test_sharding(spark, odd, tmp_path):
    docs = odd.unionByName(documents(spark).select("doc_id", "text"))
    rows = sharding.assign(docs, 60_000).collect()
    assert len(rows) == docs.count()
    shards = {}
    for r in rows:
        shards.setdefault((r.shard, r.page), []).append(r)
    for (shard, _), members in shards.items():
        assert sum(m.bytes for m in members) == members[0].shard_bytes <= 60_000 or len(members) == 1 and members[0].oversized
        assert not shard or shard[:-1] in {s[: len(shard) - 1] for s, _ in shards}
    # a split was needed: the parent's bytes are over the limit
    for shard in {s for s, _ in shards if s}:
        assert sum(r.bytes for r in rows if r.shard.startswith(shard[:-1])) > 60_000
    same = spark.createDataFrame([(1, "x" * 100)] * 25, "doc_id long, text string")
    assert sorted(r.shard_docs for r in sharding.directory(sharding.assign(same, 1000)).collect()) == [5, 10, 10]
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 60_000)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == docs.count()
    clash = same.withColumns({"shard": F.lit("mine"), "page": F.lit(7), "row_number": F.lit(1)}).unionByName(docs.withColumns({"shard": F.lit("x"), "page": F.lit(1), "row_number": F.lit(2)}))
    sharding.write_shards(clash, f"file://{tmp_path}/clash", 1000)
    back = spark.read.parquet(f"file://{tmp_path}/clash")
    assert back.count() == clash.count() and {"shard", "page", "row_number", "_shard", "_page"} <= set(back.columns) and back.where("shard = 'mine' and page = 7").count() == 25
    sizes = back.groupBy("_shard", "_page").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.count("*").alias("rows"))
    assert sizes.where("n > 1000 and rows > 1").count() == 0  # the pages are those of the assignment
    assert sharding.assign(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><b>x";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>one</a><li>two</ul></nav><div class="ad box">buy</div>{open}<h1>Head &amp; line {n}</h1><p>First <b>bo</b>ld text<br>after {n}.<p>Second&nbsp;para
 here {n}<form><input>mail us</form><script>if (a < b) {{}}</script>{close}<aside>see also</aside><div id="comments"><p>nice post {n}</p></div><footer>&copy; all rights</footer></body></html>"""


def test_html(spark):
    want = lambda n: f"Head & line {n} First bold text after {n}. Second para here {n}"
    pages = [(i, "https://a.example.com/x%d" % i, PAGE.format(open="<article>", close="</article>", n=i)) for i in range(5)]
    pages += [(100 + i, "https://b.example.com/x%d" % i, PAGE.format(open="<div class=post><p>Every page says so</p>", close="</div>", n=100 + i)) for i in range(6)]
    pages += [(300, None, None), (301, "https://c.example.com", ""), (302, "https://d.example.com/", "<article><p>cut off <b>here</article"), (303, "x", "plain &lt; text"), (304, "https://a.example.com/y", PAGE.format(open="<article>", close="", n=304).split("<aside>")[0])]
    rows = {r.page_id: r for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(rows) == len(pages)
    for i in range(5):
        assert rows[i].text == want(i) and rows[i].n_chars == len(want(i))
        # without a main element too, a block that every page has is template, and a fixed word in one that varies stays
        assert rows[100 + i].text == want(100 + i)
    assert (rows[300].text, rows[301].text, rows[302].text, rows[303].text, rows[304].text) == ("", "", "cut off here", "plain < text", want(304))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_template.extract(empty).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<script>for(var i=0;i<n;i++){}</script><article>kept text</article>",
        "<style><!-- a{} </style><article>kept text</article>",
        "<SCRIPT>var a='</p><!--'; if (a<b && c>d) {}</Script ><article>kept text</article>",
        '<article><p title="the hidden cost">kept</p> <p data-hidden="false" data-id="share">text</p></article>',
        "<article><p data-class='ad' title=\"class=ad id='nav'\">kept text</p><p hidden>gone</p><p class=x id=share>gone</p></article>",
    ],
)
def test_html_raw_elements_and_attributes(page):
    assert html_template.main_text(page, frozenset()) == "kept text"


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post comments-open"><p>kept text</p></article>',
        '<body><div class="content with-sidebar"><p>kept text</p></div>',
        '<article>kept <section id="notice-of-claim">text</section><div class="cookie-notice">no</div></article>',
        '<div class="header"><a href=x>Site</a></div><div id=page><h1>kept</h1><div class=body><p>text</div></div><div class="reader-comments"><p>no</p></div>',
        "<form><h1>kept</h1><p>text</p></form>",
        "<div class=sidebar-box><h1>kept</h1> text</div>",
        "<main>kept<article>text<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article></main><div>other things of no great length</div>",
        '<div class="comments"><div class="content"><h1>kept</h1><p>text</p></div><div class="comment"><p>no</p></div></div>',
    ],
)
def test_html_names_do_not_decide_alone(page):
    assert html_template.main_text(page, frozenset()) == "kept text"


def plain_article(page):
    """The article of the table's pages, by their own simple form."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    text = re.sub(r"<(script|style|form|aside)\b.*?</\1>|<!--.*?-->|</?(?:b|i|em|strong|a|span)\b[^>]*>", "", found[1] if found else "", flags=re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


def test_html_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = html_template.extract(pages).collect()
    assert len(got) == len(want) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_html_varying_classes_and_long_pages(spark):
    page = '<html><body><div class="wrap-{n}"><div id="post-{n}" class="entry"><h1>Head {n}</h1><p>Words of page {n}.</p><p>All rights stay with the site.</p></div></div><p>Call us</p><p>today</p></body></html>'
    pages = [(i, f"https://a.example.com/{i}", page.format(n=i)) for i in range(6)]
    pages.append((9, "https://b.example.com/", "<article>" + "<p>so it goes on</p>" * 50_000 + "</article>"))
    rows = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(rows[i] == f"Head {i} Words of page {i}." for i in range(6)) and len(rows[9].split()) == 200_000


def test_html_article_text_that_repeats_stays(spark):
    """A paragraph, a heading and a last line that all pages share are the article's; boxes after it that all pages have aren't."""
    page = lambda i, after="": f"<html><body><nav><a href='/'>home</a></nav><article><h1>Title {i}</h1><p>Pumps of kind {i} lift water for town {i * 7}.</p><p>All figures are in metres.</p><p>They ran for {i} days without rest in the year {i + 1900}.</p><h2>References</h2><p>See book {i} on page {i * 3}, by author {i}.</p><p>Conclusion.</p>{after}</article><footer>end</footer></body></html>"
    text = lambda i: f"Title {i} Pumps of kind {i} lift water for town {i * 7}. All figures are in metres. They ran for {i} days without rest in the year {i + 1900}. References See book {i} on page {i * 3}, by author {i}. Conclusion."
    after = lambda i: f'<div class="user-responses"><p>reader {i} says hi</p></div><div class="more-stories"><p><a href="/{i}">story {i}</a></p></div><div class="legal-hint"><p>We store things.</p></div>'
    for host, more in (("a", lambda i: ""), ("b", after)):
        rows = [(i, f"http://{host}.example/{i}", page(i, more(i)), "x", 0) for i in range(8)]
        got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()
        assert {r.page_id: r.text for r in got} == {i: text(i) for i in range(8)} and all(r.n_chars == len(r.text) for r in got)


def test_html_template_inside_main(spark):
    page = "<html><body><article><h1>Head {n}</h1><div class=box><p>The site moves on <b>Monday</b>.</p></div><p>Read <i>this</i> text {n}.</p></article></body></html>"
    pages = [(i, f"https://a.example.com/{i}", page.format(n=i)) for i in range(5)]
    pages += [(100 + i, f"https://copies.example.com/{i}", page.format(n=7)) for i in range(5)]
    rows = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert rows[i] == f"Head {i} Read this text {i}."
        # nothing varies on a host of copies, so nothing is known to be template
        assert rows[100 + i] == "Head 7 The site moves on Monday. Read this text 7."


def test_word_hashes():
    texts = [b"one two  one\n", None, b"", b" \t ", b"x" * 300_000 + b" one " + b"y" * common.AT_ONCE + b"z two", "é one".encode()]
    got = [h.tolist() for h in common.word_hashes(texts)]
    number = {}
    for t, h in zip(texts, got):
        ws = (t or b"").split()
        assert len(ws) == len(h) and all(number.setdefault(w, x) == x for w, x in zip(ws, h))
    assert len(set(number.values())) == len(number)
    (a, b) = common.word_hashes([b"Big Words", b"big words"], fold=True)
    assert (a == b).all()
    (t,) = common.word_hashes([b"well!! said\n\nso,"], common.TOKENS)
    assert len(t) == 6


def test_components(spark):
    from voltmesh.llm import components

    rng = np.random.default_rng(12)
    star = [(5000, i) for i in range(1000, 1400)]  # a centre above its nodes
    chain = [(i, i + 1) for i in range(100, 160)]
    loose = [(int(a), int(b)) for a, b in rng.integers(7000, 7200, (150, 2)) if a != b]
    pairs = star + chain + loose + [(20, 1100), (5000, 5001)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    for most in (10, 10**6):
        assert {r.node: r.component for r in components.connected_components(edges, most_edges=most).collect()} == label
    with pytest.raises(RuntimeError):
        components.connected_components(edges, most_rounds=1)


def test_piece_dropout_in_arrays():
    """Merged parts stay in arrays, with the bytes of characters outside the vocabulary, and every pair is found by its hash."""
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        p = piece_dropout.Pieces(f.read(), 0.25, 11, 4)
    parts = [" " + w for w in "international \U0001d11eok straße 12345 a".split()] + ["   x", "\n", "\x01"]
    ids, size = p.merge_all(parts, np.zeros(len(parts), np.uint64))
    assert ids.tolist() == [i for x in parts for i in p.agenda(x, 0)] and size.sum() == len(ids)
    found, there = p.place(np.concatenate([p.pair, p.pair + p.size * p.size, [-1]]))
    assert (found[: len(p.pair)] == np.arange(len(p.pair))).all() and there.sum() == len(p.pair)
