"""The pipeline's stages, one after another, each against a plain version on its own input."""

import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from voltmesh.llm import piece_dropout, pii, quality_classifier, queries
from voltmesh.llm.common import TOKENS, table, word_hashes

from .test_text_operators import plain_links, plain_targets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").withColumn("extra", F.lit(1))
    good = base.where("n_chars > 600").orderBy("doc_id").first()
    odd = [(None, good.text + " mail bob@ex.org", "en", None, 1, 1), (None, None, None, None, None, None), (9001, "", "en", "s", 0, 1), (9002, good.text, "en", "s", 1, 1), (9002, good.text, "en", "s", 1, 1), (9003, good.text + " one more word", "en", "s", 1, 1)]
    docs = base.select("doc_id", "text", "lang", "source", "n_chars", "extra").unionByName(spark.createDataFrame(odd, SCHEMA))
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    now, rows = table(spark, sf, "documents"), {}
    for name, stage in P.STAGES:
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        before, now = now, spark.read.parquet(f"{sf}/{name}")
        rows[name] = (before.collect(), now.collect())
        assert now.columns[: len(P.COLUMNS)] == list(P.COLUMNS) or name == P.STAGES[-1][0]

    came, kept = rows["quality classifier"]
    model = quality_classifier.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = []
    for r, h in zip(came, word_hashes([None if r.text is None else r.text.encode() for r in came], TOKENS, fold=True)):
        share = Counter((h >> np.uint64(64 - model["bits"])).tolist())
        z = sum(float(model["w"][f]) * (n / len(h)) ** 0.5 for f, n in share.items())
        same = sum(1 for a, b in zip(h, h[1:]) if a == b)
        key = int(quality_classifier._SAME) >> (64 - model["bits"])
        if same and model["w"][key]:
            z += float(model["w"][key]) * (((share[key] + same) / len(h)) ** 0.5 - (share[key] / len(h)) ** 0.5)
        if words(r.text) and 1 - 1 / (1 + np.exp(z - model["thresholds"][1])) >= 0.5:
            want.append((r.doc_id or -1, r.text))
    assert sorted(want) == sorted((r.doc_id or -1, r.text) for r in kept) and 0 < len(kept) < len(came)

    came, kept = rows["n-gram join"]
    texts = [r.text for r in came]
    label = list(range(len(texts)))
    links = plain_links(texts)
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    name = lambda i: (came[i].doc_id is None, came[i].doc_id or 0)
    classes = {}
    for i, k in enumerate(label):
        classes.setdefault(k, []).append(i)
    assert sorted(name(min(m, key=name)) for m in classes.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)

    came, kept = rows["pii"]
    terms = {r.term: r.action for r in pii.disclosing_terms(spark.read.parquet(f"{sf}/n-gram join")).collect()}
    assert sorted((r.doc_id or -1, pii.replaced(r.text, pii.spans_of(r.text, terms))) for r in came) == sorted((r.doc_id or -1, r.text) for r in kept)
    assert all(len(r.text) == r.n_chars for r in kept)

    came, kept = rows["mixing"]
    sizes = Counter()
    for r in came:
        sizes[r.source] += len(words(r.text))
    copies = Counter((r.doc_id, r.text) for r in kept)
    assert set(copies) <= {(r.doc_id, r.text) for r in came} and max(copies.values()) <= 3 and {r.copy for r in kept} <= {0, 1, 2}
    for source, size, target in plain_targets(list(sizes.items())):
        taken = sum(len(words(r.text)) for r in kept if r.source == source)
        assert abs(taken - target) <= max(len(words(r.text)) for r in came if r.source == source)

    came, kept = rows["piece dropout"]
    back = piece_dropout.decode(spark.read.parquet(f"{sf}/piece dropout"), queries.vocabulary("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((r.doc_id, r.text) for r in came)
    done = P.run(spark, sf)
    assert Counter((r.doc_id, tuple(r.ids)) for r in done.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in kept)


def test_empty_table(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() == 0
