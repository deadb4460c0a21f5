"""Language ID, toxicity, language model, extraction: held-out accuracy, exact sums, and odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import html_blocks, html_extract, language_id, maxent_lm, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_texts(spark, docs):
    model = language_id.learn(docs.where("doc_id % 5 <> 0").select("doc_id", "text", "lang"))
    held = docs.where("doc_id % 5 = 0").select("doc_id", "text", F.col("lang").alias("truth"), F.lit("x").alias("score"))
    rows = language_id.identify(held, model).collect()
    assert np.mean([r.lang_pred == r.truth for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, docs):
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 *** 45"), (4, "the and of in that"), (4, "the and of in that"), (5, "漢字仮名" * 50)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert rows[1].score == 0 and rows[1].rejected and rows[5].rejected
    assert rows[4].lang_pred == "en"
    assert language_id.learn(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    model = language_id.train({"a": {"abc": 3, "abd": 1, "b": 2}}, order=3)
    chars = "abcd"
    probability = lambda word: math.exp(model.log_probability([word])[0][0, 0])
    # After "a": what unseen characters get in all, each the same share of the floor, makes up the rest.
    total = sum(_chain(model, "a", c) for c in [*chars, ""])
    unseen = _chain(model, "a", "z") / model.floor * (1 - 5 * model.floor)
    assert total + unseen == pytest.approx(1.0, abs=1e-5)
    assert probability("abc") > probability("cba")


def _chain(model, prefix: str, nxt: str) -> float:
    """P(nxt | prefix) by the difference of two words' probabilities."""
    codes, word = language_id.gram_codes([prefix + nxt], model.order)
    before = language_id.context_codes([prefix + nxt], model.order)
    i = len(prefix)
    p = model.floor
    for n in range(model.order):
        weight = model.contexts[0][1][0, 0] if n == 0 else model.look(model.contexts[n], before[n - 1], 1.0)[i, 0]
        p = model.look(model.grams[n], codes[n], 0.0)[i, 0] + weight * p
    return float(p)


def test_toxicity_votes_and_evidence(spark):
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = [r.choice(words) for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            text[3], text[20] = r.choice(["Scum!", "trash"]), "vile"
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id % 4 <> 2").select("doc_id", "toxic")
    index = toxicity.learn(docs, toxicity.sample_labelled(docs, labels, 1000))
    got = {x.doc_id: x for x in toxicity.assess(docs.drop("toxic").withColumn("evidence", F.lit(0)), index).collect()}
    held = [(got[i].predicted, t) for i, _, t in rows if i % 4 == 2]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    assert got[0].evidence and all(e.toxic in (0, 1) for e in got[0].evidence)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "vile " * 3000)], "doc_id long, text string")
    assert [x.predicted for x in toxicity.assess(odd, index).orderBy("doc_id").collect()] == [0, 0, 0, 1]


def test_language_model_base_is_exact_and_model_is_better(spark, docs):
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "unseenword " * 5), (900003, "unseenword " * 5)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra).withColumn("held_out", F.col("doc_id") % 5 == 1).withColumn("row", F.lit(1))
    got = maxent_lm.score_texts(rows).collect()
    counts, words = collections.Counter(), collections.defaultdict(list)
    for r in rows.collect():
        w = [*(r.text or "").encode().lower().split(), b"\n"]
        words[r.doc_id].append(w)
        if not r.held_out:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == rows.count()
    for r in got:
        w = words[r.doc_id][0]
        assert r.n_tokens == len(w) and r.n_known == sum(x in counts for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = [r for r in got if r.held_out and r.doc_id < 900000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_softmax_factors_sum_to_one():
    r = np.random.default_rng(0)
    w = maxent_lm.Weights(*(r.normal(size=getattr(maxent_lm.Weights.zero(), n).shape).astype(np.float32) for n in maxent_lm.Weights.TABLES))
    total = maxent_lm.FREQUENT + maxent_lm.SPELLINGS
    types = np.arange(total)
    f = (np.full(total, 5), np.full(total, 9), np.full(total, 300), np.full(total, 77))
    assert (10 ** maxent_lm.log_probability(w, f, types)).sum() == pytest.approx(1.0, abs=1e-4)


def test_extraction_of_generated_and_broken_pages(spark, html_model):
    model = html_model
    encoder = html_extract.Encoder()
    pages = [p for p in html_blocks.marked_pages(120, seed=77) if p]
    right = [(model.run(html_extract.collate([[b for b, _ in p]], encoder)) > 0) == np.array([y for _, y in p]) for p in pages]
    assert np.concatenate(right).mean() > 0.97
    page = "<html><body><nav><ul><li><a href=/>home</a></li></ul></nav><article><h1>A &amp; B</h1><p>one  two\n three<p>four &eacute;</article><footer>x</footer>"
    odd = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<script>x"), (6, page), (7, "<!-- " + "a" * 10000)]
    rows = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(odd, "page_id long, html string").withColumn("text", F.lit(3)), model).collect()}
    assert rows[1].text == rows[6].text == "A & B\none two three\nfour é"
    assert rows[1].n_chars == len(rows[1].text)
    assert [rows[i].text for i in (2, 3, 5, 7)] == [""] * 4


def test_gradient_of_the_labeller():
    model, encoder = html_extract.Labeller(4, 3), html_extract.Encoder()
    pages = [p for p in html_blocks.marked_pages(3, seed=1) if p]
    batch, label = html_extract.collate([[b for b, _ in p] for p in pages], encoder), np.array([y for p in pages for _, y in p], float)
    _, g = model.gradient(batch, label)
    for name in ("fx", "bh", "out", "word", "path", "fb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = model.p[name][at]
        losses = []
        for d in (1e-5, -1e-5):
            model.p[name][at] = old + d
            losses.append(model.gradient(batch, label)[0])
        model.p[name][at] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7)


def test_folds_are_crc32(spark):
    from corpuskiln.llm.common import fold

    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
