"""Decontamination, mixing, neighbours and the pipeline: small cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm.ann import nearest
from corpuskiln.llm.decontaminate import contamination, decontaminate
from corpuskiln.llm.mixing import mix, mixing_rates, solve

QUESTION = "A train leaves the old station with 40 people and then 12 km later picks up another 7 people near the river bend today"


def test_contamination_kinds(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, None), (4, QUESTION), (5, "six words make up this item")], "item_id long, text string")
    changed = QUESTION.replace("40", "55").replace("12", "13")
    mixed = QUESTION.replace("12 km later picks up another 7", "13 km later picks up another 9") + ". " + QUESTION
    rows = [
        (10, f"Before it. {QUESTION}. After it."), (11, f"intro words {changed} and more"), (12, "clean words only, nothing to see at all here now"), (13, None), (14, ""),
        (15, QUESTION.upper()), (16, "so six words make up this item indeed"), (17, mixed), (10, f"Before it. {QUESTION}. After it."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in contamination(docs, items).collect()}
    assert set(got) == {(10, 1), (11, 1), (15, 1), (16, 5), (17, 1)}, "17 holds the question word for word beside a variant"
    assert got[10, 1].kind == got[15, 1].kind == "exact" and got[10, 1].item_ids == [1, 4]
    assert got[11, 1].kind == "reparameterised" and got[11, 1].changed_slots == 2
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [12, 13, 14]
    # Without a broadcast the same rows come from the shuffled join.
    assert {(r.doc_id, r.item_id) for r in contamination(docs, items, most_broadcast=0).collect()} == set(got)
    assert contamination(docs, items.limit(0)).count() == 0
    assert contamination(docs.limit(0), items).count() == 0


def test_solve():
    assert solve([[4.0, 1.0], [1.0, 3.0]], [1.0, 2.0]) == pytest.approx([1 / 11, 7 / 11])
    assert solve([[2.0, 2.0], [2.0, 2.0]], [4.0, 4.0])[0] == pytest.approx(2.0)


def test_rates_meet_targets_and_stay_nonnegative(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(r.integers(0, 500)), [float(x) for x in r.dirichlet([0.3, 0.3, 0.3])]) for i in range(300)]
    rows += [(900, 0, [0.2, 0.3, 0.5])]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    got = mixing_rates(members, [0.8, 0.15, 0.05]).collect()
    total = sum(x.n_tokens for x in got)
    sums = np.array([x.rate * x.n_tokens * np.array(x.p) for x in got]).sum(axis=0) / total
    assert min(x.rate for x in got) >= 0
    assert sums == pytest.approx([0.8, 0.15, 0.05], abs=1e-4)
    assert all(x.converged for x in got) and got[0].reached == pytest.approx([0.8, 0.15, 0.05], abs=1e-4)
    assert mixing_rates(members.limit(0), [0.5, 0.25, 0.25]).count() == 0


@pytest.mark.parametrize("targets", [[0.95, 0.04, 0.01], [0.0, 0.02, 0.98], [0.34, 0.33, 0.33]])
def test_rates_are_the_least_squares_of_a_plain_solver(spark, targets):
    r = np.random.default_rng(4)
    n, p = r.integers(1, 400, 120).astype(float), r.dirichlet([6.0, 1.0, 0.5], 120) * 0.9 + 0.1 / 3
    got = mixing_rates(spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>"), targets, steps=60)
    rows = got.collect()
    a, goal = (n[:, None] * p).T, np.array(targets) * n.sum()
    loss = float(((sum(x.rate * x.n_tokens * np.array(x.p) for x in rows) - goal) ** 2).sum()) / n.sum() ** 2
    # The cone of the documents: a plain non-negative solver, coordinate by coordinate.
    rate, miss = np.ones(120), a @ np.ones(120) - goal
    for _ in range(3000):
        for i in range(120):
            new = max(0.0, rate[i] - a[:, i] @ miss / (a[:, i] @ a[:, i]))
            miss += a[:, i] * (new - rate[i])
            rate[i] = new
    assert min(x.rate for x in rows) >= 0
    assert loss <= float((miss**2).sum()) / n.sum() ** 2 + 5e-4, (loss, rows[0].converged)


def test_mix_of_odd_rows(spark):
    rows = [(1, "good words here"), (2, "vile trash"), (3, None), (4, ""), (1, "good words here"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rate": F.lit("old"), "bag": F.lit(1), "words": F.lit(2)})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = mix(docs, labels).collect()
    assert len(got) == 6 and all(r.rate >= 0 and (r.bag, r.words) == (1, 2) for r in got)
    assert all(abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)
    assert len({r.rate for r in got if r.doc_id == 1}) == 1
    assert mix(docs, labels.limit(0)).count() == 6


def test_nearest_is_exact_on_few_vectors_and_leaves_odd_ones_out(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[8] = x[9]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)]
    rows += [(100, None), (120, []), (140, [0.0] * 8), (160, [float("nan")] + [1.0] * 7), (180, [None] + [1.0] * 7), (200, [1.0] * 3), (None, [1.0] * 8), (20, rows[20][1])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20).collect()
    y = x.astype(float)
    assert {g.query_id for g in got} == {0, 20, 40}
    for q in (0, 20, 40):
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(60), -s))[:20]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.vec_id for g in mine] == list(order)
        assert [g.score for g in mine] == [s[o] for o in order]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("options", [{"rows_in_part": 80}, {"rows_in_part": 80, "rows_in_block": 50, "queries_in_block": 7}])
def test_nearest_recall(spark, options):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = nearest(vectors, **options).collect()
    assert len({(g.query_id, g.vec_id) for g in got}) == len(got) == 20 * len({g.query_id for g in got})
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]])
        hits.append(len(best & {g.vec_id for g in got if g.query_id == ids[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert sizes[-1] == sizes[-2]


def test_reachable_targets_are_reached(spark):
    """Sharp posteriors: the default rounds end within 1e-7 of the targets, and no rates that meet them are nearer to 1."""
    r = np.random.default_rng(7)
    n, logits = r.integers(1, 4000, 2000).astype(float), r.normal(size=(2000, 3)) * 4 + np.array([6.0, 1.0, -1.0])
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    targets = np.array([0.95, 0.04, 0.01])
    got = mixing_rates(spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "i int, n_tokens long, p array<double>"), list(targets)).collect()
    rate = np.array([x.rate for x in sorted(got, key=lambda x: x.i)])
    assert got[0].converged and (rate * n) @ p / n.sum() == pytest.approx(targets, abs=1e-7)
    # The nearest point: what is over 0 is 1 plus a combination of p, what is 0 would be under it.
    z = np.linalg.lstsq(p[rate > 0], rate[rate > 0] - 1, rcond=None)[0]
    assert np.maximum(0, 1 + p @ z) == pytest.approx(rate, abs=1e-6)
