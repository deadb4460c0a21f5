"""The neighbour search of toxicity against brute force, ties included, and its odd inputs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import toxicity
from corpuskiln.llm.toxicity import LAST, Index


def index_of(bags, ids, size=4, terms=6):
    n = len(bags)
    made = Index({f"t{i}": i for i in range(terms)}, np.linspace(1.0, 2.0, terms), np.array(ids, np.int64), np.zeros(n), np.ones(n), size, 0.1)
    flat = [(t, c) for b in bags for t, c in b.items()]
    made.fill(np.cumsum([0, *map(len, bags)]), np.array([t for t, _ in flat], np.int64), np.array([c for _, c in flat], float))
    return made


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("terms, most", [(6, 3), (60, 25)])
def test_nearest_equals_brute_force_with_many_ties(seed, terms, most):
    rng = np.random.default_rng(seed)
    bag = lambda: {int(t): int(rng.integers(1, 3)) for t in rng.choice(terms, rng.integers(1, most), replace=False)}
    bags, queries = [bag() for _ in range(150)], [bag() for _ in range(40)]
    made = index_of(bags, rng.permutation(1000)[:150] - 500, terms=terms)
    own = [made.row(i) for i in range(150)]
    q, x, k = made.dense([made.vector(b) for b in queries]), made.dense(own), 5
    for spare in (0.0, 0.03, 0.5):
        got = [made.one(*made.vector(b), k, spare=spare) for b in queries]
        assert all((a == b).all() for a, b in zip(got, (made.one(*made.vector(b), k) for b in queries)))
    rows, cosine = made.nearest([made.vector(b) for b in queries], k)
    exact = np.round(q @ x.T, 12)
    for i in range(len(queries)):
        order = [j for j in np.lexsort((made.ids, -exact[i]))[:k] if exact[i, j] > 0]
        assert [r for r in rows[i] if r >= 0] == order
        assert np.allclose(cosine[i, : len(order)], exact[i, order], atol=1e-9)
    alone, _ = made.nearest(own, k, skip=np.arange(150))
    assert not (alone == np.arange(150)[:, None]).any()


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_single_lookups(seed):
    rng = np.random.default_rng(seed)
    bag = lambda: {int(t): int(rng.integers(1, 4)) for t in np.unique(rng.zipf(1.3, 40) % 300)}
    bags = [bag() for _ in range(500)]
    bags += bags[:200] + [{}]  # ties
    made = index_of(bags, rng.permutation(2000)[: len(bags)], size=2, terms=300)
    queries = [bag() for _ in range(150)] + bags[:20]
    vectors = [made.vector(b) for b in queries]
    skip = [-1] * 150 + list(range(20))
    made.ready()
    for thin in (1, 5, 10_000):  # no term as a matrix row, some, all
        made.lay_out(np.repeat(np.arange(len(bags)), np.diff(made.at)), thin=thin)
        assert (made.many(vectors, 15, skip) == [made.one(*v, 15, s) for v, s in zip(vectors, skip)]).all()


def test_no_rows_and_no_common_term():
    none = index_of([], [])
    assert (none.nearest([none.vector({0: 1}), none.vector({})], 3)[0] == -1).all()
    one = index_of([{0: 1}, {}], [7, 8])
    assert one.nearest([one.vector({1: 1})], 3)[0].tolist() == [[-1, -1, -1]]


def test_too_many_rows():
    with pytest.raises(ValueError):
        Index({}, np.zeros(0), np.zeros(LAST + 1), np.zeros(1), np.zeros(1), 4, 0.1).fill(np.zeros(LAST + 2, np.int64), np.zeros(0, np.int64), np.zeros(0))


def test_vectors_are_tf_idf_of_every_term(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = toxicity.sample_labelled(docs, labels, 10_000).collect()
    index = toxicity.learn(docs, spark.createDataFrame(rows))
    bag = lambda t: Counter(w for w in map(toxicity.term, (t or "").split()) if w)
    df = Counter(w for d in docs.collect() for w in bag(d.text))
    n, n1, total = len(rows), sum(r.toxic for r in rows), docs.count()
    bags = {r.doc_id: bag(r.text) for r in rows}
    held, toxic = Counter(w for b in bags.values() for w in b), Counter(w for r in rows if r.toxic for w in bags[r.doc_id])
    assert set(index.terms) == set(held), "no term is left out"

    def weight(w):
        a, m = toxic[w], held[w]
        b = m - a
        phi2 = (a * (n - n1 - b) - b * (n1 - a)) ** 2 / (m * (n - m) * n1 * (n - n1)) if m < n else 0.0
        return (math.log((total + 1) / (df[w] + 1)) + 1) * phi2

    def unit(b):
        x = {w: (1 + math.log(c)) * weight(w) for w, c in b.items()}
        size = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {w: v / size for w, v in x.items()}

    own = {i: unit(b) for i, b in bags.items()}
    for r in toxicity.assess(spark.createDataFrame(rows[:20]).select("doc_id", "text"), index).collect():
        q = own[r.doc_id]
        best = sorted(((-round(sum(v * x.get(w, 0.0) for w, v in q.items()), 9), i) for i, x in own.items()))[:3]
        assert [round(e.cosine, 9) for e in r.evidence] == [pytest.approx(-s, abs=2e-9) for s, _ in best]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for given in (labels, labels.union(spark.createDataFrame([(1, None)], labels.schema)), labels.union(spark.createDataFrame([(1, 1)], labels.schema))):
        index = toxicity.learn(docs, toxicity.sample_labelled(docs, given, 10))
        got = toxicity.assess(docs.withColumn("Score", F.lit("x")), index).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.assess(docs.limit(0), index).count() == 0


def test_an_index_survives_its_broadcast():
    import pickle

    made = index_of([{0: 1, 3: 2}, {1: 1}, {}, {0: 2, 1: 1, 5: 4}], [4, 3, 2, 1])
    back = pickle.loads(pickle.dumps(made))
    assert back.terms == made.terms and len(pickle.dumps(made)) < 5000
    assert all((made.one(*made.vector(b), 3) == back.one(*back.vector(b), 3)).all() for b in ({0: 1}, {1: 2, 5: 1}, {}))


def test_terms_are_counted_as_by_python():
    """Any white space, punctuation, letter case, nulls and empty texts; terms in the order of a text's tokens. Whole columns are counted, with no loop over the texts."""
    r = np.random.default_rng(8)
    words = ["Ab", "ab,", "(cd)", "CD", "ef", "\u0130x", "\u03a3", "...", "gh\u00e9", "zz", ""]
    spaces = [" ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "  "]
    texts = [None, "", " ", *("".join(str(r.choice(words)) + str(r.choice(spaces)) for _ in range(n)) for n in r.integers(1, 60, 200))]
    terms = {w: k for k, w in enumerate(["ab", "cd", "ef", "\u0130x".lower(), "\u03c3", "gh\u00e9"])}
    look = toxicity.Terms(terms, most=5)
    for _ in range(2):
        at, found, times = look(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            own: dict = {}
            for token in (text or "").split():
                k = terms.get(toxicity.term(token))
                if k is not None:
                    own[k] = own.get(k, 0) + 1
            assert list(zip(found[at[i] : at[i + 1]].tolist(), times[at[i] : at[i + 1]].tolist())) == list(own.items())
    assert [len(x) for x in look(pa.array([], pa.string()))] == [1, 0, 0]
