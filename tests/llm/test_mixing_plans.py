"""What mixing leaves in the driver: the classifier's weights are no constants of a plan."""

import math
import random

from corpuskiln.llm.mixing import posteriors


def test_plans_do_not_hold_the_weights(spark):
    """Word bags small enough to work out: the same posteriors, and a plan whose text doesn't grow with the buckets."""
    r = random.Random(5)
    words = {"good": ["fine", "well"], "low": ["dull", "thin"], "toxic": ["vile", "mean"]}
    rows = [(i, d, " ".join(r.sample(words[d] + ["the", "a", "of"], 4))) for i in range(150) for d in [r.choice(list(words))]]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(900, None), (901, "unseen words"), (902, "Vile fine vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, d, _ in rows], "doc_id long, domain string")
    found = posteriors(docs, labels, ["good", "low", "toxic"], buckets=1 << 16)
    got = {x.doc_id: (x.n_tokens, x.p) for x in found.collect()}

    bags = [(d, set(t.split())) for _, d, t in rows]
    weight = {}
    for d in words:
        n_d, rest = sum(e == d for e, _ in bags), sum(e != d for e, _ in bags)
        for w in set().union(*[b for _, b in bags]):
            a, b = sum(w in bag for e, bag in bags if e == d), sum(w in bag for e, bag in bags if e != d)
            chi2 = (a * (rest - b) - b * (n_d - a)) ** 2 * len(bags) / ((a + b) * (len(bags) - a - b + 1e-9) * n_d * rest)
            weight[d, w] = math.log((a + 0.5) / (n_d + 1)) - math.log((b + 0.5) / (rest + 1)) if chi2 >= 15 else 0.0
    odds = {}
    for d in words:
        quiet = [e for e, bag in bags if sum(weight[d, w] for w in bag) == 0]
        odds[d] = (quiet.count(d) + 0.5) / (len(quiet) - quiet.count(d) + 0.5)
    for i, t in [*[(i, t) for i, _, t in rows], (900, ""), (901, "unseen words"), (902, "vile fine vile")]:
        p = [1 / (1 + math.exp(-math.log(odds[d]) - max(-30.0, min(30.0, sum(weight.get((d, w), 0.0) for w in set(t.split())))))) for d in words]
        assert got[i][0] == len(t.split())
        assert all(abs(x - y / sum(p)) < 1e-9 for x, y in zip(got[i][1], p))
    assert len(found._jdf.queryExecution().toString()) < 40_000
