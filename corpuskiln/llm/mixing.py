"""Soft-membership mixing to target weights, all in built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, own_name, without, written

#: The share of all tokens that each domain shall have.
TARGETS = {"good": 0.95, "low": 0.04, "toxic": 0.01}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) | (toxic == 0), "good")


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; null is no word."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def buckets_of(words: Column, buckets: int) -> Column:
    """Distinct hash buckets of words; the last one says that there is no word."""
    return F.array_distinct(F.when(F.size(words) == 0, F.array(F.lit(buckets))).otherwise(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))))


def with_hits(docs: DataFrame, bag: str, slots: DataFrame, hits: str) -> DataFrame:
    """docs plus hits, the weights of those buckets of bag that have some. slots is one row with an array, null or a struct of weights
    for each bucket. It is a subquery: as constants its numbers would stand in the text of every plan, many times, and the driver keeps those."""
    every = own_name()
    return docs.withColumn(every, slots.scalar()).withColumn(hits, F.filter(F.transform(bag, lambda b: F.get(F.col(every), b)), lambda w: w.isNotNull())).drop(every)


def sum_of_hits(hits: str, name: str) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda total, w: total + w[name])


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], most_labelled: int = 20_000, buckets: int = 1 << 16, least_chi2: float = 15.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_tokens and p, array<double> of posteriors in the order of `domains`.

    labels is (doc_id, domain); a document with several domains takes the least name, null ids or
    domains are left out. The classifier is fitted on at most about most_labelled labelled
    documents, chosen by a hash of the id: for every domain, hash buckets of words that go
    with it (chi-square over least_chi2) add their log ratio to the log odds that documents without
    any such bucket have. Without labels all domains are equally likely.
    """
    known = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, most_labelled / max(total, 1)))
    # About most_labelled ids: a proven bound for the broadcast.
    chosen = F.broadcast(chosen.toDF("label_id", "label_domain"))
    bags = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, F.col("doc_id") == F.col("label_id"))
    bags = written(bags.select("label_domain", buckets_of(words_of(F.col("text")), buckets).alias("bag")), "bags")
    sizes = {r["label_domain"]: r["n"] for r in bags.groupBy("label_domain").agg(F.count("*").alias("n")).collect()}
    n_all = sum(sizes.values())
    counts = bags.select("label_domain", F.explode("bag").alias("b")).groupBy("b").agg(*[F.count_if(F.col("label_domain") == d).alias(f"n_{k}") for k, d in enumerate(domains)], F.count("*").alias("n"))
    weights = []
    for k, d in enumerate(domains):
        n_d, rest = sizes.get(d, 0), n_all - sizes.get(d, 0)
        a, b = F.col(f"n_{k}").cast("double"), (F.col("n") - F.col(f"n_{k}")).cast("double")
        chi2 = F.pow(a * (rest - b) - b * (n_d - a), 2) * n_all / ((a + b) * (n_all - a - b + 1e-9) * max(n_d, 1) * max(rest, 1))
        weights.append(F.when(chi2 >= least_chi2, F.ln((a + 0.5) / (n_d + 1)) - F.ln((b + 0.5) / (rest + 1))).otherwise(0.0).alias(f"w_{k}"))
    any_weight = " OR ".join(f"w_{k} <> 0" for k in range(len(domains)))
    rows = counts.select("b", *weights).where(any_weight).collect() if n_all else []  # at most `buckets` + 1 rows
    names = [f"w_{k}" for k in range(len(domains))]
    by_bucket = {r["b"]: tuple(r[x] for x in names) for r in rows}
    kind = f"slots array<struct<{', '.join(f'{x} double' for x in names)}>>"
    slots = written(docs.sparkSession.createDataFrame([([by_bucket.get(b) for b in range(buckets + 1)],)], kind), "weights")
    evidence = lambda hits: [sum_of_hits(hits, x) for x in names]
    quiet = with_hits(bags, "bag", slots, "hits").select("label_domain", *[(e == 0).alias(f"q_{k}") for k, e in enumerate(evidence("hits"))])
    seen = quiet.agg(*[x for k, d in enumerate(domains) for x in (F.count_if(f"q_{k}").alias(f"n_{k}"), F.count_if(F.col(f"q_{k}") & (F.col("label_domain") == d)).alias(f"d_{k}"))]).first()
    odds = [(seen[f"d_{k}"] + 0.5) / (seen[f"n_{k}"] - seen[f"d_{k}"] + 0.5) for k in range(len(domains))]
    base = without(docs, "n_tokens", "p")
    words, bag, hits = own_name(), own_name(), own_name()
    bagged = base.withColumn(words, words_of(F.col(text_col))).withColumns({"n_tokens": F.size(words).cast("long"), bag: buckets_of(F.col(words), buckets)})
    chance = [F.lit(1.0) / (1.0 + F.exp(-(F.ln(F.lit(o)) + F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e))))) for o, e in zip(odds, evidence(hits))]
    scored = with_hits(bagged, bag, slots, hits).withColumn("p", F.array(*chance)).drop(words, bag, hits)
    return scored.withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda acc, y: acc + y)))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x with matrix x = right, by elimination; directions without weight get 0."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    done = []
    for c in range(n):
        pivot = max((i for i in range(n) if i not in done), key=lambda i: abs(rows[i][c]))
        if abs(rows[pivot][c]) <= 1e-9 * max(1e-30, abs(matrix[c][c])):
            continue
        done.append(pivot)
        for i in range(n):
            if i != pivot:
                f = rows[i][c] / rows[pivot][c]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[pivot])]
    out = [0.0] * n
    for i in done:
        c = max(range(n), key=lambda c: abs(rows[i][c]))
        out[c] = rows[i][n] / rows[i][c]
    return out


def rate_at(z: list[float]) -> Column:
    """The rate of a document after all steps so far, z: their sum is projected once, from 1 to at least 0."""
    return F.greatest(F.lit(0.0), sum((F.get("p", F.lit(k)) * F.lit(float(x)) for k, x in enumerate(z)), F.lit(1.0)))


def mixing_rates(members: DataFrame, targets: list[float], steps: int = 60, close: float = 1e-9) -> DataFrame:
    """members, with n_tokens and p, plus rate >= 0: how often to take each document, reached: the shares
    that the rates lead to, and converged.

    targets are shares of all tokens for the domains in p's order. The gradient of the squared misses with respect to a document's rate is a
    combination of its p, so all steps add up to one vector z, a number for each domain, and the rate is 1 + p z, projected to at least 0 (lazy
    projection). A step is the gradient scaled by the Gram matrix of the documents with a rate over 0; of some lengths the one is taken that
    lowers most the convex function whose gradient these misses are: of all rates that meet the targets, the ones nearest to 1 result. A small ridge on z, lowered
    in stages to 1e-10 of the curvature, gives the least-squares approach where no rates meet them; there it stays at 1e-6, so that rates stay moderate.
    A round is one small distributed sum; what the driver keeps is z. It has converged when all misses are under `close` of the tokens, or the gradient with the last
    ridge is, or no length lowers the function any more; reached tells how far the targets are.
    Documents without tokens keep the rate that their posteriors say. No tokens: all rates are 1 and reached is null.
    """
    members = written(members, "members")
    k_all = range(len(targets))
    p = [F.get("p", F.lit(k)) for k in k_all]
    t = F.col("n_tokens").cast("double")

    def sums(tried: list[list[float]]) -> list[dict]:
        """For each z: half the squared rates' sum, expected tokens of the domains, and the Gram matrix of what has a rate over 0."""
        named = members.select("n_tokens", "p", *[rate_at(z).alias(f"r{c}") for c, z in enumerate(tried)])
        aggs = []
        for c in range(len(tried)):
            rate = F.col(f"r{c}")
            aggs += [F.sum(rate * rate * t / 2).alias(f"h{c}"), *[F.sum(rate * t * p[k]).alias(f"e{c}_{k}") for k in k_all]]
            aggs += [F.sum(F.when(rate > 0, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{c}_{i}_{j}") for i in k_all for j in k_all if i <= j]
        got = named.agg(*aggs).first()
        return [
            {"z": z, "half": got[f"h{c}"], "e": [got[f"e{c}_{k}"] for k in k_all], "gram": [[got[f"g{c}_{min(i, j)}_{max(i, j)}"] for j in k_all] for i in k_all]}
            for c, z in enumerate(tried)
        ]

    total = members.agg(F.sum(t).alias("n")).first()["n"] or 0.0
    here, converged = None, not total
    if total:
        goal = [x * total for x in targets]
        here = sums([[0.0] * len(targets)])[0]
        trace = sum(here["gram"][k][k] for k in k_all)
        ridge, last = 1e-3, 1e-10
        value = lambda x: x["half"] - sum(b * z for b, z in zip(goal, x["z"])) + ridge * trace * sum(z * z for z in x["z"]) / 2
        for _ in range(steps):
            miss = max(abs(e - b) for e, b in zip(here["e"], goal))
            if miss <= close * total:
                converged = True
                break
            slope = lambda: [e - b + ridge * trace * z for e, b, z in zip(here["e"], goal, here["z"])]  # noqa: E731, B023
            if max(map(abs, slope())) <= close * total / 10:
                if ridge <= last or ridge <= 1e-6 and miss > 1e-3 * total:
                    converged = True
                    break
                ridge = max(last, ridge / 100)
            damped = lambda d: [[g + (d * trace if i == j else 0.0) for j, g in enumerate(row)] for i, row in enumerate(here["gram"])]  # noqa: E731, B023
            straight, careful = (solve(damped(ridge + d), slope()) for d in (0.0, 1e-3))
            moved = lambda step, a: [z - a * x for z, x in zip(here["z"], step)]  # noqa: E731, B023
            found = sums([moved(straight, a) for a in (1.0, 0.5, 0.2, 0.05)] + [moved(careful, 1.0), moved(straight, 4.0)])
            best = min(found, key=value)
            if value(best) < value(here):
                here = best
            elif ridge <= last or ridge <= 1e-6 and miss > 1e-3 * total:
                converged = True  # as low as numbers tell
                break
            else:
                ridge = max(last, ridge / 100)
    reached = F.array(*[F.lit(x / sum(here["e"])) for x in here["e"]]) if here and sum(here["e"]) else F.lit(None).cast("array<double>")
    rate = rate_at(here["z"]) if here else F.lit(1.0)
    return without(members, "rate", "reached", "converged").withColumns({"rate": rate, "reached": reached, "converged": F.lit(converged)})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """docs plus n_tokens, one posterior p_<domain> for each target, rate, one share reached_<domain> that
    the rates lead to, and converged; labels is (doc_id, quality, toxic).

    Null or empty texts have no tokens; repeated rows are documents of their own with equal rates.
    Columns of those names are replaced.
    """
    goal = dict(sorted((targets or TARGETS).items()))
    whole = sum(goal.values())
    named = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    members = posteriors(without(docs, "rate", "converged", "reached", *[f"{x}_{d}" for d in goal for x in ("p", "reached")]), named, list(goal), **options)
    rates = mixing_rates(members, [x / whole for x in goal.values()])
    each = {f"{x}_{d}": F.get(c, F.lit(k)) for c, x in (("p", "p"), ("reached", "reached")) for k, d in enumerate(goal)}
    return rates.withColumns(each).drop("p", "reached")
