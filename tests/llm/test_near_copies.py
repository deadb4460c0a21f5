"""The near-dedup stage against brute-force Jaccard of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from corpuskiln.llm import near_copies as nc
from corpuskiln.llm.near_copies import keep_one_similar

WIDE = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows: list[tuple[int, str | None]]) -> list[int]:
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            union = sets[a] | sets[b]
            if a < b and (not union or len(sets[a] & sets[b]) / len(union) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def edited(r: random.Random, seed_words: list[str], edits: int) -> str:
    words = list(seed_words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def test_stage_is_brute_force(spark):
    r = random.Random(3)
    rows, common = [], [f"c{i}" for i in range(30)]
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([4, 8, 60, 150, 300]))] + (common if r.random() < 0.5 else [])
        rows += [(len(rows) + k, edited(r, base, r.randint(0, len(base) // 20))) for k in range(6)]
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE "), (904, "one two three four five"), (905, "One two three four  five")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], WIDE)
    want = brute_kept(rows)
    assert 25 < len(want) < len(rows)
    assert sorted(d.doc_id for d in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert keep_one_similar(docs.limit(0)).count() == 0


def test_stage_on_documents_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    assert sorted(d.doc_id for d in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows)


def test_sketches_never_differ_in_more_than_the_sets():
    r = np.random.default_rng(8)
    for size in (0, 1, 31, 33, 64, 500, 3000):
        for other in (size, size + 1, size * 5 // 4, size * 9):
            for shared in (0, size // 2, size * 9 // 10, size):
                pool = np.unique(r.integers(0, 2**64, 2 * size + 2 * other + 8, np.uint64))
                r.shuffle(pool)
                a, b = pool[:size], np.concatenate([pool[:shared], pool[size : size + other - min(shared, other)]])
                apart = len(np.setxor1d(a, b))
                for x, y in ((a, b), (b, a)):
                    assert nc.sketch_distance(nc.parity_sketch(x), nc.parity_sketch(y)) <= apart
    a, b = np.split(np.unique(r.integers(0, 2**64, 1000, np.uint64)), 2)
    assert nc.sketch_distance(nc.parity_sketch(a), nc.parity_sketch(b)) > len(a) * 2 / 9


def test_whole_sets_are_dealt_out_for_likely_pairs_only(spark, monkeypatch):
    """Texts that share rare shingles, but only three fifths of all, are tried without their whole sets."""
    r = random.Random(11)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [(len(rows) + k, " ".join(base[:300] + [f"x{r.randrange(10**6)}" for _ in range(100)])) for k in range(5)]
    rows += [(900, rows[0][1] + " end"), (901, rows[7][1] + " end")]
    asked = []
    whole = nc.whole_sets
    monkeypatch.setattr(nc, "whole_sets", lambda docs, every, some, *a: asked.append(some.count()) or whole(docs, every, some, *a))
    docs = spark.createDataFrame(rows + rows[:9] + [(None, "one row"), (None, "one row")], "doc_id long, text string")
    kept = keep_one_similar(docs).collect()
    assert sorted(d.doc_id for d in kept if d.doc_id is not None) == brute_kept(rows) == list(range(60))
    assert len(kept) == 61
    assert sum(asked) <= 8
