"""Line, near-duplicate and substring dedup against brute force, with nulls, empties, repeats and clashing names."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import simhash
from corpuskiln.llm.components import components
from corpuskiln.llm.line_dedup import dedup_lines
from corpuskiln.llm.substring_dedup import repeated_passages

LONG = "a line of well over twenty characters"
DOCS = "doc_id long, text string"


def some_texts(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(80))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 150)))
        if r.random() < 0.4:
            text = text[: len(text) // 2] + " " + passage[r.randint(0, 60) :] + "\n" + text
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "x " * 120), (105, rows[4][1]), (None, rows[5][1]), (7, rows[6][1])]
    return rows


def test_line_dedup_cases(spark):
    rows = [(1, f"{LONG}\nb"), (2, f" {LONG.upper()}\t\n{LONG}\nc"), (3, f"{LONG}\nd"), (4, "short\nx"), (5, "short"), (6, "short"), (7, None), (8, ""), (3, f"{LONG}\nd"), (None, LONG)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("old"), "lost_pos": F.lit(1)})
    found = dedup_lines(docs).collect()
    assert all(r.lost_pos == 1 for r in found)
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in found)
    assert got == sorted([(1, "b", 2, 1), (2, "c", 3, 2), (3, f"{LONG}\nd", 2, 0), (3, f"{LONG}\nd", 2, 0), (4, "short\nx", 2, 0), (5, "short", 1, 0), (6, "short", 1, 0), (7, "", 1, 0), (8, "", 1, 0), (0, "", 1, 1)])
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_needs_three_documents(spark):
    docs = spark.createDataFrame([(1, f"{LONG}\n{LONG}\n{LONG}"), (2, LONG)], DOCS)
    assert all(r.n_dropped == 0 for r in dedup_lines(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, seed):
    rows = some_texts(seed)
    window = 35
    words = [(t or "").encode().split() for _, t in rows]
    seen = defaultdict(int)
    for w in words:
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] += 1
    expected = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i or -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, DOCS).withColumn("seeds", F.lit(1))
    found = repeated_passages(docs).collect()
    got = [(r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    texts = {(r.x1, r.x2): (r.text or "").split() for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("x1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")).cast("binary")).alias("x2")).collect()}
    mine = {r[0] if r[0] is not None else -1: (r[1] or "").split() for r in rows}
    assert sum(len(r.factors) for r in found) > 20
    for r in found:
        if r.doc_id not in (None, 7):
            covered = {j for f in r.factors for j in range(f.begin, f.end)}
            assert len(covered) == r.n_removed
            for f in r.factors:
                assert mine[r.doc_id][f.begin : f.end] == texts[f.x1, f.x2][f.at : f.at + f.end - f.begin], "a factor stands at its reference"
    assert sorted(got) == sorted((i if i else -1, *rest) for i, *rest in expected)
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_linked_fingerprints_are_brute_force(spark):
    r = random.Random(5)
    fps, i = {}, 0
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(12):
            f = centre
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
            fps[i], i = f, i + 1
    fps |= {500: 0, 501: 0, 502: (1 << 63), 503: (1 << 64) - 1, 504: (1 << 64) - 1 ^ 7}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v)) for k, v in fps.items()], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    assert got == brute_components(fps, 3)


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (7, "a  b\tc d E"), (None, "one")]
    got = {(r.doc_id, r.component_id): r.fp for r in simhash.near_duplicates(simhash.fingerprints(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[1, 1] == got[2, 1] == got[3, 1] == 0
    assert got[4, 4] == got[5, 4] == got[None, 4]
    assert got[6, 6] == got[7, 6]
    assert simhash.near_duplicates(simhash.fingerprints(spark.createDataFrame([], DOCS))).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d", 9), (2, "A b c d", 9), (2, "A b c d", 9), (3, "other words here now", 9), (3, "other words here now", 9), (4, None, 9), (5, "", 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, f"{DOCS}, stay_id int"))
    assert sorted((r.doc_id, r.stay_id) for r in kept.collect()) == [(1, 9), (3, 9), (4, 9)]


def test_thresholds_fill_the_pigeonhole():
    import numpy as np

    groups = simhash.correlated_groups(np.full((64, 64), 25.0) + np.diag([25.0] * 64), 100, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    limits = simhash.thresholds(groups, np.full(64, 0.5), 10**6, 3)
    assert sum(t + 1 for t in limits) == 4


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1
    assert len({got[i] for i in range(100, 130)}) == 1
    assert got[1] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
