"""Host rules, periodic runs and the filter audit against brute force, with nulls, empties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import audit_sql, catalog, filter_audit, periodic_runs
from corpuskiln.llm.filter_audit import interactions
from corpuskiln.llm.host_rules import RULES, host_verdicts, shrunk_rates

FOLDER = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 7919} {i % 13}#" for i in range(60_000))


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_periodic_runs", "op13_filter_audit"])
@pytest.mark.skipif(not FOLDER.is_dir(), reason="the tables are not here")
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    told = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in told.description]
    found = catalog.QUERIES[name](spark, str(FOLDER))
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == sorted(told.fetchall(), key=repr)


# ---- host rules


def rules_of(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def odd_texts() -> list[str | None]:
    r = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "x y z x y z", "x y z y z x y", "é # é # é #\n\n é # é #\n\r", "a\x0bb\x0cc d e", LONG, "\n".join(["same line"] * 5)]
    return texts + [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) + "\n" + "# <b>" * r.randint(0, 3) for _ in range(150)]


def test_host_rules_count_as_brute_force(spark):
    rows = [(i if i % 9 else None, t, f"s{i % 3}" if i % 5 else None, "x", 1) for i, t in enumerate(odd_texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept int")
    got = host_verdicts(docs).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got)) == sorted(key((i, *rules_of(t))) for i, t, *_ in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and (r.base_failed or r.host_rejected) for r in got)
    assert host_verdicts(docs.limit(0)).count() == 0


def test_a_host_of_junk_is_rejected_and_a_small_one_is_not(spark):
    r = random.Random(8)
    clean = lambda: " ".join(f"word{r.randrange(10**6)}" for _ in range(80))
    junk = "buy now " * 10
    rows = [(f"host{h}", clean() if r.random() > 0.05 else junk) for h in range(12) for _ in range(40)]
    rows += [("farm", junk)] * 38 + [("farm", clean())] * 2 + [("tiny", junk), ("tiny", clean())] + [(None, clean())]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = host_verdicts(docs).collect()
    assert {x.source for x in got if x.host_rejected} == {"farm"}
    assert not any(x.kept for x in got if x.source == "farm") and sum(x.source == "farm" and not x.base_failed for x in got) == 2
    assert all(x.kept != x.base_failed for x in got if x.source != "farm")


def test_rates_shrink_to_the_mean(spark):
    counts = spark.createDataFrame([("a", 100, 10), ("b", 100, 90), ("c", 2, 2), ("d", 50, 24)], "host string, n long, f_x long")
    rate = {r.host: r.rate_x for r in shrunk_rates(counts, ["x"]).collect()}
    # The moments, worked out here again.
    n, f = [100, 100, 2, 50], [10, 90, 2, 24]
    total, mean = sum(n), sum(f) / sum(n)
    spread = (sum(b * b / a for a, b in zip(n, f)) - sum(f) * mean) / (mean * (1 - mean)) - 3
    rho = spread / (total - sum(a * a for a in n) / total - 3)
    precision = 1 / rho - 1
    for host, a, b in zip("abcd", n, f):
        assert abs(rate[host] - (mean * precision + b) / (precision + a)) < 1e-9
    assert 0.1 < rate["a"] < 0.5 and 0.5 < rate["c"] < 1
    alone = shrunk_rates(counts.limit(1), ["x"]).first()
    assert abs(alone.rate_x - 0.1) < 1e-6 and abs(alone.mean_x - 0.1) < 1e-12
    ones = spark.createDataFrame([(f"h{i}", 1, i % 2) for i in range(10)], "host string, n long, f_x long")
    assert all(abs(r.rate_x - 0.5) < 1e-3 for r in shrunk_rates(ones, ["x"]).collect())


def test_a_corpus_that_fails_alike_loses_no_host(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "too short") for i in range(40)], "doc_id long, source string, text string")
    got = host_verdicts(docs).collect()
    assert not any(r.host_rejected or r.kept for r in got) and len(RULES) == 5


# ---- periodic runs


def runs_of(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """By definition: every stretch of every lag, the smallest lag of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(r: random.Random, n: int) -> list[str]:
    words = [str(r.randrange(r.choice([1, 2, 3, 50, 1000]))) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n > 3:
            a, p = r.randrange(n), r.randint(1, max(1, n // 4))
            for i in range(a + p, r.randint(a, n)):
                words[i] = words[i - p]
    return words


def test_scan_is_brute_force():
    r = random.Random(11)
    for _ in range(400):
        words = repetitive(r, r.choice([0, 1, 23, 24, 25, 60, 150, 300]))
        ids = periodic_runs.word_ids([w.encode() for w in words])
        assert sorted((s, e - s, q) for s, e, q in periodic_runs.Scan(ids).over(1, len(words)).runs) == runs_of(words)


@pytest.mark.parametrize("whole_bytes", [1 << 16, 40])
def test_periodic_runs_are_brute_force(spark, whole_bytes):
    """whole_bytes 40: nearly every text is dealt out by ranges of lags."""
    r = random.Random(12)
    rows = [(i, " ".join(repetitive(r, r.choice([0, 5, 30, 80, 200])))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, "a " * 400), (64, "a b " * 400), (None, "z " * 30), (7, rows[7][1]), (7, rows[7][1]), (65, "  x\ty\x0b" * 40)]
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], "doc_id long, text string, runs string, id int")
    got = periodic_runs.periodic_runs(docs, whole_bytes=whole_bytes).collect()
    expected = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = runs_of(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        said = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        rest = hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
        expected.append((i if i is not None else -1, len(runs), *(-1 if x is None else x for x in best), 1000 * best[1] // best[2] if runs else -1, said, rest))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(-1 if x[c] is None else x[c] for c in columns) for x in got) == sorted(expected)
    assert all([tuple(run) for run in x.runs] == sorted(map(tuple, x.runs)) and len(x.runs) == x.n_runs for x in got)


def test_periodic_runs_of_none_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty).count() == 0
    text = LONG + " " + "once more then " * 30_000
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 120_000, 90_000, 3)


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("t")).collect()
    changed = 0
    for row in got:
        words, h = WORD.findall(row.text or ""), zlib.crc32(str(row.doc_id).encode())
        if row.doc_id is None or h % 10:
            assert row.t == row.text
            continue
        n, g = len(words), h // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert row.t == " ".join(words)
    assert changed > 10


# ---- filter audit


def test_swaps_visit_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) and len(list(filter_audit.swaps(n))) == len(seen) - 1


def test_audit_is_brute_force(spark):
    r = random.Random(21)
    texts = [None, "", "A B", "# x", LONG, *[" ".join(r.choice(["AB", "cd", "e$", "fgh", f"w{r.randrange(300)}", f"v{r.randrange(9**9)}"]) for _ in range(r.choice([3, 99, 100, 140]))) for _ in range(25)]]
    texts += [" ".join(f"v{r.randrange(9**9)}" for _ in range(120)) for _ in range(10)]
    rows = [(r.randrange(80) if r.random() > 0.1 else None, r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(160)]
    rows += [(5, texts[9], "en")] * 3
    labels = [(r.randrange(90) if r.random() > 0.1 else None, r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, mask int")
    got = interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = defaultdict(lambda: 10**9)
    for i, t, _ in rows:
        least[t or ""] = min(least[t or ""], 10**9 if i is None else i)
    judged = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged.append((lang or "", i, {f for f, x in fails.items() if x}))
    expected = {}
    for part in {p for p, *_ in judged}:
        own = [(i, f) for p, i, f in judged if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [i for i, x in own if f in x and not x & before]
                shapley[f] += len(gone)
                expected[part, order, step] = [
                    sum(not x & (before | {f}) for _, x in own), len(gone), sum(f in x and bool(x & before) for _, x in own), sum(x == {f} for _, x in own), sum(i in good for i in gone), sum(i in toxic for i in gone)
                ]
        for (p, order, step), values in expected.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    assert {(x.part, x.filter_order, x.step): [x[c] for c in filter_audit.LETTERS] for x in got} == expected and len(got) == len(expected) == 600 * 3
    assert interactions(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    assert interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("good_lost + toxic_lost > 0").count() == 0


def test_sql_is_of_the_given_tables():
    assert all("documents" in s for s in (audit_sql.PERIODIC, audit_sql.AUDIT, audit_sql.host_rules_sql()))
