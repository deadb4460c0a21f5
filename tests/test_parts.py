"""The store's parts: random writes against lists of rows, small upserts, counts without reading, writers that die or race."""

import random
from collections import Counter

import pytest

from corpuskiln.sources import parts, store

ROWS = "input string, output string"


def content(df):
    return Counter((r.input, r.output, r.split) for r in df.collect())


def counted(s, name):
    r = s.stats(name).first()
    return r.total_rows, r.has_output, r.has_embedding, [tuple(x) for x in r.splits], [tuple(x) for x in r.sources]


def test_random_writes_equal_a_list_of_rows(spark, tmp_path, monkeypatch):
    """Appends, upserts and compactions, with merges after every few parts."""
    monkeypatch.setattr(parts, "MERGE", 3)
    s, r = store.PromptStore(spark, f"file://{tmp_path}"), random.Random(2)
    expected: list[tuple[str, str, str]] = []
    for step in range(9):
        rows = [(r.choice(["", "a", "b", "c", "d", "e", f"k{step}"]), r.choice(["", "x", "y"])) for _ in range(r.randint(0, 5))]
        new, split = spark.createDataFrame(rows, ROWS), r.choice(["train", "test"])
        kind = "compact" if step == 6 else r.choice(["append", "upsert", "upsert"])
        if kind == "compact":
            s.compact("d")
            rows = []
        elif kind == "append":
            s.add_batch("d", new, split=split)
        else:
            s.upsert("d", new, split=split)
            keys = {k for k, _ in rows} - {""}
            expected = [x for x in expected if x[0] not in keys]
        expected += [(*x, split) for x in rows]
        assert content(s.load("d")) == Counter(expected), (step, kind)
    splits, outputs = Counter(x[2] for x in expected), sum(x[1] != "" for x in expected)
    assert counted(s, "d") == (len(expected), outputs, 0, sorted(splits.items()), [("manual", len(expected))])
    scanned = store.stats(s.load("d")).first()
    assert counted(s, "d") == (scanned.total_rows, scanned.has_output, scanned.has_embedding, [tuple(x) for x in scanned.splits], [tuple(x) for x in scanned.sources])
    assert {(x.split, x.n) for x in s.catalog().collect()} == {(x.split, x.n) for x in store.catalog(s.load("d")).collect()}
    assert {(x.value, x["count"]) for x in s.value_counts("d", "split").collect()} == set(splits.items())
    assert len(s._table("d").newest()[1]["parts"]) < 9


def test_an_upsert_of_ten_rows_writes_ten_rows(spark, tmp_path):
    s = store.PromptStore(spark, f"file://{tmp_path}")
    s.add_batch("d", spark.range(5000).selectExpr("'q' || id AS input", "repeat('long answer ', 50) || uuid() AS output"))
    table = s._table("d")
    before = {p["name"] for p in table.newest()[1]["parts"]}
    s.upsert("d", spark.range(10).selectExpr("'q' || id * 7 AS input", "'new' AS output"))
    manifest = table.newest()[1]
    new = [p for p in manifest["parts"] if p["name"] not in before]
    assert [p["rows"] for p in new] == [10] and before < {p["name"] for p in manifest["parts"]} and [d["rows"] for d in manifest["deletes"]] == [10]
    size = lambda name: table.fs().getContentSummary(table.at(name)).getLength()
    assert size(new[0]["name"]) + size(manifest["deletes"][0]["name"]) < size(next(iter(before))) / 5
    rows = s.load("d")
    assert rows.count() == 5000 and rows.where("output = 'new'").count() == 10 == rows.where("input IN ('q0', 'q7', 'q63')").count() + 7
    s.upsert("d", spark.range(1500).selectExpr("'q' || id AS input", "'newer' AS output"))  # more keys than go into a filter
    assert s.load("d").count() == 5000 and s.load("d").where("output = 'newer'").count() == 1500 and s.load("d").where("output = 'new'").count() == 0
    s.compact("d")
    assert s.load("d").count() == 5000 and table.newest()[1]["deletes"] == [] and len(table.newest()[1]["parts"]) == 1
    assert counted(s, "d")[:2] == (5000, 5000)


def test_counts_need_no_rows(spark, tmp_path):
    """The rows' files are gone, and the catalog and the statistics are still right."""
    s = store.PromptStore(spark, f"file://{tmp_path}")
    for name, n in (("d", 3), ("e", 2)):
        s.add_batch(name, spark.createDataFrame([(f"q{i}", "") for i in range(n)], ROWS))
        s.upsert(name, spark.createDataFrame([("q1", "a")], ROWS), split="test")
        table = s._table(name)
        for p in table.newest()[1]["parts"]:
            table.fs().delete(table.at(p["name"]), True)
    assert counted(s, "d")[:2] == (3, 1)
    assert sorted((x.dataset_name, x.split, x.n, x.error) for x in s.catalog().collect()) == [("d", "test", 1, None), ("d", "train", 2, None), ("e", "test", 1, None), ("e", "train", 1, None)]
    lost = s._table("e")
    lost.fs().delete(lost.at(lost.newest()[1]["parts"][0]["name"] + ".counts"), True)
    by_name = {x.dataset_name: x for x in s.catalog().collect()}
    assert by_name["e"].error and by_name["e"].n is None and by_name["d"].error is None


def test_a_writer_that_dies_locks_nothing(spark, tmp_path):
    s = store.PromptStore(spark, f"file://{tmp_path}")
    s.add_batch("d", spark.createDataFrame([("a", "1")], ROWS))
    table = s._table("d")
    out = table.fs().create(table.at("0f.unfinished"), False)  # it died before the rename
    out.writeBytes('{"parts": [{"na')
    out.close()
    table.part(s.load("d"))  # and another one after its part
    assert content(s.load("d")) == {("a", "1", "train"): 1}
    s.add_batch("d", spark.createDataFrame([("b", "2")], ROWS))
    assert set(content(s.load("d"))) == {("a", "1", "train"), ("b", "2", "train")} and table.versions() == [1, 2]


def test_a_writer_that_comes_second_starts_again(spark, tmp_path, monkeypatch):
    s = store.PromptStore(spark, f"file://{tmp_path}")
    s.add_batch("d", spark.createDataFrame([("a", "1"), ("b", "1")], ROWS))
    table, other, calls = s._table("d"), store.PromptStore(spark, f"file://{tmp_path}"), []
    publish = parts.PartTable.publish

    def late(self, number, manifest):
        if not calls:
            calls.append(number)
            other.upsert("d", spark.createDataFrame([("a", "2")], ROWS))
        publish(self, number, manifest)

    monkeypatch.setattr(parts.PartTable, "publish", late)
    s.upsert("d", spark.createDataFrame([("a", "3"), ("c", "3")], ROWS))
    assert set(content(s.load("d"))) == {("a", "3", "train"), ("b", "1", "train"), ("c", "3", "train")} and s.load("d").count() == 3
    with pytest.raises(parts.Taken, match="already exists"):
        publish(table, table.versions()[-1], parts.EMPTY)


def test_a_search_reads_only_files_that_may_hold_it(spark, tmp_path):
    """The same rows as a scan for words of all kinds, also after deletes, in parts with and without an index."""
    s, r = store.PromptStore(spark, f"file://{tmp_path}"), random.Random(3)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(7)) if k else "Émile"
    every = [[word(k % 40) for k in range(part * 50, part * 50 + 50)] for part in range(4)]
    for part, words in enumerate(every):
        s.add_batch("d", spark.createDataFrame([(f"q{part}-{i}", f"The {w} of PART{part}. 😀x") for i, w in enumerate(words)], ROWS).coalesce(2))
    s.index_text("d")
    for query in (every[1][7].upper(), every[3][2], "émile", "part2", "of p", "zzzz", "ab", "", "😀X", "the " + every[0][9][:3]):
        got, scan = content(s.search("d", query)), content(store.search(s.load("d"), query))
        assert got == scan, query
    files, n = s.files_to_search("d", every[1][7])
    assert n == 8 and len(files) < 3
    assert len(s.files_to_search("d", "part2")[0]) == 2 and s.files_to_search("d", "zzzz")[0] == [] and len(s.files_to_search("d", "ab")[0]) == 8
    assert s.files_to_search("d", "part2", ["input"])[0] == []
    s.upsert("d", spark.createDataFrame([("q2-5", "changed")], ROWS))
    assert content(s.search("d", "part2")) == content(store.search(s.load("d"), "part2")) and s.search("d", "part2").count() == 49
    assert s.search("d", "chang").count() == 1 and s.search("d", "part[23]", regex=True).count() == 99
