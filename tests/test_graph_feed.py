"""The graph kept by changes against the graph built anew, after random changes, in batches and in a stream."""

import random

from corpuskiln.operators import graph
from corpuskiln.streaming.graph_feed import GraphView

CHANGE = "file string, text string, by string, ts timestamp"
NAMES = ["a.py", "b.py", "p/__init__.py", "p/m.py", "web/u.js", "web/x.js", "web/u/index.js", "README.md", "n.md"]


def some_text(r: random.Random, name: str) -> str:
    if name.endswith(".py"):
        return "\n".join(r.sample(["import a", "import b", "import p", "from .m import z", "from p.m import q", "def f(): pass", "broken ("], r.randint(0, 4)))
    if name.endswith(".js"):
        return "\n".join(r.sample(["import u from './u'", "import x from './x.js'", "import r from 'react'", "import w from '../web/u/index'"], r.randint(0, 3)))
    return " ".join(r.sample(["[r](README.md)", "[n](./n.md)", "[w](http://x.y/z)", "[a](a.py)", "words"], r.randint(0, 4)))


def moments(spark, rows):
    return spark.createDataFrame([(f, t, by, n) for f, t, by, n in rows], "file string, text string, by string, n long").selectExpr("file", "text", "by", "timestamp_seconds(n) AS ts")


def edges_of(df):
    return sorted((x.source, x.target, x.type, x.id) for x in df.select("source", "target", "type", "id").collect())


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    r, view, files, n = random.Random(3), GraphView(spark, f"file://{tmp_path}/graph"), {}, 0
    for step in range(3):
        rows = []
        for _ in range(8 if step == 0 else r.randint(1, 4)):
            name, n = r.choice(NAMES), n + 1
            text = None if step and r.random() < 0.35 else some_text(r, name)
            rows.append((name, text, f"u{n}", n))
            files.pop(name, None)
            if text is not None:
                files[name] = (text, f"u{n}")
        batch = moments(spark, rows)
        view.apply(batch)
        if step == 1:
            view.apply(batch)  # after a failure a batch comes again
        all_files = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
        assert edges_of(view.edges()) == edges_of(graph.edges(all_files)), step
        expected = sorted((x.id, x.lines, x.functions) for x in graph.nodes(all_files).collect())
        assert sorted((x.id, x.lines, x.functions) for x in view.nodes().collect()) == expected
        assert {x.id: x.changed_by for x in view.nodes().collect()} == {p: by for p, (_, by) in files.items()}


def test_only_what_changed_is_parsed(spark, tmp_path, monkeypatch):
    view, parsed = GraphView(spark, f"file://{tmp_path}/graph"), []
    candidates = graph.candidates
    monkeypatch.setattr(graph, "candidates", lambda files: parsed.append(sorted(x.path for x in files.collect())) or candidates(files))
    view.apply(moments(spark, [("a.py", "import b", "u", 1), ("n.md", "[a](a.py) [c](c.md)", "u", 1)]))
    assert edges_of(view.edges()) == [("n.md", "a.py", "link", "n.md→a.py")]
    view.apply(moments(spark, [("b.py", "", "v", 2)]))
    assert parsed == [["a.py", "n.md"], ["b.py"]]
    assert [x[:2] for x in edges_of(view.edges())] == [("a.py", "b.py"), ("n.md", "a.py")], "a.py finds the new file without being parsed"
    view.apply(moments(spark, [("a.py", None, "v", 3), ("x.py", None, "v", 3)]))
    assert edges_of(view.edges()) == [] and sorted(x.id for x in view.nodes().collect()) == ["b.py", "n.md"] and parsed[2] == []


def test_a_stream_of_changes(spark, tmp_path):
    rows = [("a.py", "import b", "u", 1), ("b.py", "import a", "u", 2), ("b.py", "x = 1", "v", 3), ("c.md", "[b](b.py)", "u", 4)]
    moments(spark, rows[:2]).coalesce(1).write.parquet(f"{tmp_path}/feed/0")
    moments(spark, rows[2:]).coalesce(1).write.parquet(f"{tmp_path}/feed/1")
    feed = spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    view = GraphView(spark, f"file://{tmp_path}/graph")
    query = view.follow(feed, f"{tmp_path}/state", availableNow=True)
    assert query.awaitTermination(120) and query.exception() is None
    assert [x[:2] for x in edges_of(view.edges())] == [("a.py", "b.py"), ("c.md", "b.py")]
    assert {x.id: x.changed_by for x in view.nodes().collect()} == {"a.py": "u", "b.py": "v", "c.md": "u"}
