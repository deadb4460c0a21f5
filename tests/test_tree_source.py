"""Folders listed in parallel: pruning, endings, limits that open no more files than asked, errors as rows, models registered."""

import os

import pytest

from corpuskiln.operators import registry
from corpuskiln.sources import files, tree


@pytest.fixture
def root(tmp_path):
    for k in range(70):
        (tmp_path / f"d{k:02}" / "deep" / "deeper").mkdir(parents=True)
        (tmp_path / f"d{k:02}" / "deep" / "deeper" / f"f{k}.py").write_text(f"x = {k}")
    for name, content in (("a.md", b"\xff ok"), ("d00/b.md", b"b"), ("d00/c.bin", b"c"), ("d01/node_modules/x.py", b"no"), ("node_modules/y.py", b"no"), ("m/Llama-Q4_K_M.gguf", b"0" * 4000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    os.mkfifo(tmp_path / "d02" / "broken.md")  # whoever opens it waits for ever
    return tmp_path


def test_listing_prunes_and_covers_all(spark, root):
    got = {r.path for r in tree.list_tree(spark, f"file://{root}").collect()}
    below = {str(p.relative_to(root)) for p in root.rglob("*") if not p.is_dir() and "node_modules" not in p.parts}
    assert got == below and len(got) == 75
    assert len(tree.TreeReader(f"file://{root}", frozenset(files.SKIPPED_FOLDERS)).partitions()) > 64
    assert {r.path for r in tree.list_tree(spark, f"file://{root}", ()).collect()} - got == {"d01/node_modules/x.py", "node_modules/y.py"}


def test_errors_are_rows(spark, root):
    got = {r.path: r for r in tree.read_folder(spark, f"file://{root}", (".md",)).collect()}
    assert set(got) == {"a.md", "d00/b.md", "d02/broken.md"}
    assert got["a.md"].text == "� ok" and got["a.md"].error is None and got["d00/b.md"].text == "b"
    assert got["d02/broken.md"].text is None and got["d02/broken.md"].error
    (row,) = tree.read_folder(spark, f"file://{root}/nothing").collect()
    assert row.error and row.text is None
    sizes = {r.path: r.error for r in tree.read_folder(spark, f"file://{root}", (".md",), most_bytes=2).collect()}
    assert sizes["d00/b.md"] is None and "more than 2" in sizes["a.md"]


def test_a_limit_opens_only_the_first_files(spark, root):
    for k in range(5, 70):  # whoever opens these has an error
        (root / f"d{k:02}" / "deep" / "deeper" / f"f{k}.py").write_text("y" * 1000)
    read = lambda n: tree.read_folder(spark, f"file://{root}", (".py",), n, files.SKIPPED_FOLDERS, 100).where("path NOT LIKE '%broken.md'").collect()
    assert [(r.path, r.text, r.error) for r in read(5)] == [(f"d{k:02}/deep/deeper/f{k}.py", f"x = {k}", None) for k in range(5)]
    assert sum(r.error is not None for r in read(7)) == 2


def test_files_that_go_while_they_are_read(spark, root):
    paths = spark.createDataFrame([("a.md", 1), ("gone.md", 2), ("d00", 3)], "path string, more int")
    got = {r.path: (r.more, r.text, bool(r.error)) for r in tree.contents(paths, f"file://{root}").collect()}
    assert got == {"a.md": (1, "\ufffd ok", False), "gone.md": (2, None, True), "d00": (3, None, True)}


def test_models_are_registered(spark, root):
    known = tree.scan_models(spark, f"file://{root}", registry.empty_registry(spark))
    again = tree.scan_models(spark, f"file://{root}", known)
    (row,) = again.collect()
    assert (row.path, row.quantization, row.architecture, row.size_gb) == (f"file://{root}/m/Llama-Q4_K_M.gguf", "Q4_K_M", "llama", 4e-06)
    assert known.first().size_gb == 0.0, "a new one is rounded"
