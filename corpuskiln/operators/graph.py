"""Reference graphs of file trees: nodes with metrics, references, their resolution to files, edges."""

from __future__ import annotations

import ast
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.common import strip
from ..functions.text import basename, language_of, line_count, references, slashes, suffix, top_folder

# What is probed, in this order.
JS_PROBES = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts")
FILE_PROBES = ("", ".py", ".js", ".ts", ".md", ".sh", ".ps1", "/index.js", "/index.ts", "/README.md")
KINDS = {"markdown": "link", "shell": "source", "powershell": "source", "html": "ref", "css": "import"}
JS_LANGUAGES = ("js", "ts", "jsx", "tsx")


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_symbols(texts: pd.Series) -> pd.Series:
    """Names of functions and classes, breadth first, the first 20; broken code has none."""

    def names(t: str) -> list[str]:
        try:
            tree = ast.parse(t or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))][:20]

    return texts.map(names)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("module", T.StringType()), T.StructField("level", T.IntegerType())])))
def python_imports(texts: pd.Series) -> pd.Series:
    """Imported modules with their level of dots; `from . import x` names none and is left out."""

    def found(t: str) -> list[dict]:
        try:
            tree = ast.parse(t or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        out = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [{"module": a.name, "level": 0} for a in n.names]
            elif isinstance(n, ast.ImportFrom) and n.module:
                out.append({"module": n.module, "level": n.level})
        return out

    return texts.map(found)


@F.pandas_udf(T.StringType())
def join_path(folder: pd.Series, ref: pd.Series) -> pd.Series:
    """folder/ref without . and ..; null where it leaves the tree."""

    def one(a: str, b: str) -> str | None:
        p = posixpath.normpath(posixpath.join(a or "", b or ""))
        return None if p.startswith("..") or p.startswith("/") else p

    return pd.Series([one(a, b) for a, b in zip(folder, ref)], dtype=object)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def nodes(files: DataFrame) -> DataFrame:
    """A node for every (path, text): label, ext, lang, lines, bytes, group, functions."""
    lang = language_of(F.col("path"))
    symbols = F.when(lang == "python", python_symbols(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return files.select(
        slashes(F.col("path")).alias("id"), basename(F.col("path")).alias("label"), slashes(F.col("path")).alias("path"), suffix(F.col("path")).alias("ext"), lang.alias("lang"),
        line_count(F.col("text")).alias("lines"), F.octet_length("text").alias("size"), top_folder(F.col("path")).alias("group"),
        F.array().cast("array<string>").alias("classes"), symbols.alias("functions"), F.lit(None).cast("string").alias("changed_by"), F.lit(None).cast("timestamp").alias("change_time"),
    )


def candidates(files: DataFrame) -> DataFrame:
    """(source, pos, prio, candidate, type): every place that a reference of a file may mean, best first."""
    f = files.select(slashes(F.col("path")).alias("source"), "text", language_of(F.col("path")).alias("lang"), folder_of(slashes(F.col("path"))).alias("folder"))
    numbered = lambda base, probes: F.posexplode(F.array(*[F.concat(base, F.lit(p)) for p in probes])).alias("prio", "candidate")
    out = None

    def add(part: DataFrame, kind: str):
        nonlocal out
        part = part.select("source", "pos", "prio", "candidate", F.lit(kind).alias("type")).where("candidate IS NOT NULL")
        out = part if out is None else out.unionByName(part)

    py = f.where("lang = 'python'").select("source", "folder", F.posexplode(python_imports(F.col("text"))).alias("pos", "i")).select("source", "folder", "pos", "i.module", "i.level")
    as_path = F.replace("module", F.lit("."), F.lit("/"))
    add(py.where("level = 0").select("source", "pos", numbered(as_path, (".py", "/__init__.py"))), "import")
    climb = F.concat(F.repeat(F.lit("../"), F.col("level") - 1), as_path, F.lit(".py"))
    add(py.where("level > 0").select("source", "pos", F.lit(0).alias("prio"), join_path(F.col("folder"), climb).alias("candidate")), "import")
    js = f.where(F.col("lang").isin(*JS_LANGUAGES)).select("source", "folder", F.posexplode(references(F.col("text"), "js")).alias("pos", "ref")).where("startswith(ref, '.')")
    add(js.withColumn("base", join_path(F.col("folder"), F.col("ref"))).select("source", "pos", numbered(F.col("base"), JS_PROBES)), "import")
    for lang, kind in KINDS.items():
        refs = f.where(F.col("lang") == lang).select("source", "folder", F.posexplode(references(F.col("text"), lang)).alias("pos", "ref"))
        bare = F.regexp_replace(F.regexp_replace(strip(F.col("ref")), "\\A[\"']+|[\"']+\\z", ""), r"\A\$[A-Za-z_]+[/\\]", "")
        local = refs.withColumn("ref", slashes(bare)).where("ref <> '' AND NOT ref RLIKE '^(http|//|#|data:|mailto:)'")
        add(local.withColumn("base", join_path(F.col("folder"), F.col("ref"))).select("source", "pos", numbered(F.col("base"), FILE_PROBES)), kind)
    return out


def edges(files: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """(id, source, target, type, label): each reference meets the best candidate that is a file. No self edges; the first edge from one file to another wins whatever its type."""
    return resolved(candidates(files), node_ids if node_ids is not None else files.select(slashes(F.col("path")).alias("id")))


def resolved(places: DataFrame, node_ids: DataFrame) -> DataFrame:
    """The edges that these candidates are, given the files that there are."""
    hits = places.join(node_ids.select(F.col("id").alias("candidate")), "candidate")
    best = hits.groupBy("source", "type", "pos").agg(F.min_by("candidate", "prio").alias("target")).where("source <> target")
    first = Window.partitionBy("source", "target").orderBy("pos", "type")
    return (
        best.withColumn("n", F.row_number().over(first)).where("n = 1")
        .select(F.concat("source", F.lit("→"), "target").alias("id"), "source", "target", "type", F.col("type").alias("label"))
    )


def graph_stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: files, edges, languages (array of struct lang, count)."""
    langs = node_rows.groupBy("lang").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("files"), F.sort_array(F.collect_list(F.struct("lang", "count"))).alias("languages"))
    return langs.join(F.broadcast(edge_rows.agg(F.count("*").alias("edges"))))  # one row each


def language_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("lang").agg(F.count("*").alias("n"))


def hide_groups(node_rows: DataFrame, edge_rows: DataFrame, visible: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the visible groups, and edges with both ends among them."""
    shown = node_rows.where(F.col("group").isin(*visible))
    ids = shown.select("id")
    inside = edge_rows.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return shown, inside.select(edge_rows.columns)


def neighbourhood(node_rows: DataFrame, edge_rows: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node with the nodes next to it, and the edges at it."""
    at = edge_rows.where((F.col("source") == node) | (F.col("target") == node))
    ids = at.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return node_rows.join(ids, "id", "left_semi").union(node_rows.where(F.col("id") == node)).dropDuplicates(["id"]), at


def display_text(shown: DataFrame, all_nodes: DataFrame) -> DataFrame:
    one = shown.agg(F.count("*").alias("visible"))
    return one.join(F.broadcast(all_nodes.agg(F.count("*").alias("total")))).select(F.format_string("%d of %d files shown", "visible", "total").alias("text"))


def apply_changes(node_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with changed_by and change_time of their last change (file, by, ts); changes of unknown files do nothing."""
    last = changes.groupBy("file").agg(F.max("ts").alias("_ts"), F.max_by("by", F.struct("ts", "by")).alias("_by"))
    joined = node_rows.join(last, node_rows["id"] == last["file"], "left")
    return joined.select(*[F.coalesce("_by", "changed_by").alias(c) if c == "changed_by" else F.coalesce("_ts", "change_time").alias(c) if c == "change_time" else F.col(f"`{c}`") for c in node_rows.columns])


# ---- projects: many trees in one set of tables, told apart by a project column


def register(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """projects (path, place) plus the paths not known yet, each once, placed after those known in the order of `place`."""
    new = paths.groupBy("path").agg(F.min("place").alias("place")).join(projects.select("path"), "path", "left_anti")
    last = projects.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))  # one row
    return projects.select("path", "place").unionByName(new.join(F.broadcast(last)).select("path", (F.col("last") + 1 + F.col("place")).alias("place")))


def project_list(projects: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(path, name, files) of every project, 0 files where it has no node."""
    files = node_rows.groupBy(F.col("project").alias("path")).agg(F.count("*").alias("n"))
    return projects.join(files, "path", "left").select("path", F.substring_index("path", "/", -1).alias("name"), F.coalesce("n", F.lit(0)).alias("files"))


def snapshot(projects: DataFrame, rows: DataFrame, project: str | None = None) -> DataFrame:
    """Nodes or edges of a project; of the one registered first if it is unknown or not given."""
    choice = projects.agg(F.coalesce(F.max(F.when(F.col("path") == F.lit(project), F.col("path"))), F.min_by("path", "place")).alias("chosen"))  # one row
    return rows.join(F.broadcast(choice), rows["project"] == choice["chosen"], "left_semi")


def refresh(node_rows: DataFrame, project: str, found: DataFrame) -> DataFrame:
    """node_rows with a project's nodes replaced by those found in a new scan; what is known of changes to a node stays."""
    kept = node_rows.where(~F.col("project").eqNullSafe(F.lit(project)))
    known = node_rows.where(F.col("project") == project).select(F.col("id").alias("_id"), F.col("changed_by").alias("_by"), F.col("change_time").alias("_at"))
    new = found.join(known, found["id"] == known["_id"], "left")
    value = lambda c: F.lit(project) if c == "project" else F.col("_by") if c == "changed_by" else F.col("_at") if c == "change_time" else F.col(f"`{c}`")
    return kept.unionByName(new.select(*[value(c).alias(c) for c in node_rows.columns]))


def unknown_files(node_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(file) of changes whose file is no node yet: their project needs a refresh."""
    return changes.select("file").distinct().join(node_rows.select(F.col("id").alias("file")), "file", "left_anti")
