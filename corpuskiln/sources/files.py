"""Files of folders as rows: plain documents, source trees, model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import LANGUAGES, basename, suffix

# Fixed values.
DOCUMENT_SUFFIXES = (".py", ".ts", ".js", ".md", ".tex", ".txt")
SKIPPED_FOLDERS = (
    ".git", "__pycache__", "node_modules", "venv", ".venv", "dist", "build", ".next", ".nuxt", ".output", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".eggs", "htmlcov", "local_data", ".claude", ".idea", ".vscode", "__snapshots__", ".cargo",
)


def relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    inside = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(inside)), F.substr(bare, F.lit(len(inside) + 1))).otherwise(F.ltrim(bare, F.lit("/")))


def read_documents(spark: SparkSession, root: str, suffixes: tuple[str, ...] = DOCUMENT_SUFFIXES) -> DataFrame:
    """(path, text) of all files below root with these endings; bytes that are no UTF-8 become replacement marks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = raw.select(relative(F.col("path"), root).alias("path"), F.col("content").cast("string").alias("text"))
    return named.where(suffix(F.col("path")).isin(*suffixes))


def outside(path: Column, folders: tuple[str, ...] = SKIPPED_FOLDERS) -> Column:
    """No folder of the path is one of these."""
    return ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, folders)))


def read_tree(spark: SparkSession, root: str, most_files: int = 2000) -> DataFrame:
    """(path, text) of a source tree without build and tool folders: known languages only, the first `most_files` by path."""
    files = read_documents(spark, root, tuple(LANGUAGES)).where(outside(F.col("path")))
    return files.orderBy("path").limit(most_files)


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, size_gb) of all *.gguf files below root, without reading them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gguf").load(root)
    return raw.select("path", basename(F.col("path")).alias("filename"), (F.col("length") / 1e9).alias("size_gb"))


def numeric_order(path: Column) -> Column:
    """N of names that end in _N.md, for sorting them by number."""
    return F.try_to_number(F.regexp_extract(path, r"_(\d+)\.md\z", 1), F.lit("999999999999")).cast("long")
