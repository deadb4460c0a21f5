"""Folders as a Spark data source: listed in parallel, pruned before they are entered, read only where asked, an error for each file that can't be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import suffix
from ..operators.registry import register_gguf
from .files import DOCUMENT_SUFFIXES, SKIPPED_FOLDERS

PATHS = "path string, name string, length bigint, error string"
#: Folders are opened on the driver until there are so many to deal out.
LEAST_PARTS = 64


def listed(system: fs.FileSystem, folder: str, skipped: frozenset[str]) -> tuple[list[str], list[tuple]]:
    """The folders to enter next, and (path, name, length, error) of the files, in a folder; an error is the folder's row."""
    try:
        found = system.get_file_info(fs.FileSelector(folder, recursive=False))
    except OSError as e:
        return [], [(folder, folder.rsplit("/", 1)[-1], None, str(e))]
    below = [i.path for i in found if i.type == fs.FileType.Directory and i.base_name not in skipped]
    files = [(i.path, i.base_name, *((i.size, None) if i.type == fs.FileType.File else (None, "no plain file"))) for i in found if i.type != fs.FileType.Directory]
    return below, files


class TreePaths(DataSource):
    """`spark.read.format("tree_paths").option("root", ...).load()`: PATHS of all files below a root, of any file system that Arrow knows by its URI. Folders named in
    the option `skipped`, separated by commas, are not entered. A folder that can't be listed is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "tree_paths"

    def schema(self) -> str:
        return PATHS

    def reader(self, schema) -> TreeReader:
        skipped = self.options.get("skipped", ",".join(SKIPPED_FOLDERS))
        return TreeReader(self.options["root"], frozenset(x for x in skipped.split(",") if x))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skipped: frozenset[str]):
        self.root, self.skipped = root, skipped

    def partitions(self) -> list[InputPartition]:
        """Subtrees, as many as there are after the fewest levels that give enough; the files met on the way are the first one."""
        system, top = fs.FileSystem.from_uri(self.root)
        level, met = [top], []
        while level and len(level) < LEAST_PARTS:
            below = []
            for folder in level:
                more, files = listed(system, folder, self.skipped)
                below += more
                met += files
            level = below
        return [InputPartition(("met", met)), *[InputPartition(("folder", folder)) for folder in level]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kind, value = partition.value
        if kind == "met":
            yield from value
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        open_ = [value]
        while open_:
            below, files = listed(system, open_.pop(), self.skipped)
            yield from files
            open_ += below


def list_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """PATHS below root, with paths relative to it; nothing is read."""
    spark.dataSource.register(TreePaths)
    found = spark.read.format("tree_paths").option("root", root).option("skipped", ",".join(skipped)).load()
    _, top = fs.FileSystem.from_uri(root)
    return found.withColumn("path", F.expr("substring(path, {})".format(len(top.rstrip("/")) + 2)))


def contents(paths: DataFrame, root: str, most_bytes: int | None = None) -> DataFrame:
    """paths plus text, with marks in place of bytes that are no UTF-8, or error: what kept a file from being read. A file over most_bytes has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts, errors = [], []
                for path in some.column("path").to_pylist():
                    text = error = None
                    try:
                        with system.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                            if most_bytes is not None and f.size() > most_bytes:
                                error = f"{f.size()} bytes are more than {most_bytes}"
                            else:
                                text = f.read().decode("utf-8", "replace")
                    except OSError as e:
                        error = str(e)
                    texts.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*some.schema.names, "text", "error"])

    return paths.drop("text", "error").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in paths.drop("text", "error").dtypes) + ", text string, error string")


def read_folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = DOCUMENT_SUFFIXES, most_files: int | None = None, skipped: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """(path, text, error) of the files with these endings, the first most_files by path if asked: only these are opened. Folders and files that can't be
    read are rows with an error; their order is by path."""
    found = list_tree(spark, root, skipped)
    broken = found.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("text"), "error")
    wanted = found.where(F.col("error").isNull() & suffix(F.col("name")).isin(*suffixes)).select("path")
    if most_files is not None:
        wanted = wanted.orderBy("path").limit(most_files)
    dealt = wanted.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return contents(dealt, root, most_bytes).unionByName(broken).orderBy("path")


def scan_models(spark: SparkSession, root: str, registry: DataFrame) -> DataFrame:
    """The registry with all *.gguf files below root registered, as one by one: sizes are refreshed, what is known stays. No file is opened."""
    found = list_tree(spark, root, ()).where(F.col("error").isNull() & F.col("name").endswith(".gguf"))
    return register_gguf(registry, found.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), (F.col("length") / 1e9).alias("size_gb")))
