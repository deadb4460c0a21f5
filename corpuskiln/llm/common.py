"""What several operators share: reading, shared scratch tables, word codes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, \x20 and \x09-\x0D; what bytes.split() splits at.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_scratch: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Without spark.checkpoint.dir (local tests) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="corpuskiln-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return f"file://{_own_scratch[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: whatever came from them is in written tables of its own."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


class WordCodes(dict):
    """word bytes -> 64-bit code, computed once for each word; forgets all when it holds `most` words."""

    def __init__(self, code=xxhash.xxh64_intdigest, most: int = 150_000):
        super().__init__()
        self._code, self._most = code, most

    def __missing__(self, word: bytes):
        if len(self) >= self._most:
            self.clear()
        value = self[word] = self._code(word)
        return value

    def of(self, words: list[bytes], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Numpy arrays of 64-bit integers as an Arrow array<long>."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def own_name() -> str:
    """A column name that no caller's table has."""
    return f"_{uuid.uuid4().hex}"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
