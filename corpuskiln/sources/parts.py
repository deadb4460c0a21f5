"""A table as parts and versions: parts are never changed, a version's manifest names its parts, the rows deleted from them and where their counts are.

`<path>/<part>` holds rows, `<path>/<part>.counts` what they add to the statistics, `<path>/<n>.json` the n-th manifest. A manifest is written under
another name and renamed without overwriting, so it is whole or not there, and of two writers of one number the second one starts again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: So many parts of about one size are merged; a size is a power of MERGE rows.
MERGE = 8
FILE, ROW = "_file", "_row"
COUNTS = "what string, value string, n long"
EMPTY: dict = {"parts": [], "deletes": []}


class Taken(Exception):
    """Another writer has published this version."""


class PartTable:
    """counted: columns whose values are counted; marked: conditions whose rows are counted; key: the column of a Bloom filter in the files."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, counted: list[str], marked: dict[str, Callable[[], Column]], key: str | None = None):
        self.spark, self.path, self.schema, self.counted, self.marked, self.key = spark, path, schema, counted, marked, key
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def fs(self):
        return self.at("x").getFileSystem(self.conf)

    # ---- versions

    def versions(self) -> list[int]:
        folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in self.fs().listStatus(folder)] if self.fs().exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        stream = self.fs().open(self.at(f"{number:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """One listing and one small read, however many versions there are."""
        known = self.versions()
        return (known[-1], self.manifest(known[-1])) if known else (0, EMPTY)

    def publish(self, number: int, manifest: dict) -> None:
        unfinished = self.at(f"{uuid.uuid4().hex}.unfinished")
        out = self.fs().create(unfinished, False)
        out.writeBytes(json.dumps(manifest))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(unfinished.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(unfinished, self.at(f"{number:010d}.json"), options)
        except Py4JJavaError as error:
            self.fs().delete(unfinished, False)
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Taken(f"version {number} already exists") from error
            raise

    def change(self, make: Callable[[dict], dict]) -> None:
        """The next version is make(the newest one); again from a newer one if another writer comes first."""
        for _ in range(20):
            number, before = self.newest()
            after = make(before)
            try:
                self.publish(number + 1, after)
            except Taken:
                continue
            self.forget(number, before, after)
            return
        raise Taken(f"{self.path}: other writers came first 20 times")

    def forget(self, number: int, before: dict, after: dict) -> None:
        """Delete versions before the last two, and what only they name: a reader of the version before can go on."""
        names = lambda m: {x["name"] for x in (*m["parts"], *m["deletes"])}
        keep = names(before) | names(after)
        for old in (n for n in self.versions() if n < number):
            try:
                gone = names(self.manifest(old)) - keep
            except Py4JJavaError:  # another writer has deleted it
                continue
            for name in gone:
                for suffix in ("", ".counts", ".grams"):
                    self.fs().delete(self.at(name + suffix), True)
            self.fs().delete(self.at(f"{old:010d}.json"), False)

    # ---- rows

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        out = rows.write.option("compression", "snappy")
        if self.key in rows.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option(f"parquet.bloom.filter.candidates.number#{self.key}", "12")
        out.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def count(self, rows: DataFrame, name: str, sign: int = 1) -> int:
        """Write what these rows add to the counts (or take off); how many rows they are."""
        what = [(F.lit("rows"), F.lit(None).cast("string")), *((F.lit(c), F.col(c).cast("string")) for c in self.counted)]
        each = [F.struct(w.alias("what"), v.alias("value")) for w, v in what] + [F.when(f(), F.struct(F.lit(m).alias("what"), F.lit(None).cast("string").alias("value"))) for m, f in self.marked.items()]
        counts = rows.select(F.explode(F.array(*each)).alias("e")).where("e IS NOT NULL").groupBy("e.what", "e.value").agg((F.count("*") * sign).alias("n"))
        counts.write.parquet(f"{self.path}/{name}.counts")
        row = self.spark.read.schema(COUNTS).parquet(f"{self.path}/{name}.counts").where("what = 'rows'").first()
        return abs(row["n"]) if row else 0

    def part(self, rows: DataFrame) -> dict:
        """A new part of these rows, which no version names yet."""
        name = uuid.uuid4().hex
        return {"name": name, "rows": self.count(self.written(rows, name), name)}

    def read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def located(self, names: list[str]) -> DataFrame:
        return self.read(names).select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW)) if names else self.read([]).select("*", F.lit("").alias(FILE), F.lit(0).cast("long").alias(ROW))

    def live(self, manifest: dict, names: list[str] | None = None) -> DataFrame:
        """Rows of the parts (all by default) that no later write has deleted, with their places. Only parts that lost rows meet a join."""
        wanted = [p["name"] for p in manifest["parts"] if names is None or p["name"] in names]
        deletes = [d for d in manifest["deletes"] if {*d["parts"]} & {*wanted}]
        torn = {n for d in deletes for n in d["parts"]}
        rows = self.located([n for n in wanted if n not in torn])
        if not deletes:
            return rows
        gone = self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(*[f"{self.path}/{d['name']}" for d in deletes])
        return rows.unionByName(self.located([n for n in wanted if n in torn]).join(gone, [FILE, ROW], "left_anti"))

    def rows(self, manifest: dict, files: list[str] | None = None) -> DataFrame:
        """Live rows, or those of some files alone, which are then the only ones that are read."""
        if files is None:
            return self.live(manifest).drop(FILE, ROW)
        if not files:
            return self.read([])
        some = self.spark.read.schema(self.schema).parquet(*files).select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        if manifest["deletes"]:
            some = some.join(self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(*[f"{self.path}/{d['name']}" for d in manifest["deletes"]]), [FILE, ROW], "left_anti")
        return some.drop(FILE, ROW)

    # ---- writes

    def append(self, rows: DataFrame) -> None:
        """A new part; what is there is not read, but for merging parts of one size now and then."""
        part = self.part(rows)
        self.change(lambda m: self.merged({"parts": [*m["parts"], part], "deletes": m["deletes"]}))

    def replace(self, rows: DataFrame) -> None:
        part = self.part(rows)
        self.change(lambda m: {"parts": [part], "deletes": []})

    def upsert(self, rows: DataFrame, few: int = 1000, gone: DataFrame | None = None) -> None:
        """A new part of these rows, and the places of those that they replace: rows of an equal key that isn't empty, or of a key of `gone`, whose one column has keys.
        Nothing else is written, and of the parts only keys are read; up to `few` keys go to the files' Bloom filters and dictionaries, more meet the keys in a join."""
        part = self.part(rows)
        keys = (self.read([part["name"]]).select(self.key) if gone is None else gone).toDF("k").where("k <> ''").distinct()
        some = [r.k for r in keys.limit(few + 1).collect()]

        def make(m: dict) -> dict:
            after = {"parts": [*m["parts"], part], "deletes": m["deletes"]}
            if not some:
                return self.merged(after)
            there = self.live(m)
            hit = there.where(F.col(self.key).isin(some)) if len(some) <= few else there.join(keys, F.col(self.key) == F.col("k"), "left_semi")
            replaced = uuid.uuid4().hex
            found = self.written(hit.select(FILE, ROW, *self.schema.names), replaced)
            touched = {r[0] for r in found.select(FILE).distinct().collect()}  # files, of which a part has few
            if touched:
                after["deletes"] = [*m["deletes"], self.delete(found, [p["name"] for p in m["parts"] if touched & self.files(p["name"])])]
            self.fs().delete(self.at(replaced), True)
            return self.merged(after)

        self.change(make)

    def delete(self, rows: DataFrame, parts: list[str]) -> dict:
        """The places of these rows of these parts, with what they take off the counts; no version names it yet."""
        name = uuid.uuid4().hex
        self.written(rows.select(FILE, ROW), name)
        return {"name": name, "parts": parts, "rows": self.count(rows, name, -1)}

    def files(self, name: str) -> set[str]:
        return {s.getPath().getName() for s in self.fs().listStatus(self.at(name))}

    def merged(self, manifest: dict) -> dict:
        """The manifest with MERGE parts of about one size made one, if there are so many: a row is written log(rows) times at most. Their deleted rows go."""
        sizes: dict[int, list[dict]] = {}
        for p in manifest["parts"]:
            size = 0
            while MERGE ** (size + 1) <= p["rows"]:
                size += 1
            sizes.setdefault(size, []).append(p)
        for alike in sizes.values():
            if len(alike) >= MERGE:
                return self.merged(self.together(manifest, [p["name"] for p in alike]))
        return manifest

    def together(self, manifest: dict, names: list[str]) -> dict:
        """The manifest with these parts as one. Deletes that are of other parts too are written again for these alone, as their counts are over both."""
        whole = self.part(self.live(manifest, names).drop(FILE, ROW))
        deletes = []
        for d in manifest["deletes"]:
            left = [p for p in d["parts"] if p not in names]
            if len(left) == len(d["parts"]):
                deletes.append(d)
            elif left:
                gone = self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(f"{self.path}/{d['name']}")
                deletes.append(self.delete(self.located(left).join(gone, [FILE, ROW], "left_semi"), left))
        return {"parts": [*(p for p in manifest["parts"] if p["name"] not in names), whole], "deletes": deletes}

    def compact(self) -> None:
        """All live rows as one part, without deleted ones."""
        self.change(lambda m: self.together(m, [p["name"] for p in m["parts"]]) if len(m["parts"]) > 1 or m["deletes"] else m)

    # ---- counts

    def counts(self, manifest: dict) -> DataFrame:
        """(what, value, n) over the live rows; no row is read."""
        names = [x["name"] for x in (*manifest["parts"], *manifest["deletes"])]
        if not names:
            return self.spark.createDataFrame([], COUNTS)
        every = self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/{n}.counts" for n in names])
        return every.groupBy("what", "value").agg(F.sum("n").alias("n")).where("n <> 0")
