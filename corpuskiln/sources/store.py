"""A store of prompt datasets: one Parquet folder for each, typed rows, staged writes.

Rows live in the parts of a PartTable, `<root>/prompts/<name>`. A change writes
a new part and then the next manifest, so readers never see half a write and no path is overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import formats
from ..functions.common import none_if_empty, or_empty, strip
from ..functions.stored import stored
from ..functions.text import contains_any
from ..schemas import INDEX, OPENAI, PROMPTS, SHAREGPT, TAGS
from . import grams
from .parts import COUNTS, FILE, PartTable

SEARCHED = ["input", "output", "description", "conversations", "tags"]
DEFAULT_SYSTEM = "You are a helpful AI assistant."


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order; absent ones are false for booleans and null otherwise, strings are never null."""
    have = {c.lower() for c in rows.columns}
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        elif isinstance(f.dataType, T.StringType):
            c = or_empty(c)
        cols.append(c.alias(f.name))
    return rows.select(*cols)


def prompt_rows(rows: DataFrame, dataset: str, split: str = "train", source: str = "manual", flatten: bool = True) -> DataFrame:
    """Rows with any of conversations (turns), messages, input, output, description, split, source and tags as store rows.

    A conversation given in one format is kept in both. Rows without one get up to two turns made from input and output.
    flatten fills empty input and output from the first human and assistant turns.
    """
    have = {c.lower() for c in rows.columns}
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    given = lambda c: F.when(F.size(c) > 0, c)
    turns, messages = given(col("conversations", SHAREGPT)), given(col("messages", OPENAI))
    asked, said = or_empty(col("input", "string")), or_empty(col("output", "string"))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    made = F.filter(F.array(turn("human", asked), turn("gpt", said)), lambda t: t["value"] != "")
    both = F.coalesce(turns, formats.to_sharegpt(messages))
    fill = lambda own, *names: F.when((own == "") & F.lit(flatten) & both.isNotNull(), formats.first_value(both, *names)).otherwise(own)
    out = rows.select(
        F.uuid().alias("id"), F.lit(dataset).alias("dataset_name"), F.coalesce(none_if_empty(col("split", "string")), F.lit(split)).alias("split"),
        F.coalesce(both, made).alias("conversations"), F.coalesce(messages, formats.to_openai(turns)).alias("messages"), fill(asked, "human").alias("input"),
        fill(said, "gpt", "assistant").alias("output"), col("description", "string").alias("description"),
        F.coalesce(none_if_empty(col("source", "string")), F.lit(source or "manual")).alias("source"), col("tags", TAGS).alias("tags"),
        F.current_timestamp().alias("created_at"), F.lit(False).alias("has_embedding"),
    )
    return conform(out, PROMPTS)


def upsert(current: DataFrame, rows: DataFrame, key: str = "input", dedupe: str | None = None) -> DataFrame:
    """current without rows whose key is in rows, then all rows. Empty and null keys replace nothing;
    equal keys inside rows all stay, or with dedupe='last' the newest (by created_at, then id)."""
    if dedupe == "last":
        newest = rows.groupBy(key).agg(F.max(F.struct("created_at", "id")).alias("newest")).select(F.col(key).alias("k"), F.col("newest.id").alias("i"))
        rows = rows.join(newest, rows[key].eqNullSafe(newest["k"]) & (rows["id"] == newest["i"]), "left_semi")
    keys = rows.where(or_empty(F.col(key)) != "").select(F.col(key).alias("replaced")).distinct()
    return current.join(keys, current[key] == keys["replaced"], "left_anti").unionByName(rows)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def histogram(rows: DataFrame, column: str, most: int = 1000) -> DataFrame:
    top = value_counts(rows, column).orderBy(F.desc("count"), "value").limit(most)
    return top.agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias(f"{column}s"))


def stats(rows: DataFrame) -> DataFrame:
    """One row: total_rows, has_output, has_embedding, and histograms of split and source: arrays of their most frequent values (a thousand at most), sorted.
    value_counts has all of them as rows."""
    total = rows.agg(
        F.count("*").alias("total_rows"), F.count_if(or_empty(F.col("output")) != "").alias("has_output"), F.count_if("has_embedding").alias("has_embedding")
    )
    return total.join(F.broadcast(histogram(rows, "split"))).join(F.broadcast(histogram(rows, "source")))  # one row each, of bounded size


def catalog(rows: DataFrame) -> DataFrame:
    """(dataset_name, split, n) over rows of several datasets."""
    return rows.groupBy("dataset_name", "split").agg(F.count("*").alias("n"))


def searched(rows: DataFrame, columns: list[str] | None = None) -> dict[str, Column]:
    """The text that a search looks at, by column; unknown names are dropped."""
    kinds = dict(rows.dtypes)

    def as_text(c: str) -> Column:
        if kinds[c].startswith("array<struct"):
            return F.array_join(F.transform(c, lambda t: or_empty(t["value"])), "\n")
        return F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")

    return {c: as_text(c) for c in columns or SEARCHED if c in rows.columns}


def search(rows: DataFrame, query: str, columns: list[str] | None = None, regex: bool = False) -> DataFrame:
    """Keyword search, in any case, over the text of the named columns; unknown names are dropped."""
    return rows.where(contains_any(query, list(searched(rows, columns).values()), regex))


def sft_rows(talks: DataFrame, language: str = "English", default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Fine-tuning rows of talks with a `messages` column: the first system, user and assistant message; user and assistant are needed."""
    system, user, answer = (formats.first_message(F.col("messages"), r) for r in ("system", "user", "assistant"))
    first = talks.select("*", system.alias("_system"), user.alias("_user"), answer.alias("_answer")).where("_user IS NOT NULL AND _answer IS NOT NULL")
    developer = F.when(F.col("_system").isNotNull(), or_empty(F.col("_system.content"))).otherwise(default_system)
    analysis, final = strip(or_empty(F.col("_answer.thinking"))), strip(or_empty(F.col("_answer.content")))
    none = F.lit(None).cast("string")
    message = lambda role, content, thinking: F.struct(F.lit(role).alias("role"), content.alias("content"), thinking.alias("thinking"))
    whole = F.array(
        message("system", F.concat(F.lit(f"reasoning language: {language}\n\n"), developer), none), message("user", or_empty(F.col("_user.content")), none),
        message("assistant", final, none_if_empty(analysis)),
    )
    keep = [c for c in talks.columns if c != "messages"]
    return first.select(
        *keep, F.lit(language).alias("reasoning_language"), developer.alias("developer"), or_empty(F.col("_user.content")).alias("user"), analysis.alias("analysis"),
        final.alias("final"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("messages"),
    )


def sharegpt_lines(rows: DataFrame) -> DataFrame:
    """(value): one JSON line {"conversations": [...]} for every row with turns."""
    return rows.where(F.size("conversations") > 0).select(F.to_json(F.struct("conversations")).alias("value"))


def view(rows: DataFrame, row: int | None = None, most: int | None = 5) -> DataFrame:
    """Turns of the first `most` rows by id (0 or None: all) or of the row-th: (id, pos, from, value); rows without turns show input and output."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    turns = F.when(F.size("conversations") > 0, F.col("conversations")).otherwise(F.array(turn("human", "input"), turn("gpt", "output")))
    ordered = rows.orderBy("id")
    some = ordered.offset(row).limit(1) if row is not None else ordered.limit(most) if most else ordered
    return some.select("id", F.posexplode(turns).alias("pos", "turn")).select("id", "pos", "turn.from", "turn.value")


class PromptStore:
    """Named datasets under a root folder of any Hadoop file system."""

    kind, schema, counted, key = "prompts", PROMPTS, ["split", "source"], "input"
    marked = {"output": lambda: or_empty(F.col("output")) != "", "embedding": lambda: F.col("has_embedding")}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str) -> PartTable:
        path = f"{self.root}/{self.kind}/{name.replace('/', '_').replace(chr(92), '_')}"
        return PartTable(self.spark, path, self.schema, self.counted, self.marked, self.key)

    def _versions(self, name: str) -> list[tuple[int, dict]]:
        """(number, manifest) of the versions there are, oldest first."""
        table = self._table(name)
        return [(n, table.manifest(n)) for n in table.versions()]

    def _publish(self, name: str, number: int, parts: list[dict]) -> None:
        """This version is these parts. Two writers of one number: the second one fails here and changes nothing."""
        self._table(name).publish(number, {"parts": parts, "deletes": []})

    def load(self, name: str, split: str | None = None) -> DataFrame:
        """All rows, or those of a split; a missing dataset is empty. Absent columns are filled in."""
        table = self._table(name)
        rows = conform(table.rows(table.newest()[1]), self.schema)
        return rows.where(F.col("split") == split) if split else rows

    def save(self, name: str, rows: DataFrame) -> None:
        """The dataset becomes these rows."""
        self._table(name).replace(conform(rows, self.schema))

    def append(self, name: str, rows: DataFrame, split: str = "train", source: str = "manual", flatten: bool = True) -> None:
        """New rows are a new part."""
        self._table(name).append(conform(prompt_rows(rows, name, split, source, flatten), self.schema))

    def compact(self, name: str) -> None:
        """One part without deleted rows; the rows stay the same."""
        self._table(name).compact()

    def add_conversation(self, name: str, rows: DataFrame, **options) -> None:
        self.append(name, rows, **options)

    def add_prompt(self, name: str, rows: DataFrame, **options) -> None:
        self.append(name, rows.select(*[c for c in rows.columns if c not in ("messages", "conversations")]), **options)

    def add_batch(self, name: str, rows: DataFrame, split: str = "train", source: str = "manual") -> None:
        self.append(name, rows, split, source, flatten=False)

    def upsert(self, name: str, rows: DataFrame, split: str = "train", source: str = "manual", dedupe: str | None = None) -> None:
        """As the function upsert over the dataset, but written are only the new rows and the places of those replaced."""
        new = prompt_rows(rows, name, split, source, flatten=False)
        if dedupe == "last":  # the newest of equal keys; rows made here are of one time, so the ids, made once, must be settled
            new = stored(new, "prompts")
            new = upsert(new.limit(0), new, dedupe="last")
        self._table(name).upsert(conform(new, self.schema))

    def get(self, name: str, row_id: str) -> DataFrame:
        return self.load(name).where(F.col("id") == row_id).limit(1)

    def index_text(self, name: str) -> None:
        """Give every part that has none its index of trigrams; searches then read only files that may have a hit."""
        table = self._table(name)
        for part in table.newest()[1]["parts"]:  # parts are few: they are merged by size
            if not table.fs().exists(table.at(f"{part['name']}.grams")):
                rows = table.located([part["name"]])
                grams.build(rows, searched(rows), FILE).write.parquet(f"{table.path}/{part['name']}.grams")

    def files_to_search(self, name: str, query: str, columns: list[str] | None = None) -> tuple[list[str], int]:
        """(files that may hold the query in one of the columns, by path; how many files there are). Files of parts without an index are all in."""
        table = self._table(name)
        wanted, every, known = [], 0, {}
        for part in table.newest()[1]["parts"]:
            files = [f"{table.path}/{part['name']}/{f}" for f in sorted(table.files(part["name"])) if f.endswith(".parquet")]
            every += len(files)
            if len(query) >= grams.SIZE and table.fs().exists(table.at(f"{part['name']}.grams")):
                known |= {f.rsplit("/", 1)[1]: f for f in files}
            else:
                wanted += files
        if known:
            folders = {f"{f.rsplit('/', 1)[0]}.grams" for f in known.values()}
            index = self.spark.read.schema(grams.SCHEMA).parquet(*sorted(folders))
            hits = grams.may_hold(index, query.lower(), list(searched(table.read([]), columns)))
            wanted += [known[r.file] for r in hits.collect() if r.file in known]  # names of files
        return sorted(wanted), every

    def search(self, name: str, query: str, columns: list[str] | None = None, regex: bool = False) -> DataFrame:
        if regex:
            return search(self.load(name), query, columns, regex)
        table = self._table(name)
        files, every = self.files_to_search(name, query, columns)
        return search(conform(table.rows(table.newest()[1], None if len(files) == every else files), self.schema), query, columns)

    def stats(self, name: str) -> DataFrame:
        """As the function stats over the dataset, from the counts kept with its parts: no row is read."""
        table = self._table(name)
        counts = table.counts(table.newest()[1])
        n = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
        total = counts.agg(n("rows"), n("output"), n("embedding")).toDF("total_rows", "has_output", "has_embedding")
        for column in self.counted:
            top = counts.where(F.col("what") == column).select("value", F.col("n").alias("count")).orderBy(F.desc("count"), "value").limit(1000)
            total = total.join(F.broadcast(top.agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias(f"{column}s"))))  # one row each, of bounded size
        return total

    def value_counts(self, name: str, column: str) -> DataFrame:
        """(value, count) of split or source, all of them, from the parts' counts."""
        table = self._table(name)
        return table.counts(table.newest()[1]).where(F.col("what") == column).select("value", F.col("n").alias("count"))

    def names(self) -> list[str]:
        path = self._table("x").at("x").getParent().getParent()
        fs = self._table("x").fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def catalog(self) -> DataFrame:
        """(dataset_name, split, n, kilobytes, error) of all datasets, from the counts kept with their parts, in one job; a dataset whose
        manifest or counts are missing has a row with its error only."""
        sizes, paths = [], []
        for name in self.names():  # files are listed here, rows and counts aren't read
            table = self._table(name)
            try:
                _, manifest = table.newest()
                own = [f"{table.path}/{x['name']}.counts" for x in (*manifest["parts"], *manifest["deletes"])]
                for p in own:
                    table.fs().getFileStatus(table.at(p.rsplit("/", 1)[1]))
                size = table.fs().getContentSummary(table.at("x").getParent()).getLength() // 1024
                sizes.append((name, size, None))
                paths += own
            except Exception as e:  # noqa: BLE001  whatever a broken dataset raises is its row
                sizes.append((name, None, str(getattr(e, "java_exception", None) or e).split("\n")[0]))
        known = self.spark.createDataFrame(sizes, "dataset_name string, kilobytes long, error string")
        if not paths:
            return known.select("dataset_name", F.lit(None).cast("string").alias("split"), F.lit(None).cast("long").alias("n"), "kilobytes", "error").where("error IS NOT NULL")
        counts = self.spark.read.schema(COUNTS).parquet(*paths).withColumn("dataset_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
        by = "split" if "split" in self.counted else "rows"
        n = counts.where(F.col("what") == by).groupBy("dataset_name", F.col("value").alias("split")).agg(F.sum("n").alias("n")).where("n > 0")
        return known.join(n, "dataset_name", "left").where("n IS NOT NULL OR error IS NOT NULL").select("dataset_name", "split", "n", "kilobytes", "error")

    def export_sharegpt(self, name: str, path: str, split: str | None = "train") -> None:
        sharegpt_lines(self.load(name, split)).write.text(path)

    def export_sft(self, name: str, path: str, split: str | None = "train", language: str = "English") -> str:
        """Fine-tuning rows as Parquet; without any row nothing is written and the result is empty."""
        talks = self.load(name, split).select(formats.resolve_messages(F.col("messages"), F.col("conversations")).alias("messages"))
        rows = sft_rows(talks, language)
        if rows.isEmpty():
            return ""
        rows.write.option("compression", "snappy").parquet(path)
        return path

    def drop(self, name: str) -> bool:
        table = self._table(name)
        return bool(table.fs().delete(table.at("x").getParent(), True))

    def seed(self, name: str, system_prompt: str, helpers: list[tuple[str, str]]) -> None:
        """A system prompt and helper prompts, added once however often this runs."""
        rows = [(f"system: {name}", system_prompt), *helpers]
        self.upsert(name, self.spark.createDataFrame(rows, "input string, output string"), source="seed")


class VectorIndex(PromptStore):
    """Vector indexes by dataset name, stored and published like prompt datasets."""

    kind, schema, counted, key, marked = "index", INDEX, [], None, {}

    def listing(self) -> DataFrame:
        """(name, count, kilobytes, error) of all indexes."""
        return self.catalog().groupBy(F.col("dataset_name").alias("name")).agg(F.sum("n").alias("count"), F.max("kilobytes").alias("kilobytes"), F.max("error").alias("error"))
