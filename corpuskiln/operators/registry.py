"""Registries of model files, and the text format that describes a served model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import none_if_empty, or_empty
from ..functions.text import architecture, basename, quantization, suffix
from ..schemas import GGUF, LORA, MODELFILE
from ..sources.store import conform

# Parameter names that the format knows.
PARAMETERS = ("num_ctx", "repeat_last_n", "repeat_penalty", "temperature", "seed", "stop", "num_predict", "top_k", "top_p", "min_p")


def _register(registry: DataFrame, found: DataFrame, schema, made: dict[str, Column], override: tuple[str, ...], refresh_size: bool) -> DataFrame:
    have = set(found.columns)
    new = found.select("path", *[c for c in schema.names if c in have and c != "path"])
    for name in schema.names:
        if name not in new.columns:
            new = new.withColumn(name, made.get(name, F.lit(None).cast(schema[name].dataType)))
        elif name in made and name != "size_gb":
            new = new.withColumn(name, F.coalesce(none_if_empty(F.col(name)), made[name]))
    new = new.dropDuplicates(["path"]).withColumn("size_gb", F.col("size_gb").cast("double"))
    o, n = registry.alias("o"), new.alias("n")
    cols = []
    for name in schema.names:
        old, fresh = F.col(f"o.{name}"), F.col(f"n.{name}")
        given = none_if_empty(fresh.cast("string")).cast(schema[name].dataType)
        if name == "path":
            c = F.coalesce(old, fresh)
        elif name == "size_gb":
            c = F.when(F.col("o.path").isNull(), F.round(fresh, 3)).otherwise(F.coalesce(fresh, old) if refresh_size else old)
        elif name in override:
            c = F.when(F.col("o.path").isNull(), fresh).when(F.lit(name in have), F.coalesce(given, old)).otherwise(old)
        else:
            c = F.when(F.col("o.path").isNull(), fresh).otherwise(old)
        cols.append(c.alias(name))
    return o.join(n, F.col("o.path") == F.col("n.path"), "full").select(*cols)


def register_gguf(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with found (path, and any of size_gb, base_model, quantization, architecture, source, notes): a known path takes
    non-empty values and the new size; a new one is filled in from its name, size rounded to 3 places."""
    name = basename(F.col("path"))
    made = {
        "id": F.sha2(F.col("path"), 256), "filename": name, "quantization": quantization(name), "architecture": architecture(name), "source": F.lit("manual"),
        "base_model": F.lit(""), "notes": F.lit(""), "ollama_name": F.lit(""), "registered_at": F.current_timestamp(),
    }
    return _register(registry, found, GGUF, made, ("base_model", "quantization", "architecture", "notes"), refresh_size=True)


def register_lora(registry: DataFrame, found: DataFrame) -> DataFrame:
    """As register_gguf for adapters: the format is gguf or safetensors by the ending, and a known path keeps its size."""
    made = {
        "id": F.sha2(F.col("path"), 256), "filename": basename(F.col("path")), "format": F.when(suffix(F.col("path")) == ".gguf", "gguf").otherwise("safetensors"), "task": F.lit(""),
        "source": F.lit("manual"), "base_model": F.lit(""), "notes": F.lit(""), "ollama_name": F.lit(""), "registered_at": F.current_timestamp(),
    }
    return _register(registry, found, LORA, made, ("base_model", "task", "notes"), refresh_size=False)


def empty_registry(spark, schema=GGUF) -> DataFrame:
    return conform(spark.createDataFrame([], schema), schema)


def mark_deployed(registry: DataFrame, path: str, name: str) -> DataFrame:
    return registry.withColumn("ollama_name", F.when(F.col("path") == path, name).otherwise(F.col("ollama_name")))


def find(registry: DataFrame, name_or_path: str) -> DataFrame:
    return registry.where((F.col("filename") == name_or_path) | (F.col("path") == name_or_path)).orderBy("path").limit(1)


def for_task(registry: DataFrame, task: str) -> DataFrame:
    return registry.where(or_empty(F.col("task")).rlike(f"(?i){task}"))


def listing(registry: DataFrame, verbose: bool = False) -> DataFrame:
    return registry if verbose else registry.select("filename", "size_gb", "quantization", "architecture", "ollama_name")


def repo_listing(files: DataFrame, name_col: str = "name") -> DataFrame:
    """Files of a model repository in order, model files marked and labelled with their quantization."""
    n = F.col(name_col)
    return files.select(n.alias("name"), n.endswith(".gguf").alias("is_model"), F.when(n.endswith(".gguf"), quantization(n)).otherwise("").alias("label")).orderBy("name")


def inventory(models: DataFrame) -> DataFrame:
    """(name, gigabytes, day) of served models with size in bytes and an ISO time."""
    return models.select("name", F.round(F.col("size") / 1e9, 1).alias("gigabytes"), F.substring("modified", 1, 10).alias("day"))


def recent(openings: DataFrame, key: str, ts: str, most: int = 10) -> DataFrame:
    """The last opened distinct keys, newest first."""
    return openings.groupBy(key).agg(F.max(ts).alias("last")).orderBy(F.desc("last"), key).limit(most)


# ---- model description files


def read_modelfile(text: str) -> dict | None:
    """Directives of a description; None if a quoted block does not end."""
    out: dict = {"base": None, "system": None, "template": None, "license": None, "parameters": {}, "adapters": [], "messages": []}
    lines = iter((text or "").splitlines())
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        word, rest = word.upper(), rest.strip()
        if not rest or word.startswith("#"):
            continue
        if word in ("SYSTEM", "TEMPLATE") and rest.startswith('"""'):
            body = rest[3:]
            while not body.endswith('"""'):
                more = next(lines, None)
                if more is None:
                    return None
                body += "\n" + more
            body = body[:-3]
            out[word.lower()] = body.strip() if word == "SYSTEM" else body
        elif word in ("SYSTEM", "TEMPLATE", "LICENSE"):
            out[word.lower()] = rest
        elif word == "FROM":
            out["base"] = rest
        elif word == "PARAMETER":
            key, _, value = rest.partition(" ")
            out["parameters"].setdefault(key.lower(), []).append(value)
        elif word == "ADAPTER":
            out["adapters"].append(rest)
        elif word == "MESSAGE":
            role, _, content = rest.partition(" ")
            out["messages"].append({"role": role, "content": content})
    return out


def parse_modelfile(text: Column) -> Column:
    @F.pandas_udf(MODELFILE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [read_modelfile(t) or {} for t in texts]
        return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("base", "system", "template", "license", "parameters", "adapters", "messages")}, dtype=object)

    return parse(or_empty(text))


def render_modelfile(m: Column) -> Column:
    """The description as text in a fixed order; null without a base."""
    block = lambda word, c: F.format_string(f'{word} """\n%s\n"""', c)
    system = F.when(F.contains(m["system"], F.lit("\n")), block("SYSTEM", m["system"])).otherwise(F.concat(F.lit("SYSTEM "), m["system"]))
    some = lambda c, then: F.when(or_empty(c) != "", then)
    params = F.flatten(F.transform(F.map_entries(m["parameters"]), lambda e: F.transform(e["value"], lambda v: F.concat_ws(" ", F.lit("PARAMETER"), e["key"], v))))
    lines = F.concat(
        F.array(F.concat(F.lit("FROM "), m["base"]), some(m["system"], system), some(m["template"], block("TEMPLATE", m["template"]))), F.coalesce(params, F.array().cast("array<string>")),
        F.coalesce(F.transform(m["adapters"], lambda a: F.concat(F.lit("ADAPTER "), a)), F.array().cast("array<string>")),
        F.coalesce(F.transform(m["messages"], lambda x: F.concat_ws(" ", F.lit("MESSAGE"), x["role"], x["content"])), F.array().cast("array<string>")),
        F.array(some(m["license"], F.concat(F.lit("LICENSE "), m["license"]))),
    )
    return F.when(or_empty(m["base"]) != "", F.concat(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n")))


def typed_parameters(parameters: Column) -> Column:
    """array<struct key, long_value, double_value, text_values>: whole numbers, numbers with a point, other text; stop stays a list. Unknown names are left out."""

    def one(e: Column) -> Column:
        v, stop = F.get(e["value"], F.lit(0)), e["key"] == "stop"
        whole = F.when(~stop & ~F.contains(v, F.lit(".")), v.try_cast("long"))
        real = F.when(~stop & F.contains(v, F.lit(".")), v.try_cast("double"))
        text = F.when(stop | (whole.isNull() & real.isNull()), e["value"])
        return F.struct(e["key"].alias("key"), whole.alias("long_value"), real.alias("double_value"), text.alias("text_values"))

    return F.transform(F.filter(F.map_entries(parameters), lambda e: e["key"].isin(*PARAMETERS)), one)


# ---- narration scripts


def script_sections(scripts: DataFrame, id_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """(id, section_no, name, slug, text): headings open sections; fenced code, quotes, dividers and stage lines go,
    inline stage notes, time marks and markup too; sections without text are dropped."""
    line = scripts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("pos", "line"))
    order = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.startswith(F.trim("line"), F.lit("```"))
    marked = line.withColumn("fence", fence).withColumn("inside", F.sum(F.col("fence").cast("int")).over(order) % 2 == 1)
    open_ = marked.where("NOT fence AND NOT inside AND NOT startswith(line, '>')").where(~F.col("line").rlike(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$") & ~F.col("line").rlike(r"(?i)^\s*\[B-ROLL[^\]]*\]\s*$"))
    heading = r"^#{1,6}\s+(.+?)\s*$"
    numbered = open_.withColumn("is_heading", F.col("line").rlike(heading)).withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(order))
    bare = F.regexp_replace(F.regexp_replace("line", r"(?i)\[B-ROLL[^\]]*\]", ""), r"\(\d+:\d{2}\s*[–—-]\s*\d+:\d{2}\)", "")
    said = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[*_~`|\\<>]", ""), r"[ \t]+", " "))
    out = numbered.withColumn("said", F.when(~F.col("is_heading"), said)).groupBy("id", "section_no").agg(
        F.coalesce(F.max(F.when(F.col("is_heading"), F.trim(F.regexp_extract("line", heading, 1)))), F.lit("intro")).alias("name"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: or_empty(x["said"]) != ""), lambda x: x["said"]), " ").alias("text"),
    )
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("name"), r"(?U)[^\w]+", "_"), r"\A_+|_+\z", ""), 1, 40)
    return out.where("text <> ''").select(F.col("id").alias(id_col), "section_no", "name", slug.alias("slug"), "text")
