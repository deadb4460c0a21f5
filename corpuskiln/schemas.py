"""Row types of the library."""

from __future__ import annotations

from pyspark.sql import types as T

SHAREGPT = "array<struct<from:string,value:string>>"
OPENAI = "array<struct<role:string,content:string,thinking:string>>"
TAGS = "array<string>"


def _turn(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


_KINDS = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "texts": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()), "sharegpt": _turn("from", "value"), "openai": _turn("role", "content", "thinking"),
}


def _schema(columns: str) -> T.StructType:
    """Columns written as `name kind`, comma-separated; the kind is string if left out."""
    parts = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(p[0], _KINDS[p[1] if len(p) > 1 else "string"]) for p in parts])


PROMPTS = _schema(
    "id, dataset_name, split, conversations sharegpt, messages openai, input, output, description, source, tags texts, created_at timestamp, has_embedding boolean"
)
INDEX = _schema("id, dataset_name, text, embedding floats, created_at timestamp")
NODES = _schema("id, label, path, ext, lang, lines int, size int, group, classes texts, functions texts, changed_by, change_time timestamp")
EDGES = _schema("id, source, target, type, label")
PLACES = _schema("source, pos int, prio int, candidate, type")
GGUF = _schema("id, filename, path, size_gb double, base_model, quantization, architecture, source, notes, registered_at timestamp, ollama_name")
LORA = _schema("id, filename, path, size_gb double, base_model, task, format, source, notes, registered_at timestamp, ollama_name")
CLAIM = "struct<text:string,lhs:string,rhs:string,claim_type:string,source:string>"
PAPER = "struct<title:string,authors:array<string>,abstract:string,categories:array<string>,arxiv_url:string,pdf_link:string,published:string,arxiv_id:string>"
MODELFILE = (
    "struct<base:string,system:string,template:string,license:string,parameters:map<string,array<string>>,adapters:array<string>,"
    "messages:array<struct<role:string,content:string>>>"
)
