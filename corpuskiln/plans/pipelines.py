"""Whole flows: documents to training conversations, prompts to a vector index, a file tree to a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import formats, text
from ..functions.chunks import chunk_document as chunks_of
from ..functions.stored import stored
from ..operators import graph, quality, vectors
from ..operators.providers import Provider, apply_provider


def document_chunks(docs: DataFrame, most_chunks: int | None = 20) -> DataFrame:
    """(path, doc_type, pos, chunk) of (path, text): chunked by kind, at most `most_chunks` a document (None: all)."""
    kind = text.doc_type(F.col("path"))
    chunks = chunks_of(F.col("text"), F.col("doc_type"))
    listed = docs.withColumn("doc_type", kind).withColumn("chunks", chunks)
    some = F.col("chunks") if most_chunks is None else F.slice("chunks", 1, most_chunks)
    return listed.select("path", "doc_type", F.posexplode(some).alias("pos", "chunk"))


def generate_conversations(
    chunks: DataFrame, generator: Callable[[], Provider], moderator: Callable[[], Provider] | None = None, system: str = "You are a helpful AI assistant."
) -> tuple[DataFrame, DataFrame]:
    """(conversations, run stats): chunk -> prompt -> model -> parsed items -> moderation. Conversations are (path, pos,
    messages); stats are (path, made, kept, failed). A failed generation makes none; a failed verdict drops its talk."""
    asked = chunks.withColumn("prompt", text.persona_prompt(F.col("doc_type"), F.col("chunk")))
    answered = apply_provider(asked, generator, "prompt", "reply", "string")
    talks = answered.select("path", "pos", F.explode_outer(formats.triplets(F.col("reply"), F.lit(system))).alias("messages"))
    if moderator is None:
        judged = talks.withColumn("harm", F.lit(False))
    else:
        checked = talks.withColumn("said", quality.moderation_text(F.col("messages")))
        judged = apply_provider(checked, moderator, "said", "verdict", "string").withColumn("harm", quality.flagged(F.col("verdict"))).drop("said", "verdict")
    judged = stored(judged, "judged")  # both results read it, and the models are asked once
    real = judged.where("messages IS NOT NULL")
    stats = judged.groupBy("path").agg(
        F.count("messages").alias("made"), F.count_if(F.col("messages").isNotNull() & ~F.col("harm")).alias("kept"), F.count_if(F.col("messages").isNull() | F.col("harm")).alias("failed")
    )
    return quality.moderate(real).drop("harm"), stats


def index_prompts(prompts: DataFrame, index: DataFrame, embedder: Callable[[], Provider]) -> tuple[DataFrame, DataFrame]:
    """(new index, prompts with has_embedding) after embedding what the index lacks."""
    grown = vectors.build_index(prompts, index, embedder)
    return grown, vectors.flag_indexed(prompts, grown)


def file_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree's (path, text)."""
    return graph.nodes(files), graph.edges(files)
