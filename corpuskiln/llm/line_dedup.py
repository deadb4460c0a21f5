"""Line deduplication, all in built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, ascii_lower, own_name, without, written


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that many documents share; keep them in the document of the largest id.

    Returns docs with the text cut down to its kept lines, plus n_lines and n_dropped (which
    replace columns of those names). A line counts once for each id that holds it, so repeated
    rows of one id are one document, and rows of a null id are one document that is never the
    largest. Null or empty text is one empty line and becomes empty text. Keys under min_chars
    code points are never dropped. Keys are compared by two 64-bit hashes.

    Each line is hashed once, into a written table. Only hashes are shuffled for the counts; a hot line is summed before the
    shuffle, and its rows meet its verdict in a join that AQE can split. Texts are shuffled once, as arrays of
    lines, to meet the positions that they lose. Other columns of docs stay whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows of one id and one text lose the same lines: (id, hash of text) names what to drop.
    lines = written(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")),
        "line-hashes",
    )
    counted = (
        lines.groupBy("h", "g", "id").agg(F.count("*").alias("n"))
        .groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs).drop("n")
    )
    shared = written(counted, "shared-lines")  # AQE splits skewed joins of exchanges only, not of aggregates
    lost_id, lost_version, lost_pos, parts, version = (own_name() for _ in range(5))
    lost = (
        lines.join(shared, ["h", "g"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias(lost_id), F.col("version").alias(lost_version)).agg(F.collect_set("pos").alias(lost_pos))
    )
    base = without(docs, "n_lines", "n_dropped")
    named = base.withColumns({parts: F.split(text, "\n"), version: F.xxhash64(text)}).drop(text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost_pos))
    cut = F.when(F.col(lost_pos).isNull(), F.array_join(parts, "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(parts), i)), "\n")
    )
    return named.join(lost, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(version) == F.col(lost_version)), "left").select(
        *[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost_pos), F.lit(0)).cast("long").alias("n_dropped"),
    )
