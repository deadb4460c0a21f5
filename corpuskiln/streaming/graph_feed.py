"""A reference graph kept up to date by a feed of file changes: only references from or to what changed are resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stored import stored
from ..functions.text import slashes
from ..operators import graph
from ..schemas import EDGES, NODES, PLACES
from ..sources.parts import PartTable


class GraphView:
    """Nodes, edges and the candidates of every reference under a root folder, each a PartTable.

    A change is (file, text, by, ts); a null text deletes the file. A file's own references are parsed again when it changes. Those of others can only lead elsewhere
    if a file that one of their candidates names has appeared or gone, so these are found by the candidates kept, without parsing.
    Tables change in such an order that the same batch may come again after a failure: what has appeared is told by the nodes, which change last.
    """

    def __init__(self, spark: SparkSession, root: str):
        table = lambda name, schema, key: PartTable(spark, f"{root.rstrip('/')}/{name}", schema, [], {}, key)
        self.node_table, self.edge_table, self.place_table = table("nodes", NODES, "id"), table("edges", EDGES, "source"), table("places", PLACES, "source")

    @staticmethod
    def rows(table: PartTable) -> DataFrame:
        return table.rows(table.newest()[1])

    def nodes(self) -> DataFrame:
        return self.rows(self.node_table)

    def edges(self) -> DataFrame:
        return self.rows(self.edge_table)

    def apply(self, changes: DataFrame) -> None:
        """One batch: the last change of each file, by ts and then by author."""
        last = changes.where("file IS NOT NULL").groupBy(slashes(F.col("file")).alias("path")).agg(F.max_by(F.struct("text", "by", F.col("ts").cast("timestamp").alias("ts")), F.struct("ts", "by")).alias("c"))
        batch = stored(last.select("path", "c.text", "c.by", "c.ts"), "changes")
        if batch.isEmpty():
            return
        there, ids = batch.where("text IS NOT NULL"), self.nodes().select("id")
        changed = batch.select("path")
        appeared = there.select("path").join(ids, F.col("path") == F.col("id"), "left_anti")
        gone = batch.where("text IS NULL").select("path").join(ids, F.col("path") == F.col("id"), "left_semi")
        moved = stored(appeared.union(gone).toDF("candidate"), "moved")

        others = self.rows(self.place_table).join(moved, "candidate", "left_semi").select("source")
        touched = stored(others.union(changed).distinct().toDF("source"), "touched")
        self.place_table.upsert(self.conformed(graph.candidates(there.select("path", "text")), self.place_table), gone=changed)

        now = ids.join(changed, F.col("id") == F.col("path"), "left_anti").union(there.select("path"))
        again = self.rows(self.place_table).join(touched, "source", "left_semi")
        self.edge_table.upsert(self.conformed(graph.resolved(again, now), self.edge_table), gone=touched)

        parsed = graph.nodes(there.select("path", "text")).drop("changed_by", "change_time")
        said = there.select(F.col("path").alias("id"), F.col("by").alias("changed_by"), F.col("ts").alias("change_time"))
        self.node_table.upsert(self.conformed(parsed.join(said, "id"), self.node_table), gone=changed)

    @staticmethod
    def conformed(rows: DataFrame, table: PartTable) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields])

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a stream of changes batch by batch."""
        return changes.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
