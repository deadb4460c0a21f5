"""Streams with a value for each key, forgotten after a silence: vector drift and speech onsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .machines import Onset
from .stateful import IDLE_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Values that expire need this state store; a checkpoint that exists keeps its own."""
    spark.conf.set(PROVIDER, ROCKSDB)


def in_one(parts: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def turned(one, two) -> float | None:
    """1 - cosine; 1 where a vector is zero, None where one is missing or their lengths differ."""
    if one is None or two is None or len(one) != len(two):
        return None
    a, b = np.asarray(one, float), np.asarray(two, float)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 - float(a @ b) / size if size else 1.0


class Drift(StatefulProcessor):
    """The last vector of each key; a new version's distance from it."""

    def __init__(self, order: str, vector: str, rolling: bool, idle_ms: int):
        self.order, self.vector, self.rolling, self.idle_ms = order, vector, rolling, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "known boolean, v array<double>", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        known, last = self.last.get() if self.last.exists() else (False, None)
        new, out = in_one(rows, self.order), []
        for at, v in zip(new[self.order], new[self.vector]):
            vector = None if v is None else [float(x) for x in v]
            out.append((key[0], at, turned(last, vector) if known else None))
            if self.rolling or not known:
                known, last = True, vector
        self.last.update((True, last))  # also sets its time anew
        yield pd.DataFrame(out, columns=["key", "at", "drift"])


def stream_drift(versions: DataFrame, key: str, order: str, vector: str = "embedding", against: str = "previous", idle_ms: int = IDLE_MS) -> DataFrame:
    """(key, order, drift) of a stream of versions that come in order over batches, as operators.vectors.drift has it for a finite table: 1 - cosine to the version
    before (or, against `first`, to the first one), to 4 places, null for the first. A key silent for idle_ms is forgotten: its next version is a first one."""
    with_rocksdb(versions.sparkSession)
    kinds = dict(versions.dtypes)
    rows = versions.select(key, order, F.col(vector).cast("array<double>").alias(vector))
    found = rows.groupBy(key).transformWithStateInPandas(Drift(order, vector, against != "first", idle_ms), f"key {kinds[key]}, at {kinds[order]}, drift double", "Append", "ProcessingTime")
    return found.select(F.col("key").alias(key), F.col("at").alias(order), F.round("drift", 4).alias("drift"))


class Onsets(StatefulProcessor):
    """The counter of each stream and the frames it keeps."""

    def __init__(self, level: int, keep: int, idle_ms: int):
        self.level, self.keep, self.idle_ms = level, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heard = handle.getValueState("heard", "count int, kept array<bigint>", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        count, before = self.heard.get() if self.heard.exists() else (0, [])
        machine = Onset(self.level, self.keep, int(count), [int(x) for x in before])
        new = in_one(rows, "frame_no")
        hits = [(frame, hit) for frame, speech in zip(new["frame_no"].tolist(), new["is_speech"].tolist()) if (hit := machine.feed(frame, speech)) is not None]
        self.heard.update((machine.count, machine.before))
        yield pd.DataFrame({"stream_id": pd.Series([key[0]] * len(hits), dtype=object), "frame_no": [f for f, _ in hits], "buffered": pd.Series([b for _, b in hits], dtype=object)})


def stream_onsets(frames: DataFrame, level: int = 3, keep: int = 5, idle_ms: int = IDLE_MS) -> DataFrame:
    """(stream_id, frame_no, buffered) of a stream of frames that come in order over batches, as `onsets` has it for a finite table. A stream silent for
    idle_ms starts anew."""
    with_rocksdb(frames.sparkSession)
    kind = dict(frames.dtypes)["stream_id"]
    rows = frames.select("stream_id", F.col("frame_no").cast("bigint").alias("frame_no"), F.coalesce("is_speech", F.lit(False)).alias("is_speech")).where("frame_no IS NOT NULL")
    return rows.groupBy("stream_id").transformWithStateInPandas(Onsets(level, keep, idle_ms), f"stream_id {kind}, frame_no bigint, buffered array<bigint>", "Append", "ProcessingTime")
