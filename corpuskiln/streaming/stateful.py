"""The state machines over DataFrames: finite tables, and streams through applyInPandasWithState."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean, speech_chunks, suffix
from .machines import Segmenter, SentenceBuffer, Throttle
from .scans import SLICE, OnsetScan, SegmentScan, ThrottleScan, scan

# Endings whose changes are watched.
WATCHED = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".md", ".mdx", ".markdown", ".sh", ".bash", ".zsh", ".ps1", ".psm1", ".psd1", ".json", ".yaml", ".yml", ".toml",
    ".env", ".cfg", ".ini", ".conf", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".rs", ".go", ".rb", ".java", ".cs", ".lua", ".sql", ".c", ".h", ".cpp",
    ".cc", ".cxx", ".hpp",
)


#: A key that is silent for so long is forgotten: states don't pile up.
IDLE_MS = 3_600_000


def watched(changes: DataFrame, path_col: str = "file") -> DataFrame:
    return changes.where(suffix(F.col(path_col)).isin(*WATCHED))


def same_key(a, b) -> bool:
    """Equal, or both null: a null number arrives as NaN, which differs from itself."""
    return a == b or bool(pd.isna(a) and pd.isna(b))


def throttle(events: DataFrame, key: str, ts: str, seconds: float, tie: str, slice_rows: int = 20_000) -> DataFrame:
    """Accepted events of a finite table, ties in time by the tie column; events without a time are left out. A parallel scan over slices of time
    in which the largest key has some slice_rows events on average."""
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).where("_t IS NOT NULL")
    gap = round(seconds * 1e6)
    if gap <= 0:
        return timed.drop("_t")
    keys = timed.groupBy(key).agg(F.count("*").alias("n"), F.min("_t").alias("a"), F.max("_t").alias("b"))
    most = keys.agg(F.max("n").alias("n"), F.coalesce(F.min("a"), F.lit(0)).alias("a"), F.coalesce(F.max("b"), F.lit(0)).alias("b")).first()
    width = max(4 * gap, (most.b - most.a) * slice_rows // (most.n or 1))
    sliced = timed.withColumn(SLICE, F.floor(F.col("_t") / width))
    return scan(sliced, key, ["_t", tie], ThrottleScan(gap, width, events.columns), events.schema, (most.a // width, most.b // width))


def stream_throttle(events: DataFrame, key: str, ts: str, seconds: float, tie: str) -> DataFrame:
    """Accepted (key, ts, tie) of a stream; events must come in order over batches, in a batch they are sorted. The state of a key is one time."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = Throttle(seconds, state.get[0] if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(["_t", tie])
        keep = rows[[machine.feed(t) for t in rows["_t"]]]
        state.update((machine.last,))
        state.setTimeoutDuration(max(IDLE_MS, int(seconds * 2000)))
        yield keep[[key, ts, tie]]

    kinds = dict(events.dtypes)
    timed = events.select(key, ts, tie, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {tie} {kinds[tie]}", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_order(tokens: DataFrame, feed: Callable[[], object], one: Callable, end: Callable, key: str, seq: str, out: str) -> DataFrame:
    """A machine over each key's rows of a finite table, in order of seq. Sorted partitions stream through it, so a
    key is one task's work but is never held in memory."""
    names = [c.split(" ")[0] for c in out.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current, last = None, None, None
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if machine is None or not same_key(k, current):
                    if machine is not None:
                        rows += [(current, *x) for x in end(machine, last)]
                    machine, current = feed(), k
                last = getattr(r, seq)
                rows += [(k, *x) for x in one(machine, r)]
            yield pd.DataFrame(rows, columns=names)
        if machine is not None:
            yield pd.DataFrame([(current, *x) for x in end(machine, last)], columns=names)

    return tokens.repartition(key).sortWithinPartitions(key, seq).mapInPandas(run, out)


def spoken_chunks(stretches: DataFrame, least: int, most: int) -> DataFrame:
    """(stream_id, seq, chunk): stretches cut for speaking, what a flush left over only cleaned."""
    rest = F.filter(F.array(clean(F.col("stretch"))), lambda c: c != "")
    return stretches.select("stream_id", "seq", F.explode(F.when(F.col("flushed"), rest).otherwise(speech_chunks(F.col("stretch"), least, most))).alias("chunk"))


def sentence_chunks(tokens: DataFrame, least: int = 15, most: int = 250) -> DataFrame:
    """(stream_id, seq, chunk) of a finite table (stream_id, seq, token); seq is that of the token that completed the chunk."""
    kind = dict(tokens.dtypes)["stream_id"]
    found = in_order(
        tokens, lambda: SentenceBuffer(least), lambda m, r: [(r.seq, c, False) for c in m.feed(r.token or "")], lambda m, last: [(last, c, True) for c in m.flush()],
        "stream_id", "seq", f"stream_id {kind}, seq bigint, stretch string, flushed boolean",
    )
    return spoken_chunks(found, least, most)


def stream_sentence_chunks(tokens: DataFrame, least: int = 15, most: int = 250) -> DataFrame:
    """The same over a stream (stream_id, seq from 0, token, is_end): tokens that come early wait for the ones before; is_end flushes and forgets the key."""
    kind = dict(tokens.dtypes)["stream_id"]

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # what a silent stream left over is flushed
            rest = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame([(keys[0], rest["next"] - 1, rest["held"], True)], columns=["stream_id", "seq", "stretch", "flushed"])
            return
        saved = json.loads(state.get[0]) if state.exists else {"held": "", "next": 0, "early": {}}
        machine = SentenceBuffer(least, saved["held"])
        early, expected, rows = saved["early"], saved["next"], []
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if r.seq >= expected:  # a repeated token is known already
                    early[str(r.seq)] = [r.token or "", bool(r.is_end)]
        ended = False
        while str(expected) in early:
            token, last = early.pop(str(expected))
            rows += [(keys[0], expected, c, False) for c in machine.feed(token)]
            if last:
                rows += [(keys[0], expected, c, True) for c in machine.flush()]
                ended = True
            expected += 1
        if ended and not early:
            state.remove()
        else:
            state.update((json.dumps({"held": machine.held, "next": expected, "early": early}),))
            state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "stretch", "flushed"])

    out = f"stream_id {kind}, seq bigint, stretch string, flushed boolean"
    return spoken_chunks(tokens.groupBy("stream_id").applyInPandasWithState(run, out, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout), least, most)


def frame_slices(frames: DataFrame, slice_frames: int) -> DataFrame:
    """Frames with a number, a missing verdict as silence, in slices of slice_frames numbers."""
    numbered = frames.select("stream_id", F.col("frame_no").cast("bigint").alias("frame_no"), F.coalesce("is_speech", F.lit(False)).alias("is_speech")).where("frame_no IS NOT NULL")
    return numbered.withColumn(SLICE, F.floor(F.col("frame_no") / slice_frames))


def voice_segments(frames: DataFrame, silence_ms: int = 800, cap_ms: int = 60_000, slice_frames: int = 16_384) -> DataFrame:
    """(stream_id, begin, end) of a finite table (stream_id, frame_no, is_speech); an open segment ends with the frames. A parallel scan."""
    kind = dict(frames.dtypes)["stream_id"]
    return scan(frame_slices(frames, slice_frames), "stream_id", ["frame_no"], SegmentScan(silence_ms, cap_ms, "stream_id"), f"stream_id {kind}, begin bigint, end bigint")


def stream_voice_segments(frames: DataFrame, silence_ms: int = 800, cap_ms: int = 60_000) -> DataFrame:
    """Ended segments of a stream of frames that come in order over batches."""
    kind = dict(frames.dtypes)["stream_id"]

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            machine = Segmenter(**json.loads(state.get[0]))
            state.remove()
            if found := machine.flush(machine.last):
                yield pd.DataFrame([(keys[0], *found)], columns=["stream_id", "begin", "end"])
            return
        machine = Segmenter(**json.loads(state.get[0])) if state.exists else Segmenter(silence_ms, cap_ms=cap_ms)
        rows = []
        for r in pd.concat(list(parts)).sort_values("frame_no").itertuples(index=False):
            if found := machine.feed(int(r.frame_no), bool(r.is_speech)):
                rows.append((keys[0], *found))
        state.update((json.dumps(asdict(machine)),))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(rows, columns=["stream_id", "begin", "end"])

    return frames.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, begin bigint, end bigint", "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def voice_continue(frames: DataFrame, starts: DataFrame, silence_ms: int = 800, cap_ms: int = 30_000) -> DataFrame:
    """(stream_id, begin, end) for each start (stream_id, begin): a segment that already began goes on from frame `begin` to the silence
    or the cap, or to the last frame. Only the frames up to the cap are looked at; a start without frames has no row."""
    quiet = silence_ms // 30
    near = frames.join(starts, "stream_id").where((F.col("frame_no") >= F.col("begin")) & (F.col("frame_no") < F.col("begin") + cap_ms // 30))
    by_frame = Window.partitionBy("stream_id", "begin").orderBy("frame_no")
    silent = F.sum(F.when(F.col("is_speech"), 0).otherwise(1)).over(by_frame.rowsBetween(1 - quiet, 0))
    return near.withColumn("silent", silent).groupBy("stream_id", "begin").agg(
        F.coalesce(F.min(F.when(F.col("silent") >= quiet, F.col("frame_no"))), F.max("frame_no")).alias("end")
    )


def onsets(frames: DataFrame, level: int = 3, keep: int = 5, slice_frames: int = 16_384) -> DataFrame:
    """(stream_id, frame_no, buffered) of a finite table: where speech was noticed, and the frames kept from before. A parallel scan."""
    kind = dict(frames.dtypes)["stream_id"]
    return scan(frame_slices(frames, slice_frames), "stream_id", ["frame_no"], OnsetScan(level, keep, "stream_id"), f"stream_id {kind}, frame_no bigint, buffered array<bigint>")


def change_events(lines: DataFrame, ts_col: str = "ts") -> DataFrame:
    """(file, by, cwd, ts) of JSON lines (value, ts); lines without a file go, a missing author is `unknown`."""
    e = F.from_json("value", "file string, `by` string, cwd string")
    return lines.select(e.alias("e"), ts_col).where("coalesce(e.file, '') <> ''").select("e.file", F.coalesce(F.nullif("e.by", F.lit("")), F.lit("unknown")).alias("by"), "e.cwd", ts_col)


def append_turns(history: DataFrame, said: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """history plus the new turns (key, role, text, and place: their order), numbered on from each conversation's last turn; a new conversation starts at 0."""
    last = history.groupBy(key).agg((F.max(order) + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    new = said.withColumn("_place", place).join(last, key, "left").select(key, (F.coalesce("_next", F.lit(0)) + F.col("_place")).alias(order), "role", "text")
    return history.select(key, order, "role", "text").unionByName(new)


def last_turns(talks: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return talks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
