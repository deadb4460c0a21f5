"""State machines over finite tables as parallel scans: a key's rows are cut into slices, each slice becomes a function of the state
that it is entered with, functions are composed in a tree, and with its entering state each slice runs on its own."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.stored import stored
from .machines import Onset, Segmenter

#: Functions that meet in one task of the tree.
FAN = 64
NODE, SLICE, UP = "_node", "_slice", "_up"


class Scan(Protocol):
    """What a machine must say of a slice: a sorted pandas frame of one key's rows that follow each other."""

    def summary(self, rows: pd.DataFrame) -> Any:
        """The slice as a function of states."""

    def compose(self, functions: list) -> Any:
        """The function of these slices one after the other."""

    def apply(self, function: Any, state: Any) -> Any: ...

    def start(self) -> Any:
        """The state before a key's first row."""

    def emit(self, rows: pd.DataFrame, state: Any, last: bool) -> pd.DataFrame:
        """What the slice gives, entered with this state; last: it is its key's last."""


def same(value: Any, n: int) -> pd.Series:
    """A column of one key; pandas may hand over a null one as NaN."""
    return pd.Series([None if pd.isna(value) else value] * n, dtype=object)


def scan(rows: DataFrame, key: str, order: list[str], machine: Scan, out: str, ends: tuple[int, int] | None = None) -> DataFrame:
    """emit() of every slice. rows has the key, the columns that the machine reads, and the slice's number SLICE; ends: the least and the greatest number, if known.

    Slices are groups of (key, slice), so a hot key is as many tasks as it has slices. FAN functions at a time are composed until a key
    has no more than FAN: log(slices) rounds over tables that shrink by FAN each. States go down the same tree. Null keys are one key.
    """
    kind = dict(rows.dtypes)[key]
    table = f"{key} {kind}, {NODE} bigint, f binary"

    def leaf(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        function = machine.summary(pdf.sort_values(order, kind="stable"))
        return pd.DataFrame({key: same(k[0], 1), NODE: [k[1]], "f": [pickle.dumps(function)]})

    def up(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        functions = [pickle.loads(f) for f in pdf.sort_values(NODE)["f"]]
        return pd.DataFrame({key: same(k[0], 1), NODE: [k[1]], "f": [pickle.dumps(machine.compose(functions))]})

    def down(above: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        state, last = pickle.loads(above["state"].iloc[0]), bool(above["last"].iloc[0])
        states, pdf = [], pdf.sort_values(NODE)
        for f in pdf["f"]:
            states.append(pickle.dumps(state))
            state = machine.apply(pickle.loads(f), state)
        return pd.DataFrame({key: same(pdf[key].iloc[0], len(pdf)), NODE: pdf[NODE].to_numpy(), "state": states, "last": [False] * (len(pdf) - 1) + [last]})

    def emit(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return machine.emit(pdf.sort_values(order, kind="stable"), pickle.loads(above["state"].iloc[0]), bool(above["last"].iloc[0]))

    low, high = ends or rows.agg(F.coalesce(F.min(SLICE), F.lit(0)), F.coalesce(F.max(SLICE), F.lit(0))).first()
    span = high - low + 1
    dealt = rows.withColumn(SLICE, F.col(SLICE) - F.lit(low))  # from 0, so that the tree is as high as the table is long
    parent = F.floor(F.col(NODE) / FAN).alias(UP)
    levels = [stored(dealt.groupBy(key, SLICE).applyInPandas(leaf, table), "functions")]
    while span > FAN:
        span = -(-span // FAN)
        levels.append(stored(levels[-1].select("*", parent).groupBy(key, UP).applyInPandas(up, table), "functions"))
    states = levels[-1].select(key).distinct().select(key, F.lit(0).cast("bigint").alias(NODE), F.lit(bytearray(pickle.dumps(machine.start()))).alias("state"), F.lit(True).alias("last"))
    for level in reversed(levels):
        above = states.withColumnRenamed(NODE, UP).groupBy(key, UP)
        states = stored(above.cogroup(level.select("*", parent).groupBy(key, UP)).applyInPandas(down, f"{key} {kind}, {NODE} bigint, state binary, last boolean"), "states")
    return dealt.groupBy(key, SLICE).cogroup(states.withColumnRenamed(NODE, SLICE).groupBy(key, SLICE)).applyInPandas(emit, out)


# ---- throttle: the state is the time from which an event is accepted


@dataclass
class ThrottleScan:
    """Times are whole microseconds in the column _t; slices are `width` wide, at least as much as the gap."""

    gap: int
    width: int
    columns: list[str]

    def summary(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(times, next): entered at a state up to times[j] and after times[j - 1], the slice leaves next[j]. Only states less than a gap into the
        slice occur, so these times and the one after are enough; a state after all of them passes unchanged."""
        t = np.unique(rows["_t"].to_numpy(np.int64))
        after = np.searchsorted(t, t + self.gap)
        leap = np.where(after < len(t), after, np.arange(len(t)))  # the next accepted event, or itself if it is the last one here
        for _ in range(int(np.ceil(np.log2(self.width / self.gap + 2))) + 1):
            leap = leap[leap]
        some = int(np.searchsorted(t, t[0] // self.width * self.width + self.gap)) + 1
        return t[:some], t[leap[:some]] + self.gap

    def compose(self, functions: list) -> tuple[np.ndarray, np.ndarray]:
        times = np.concatenate([functions[0][0], *[f[0][:1] for f in functions[1:2]]])
        state = times
        for f in functions:
            state = self.mapped(f, state)
        return times, state

    @staticmethod
    def mapped(function: tuple[np.ndarray, np.ndarray], states: np.ndarray) -> np.ndarray:
        times, leaves = function
        j = np.searchsorted(times, states)
        return np.where(j < len(times), leaves[np.minimum(j, len(times) - 1)], states)

    def apply(self, function: tuple, state: int) -> int:
        return int(self.mapped(function, np.array([state]))[0])

    def start(self) -> int:
        return -(1 << 62)

    def emit(self, rows: pd.DataFrame, state: int, last: bool) -> pd.DataFrame:
        t, kept = rows["_t"].to_numpy(np.int64), []
        j = int(np.searchsorted(t, state))
        while j < len(t):
            kept.append(j)
            j = int(np.searchsorted(t, t[j] + self.gap))
        return rows.iloc[kept][self.columns]


# ---- voice segments: the state is a mode, the frames heard, and where an open segment began

KEPT = -(1 << 62)


class SegmentScan:
    """Modes are those of the machine: the run of speech before a segment, the run of silence in one. Frames (frame_no, is_speech) in order.

    A slice is a function over all modes and counts of heard frames. It is worked out in pieces of at most `cap` frames, in which listening starts anew by the cap
    once at most: the fate of each mode without a cap, and of a fresh start at each frame, say it all.
    """

    def __init__(self, silence_ms: int, cap_ms: int, key: str):
        self.silence_ms, self.cap_ms, self.key = silence_ms, cap_ms, key
        blank = Segmenter(silence_ms, cap_ms=cap_ms)
        self.onset, self.cap = blank.onset, max(1, cap_ms // 30)
        self.modes = self.onset + max(1, silence_ms // 30)
        never = 30 * (1 << 40)
        self.to = np.zeros((2, self.modes), np.int64)
        self.ends, self.begins = np.zeros((2, self.modes), bool), np.zeros((2, self.modes), bool)
        for speech in (0, 1):
            for mode in range(self.modes):  # the machine itself says where each mode goes
                m = self.machine(mode, 0, 0, never)
                was_open = m.begin is not None
                ended = m.feed(10, bool(speech)) is not None
                self.ends[speech, mode] = ended
                self.begins[speech, mode] = m.begin is not None and not was_open
                self.to[speech, mode] = m.run if m.begin is None else self.onset + m.quiet

    def machine(self, mode: int, heard: int, begin: int, cap_ms: int | None = None) -> Segmenter:
        is_open = mode >= self.onset
        return Segmenter(self.silence_ms, self.onset, self.cap_ms if cap_ms is None else cap_ms, heard, 0 if is_open else mode, begin if is_open else None, mode - self.onset if is_open else 0)

    def piece(self, frames: np.ndarray, speech: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states (mode, heard, begin) after at most `cap` frames."""
        n, every = len(frames), np.arange(self.modes)
        end, reset, began, first = every.copy(), np.full(self.modes, -1), np.full(self.modes, -1), np.full(self.modes, n)
        fresh = np.zeros((3, n + 1), np.int64)  # mode, last reset and last begin after a fresh start at each frame
        fresh[1:, n] = -1
        for i in range(n - 1, -1, -1):  # from the last frame back: what each mode before frame i comes to
            s = int(speech[i])
            to = self.to[s]
            end, reset, began = end[to], reset[to], began[to]
            reset = np.where((reset < 0) & self.ends[s], i, reset)
            began = np.where((began < 0) & self.begins[s], i, began)
            first = np.where(self.ends[s], i, first[to])
            fresh[:, i] = end[0], reset[0], began[0]
        mode, heard, begin = state
        capped = self.cap - heard - 1  # the frame at which the cap ends it, if nothing else does before
        cut = (capped < n) & (capped < first[mode])
        again = fresh[:, np.where(cut, capped + 1, n)]
        out = np.where(cut, again[0], end[mode])
        at = np.where(cut, np.where(again[1] >= 0, again[1], capped), reset[mode])
        opened = np.where(cut, again[2], began[mode])
        return out, np.where(at >= 0, n - 1 - at, heard + n), np.where(opened >= 0, frames[np.maximum(opened, 0)] - self.onset + 1, np.where(cut, KEPT, begin))

    def after(self, rows: pd.DataFrame, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        frames, speech = rows["frame_no"].to_numpy(np.int64), rows["is_speech"].to_numpy(bool)
        size = min(self.cap, 1024)
        for i in range(0, len(frames), size):
            state = self.piece(frames[i : i + size], speech[i : i + size], state)
        return state

    def summary(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(code of the state, begin or KEPT) for every mode and count."""
        mode, heard = (x.reshape(-1) for x in np.meshgrid(np.arange(self.modes), np.arange(self.cap), indexing="ij"))
        mode, heard, begin = self.after(rows, (mode, heard, np.full(len(mode), KEPT)))
        return (mode * self.cap + heard).astype(np.int32), begin

    def compose(self, functions: list) -> tuple[np.ndarray, np.ndarray]:
        code, begin = functions[0]
        for to, later in functions[1:]:
            code, begin = to[code], np.where(later[code] == KEPT, begin, later[code])
        return code, begin

    def apply(self, function: tuple, state: tuple[int, int]) -> tuple[int, int]:
        code, begin = state
        return int(function[0][code]), begin if function[1][code] == KEPT else int(function[1][code])

    def start(self) -> tuple[int, int]:
        return 0, 0

    def emit(self, rows: pd.DataFrame, state: tuple[int, int], last: bool) -> pd.DataFrame:
        m = self.machine(state[0] // self.cap, state[0] % self.cap, state[1])
        frames = rows["frame_no"].tolist()
        found = [x for frame, speech in zip(frames, rows["is_speech"].tolist()) if (x := m.feed(frame, speech))]
        if last and (x := m.flush(frames[-1])):
            found.append(x)
        return pd.DataFrame({self.key: same(rows[self.key].iloc[0], len(found)), "begin": [b for b, _ in found], "end": [e for _, e in found]})


# ---- onsets: the state is the counter and the frames kept


@dataclass
class OnsetScan:
    level: int
    keep: int
    key: str

    def run(self, rows: pd.DataFrame, count: int, before: list[int]) -> tuple[Onset, list[tuple[int, list[int]]]]:
        m = Onset(self.level, self.keep, count, list(before))
        return m, [(frame, hit) for frame, speech in zip(rows["frame_no"].tolist(), rows["is_speech"].tolist()) if (hit := m.feed(frame, speech)) is not None]

    def summary(self, rows: pd.DataFrame) -> list[tuple[int, bool, list[int]]]:
        """For each count: the count after the slice, whether it fired, and the last frames kept since."""
        done = [self.run(rows, count, []) for count in range(self.level)]
        return [(m.count, bool(hits), m.before) for m, hits in done]

    def compose(self, functions: list) -> list[tuple[int, bool, list[int]]]:
        out = [(count, False, []) for count in range(self.level)]
        for f in functions:
            out = [self.joined(x, f[x[0]]) for x in out]
        return out

    def joined(self, one: tuple, two: tuple) -> tuple[int, bool, list[int]]:
        return two[0], one[1] or two[1], two[2] if two[1] else [*one[2], *two[2]][-self.keep :]

    def apply(self, function: list, state: tuple[int, list[int]]) -> tuple[int, list[int]]:
        count, _, before = self.joined((state[0], False, state[1]), function[state[0]])
        return count, before

    def start(self) -> tuple[int, list[int]]:
        return 0, []

    def emit(self, rows: pd.DataFrame, state: tuple[int, list[int]], last: bool) -> pd.DataFrame:
        _, hits = self.run(rows, *state)
        return pd.DataFrame({self.key: same(rows[self.key].iloc[0], len(hits)), "frame_no": [f for f, _ in hits], "buffered": pd.Series([b for _, b in hits], dtype=object)})
