"""Parallel scans against the machines fed row by row, with slices so small that they are composed in several levels."""

import random

import numpy as np
import pandas as pd
import pytest

from corpuskiln.streaming import scans, stateful
from corpuskiln.streaming.machines import Onset, Segmenter, Throttle


def noisy(r: random.Random, n: int) -> list[bool]:
    out: list[bool] = []
    while len(out) < n:
        out += [r.random() < r.choice([0.05, 0.5, 0.95])] * r.randint(1, 6) if r.random() < 0.5 else [r.random() < 0.5]
    return out[:n]


def segments_of(frames: list[tuple[int, bool]], silence_ms: int, cap_ms: int) -> list[tuple[int, int]]:
    m = Segmenter(silence_ms, cap_ms=cap_ms)
    found = [x for f, s in frames if (x := m.feed(f, s))]
    return found + [x for x in [m.flush(frames[-1][0])] if x]


@pytest.mark.parametrize("silence_ms, cap_ms", [(120, 60_000), (90, 600), (800, 3000), (30, 300), (0, 900), (120, 30)])
def test_segment_functions_are_the_machine(silence_ms, cap_ms):
    r = random.Random(silence_ms + cap_ms)
    scan = scans.SegmentScan(silence_ms, cap_ms, "k")
    for _ in range(15):
        n = r.choice([1, 5, 40, 300])
        frames = sorted(r.sample(range(2 * n + 5), n))
        rows = pd.DataFrame({"k": "a", "frame_no": frames, "is_speech": noisy(r, n)})
        cuts = sorted({0, n, *(r.randrange(n) for _ in range(4))})
        parts = [rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])]
        functions = [scan.summary(p) for p in parts]
        state, found = scan.start(), []
        for i, (p, f) in enumerate(zip(parts, functions)):
            got = scan.emit(p, state, i == len(parts) - 1)
            found += list(zip(got["begin"], got["end"]))
            state = scan.apply(f, state)
        assert found == segments_of(list(zip(frames, rows["is_speech"])), silence_ms, cap_ms)
        whole = scan.apply(scan.compose(functions), scan.start())
        assert whole == state or whole[0] == state[0] < scan.onset * scan.cap


def test_voice_segments_and_onsets_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(scans, "FAN", 3)
    slice_frames, r = 13, random.Random(7)
    rows = [(k, f, s) for k, n in (("a", 330), ("b", 3), (None, 120)) for f, s in enumerate(noisy(r, n))]
    frames = spark.createDataFrame([*rows, ("c", 5, None), ("c", None, True)], "stream_id string, frame_no int, is_speech boolean").repartition(5)
    got = {(x.stream_id, x.begin, x.end) for x in stateful.voice_segments(frames, 90, 900, slice_frames).collect()}
    assert got == {(k, *x) for k in ("a", "b", None) for x in segments_of([(f, s) for q, f, s in rows if q == k], 90, 900)}
    hits = sorted(((x.stream_id or "", x.frame_no, x.buffered) for x in stateful.onsets(frames, 3, 5, slice_frames).collect()))
    expected = []
    for k in ("a", "b", None):
        m = Onset(3, 5)
        expected += [(k or "", f, hit) for q, f, s in rows if q == k and (hit := m.feed(f, s)) is not None]
    assert hits == sorted(expected)


@pytest.mark.parametrize("slice_rows", [20, 10**6])
def test_throttle_in_small_slices(spark, slice_rows):
    r = random.Random(slice_rows)
    times = {"a": [r.randrange(0, 4_000_000) for _ in range(500)], None: [r.randrange(0, 10**7) for _ in range(50)], "gaps": [0, 1, 5_000_000, 5_000_000, 9_000_000], "one": [77]}
    rows = [(k, t, n) for n, (k, t) in enumerate((k, t) for k, ts in times.items() for t in ts)]
    r.shuffle(rows)
    events = spark.createDataFrame([*rows, ("a", None, -1)], "k string, us bigint, n int").selectExpr("k", "timestamp_micros(us) AS ts", "n", "'x' AS more")
    got = stateful.throttle(events, "k", "ts", 0.004, "n", slice_rows)
    assert got.columns == events.columns
    expected = set()
    for k in times:
        m = Throttle(4000)
        expected |= {n for q, t, n in sorted(rows, key=lambda x: (x[1], x[2])) if q == k and m.feed(t)}
    assert {x.n for x in got.collect()} == expected
    assert stateful.throttle(events.limit(0), "k", "ts", 1.0, "n").count() == 0
    assert stateful.throttle(events, "k", "ts", 0.0, "n").count() == len(rows)


def test_throttle_tree_has_several_levels(spark, monkeypatch):
    """300 slices of one key, five to a task: four levels of functions, no task with the whole key."""
    monkeypatch.setattr(scans, "FAN", 5)
    events = spark.range(300).selectExpr("'k' AS k", "timestamp_micros(id * 40000 + (id * id) % 9000) AS ts", "id AS n")
    m = Throttle(10_000)
    expected = [n for n in range(300) if m.feed(n * 40_000 + n * n % 9_000)]
    assert sorted(x.n for x in stateful.throttle(events, "k", "ts", 0.01, "n", 1).collect()) == expected == list(range(300))


def test_throttle_functions_compose():
    r = random.Random(6)
    for _ in range(300):
        gap = r.randint(1, 30)
        width = gap * r.randint(1, 5)
        scan = scans.ThrottleScan(gap, width, ["_t"])
        t = sorted({r.randrange(0, 400) for _ in range(r.randint(1, 60))})
        slices = [pd.DataFrame({"_t": [x for x in t if x // width == s]}) for s in sorted({x // width for x in t})]
        functions, state, found = [scan.summary(s) for s in slices], scan.start(), []
        for s, f in zip(slices, functions):
            found += scan.emit(s, state, False)["_t"].tolist()
            state = scan.apply(f, state)
        m = Throttle(gap)
        assert found == [x for x in t if m.feed(x)]
        for k in range(1, len(functions)):  # any bracketing gives the same
            both = [scan.compose(functions[:k]), scan.compose(functions[k:])]
            assert scan.apply(scan.compose(both), scan.start()) == state == scan.apply(scan.compose(functions), scan.start())
    assert np.array_equal(scans.ThrottleScan.mapped((np.array([5]), np.array([9])), np.array([5, 6])), [9, 6])
