"""Periodic runs of words: stretches that repeat themselves, found by comparing a text with itself at every lag."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_bytes, written

#: Words that a probe compares in a row; no stretch to be found is shorter.
PROBE = 8
RUN = "struct<start:long,length:long,period:long>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, within one text."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def octaves(n: int, least_exponent: int = 3) -> list[tuple[int, int]]:
    """Ranges of lags from 1 to n / least_exponent that cost about the same: each ends at twice its begin."""
    top, out, begin = n // least_exponent + 1, [], 1
    while begin < top:
        end = min(top, max(PROBE, 2 * begin))
        out.append((begin, end))
        begin = end
    return out


class Scan:
    """One text against itself. A run of smallest period q is a maximal stretch where words q apart are equal, of at least
    max(least, least_exponent * q) words."""

    def __init__(self, ids: np.ndarray, least: int = 24, least_exponent: int = 3):
        self.ids, self.n, self.least, self.times = ids, len(ids), least, least_exponent
        self.runs: set[tuple[int, int, int]] = set()  # start, end, period

    def shortest(self, lag: int) -> int:
        """How many places in a row must be equal at this lag for a run."""
        return max(self.least, self.times * lag) - lag

    def probe(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(lags, places) where PROBE words in a row equal those `lag` further on, for lags from begin to before end, in order. The places looked at are so
        close that every stretch long enough holds one whole probe."""
        stride = min(self.shortest(q) for q in (begin, min(max(begin, PROBE), end - 1), end - 1)) - PROBE + 1
        m = max(0, (self.n - begin - PROBE) // stride + 1)
        if not m:
            return np.zeros(0, int), np.zeros(0, int)
        padded = np.concatenate([self.ids, np.full(end - begin + stride + PROBE, -1, np.int32)])
        size = padded.itemsize
        shifted = np.lib.stride_tricks.as_strided(padded[begin:], (end - begin, m), (size, size * stride), writeable=False)
        rows, columns = np.nonzero(shifted == self.ids[: m * stride : stride][:m])
        lags, places = rows + begin, columns * stride
        for k in range(1, PROBE):
            if not len(lags):
                break
            same = padded[places + k] == padded[places + k + lags]
            lags, places = lags[same], places[same]
        whole = places + lags + PROBE <= self.n
        return lags[whole], places[whole]

    def smallest_period(self, start: int, end: int, q: int) -> int:
        """The smallest period of a stretch of period q and at least 2 q words: it divides q."""
        part = self.ids[start:end]
        for f in primes_of(q):
            while q % f == 0 and np.array_equal(part[q // f :], part[: -(q // f)]):
                q //= f
        return q

    def known(self, lag: int, place: int) -> bool:
        """Whether a probe lies in a run that is known, whose period divides the lag. A new run shares less than its period
        with such a run, so it has probes that lie in none."""
        return any(lag % d == 0 and s <= place and place + lag + PROBE <= e for s, e, d in self.runs)

    def compare(self, lag: int) -> None:
        """The whole text against itself at one lag, run-length coded; long stretches are kept with their smallest period."""
        same = np.concatenate([[False], self.ids[lag:] == self.ids[:-lag], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest(lag)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            self.runs.add((s, e + lag, self.smallest_period(s, e + lag, lag)))

    def over(self, begin: int, end: int) -> Scan:
        """All lags from begin to before end, a bounded number of compared words at a time."""
        for lo, hi in ((max(a, begin), min(b, end)) for a, b in octaves(self.n, self.times) if a < end and b > begin):
            wide = max(1, 4_000_000 * lo // max(self.n, 1))
            for first in range(lo, hi, wide):
                lags, places = self.probe(first, min(first + wide, hi))
                done = 0
                for lag, place in zip(lags.tolist(), places.tolist()):
                    if lag != done and not self.known(lag, place):
                        self.compare(lag)
                        done = lag
        return self


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(edge).tolist()) if not d]


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of the greatest length / period, the digest of all and the digest of what is left."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    rest = hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, told, rest)


REPORT = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def columns_of(values: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    return [pa.array([v[k] for v in values], kind) for k, (_, kind) in enumerate(kinds)]


def whole_texts(texts: DataFrame, least: int, least_exponent: int) -> DataFrame:
    """(id, n_runs, ..., runs): all lags of each text in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, listed = [], []
            for text in batch.column("text"):
                words = text.as_py().split()
                found = Scan(word_ids(words), least, least_exponent).over(1, len(words))
                runs = sorted((s, e - s, q) for s, e, q in found.runs)
                out.append(report(words, runs))
                listed.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns_of(out, REPORT), pa.array(listed, kind)], ["id", *[x for x, _ in REPORT], "runs"])

    return texts.select("id", "text").mapInArrow(run, f"id long, {', '.join(f'{x} {"string" if k == pa.string() else "long"}' for x, k in REPORT)}, runs array<{RUN}>")


def lag_ranges(texts: DataFrame, ranges: int, least: int, least_exponent: int) -> DataFrame:
    """(x1, x2, start, length, period), for each text once: each of `ranges` tasks compares a text at some octaves of its lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x1, x2, text, part in zip(*(batch.column(c) for c in ("x1", "x2", "text", "part"))):
                words = text.as_py().split()
                scan = Scan(word_ids(words), least, least_exponent)
                for begin, end in octaves(scan.n, least_exponent)[part.as_py() :: ranges]:
                    scan.over(begin, end)
                rows += [(x1.as_py(), x2.as_py(), s, e - s, q) for s, e, q in scan.runs]
            names = ["x1", "x2", "start", "length", "period"]
            yield pa.RecordBatch.from_arrays(columns_of(rows, [(c, pa.int64()) for c in names]), names)

    parts = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).repartition("x1", "x2", "part")
    # A run whose lags lie in several ranges is found with its smallest period in each.
    return parts.mapInArrow(run, "x1 long, x2 long, start long, length long, period long").distinct()


def reported(texts: DataFrame) -> DataFrame:
    """(x1, x2, n_runs, ..., runs) of texts with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [report(t.as_py().split(), [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []]) for t, runs in zip(batch.column("text"), batch.column("runs"))]
            yield pa.RecordBatch.from_arrays([batch.column("x1"), batch.column("x2"), *columns_of(out, REPORT), batch.column("runs")], ["x1", "x2", *[x for x, _ in REPORT], "runs"])

    return texts.mapInArrow(run, f"x1 long, x2 long, {', '.join(f'{x} {"string" if k == pa.string() else "long"}' for x, k in REPORT)}, runs array<{RUN}>")


def periodic_runs(docs: DataFrame, least: int = 24, least_exponent: int = 3, whole_bytes: int = 1 << 16, ranges: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs) for every row of docs.

    A run is a stretch of words with smallest period q, of at least max(least, least_exponent * q) words, that no word beside it
    extends with that period. start to exponent_milli are of the run of the greatest length / period, then the smallest start, then
    the smallest period; null if there is none. collapsed_sha256 is of the words that no run contains after its first
    period. Null and empty texts have no words. Repeated rows have a row each.

    Every lag up to n / least_exponent is compared: at places so close that no stretch slips between them, then over the whole
    text where such a probe agrees; n log n words in all. Texts over whole_bytes are dealt out by lag ranges, `ranges` tasks a text and each
    text once, and meet their runs in a join; others are worked on where they are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    long = F.octet_length("text") > whole_bytes
    names = [x for x, _ in REPORT]
    short = whole_texts(rows.where(~long), least, least_exponent)
    known = written(rows.where(long).select("id", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2"), "text"), "long-texts")
    texts = known.groupBy("x1", "x2").agg(F.first("text").alias("text"))
    found = written(lag_ranges(texts, ranges, least, least_exponent), "long-runs")
    runs = found.groupBy("x1", "x2").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    done = written(reported(texts.join(runs, ["x1", "x2"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(f"array<{RUN}>")))), "long-reports")
    return short.unionByName(known.select("id", "x1", "x2").join(done, ["x1", "x2"]).select("id", *names, "runs")).withColumnRenamed("id", "doc_id")


def planted(text: Column, doc_id: Column) -> Column:
    """A text that repeats itself from some word on, for about a tenth of the ids: h = crc32 of the id as text; if h % 10 = 0, each word i >= a becomes
    word a + (i - a) % p, with g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8). Other texts, and those of null ids, stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        values = lambda a: F.struct(a.alias("a"), F.floor((n - a) / (3 + g % 8)).cast("int").alias("p"))
        place = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % (s["p"] + 1))))
        return F.when(n > 0, F.array_join(bound(bound(a, values), place), " ")).otherwise("")

    return F.when(h % 10 == 0, bound(words, repeat)).otherwise(text)
