"""Repeated passages by relative Lempel-Ziv parsing against an index of all the corpus's blocks.

A block is the stretch of windows that share a seed: the least hash among a window's short word
runs, so that equal passages fall into equal blocks wherever they stand. Every block of every
document goes into the index: seed, hash of the whole block, and two places where it stands, the least and the
greatest. A document is then parsed greedily from left to right: a block that the index holds elsewhere
extends the factor before it if the index has it at the next place of that factor's reference, and begins
a factor otherwise. Where a factor ends, some windows of the next block may still be repeated; those
blocks are checked window by window against all blocks of their seed, and extend the factor in the same
way. Factors, each of one window or more, are the duplicate spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import WordCodes, long_lists, longs, text_bytes, written

STEP = 0x9E3779B97F4A7C13
BACK = pow(STEP, -1, 1 << 64)
EMPTY = hashlib.sha256(b"").hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of any run of words of one text, from sums of code * STEP**position."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if len(Runs._up) <= n:
            size = max(2 * n, 4096)
            Runs._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, STEP, np.uint64)]), dtype=np.uint64)
            Runs._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BACK, np.uint64)]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * Runs._up[:n], out=self.sums[1:])

    def all_of(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * Runs._down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * Runs._down[begin] + (end - begin).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` values in a row."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def seeds_of(runs: Runs, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed of each window, and the hash at each place where some window finds its seed."""
    grams = runs.all_of(k)
    width = window - k + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = sliding(grams, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, grams[sliding(padded, width, np.maximum) == grams]


def pieces(batches, most: int = 4 << 20):
    """The batches cut so that a piece holds about `most` bytes of text, or one text: what a task builds from it stays bounded."""
    for b in batches:
        begin, held = 0, 0
        for i, size in enumerate(pc.binary_length(b.column("text")).to_pylist()):
            if held and held + size > most:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if len(b) > begin:
            yield b.slice(begin)


def text_class() -> list[Column]:
    """Two hashes of the raw text: rows of one class have one text."""
    return [F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2")]


def scan(docs: DataFrame, window: int, k: int) -> DataFrame:
    """For every row its class, word count, digest of all words, and its seeds (twice: in two places of the text)."""

    def run(batches):
        codes = WordCodes()
        for b in pieces(batches):
            n_words, digests, seeds, twice = [], [], [], []
            for text in b.column("text").to_pylist():
                words = text.split()
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found = np.zeros(0, np.uint64)
                if len(words) >= window:
                    found = seeds_of(Runs(codes.of(words)), window, k)[1]
                values, counts = np.unique(found, return_counts=True)
                seeds.append(values)
                twice.append(counts > 1)
            ends = np.cumsum([0, *map(len, seeds)]).astype(np.int32)
            flags = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(twice) if twice else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("x1"), b.column("x2"), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), long_lists(seeds), flags],
                ["doc_id", "x1", "x2", "n_words", "digest", "seeds", "twice"],
            )

    return docs.select("doc_id", *text_class(), "text").mapInArrow(run, "doc_id long, x1 long, x2 long, n_words long, digest string, seeds array<long>, twice array<boolean>")


def blocks(texts: DataFrame, window: int, k: int) -> DataFrame:
    """The blocks whose seed is known to repeat: seed, hash of the block, its place, and its windows' hashes."""

    def run(batches):
        codes = WordCodes()
        for b in pieces(batches):
            rows: list[list[np.ndarray]] = [[] for _ in range(6)]
            lists = []
            for text, known, x1, x2 in zip(b.column("text").to_pylist(), b.column("known").to_pylist(), b.column("x1").to_pylist(), b.column("x2").to_pylist()):
                runs = Runs(codes.of(text.split()))
                least, _ = seeds_of(runs, window, k)
                if not len(least):
                    continue
                hit = np.isin(least, np.array(known, np.int64).view(np.uint64))
                begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                end = np.concatenate([begin[1:], [len(least)]])
                begin, end = begin[hit[begin]], end[hit[begin]]
                whole = runs.all_of(window)
                lists += [whole[i:j] for i, j in zip(begin.tolist(), end.tolist())]
                for col, values in zip(rows, (least[begin].view(np.int64), runs.of(begin, end + window - 1).view(np.int64), np.full(len(begin), x1), np.full(len(begin), x2), begin, end - begin)):
                    col.append(values)
            if lists:
                seed, block, x1, x2, begin, n = (np.concatenate(c) for c in rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(block), pa.array(x1), pa.array(x2), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), long_lists(lists)],
                    ["seed", "block", "x1", "x2", "begin", "n", "windows"],
                )

    return texts.mapInArrow(run, "seed long, block long, x1 long, x2 long, begin int, n int, windows array<long>")


PLACE = "struct<x1:bigint,x2:bigint,begin:int>"
FACTOR = "struct<begin:int,end:int,x1:long,x2:long,at:int>"


def parse(hits: list[dict], me: tuple[int, int]) -> list[list]:
    """Greedy factors [first window, windows, x1, x2, at] of a text's repeated windows: a block, or a window of an
    unsure one, goes on with the factor before it if the index has it at the next place of that factor's reference; else it begins a new one."""
    out: list[list] = []
    for hit in sorted(hits, key=lambda h: h["begin"]):
        for begin, n, places in [(hit["begin"], hit["n"], (hit["low"], hit["high"]))] if hit["at"] is None else [(hit["begin"] + w["at"], 1, (w["low"], w["high"])) for w in sorted(hit["at"], key=lambda w: w["at"])]:
            known = [(p["x1"], p["x2"], p["begin"]) for p in places if (p["x1"], p["x2"], p["begin"]) != (*me, begin)]
            last = out[-1] if out and out[-1][0] + out[-1][1] == begin else None
            if last and (last[2], last[3], last[4] + last[1]) in known:
                last[1] += n
            else:
                out.append([begin, n, *known[0]])
    return out


def cut(found: DataFrame, window: int) -> DataFrame:
    """The factors of each text, the word spans that they cover, and what is left of it."""

    def run(batches):
        for b in pieces(batches):
            out: list[list] = [[] for _ in range(6)]
            for text, hits, x1, x2 in zip(*(b.column(c).to_pylist() for c in ("text", "hits", "x1", "x2"))):
                words = text.split()
                factors = parse(hits, (x1, x2))
                change = np.zeros(len(words) + 1, np.int64)
                for begin, n, *_ in factors:
                    change[begin] += 1
                    change[begin + n + window - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                listed = [{"begin": f[0], "end": f[0] + f[1] + window - 1, "x1": f[2], "x2": f[3], "at": f[4]} for f in factors]
                for col, value in zip(out, (x1, x2, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), edge.tolist(), listed)):
                    col.append(value)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], kind)],
                ["x1", "x2", "removed", "kept", "edges", "parsed"],
            )

    return found.mapInArrow(run, f"x1 long, x2 long, removed long, kept string, edges array<int>, parsed array<{FACTOR}>")


def repeated_passages(docs: DataFrame, window: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, factors) for every row of docs.

    A word is removed if a window of `window` words over it starts anywhere else too, in the same
    text or another; spans lists the removed word ranges as begin, end, begin, end, ... and factors the parse:
    words begin to end stand at word `at` of the text whose two hashes are x1 and x2. Null and
    empty texts have no words; a text shorter than a window loses nothing. Rows with one text are
    one class that is parsed once: all its windows repeat, so all its words go. Repeated rows count
    as copies. Blocks are compared by two 64-bit hashes, as are windows (with their seed's).

    Counts are sums before the shuffle; hot seeds, blocks and classes meet their verdicts in joins
    of written tables, which AQE can split. Texts are shuffled once, one for each class.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    scanned = written(scan(rows, window, k), "seeds")
    classes = scanned.groupBy("x1", "x2").agg(F.count("*").alias("copies"), F.first("seeds").alias("seeds"), F.first("twice").alias("twice"))
    seeds = classes.select("x1", "x2", F.inline(F.arrays_zip("seeds", "twice"))).toDF("x1", "x2", "seed", "twice")
    again = written(seeds.groupBy("seed").agg(F.count("*").alias("texts"), F.max("twice").alias("twice")).where("texts > 1 OR twice").select("seed"), "again")
    known = seeds.select("x1", "x2", "seed").join(again, "seed").groupBy("x1", "x2").agg(F.collect_list("seed").alias("known"))
    texts = rows.select(*text_class(), "text").groupBy("x1", "x2").agg(F.first("text").alias("text"))
    parsed = written(texts.join(known, ["x1", "x2"]), "parsed")
    index = written(blocks(parsed, window, k), "blocks")
    place = lambda begin: F.struct("x1", "x2", begin.alias("begin"))
    ends = lambda p: (F.min(p).alias("low"), F.max(p).alias("high"))  # noqa: E731  two places: one of them is another's
    distinct = written(index.groupBy("seed", "block").agg(F.count("*").alias("times"), F.first("windows").alias("windows"), *ends(place(F.col("begin")))), "distinct")
    factors = distinct.where("times > 1").select("seed", "block", F.lit(None).cast(f"array<struct<at:int,low:{PLACE},high:{PLACE}>>").alias("at"), "low", "high")
    unsure = written(distinct.groupBy("seed").agg(F.min("times").alias("least")).where("least = 1").select("seed"), "unsure")
    single = distinct.join(unsure, "seed").select("seed", "block", "times", "low", "high", F.posexplode("windows").alias("at", "w"))
    moved = lambda p: F.struct(p["x1"].alias("x1"), p["x2"].alias("x2"), (p["begin"] + F.col("at")).alias("begin"))
    counted = single.groupBy("seed", "w").agg(F.sum("times").alias("n"), F.min(moved(F.col("low"))).alias("low"), F.max(moved(F.col("high"))).alias("high"))
    repeated = written(counted.where("n > 1").select("seed", "w", "low", "high"), "repeated")
    checked = single.where("times = 1").select("seed", "block", "at", "w").join(repeated, ["seed", "w"])
    checked = checked.groupBy("seed", "block").agg(F.collect_list(F.struct("at", "low", "high")).alias("at"))
    none = F.lit(None).cast(PLACE)
    verdicts = written(factors.unionByName(checked.withColumns({"low": none, "high": none})), "verdicts")
    hits = index.select("seed", "block", "x1", "x2", "begin", "n").join(verdicts, ["seed", "block"])
    hits = hits.groupBy("x1", "x2").agg(F.collect_list(F.struct("begin", "n", "at", "low", "high")).alias("hits"))
    done = cut(parsed.select("x1", "x2", "text").join(hits, ["x1", "x2"]), window)
    several = classes.where("copies > 1").select("x1", "x2", F.lit(True).alias("copied"))
    fate = written(done.join(several, ["x1", "x2"], "full"), "fate")
    gone = F.col("copied").isNotNull() & (F.col("n_words") >= window)
    return (
        scanned.select("doc_id", "x1", "x2", "n_words", "digest").join(fate, ["x1", "x2"], "left")
        .select(
            "doc_id", "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
            F.when(gone, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("edges", F.array().cast("array<int>"))).alias("spans"),
            F.when(gone, F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"), "x1", "x2", F.lit(0).alias("at"))).cast(f"array<{FACTOR}>"))
            .otherwise(F.coalesce("parsed", F.array().cast(f"array<{FACTOR}>"))).alias("factors"),
        )
    )
