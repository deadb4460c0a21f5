"""A hashed maximum-entropy language model with a class-factored softmax.

Every token has a type: one of the most frequent words, or else a hash of its spelling's end. Types
are grouped into classes: frequent words by rank, spelling types by hash. The model is

    P(token | before) = P(class | before) * P(type | class, before) * P(token | type),

where the first two factors are softmaxes over sums of weights of hashed features of the tokens
before (the last one, the two before that skipped to, and the last two together), and the last one is a smoothed
share of counts among the words of that spelling (1 for frequent words).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import WordCodes, text_bytes, written

END = b"\n"  # can't be a word
FREQUENT = 256  # words with a type of their own, the end included
CLASSES, WIDTH = 64, 16  # the first 16 classes hold the frequent words, 16 in each; the others hold one spelling type each
SPELLINGS = CLASSES - FREQUENT // WIDTH
PAIRS = 1 << 13
STRIP = b".,;:!?\"'()[]{}<>*_|`~#$%&@"


def spelling(word: bytes) -> int:
    """One of SPELLINGS types, by the last three bytes without punctuation, and by the kind of punctuation."""
    core = word.strip(STRIP)
    return xxhash.xxh32_intdigest(core[-3:] + word[-1:] if core != word else core[-3:]) % SPELLINGS


def word_code(word: bytes) -> int:
    """64-bit hash with the spelling type in its low 6 bits."""
    return xxhash.xxh64_intdigest(word) >> 6 << 6 | spelling(word)


@dataclass
class Vocabulary:
    """Frequent words by sorted hash, and the shares of spelling types; its size has a bound."""

    codes: np.ndarray  # sorted
    types: np.ndarray  # the type of each of these words, or -1
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    type_tokens: np.ndarray  # tokens and distinct words for each spelling type, frequent words left out
    type_words: np.ndarray
    cut: int  # words of this log_step and over are here

    def frequent(self) -> Vocabulary:
        """Only the words that have a type of their own: all that training needs."""
        own = self.types >= 0
        return replace(self, codes=self.codes[own], types=self.types[own], counts=self.counts[own])


@dataclass
class Weights:
    """Class scores and scores inside the frequent classes, by hashed feature."""

    bias: np.ndarray
    last: np.ndarray  # type of the last token -> class scores
    skip1: np.ndarray
    skip2: np.ndarray
    pair: np.ndarray  # hash of the last two types -> class scores
    in_bias: np.ndarray
    in_last: np.ndarray  # type of the last token -> scores of the frequent words
    in_skip: np.ndarray

    TABLES = ("bias", "last", "skip1", "skip2", "pair", "in_bias", "in_last", "in_skip")

    @classmethod
    def zero(cls) -> Weights:
        n = FREQUENT + SPELLINGS
        z = lambda *s: np.zeros(s, np.float32)
        return cls(z(1, CLASSES), z(n, CLASSES), z(n, CLASSES), z(n, CLASSES), z(PAIRS, CLASSES), z(1, FREQUENT), z(n, FREQUENT), z(n, FREQUENT))


def class_of(types: np.ndarray) -> np.ndarray:
    return np.where(types < FREQUENT, types // WIDTH, types - FREQUENT + FREQUENT // WIDTH)


class Tokens:
    """Texts -> token hashes; words first, then one end."""

    def __init__(self):
        self.codes = WordCodes(word_code)
        self.end = word_code(END)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = self.codes.of(words)
        out[-1] = self.end
        return out


def types_of(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Types, and places in the vocabulary (-1: not in it)."""
    if not len(v.codes):
        return FREQUENT + (codes & np.uint64(63)).astype(np.int64), np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(v.codes, codes), len(v.codes) - 1)
    here = np.where(v.codes[at] == codes, at, -1)
    own = np.where(here >= 0, v.types[at], -1)
    return np.where(own >= 0, own, FREQUENT + (codes & np.uint64(63)).astype(np.int64)), here


def features(types: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Types one, two and three tokens before within a text (an end stands before it), and the hashed pair."""
    edge = types[-1] if len(types) else 0  # every text ends with the end token
    first = np.zeros(len(types), np.int64)
    first[starts] = np.arange(len(starts))
    since = np.arange(len(types)) - starts[np.maximum.accumulate(first)]
    back = [np.where(since >= k, np.concatenate([np.full(k, edge), types[:-k]])[: len(types)], edge) for k in (1, 2, 3)]
    return (*back, (back[0] * 1009 + back[1] * 7919) % PAIRS)


def softmax(z: np.ndarray) -> np.ndarray:
    """Of scores held between -40 and 40, in place."""
    np.clip(z, -40, 40, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def forward(w: Weights, f: tuple, types: np.ndarray):
    """Class probabilities of all rows, and word probabilities inside the class for rows of frequent words."""
    last, skip1, skip2, pair = f
    z = np.take(w.last, last, axis=0)
    for table, ids in ((w.skip1, skip1), (w.skip2, skip2), (w.pair, pair)):
        z += np.take(table, ids, axis=0)
    z += w.bias
    p = softmax(z)
    rows = np.flatnonzero(types < FREQUENT)
    c = types[rows] // WIDTH
    blocks = lambda t: t.reshape(-1, WIDTH)
    per = FREQUENT // WIDTH
    q = softmax(np.take(blocks(w.in_last), last[rows] * per + c, axis=0) + np.take(blocks(w.in_skip), skip1[rows] * per + c, axis=0) + np.take(blocks(w.in_bias), c, axis=0))
    return p, rows, c, q


def log_probability(w: Weights, f: tuple, types: np.ndarray) -> np.ndarray:
    """log10 of P(class) * P(type | class) of each token."""
    out = np.empty(len(types))
    for at in range(0, len(types), 8192):
        part = slice(at, at + 8192)
        t = types[part]
        p, rows, c, q = forward(w, tuple(x[part] for x in f), t)
        got = np.log10(np.maximum(p[np.arange(len(t)), class_of(t)].astype(np.float64), 1e-30))
        got[rows] += np.log10(np.maximum(q[np.arange(len(rows)), t[rows] % WIDTH].astype(np.float64), 1e-30))
        out[part] = got
    return out


def row_sums(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sum of the rows of each."""
    order = np.argsort(ids.astype(np.int16), kind="stable")  # all ids are under 2**15; 16 bits sort by radix
    ordered = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(np.take(values, order, axis=0), first, axis=0)


class Trainer:
    """Gradient ascent on the log probability with Adagrad; a task's steps start from shared weights."""

    def __init__(self, w: Weights, rate: float):
        self.w, self.rate = w, rate
        self.seen = {name: np.full(len(getattr(w, name).reshape(-1, CLASSES if not name.startswith("in_") else WIDTH)), 1e-6, np.float32) for name in Weights.TABLES}

    def step(self, f: tuple, types: np.ndarray) -> None:
        last, skip1, skip2, pair = f
        p, rows, c, q = forward(self.w, f, types)
        p[np.arange(len(types)), class_of(types)] -= 1
        q[np.arange(len(rows)), types[rows] % WIDTH] -= 1
        for name, ids in (("last", last), ("skip1", skip1), ("skip2", skip2), ("pair", pair)):
            self._move(name, *row_sums(ids, p), len(p), CLASSES)
        self._move("bias", np.zeros(1, np.int64), np.ones(len(p), np.float32)[None, :] @ p, len(p), CLASSES)
        per = FREQUENT // WIDTH
        if len(rows):
            for name, ids in (("in_last", last[rows] * per + c), ("in_skip", skip1[rows] * per + c), ("in_bias", c)):
                self._move(name, *row_sums(ids, q), len(q), WIDTH)

    def _move(self, name: str, which: np.ndarray, total: np.ndarray, n: int, width: int) -> None:
        total /= np.float32(n**0.5)
        seen = self.seen[name]
        seen[which] += np.einsum("ij,ij->i", total, total) / width
        table = getattr(self.w, name).reshape(-1, width)
        table[which] -= self.rate * total / np.sqrt(seen[which])[:, None]


def token_rows(docs: DataFrame) -> DataFrame:
    """(code, n): counts of token hashes by task, summed within it; few rows for each distinct word."""

    def run(batches):
        tokens, held, size = Tokens(), [], 0

        def merged():
            codes, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            keys, inverse = np.unique(codes, return_inverse=True)
            return keys, np.bincount(inverse, counts).astype(np.int64)

        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                held.append(np.unique(np.concatenate([tokens(t) for t in texts[at : at + 500]]), return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["code", "n"])
                        held, size = [], 0
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long")


def log_step() -> Column:
    """Eighths of powers of two of a count n."""
    return F.floor(F.log(2.0, F.col("n")) * 8).cast("int")


def vocabulary(counts: DataFrame, most: int) -> Vocabulary:
    """The counts of at most `most` words, the most frequent, and sums over the rest; both bounded.

    A histogram over the counts' logarithms tells where to cut, so nothing is sorted at one place."""
    step = log_step()
    histogram = sorted(((r["b"], r["words"], r["tokens"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()), reverse=True)
    cut, taken = 1 << 30, 0
    for b, words, _ in histogram:
        if taken + words > most:
            break
        cut, taken = b, taken + words
    top = counts.where(step >= cut).toPandas() if taken else counts.limit(0).toPandas()
    top = top.sort_values(["n", "code"], ascending=[False, True])
    codes, n = top["code"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    types = np.full(len(codes), -1, np.int64)
    types[:FREQUENT] = np.arange(min(FREQUENT, len(codes)))
    end = word_code(END)
    if end in codes and types[np.flatnonzero(codes == end)[0]] < 0:  # ends mark the edges of texts and need a type of their own
        types[FREQUENT - 1] = -1
        types[np.flatnonzero(codes == end)[0]] = FREQUENT - 1
    own = F.col("code").bitwiseAND(F.lit(63)).alias("t")
    type_tokens, type_words = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for t, tokens, words in ((r["t"], r["tokens"], r["words"]) for r in counts.groupBy(own).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()):
        type_tokens[t], type_words[t] = tokens, words
    for code, k in zip(codes[types >= 0].tolist(), n[types >= 0].tolist()):
        type_tokens[code & 63] -= k
        type_words[code & 63] -= 1
    order = np.argsort(codes)
    return Vocabulary(codes[order], types[order], n[order], sum(h[2] for h in histogram), sum(h[1] for h in histogram), type_tokens, type_words, cut)


def train_round(docs: DataFrame, v: Vocabulary, w: Weights, rate: float, batch: int = 4096, rows: int = 256) -> Weights:
    """One distributed update: tasks take gradient steps over their texts; each weight row moves by the
    mean of the tasks that touched it. The sums stream through one task for each stretch of rows."""
    shared = docs.sparkSession.sparkContext.broadcast((v, w))
    names = Weights.TABLES

    def run(batches):
        v, start = shared.value
        trainer = Trainer(Weights(*(getattr(start, n).copy() for n in names)), rate)
        tokens, held, size = Tokens(), [], 0
        touched = False

        def learn():
            codes = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            types, _ = types_of(codes, v)
            f = features(types, starts)
            for at in range(0, len(types), batch):
                trainer.step(tuple(x[at : at + batch] for x in f), types[at : at + batch])

        for b in batches:
            for text in b.column("text").to_pylist():
                held.append(tokens(text))
                size += len(held[-1])
                if size > 100_000:
                    learn()
                    held, size, touched = [], 0, True
        if held:
            learn()
            touched = True
        if touched:
            for k, name in enumerate(names):
                width = getattr(start, name).shape[1]
                moved = getattr(trainer.w, name) - getattr(start, name)
                for at in range(0, len(moved), rows):
                    part = moved[at : at + rows]
                    which = np.abs(part).max(axis=1) > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary()), pa.array([which.tobytes()], pa.binary())],
                        ["k", "at", "moved", "which"],
                    )

    def add(batches):
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for k, at, moved, which in zip(*(c.to_pylist() for c in b.columns)):
                hit = np.frombuffer(which, bool)
                part = np.frombuffer(moved, np.float32).reshape(len(hit), -1)
                if (k, at) not in sums:
                    sums[k, at] = [np.zeros(part.shape, np.float64), np.zeros(len(hit))]
                sums[k, at][0] += part
                sums[k, at][1] += hit
        for (k, at), (total, n) in sums.items():
            mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["k", "at", "moved"])

    deltas = docs.select("text").mapInArrow(run, "k int, at int, moved binary, which binary")
    means = deltas.repartition("k", "at").mapInArrow(add, "k int, at int, moved binary").collect()  # the size of the weights
    out = Weights(*(getattr(w, n).copy() for n in names))
    for r in means:
        table = getattr(out, names[r["k"]])
        part = np.frombuffer(r["moved"], np.float32).reshape(-1, table.shape[1])
        table[r["at"] : r["at"] + len(part)] += part
    return out


def score_rows(docs: DataFrame, v: Vocabulary, w: Weights) -> DataFrame:
    """For each row: n_tokens, tokens and sums of log10 over what the broadcast vocabulary knows, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((v, w))

    def run(batches):
        v, w = shared.value
        tokens = Tokens()
        base_of = np.log10((np.append(v.counts, 0) + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))
        # Known words without a type of their own: their share of their spelling type.
        share = np.log10((v.counts + 0.5) / (v.type_tokens + 0.5 * (v.type_words + 1))[(v.codes & np.uint64(63)).astype(np.int64)])
        in_type = np.append(np.where(v.types >= 0, 0.0, share), 0.0)  # the last one stands for place -1
        for b in batches:
            texts = b.column("text").to_pylist()
            cols: list[list] = [[] for _ in range(4)]
            rare, times = [], []
            for at in range(0, len(texts), 100):
                held = [tokens(t) for t in texts[at : at + 100]]
                codes, sizes = np.concatenate(held), np.array(list(map(len, held)))
                starts = np.cumsum(sizes) - sizes
                types, here = types_of(codes, v)
                known = here >= 0
                model = log_probability(w, features(types, starts), types) + np.where(known, in_type[here], 0.0)
                for col, values in zip(cols, (sizes, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(np.where(known, base_of[here], 0.0), starts), np.add.reduceat(model, starts))):
                    col.extend(values.tolist())
                for i, j in zip(starts.tolist(), (starts + sizes).tolist()):
                    other, n = np.unique(codes[i:j][~known[i:j]], return_counts=True)
                    rare.append(other)
                    times.append(n)
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            flat = lambda x, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names if c != "text"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), flat([r.view(np.int64) for r in rare], np.int64), flat(times, np.int32)],
                [*(c for c in b.schema.names if c != "text"), "n_tokens", "n_top", "base_top", "score_top", "rare", "times"],
            )

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_top long, base_top double, score_top double, rare array<long>, times array<int>")


def score_texts(docs: DataFrame, rounds: tuple[float, ...] = (0.15, 0.1), most: int = 500_000, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    All rows that are not held out train: the counts and one gradient pass cover every one of their
    tokens, in as many rounds as `rounds` has learning rates (rows are dealt to rounds by a hash). Null
    and empty texts are one end token. Repeated rows count each time; a null held_out trains. Words
    are told apart by 58-bit hashes and their spelling type. Nothing to train on: every token is unknown.

    The `most` most frequent words are broadcast with their counts (a fixed bound); rarer words of
    each text meet their counts in a join of written tables.
    """
    rows = docs.select(
        F.xxhash64(F.uuid()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held_out"), text_bytes(F.col(text_col)).alias("text")
    )
    training = rows.where(~F.col("held_out"))
    counts = written(token_rows(training).groupBy("code").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts, most)
    w = Weights.zero()
    turn = F.pmod(F.xxhash64(F.lit(17), "doc_id", F.length("text")), F.lit(len(rounds)))
    for k, rate in enumerate(rounds):
        w = train_round(training.where(turn == k), v.frequent(), w, rate)
    scored = written(score_rows(rows, v, w), "scored")  # the rows' random keys are fixed from here on
    rare_counts = counts.where(log_step() < v.cut)
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    room = F.array(*[F.lit(float(t + 0.5 * (k + 1))) for t, k in zip(v.type_tokens, v.type_words)])
    share = F.log10((n + 0.5) / F.get(room, F.col("code").bitwiseAND(F.lit(63)).cast("int")))
    base = F.log10((n + 0.5) / F.lit(v.tokens + 0.5 * (v.distinct + 1)))
    rest = (
        scored.select("row", F.inline(F.arrays_zip("rare", "times"))).toDF("row", "code", "times").join(rare_counts, "code", "left")
        .groupBy("row").agg(F.sum(F.when(n > 0, times).otherwise(0)).alias("known"), F.sum(times * base).alias("base"), F.sum(times * share).alias("share"))
    )
    zero = F.lit(0)
    return scored.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("known", zero)).cast("long").alias("n_known"), F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score_top") + F.coalesce("share", F.lit(0.0))).alias("score"),
    )
