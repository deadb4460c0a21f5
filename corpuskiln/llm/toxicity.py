"""Toxicity by the nearest labelled examples, found exactly in a block-max inverted index of TF-IDF vectors.

Every term of the labelled sample is in the index. A term's weight is its inverse document frequency over the corpus
times its association with the label (the squared phi coefficient, between 0 and 1): neighbours are
near for what tells the labels apart, and terms that tell little weigh little, but none is left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import discard, without, written

TIE_BITS = 20  # an index holds fewer rows than this many bits count
LAST = (1 << TIE_BITS) - 1
PUNCTUATION = ".,;:!?\"'()[]{}<>*_|`~#$%&@^-+=/\\“”«»…"


def term(token: str) -> str:
    return token.strip(PUNCTUATION).lower()


class Terms:
    """Texts -> counts of the known terms, each distinct token of some texts looked at once."""

    def __init__(self, terms: dict[str, int], most: int = 200_000):
        self.terms, self.most, self.seen = terms, most, {}

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """The number of each token's term, or -1."""
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = [seen.get(token, -2) for token in tokens]
        for i, k in enumerate(out):
            if k == -2:
                out[i] = seen[tokens[i]] = self.terms.get(term(tokens[i]), -1)
        return np.array(out, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text begins in terms and times, which are in the order of a text's tokens. Arrow splits at the white space that str.split knows."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        tokens = lists.flatten().dictionary_encode()
        numbers = self.numbers(tokens.dictionary.to_numpy(zero_copy_only=False).tolist())[tokens.indices.to_numpy()]
        row, width = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), max(len(self.terms), 1)
        key, first, times = np.unique((row * width + numbers)[numbers >= 0], return_index=True, return_counts=True)
        order = np.argsort(first)
        key, times = key[order], times[order]
        return np.searchsorted(key // width, np.arange(len(lists) + 1)), key % width, times


def slices(b: pa.RecordBatch, text: str, most: int = 8 << 20) -> list[pa.Array]:
    """The texts of a batch in slices of some megabytes, so that what is made of their tokens is bounded."""
    rows = max(1, min(2000, most * len(b) // max(b.column(text).nbytes, 1)))
    return [b.column(text).slice(at, rows) for at in range(0, len(b), rows)]


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for sizes[0] places, then the same for the others."""
    return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Index:
    """Labelled unit vectors by row and, inverted, by term; rows lie in blocks, and of every frequent term each block's largest weight is known."""

    terms: dict[str, int]
    term_weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    size: int  # rows in a block
    prior: float
    at: np.ndarray | None = None  # where each row begins in:
    row_terms: np.ndarray | None = None
    row_times: np.ndarray | None = None
    row_x: np.ndarray | None = None
    post_at: np.ndarray | None = None  # where each term begins in:
    post_rows: np.ndarray | None = None
    post_x: np.ndarray | None = None
    top: np.ndarray | None = None  # by term: its largest weight
    common: np.ndarray | None = None  # by term: its number among the frequent ones, or -1
    block_top: np.ndarray | None = None  # frequent terms x blocks
    tie: np.ndarray | None = None  # by row: falls with the id
    row_of: np.ndarray | None = None  # rows by rising id
    dense_of: np.ndarray | None = None  # by term: its number among those with a row in dense_x, or -1
    dense_x: np.ndarray | None = None  # most frequent terms x rows, in single precision
    span_top: np.ndarray | None = None  # those terms x spans of blocks: the largest weights
    slope: float = 1.0
    shift: float = 0.0

    def unit(self, terms: np.ndarray, times: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Weights of unit length for each row; a row without weight is zero."""
        x = (1 + np.log(times)) * self.term_weight[terms]
        return x / np.maximum(np.sqrt(np.bincount(row, x * x, rows)), 1e-300)[row]

    def vector(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms, times = np.fromiter(bag, np.int64, len(bag)), np.fromiter(bag.values(), np.float64, len(bag))
        return terms, self.unit(terms, times, np.zeros(len(bag), np.int64), 1)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        self.ready()
        return self.row_terms[self.at[i] : self.at[i + 1]], self.row_x[self.at[i] : self.at[i + 1]]

    def dense(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For tests."""
        out = np.zeros((len(vectors), len(self.term_weight)))
        for i, (terms, x) in enumerate(vectors):
            out[i, terms] = x
        return out

    def fill(self, at: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """From rows of term counts; rows that share their heaviest term are laid side by side, which keeps the blocks' bounds tight."""
        n = len(self.ids)
        if n > LAST:
            raise ValueError(f"an index holds at most {LAST} rows; take a smaller sample of labelled rows")
        row = np.repeat(np.arange(n), np.diff(at))
        x = self.unit(terms, times, row, n)
        most = np.zeros(n)
        np.maximum.at(most, row, x)
        lead = np.full(n, -1)  # each row's heaviest term
        top = np.flatnonzero(x == most[row])
        lead[row[top]] = terms[top]
        order = np.lexsort((self.ids, lead))
        self.ids, self.toxic, self.weight = self.ids[order], self.toxic[order], self.weight[order]
        sizes = np.diff(at)[order]
        take = ragged(at[:-1][order], sizes)
        self.at, self.row_terms, self.row_times = np.append(0, np.cumsum(sizes)), terms[take].astype(np.int32), times[take].astype(np.int32)

    def ready(self) -> None:
        """Postings are made where they are first asked for: in the tasks, not on the driver."""
        if self.row_of is None:
            self.invert(self.at, self.row_terms, self.row_times)

    #: What invert makes anew from the rest; a broadcast leaves it out.
    DERIVED = ("row_x", "post_at", "post_rows", "post_x", "top", "common", "block_top", "tie", "row_of", "dense_of", "dense_x", "span_top", "_add")

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k not in self.DERIVED}
        small = np.uint16 if not len(self.row_times) or self.row_times.max() < 1 << 16 else np.int32
        packed = {"terms": "\n".join(self.terms).encode(), "row_terms": self.row_terms.tobytes(), "row_times": self.row_times.astype(small).tobytes()}  # no term holds white space
        return state | {k: zlib.compress(v, 1) for k, v in packed.items()} | {"small": small}

    def __setstate__(self, state: dict) -> None:
        small = state.pop("small")
        words, terms, times = (zlib.decompress(state.pop(k)) for k in ("terms", "row_terms", "row_times"))
        self.__dict__.update(state)
        self.terms = {w: k for k, w in enumerate(words.decode().split("\n"))} if words else {}
        self.row_terms, self.row_times = np.frombuffer(terms, np.int32), np.frombuffer(times, small).astype(np.int32)

    def invert(self, at: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Weights, postings and bounds of rows in their order."""
        n = len(self.ids)
        self.at, self.row_terms, self.row_times = at, terms, times
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        self.row_x = self.unit(terms, times, row, n)
        by = np.argsort(terms, kind="stable")
        self.post_at = np.searchsorted(terms[by], np.arange(len(self.term_weight) + 1))
        self.post_rows, self.post_x = row[by], self.row_x[by]
        held = np.flatnonzero(np.diff(self.post_at))
        self.top = np.zeros(len(self.term_weight))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.post_x, self.post_at[held])
        often = np.flatnonzero(np.diff(self.post_at) > max(n / 16, self.size))
        self.common = np.full(len(self.term_weight), -1, np.int32)
        self.common[often] = np.arange(len(often))
        self.block_top = np.zeros((len(often), -(-n // self.size)))
        here = self.common[self.row_terms] >= 0
        np.maximum.at(self.block_top, (self.common[self.row_terms[here]], row[here] // self.size), self.row_x[here])
        self.row_of = np.argsort(self.ids, kind="stable")
        self.tie = np.empty(n, np.int64)
        self.tie[self.row_of] = LAST - np.arange(n)  # of equal cosines the smaller id has the larger tie
        self.lay_out(row)

    def lay_out(self, row: np.ndarray, most_cells: int = 12_000_000, thin: int = 16) -> None:
        """The most frequent terms, each in over 1 / `thin` of the rows, also as rows of a matrix of at most `most_cells` weights.
        A cell costs some 1 / 250 of a posting, and a query holds a term about as often as a row does: so from a sixteenth on the matrix is cheaper."""
        n, held = len(self.ids), np.diff(self.post_at)
        chosen = np.argsort(-held, kind="stable")[: most_cells // max(n, 1)]
        chosen = chosen[held[chosen] > n / thin]
        self.dense_of = np.full(len(self.term_weight), -1, np.int32)
        self.dense_of[chosen] = np.arange(len(chosen))
        self.dense_x = np.zeros((len(chosen), n), np.float32)
        here = self.dense_of[self.row_terms] >= 0
        self.dense_x[self.dense_of[self.row_terms[here]], row[here]] = self.row_x[here]
        self.span_top = np.maximum.reduceat(self.dense_x, np.arange(0, n, self.span), axis=1) if n else np.zeros((len(chosen), 0), np.float32)

    @property
    def span(self) -> int:
        """Rows in a span of blocks, the unit that a batch of queries skips or opens."""
        return 16 * self.size

    def one(self, terms: np.ndarray, x: np.ndarray, k: int, skip: int = -1, spare: float = 0.03) -> np.ndarray:
        """Keys (a cosine of 12 digits and its tie in one integer) of the k best rows, best first, 0 where there are fewer.

        Postings of all terms are added up but for frequent ones of little weight, `spare` in all at most. With what those can add,
        by the blocks' maxima, whole blocks fall short of the k-th best; in the other blocks the rows that don't are completed."""
        self.ready()
        n, best = len(self.ids), np.zeros(k, np.int64)
        if not n or not len(terms):
            return best
        most = np.where(self.common[terms] >= 0, x * self.top[terms], 2.0)
        order = np.argsort(most)
        late = order[: np.searchsorted(np.cumsum(most[order]), spare, "right")]
        now = np.delete(np.arange(len(terms)), late)
        begin, sizes = self.post_at[terms[now]], self.post_at[terms[now] + 1] - self.post_at[terms[now]]
        place = ragged(begin, sizes)
        partial = np.bincount(self.post_rows[place], self.post_x[place] * np.repeat(x[now], sizes), n)
        if skip >= 0:
            partial[skip] = -1.0
        rest = x[late] @ self.block_top[self.common[terms[late]]] if len(late) else np.zeros(-(-n // self.size))
        floor = max(np.partition(partial, -k)[-k] if n > k else 0.0, 0.0) - 1e-11
        starts = np.arange(0, n, self.size)
        open_ = np.flatnonzero(np.maximum.reduceat(partial, starts) + rest >= floor)
        rows = ragged(starts[open_], np.minimum(self.size, n - starts[open_]))
        rows = rows[partial[rows] + rest[rows // self.size] >= floor]
        score = partial[rows]
        if len(late):
            score = score + self.cosines(terms[late], x[late], rows)
        if len(rows) > k:
            rows = rows[score >= np.partition(score, -k)[-k] - 1e-11]
        whole = np.rint(self.cosines(terms, x, rows) * 1e12).astype(np.int64)  # added up in one order whatever the way here
        keys = np.where((whole > 0) & (rows != skip), (whole << TIE_BITS) | self.tie[rows], 0)
        keys = -np.sort(-(np.partition(keys, -k)[-k:] if len(keys) > k else keys))
        best[: len(keys)] = keys
        return best

    def cosines(self, terms: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact cosines of a vector with some rows."""
        if not hasattr(self, "_add"):
            self._add = np.zeros(len(self.term_weight))  # kept between calls: clearing a few places is cheaper than a new array
        self._add[terms] = x
        sizes = self.at[rows + 1] - self.at[rows]
        place = ragged(self.at[rows], sizes)
        got = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.row_x[place] * self._add[self.row_terms[place]], len(rows))
        self._add[terms] = 0
        return got

    def many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int]) -> np.ndarray:
        """What `one` gives, for a batch of queries with many postings.

        Postings of the rarer terms are added up; frequent terms add products of matrices, span by span. A query whose bound in a
        span, by the largest weights there, is below its k-th best elsewhere skips it. Single precision only chooses rows: those within its
        largest error of the k-th best get their exact cosines."""
        n, m, width = len(self.ids), len(vectors), len(self.dense_x)
        slack = (width + 64) * 2.0**-23  # twice the largest error of a sum of width + 64 products that is at most 1
        sizes = [len(t) for t, _ in vectors]
        owner = np.repeat(np.arange(m), sizes)
        terms, x = (np.concatenate(part) for part in zip(*vectors))
        number = self.dense_of[terms]
        query = np.zeros((m, width), np.float32)
        query[owner[number >= 0], number[number >= 0]] = x[number >= 0]
        score = np.empty((m, n), np.float32)
        for i, (own, weights) in enumerate(vectors):  # one after the other: what one needs stays in the processor's cache
            rare = self.dense_of[own] < 0
            begin, held = self.post_at[own[rare]], self.post_at[own[rare] + 1] - self.post_at[own[rare]]
            place = ragged(begin, held)
            score[i] = np.bincount(self.post_rows[place], self.post_x[place] * np.repeat(weights[rare], held), n)
        for i, row in enumerate(skip):
            if row >= 0:
                score[i, row] = -2.0
        most = query @ self.span_top
        floor = np.zeros(m, np.float32)
        for j, at in enumerate(range(0, n, self.span)):
            part = score[:, at : at + self.span]
            open_ = np.flatnonzero(part.max(axis=1) + most[:, j] >= floor - slack)
            if len(open_):
                some = slice(None) if len(open_) == m else open_  # a slice spares copies
                part[some] += query[some] @ self.dense_x[:, at : at + self.span]
                if part.shape[1] > k:
                    floor[some] = np.maximum(floor[some], np.partition(part[some], -k, axis=1)[:, -k])
        for i, row in enumerate(skip):
            if row >= 0:
                score[i, row] = -2.0
        out = np.zeros((m, k), np.int64)
        for i in range(m):
            rows = np.flatnonzero(score[i] >= max(floor[i] - slack, 1e-13))
            if len(rows) > k:
                rows = rows[score[i, rows] >= np.partition(score[i, rows], -k)[-k] - slack]
            whole = np.rint(self.cosines(*vectors[i], rows) * 1e12).astype(np.int64)
            keys = np.where(whole > 0, (whole << TIE_BITS) | self.tie[rows], 0)
            keys = -np.sort(-keys)[:k]
            out[i, : len(keys)] = keys
        return out

    def keys(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int], batch: int = 64) -> np.ndarray:
        """The k best keys of each vector. Vectors with few postings are looked up one by one, the others in batches; both ways are exact."""
        held, out = np.diff(self.post_at), np.zeros((len(vectors), k), np.int64)
        costs = np.array([held[t].sum() for t, _ in vectors])
        few = costs <= self.dense_x.size / 350  # a posting costs about as much as so many cells of the matrix
        for i in np.flatnonzero(few):
            out[i] = self.one(*vectors[i], k, skip[i])
        heavy = np.flatnonzero(~few)
        for at in range(0, len(heavy), batch):
            some = heavy[at : at + batch]
            out[some] = self.many([vectors[i] for i in some], k, [skip[i] for i in some])
        return out

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each vector (terms, weights) the k labelled rows of the largest cosine over 0 (-1 where there are fewer), ties to
        the smaller id, without row skip[i], and their cosines."""
        self.ready()
        out = self.keys(vectors, k, [-1] * len(vectors) if skip is None else [int(i) for i in skip])
        rows = np.where(out > 0, self.row_of[np.where(out > 0, LAST - (out & LAST), 0)], -1) if len(self.ids) else np.full((len(vectors), k), -1)
        return rows, (out >> TIE_BITS) / 1e12

    def votes(self, rows: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of label 1 among neighbours, weighted by nearness and by what each row stands for."""
        w = np.where(rows >= 0, self.weight[rows] / (1.05 - cosine), 0.0)
        return ((w * self.toxic[rows]).sum(axis=1) + 0.5 * self.prior) / (w.sum(axis=1) + 0.5)

    def vectors(self, at: np.ndarray, terms: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What vector gives, for rows of term counts."""
        x = self.unit(terms, times, np.repeat(np.arange(len(at) - 1), np.diff(at)), len(at) - 1)
        return [(terms[a:b], x[a:b]) for a, b in zip(at[:-1], at[1:])]

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and neighbours with their cosines; without a neighbour the score is the rate of label 1."""
        rows, cosine = self.nearest(vectors, k)
        some = rows[:, 0] >= 0
        scores = np.full(len(vectors), self.prior)
        scores[some] = self.calibrated(self.votes(rows[some], cosine[some]))
        return scores, rows, cosine

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        v = np.clip(vote, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic, weight): at most about `most` labelled documents, half of them for each label, by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, most / 2 / n)).otherwise(share)
    chosen = known.withColumn("share", share).where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_003)) / 1_000_003.0 < F.col("share"))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("label_id"), "toxic", F.try_divide(F.lit(1.0), F.col("share")).alias("weight")))  # about `most` rows
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", "weight")


def term_counts(texts: DataFrame, shared) -> tuple[np.ndarray, int]:
    """For each of the broadcast terms the number of rows that hold it, over all rows, and the number of rows."""

    def run(batches):
        look, n, df = Terms(shared.value), 0, np.zeros(len(shared.value), np.int64)
        for b in batches:
            n += len(b)
            for part in slices(b, "text"):
                df += np.bincount(look(part)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], ["k", "n"])

    got = texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got["k"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(shared.value))
    df[k[k >= 0]] = n[k >= 0]
    return df, int(n[k < 0].sum())


def numbered(rows: DataFrame, shared) -> DataFrame:
    """The rows of bags_of with the terms as their numbers."""

    def run(batches):
        terms = shared.value
        for b in batches:
            numbers = pa.array([[terms[w] for w in bag] for bag in b.column("terms").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([numbers if c == "terms" else b.column(c) for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, "doc_id long, toxic int, weight double, terms array<int>, times array<int>")


def bags_of(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight, terms, times) with the terms as strings."""

    def run(batches):
        for b in batches:
            bags = []
            for text in b.column("text").to_pylist():
                bag: Counter = Counter()
                for token, n in Counter((text or "").split()).items():
                    bag[term(token)] += n
                bag.pop("", None)
                bags.append(bag)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), b.column("weight"), pa.array([list(x) for x in bags], pa.list_(pa.string())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "weight", "terms", "times"],
            )

    rows = labelled.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int"), F.col("weight").cast("double"))
    return rows.mapInArrow(run, "doc_id long, toxic int, weight double, terms array<string>, times array<int>")


def associations(rows: DataFrame, labelled: int, toxic: int) -> tuple[dict[str, int], np.ndarray]:
    """Every term of the rows with a number, and the squared phi coefficient of its presence with label 1."""
    got = rows.select("toxic", F.explode("terms").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).toArrow()
    a, n = got["a"].to_numpy().astype(float), got["n"].to_numpy().astype(float)
    b, clean = n - a, labelled - toxic
    below = n * (labelled - n) * max(toxic, 1) * max(clean, 1)
    return {w: k for k, w in enumerate(got["w"].to_pylist())}, np.where(below > 0, (a * (clean - b) - b * (toxic - a)) ** 2 / np.maximum(below, 1), 0.0)


def left_out(spark: SparkSession, index: Index, k: int) -> np.ndarray:
    """The vote of each indexed row by its neighbours other than itself."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        known = shared.value
        for b in batches:
            rows = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(known.votes(*known.nearest(list(map(known.row, rows.tolist())), k, skip=rows)))], ["id", "vote"])

    got = spark.range(len(index.ids)).mapInArrow(run, "id long, vote double").toArrow()
    votes = np.zeros(len(index.ids))
    shared.destroy()
    votes[got["id"].to_numpy()] = got["vote"].to_numpy()
    return votes


def learn(docs: DataFrame, labelled: DataFrame, block: int = 64, k: int = 15) -> Index:
    """An index of the labelled rows (doc_id, text, toxic, weight) over all their terms.

    The rows are a bounded sample, so they come to the driver as term counts; document
    frequencies of the terms are counted over all of docs. A leave-one-out vote of every indexed row
    calibrates the scores (Platt). Without labelled rows, or with one label only, the index has no neighbour
    to tell apart and every text gets the smoothed rate of label 1.
    """
    stored = written(bags_of(labelled), "bags")
    n, n1 = (lambda r: (r["n"], r["a"] or 0))(stored.agg(F.count("*").alias("n"), F.sum("toxic").alias("a")).first())
    terms, phi = associations(stored, n, n1)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    df, total = term_counts(docs, shared)
    weight = (np.log((total + 1) / (df + 1)) + 1) * phi
    got = numbered(stored, shared).toArrow()
    shared.destroy()
    discard(stored)
    column = lambda c: got[c].to_numpy()
    stands_for, toxic = column("weight"), column("toxic").astype(float)
    prior = float(((stands_for * toxic).sum() + 0.5) / (stands_for.sum() + 1))
    lists, times = got["terms"].combine_chunks(), got["times"].combine_chunks()
    index = Index(terms, weight, column("doc_id"), toxic, stands_for, block, prior)
    flat = lists.flatten().to_numpy().astype(np.int64) if len(got) else np.zeros(0, np.int64)
    at = np.append(0, np.cumsum(lists.value_lengths().to_numpy())) if len(got) else np.zeros(1, np.int64)
    index.fill(at.astype(np.int64), flat, times.flatten().to_numpy().astype(float) if len(got) else np.zeros(0))
    del got, lists, times, flat
    if not 0 < n1 < n:
        return index
    votes = left_out(docs.sparkSession, index, k)
    z = np.log(np.clip(votes, 1e-4, 1 - 1e-4) / (1 - np.clip(votes, 1e-4, 1 - 1e-4)))
    for _ in range(300):  # a little ridge keeps separable labels finite
        p = 1 / (1 + np.exp(-(index.slope * z + index.shift)))
        g = index.weight * (p - index.toxic) / index.weight.sum()
        index.slope -= 0.5 * ((g * z).sum() + 0.01 * (index.slope - 1))
        index.shift -= 0.5 * (g.sum() + 0.01 * index.shift)
    return index


def assess(docs: DataFrame, index: Index, k: int = 15, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1), predicted (1 from `threshold`) and evidence: up to 3 nearest labelled examples.

    Columns of those names are replaced. Null and empty texts, and texts without any term of the
    index that tells labels apart, get the smoothed rate of label 1. Repeated rows score alike; of
    equally near examples the smaller id wins.
    """
    base = without(docs, "score", "predicted", "evidence")
    item = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(item))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    arrow_item = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        known = shared.value
        look = Terms(known.terms)
        for b in batches:
            found = [known.score(known.vectors(*look(part)), k) for part in slices(b, text_col)]
            scores, rows, cosine = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0), np.zeros((0, k), np.int64), np.zeros((0, k)))
            evidence = [
                [{"doc_id": int(known.ids[r]), "cosine": float(c), "toxic": int(known.toxic[r])} for r, c in zip(rs, cs) if r >= 0]
                for rs, cs in zip(rows[:, :3], cosine[:, :3])
            ]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(evidence, arrow_item)],
                [*b.schema.names, "score", "predicted", "evidence"],
            )

    return base.mapInArrow(run, schema)
