"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import without

UND = "und"
EDGE = 32  # the code that stands before and after each word


def letters(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


def gram_codes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For every character (and end) of the words: hashes of its n-grams for n = 1..order, and which word it is in."""
    if not words:
        return [np.zeros(0, np.uint64)] * order, np.zeros(0, np.int64)
    pad = " " * (order - 1)
    text = np.frombuffer("".join(f"{pad}{w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes + order - 1) - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    codes, value = [], np.zeros(len(at), np.uint64)
    for n in range(order):
        value = (value ^ (text[at - n] + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        codes.append(value)
    return codes, word


def context_codes(words: list[str], order: int) -> list[np.ndarray]:
    """For the same characters: hashes of the n - 1 characters before them, for n = 2..order."""
    codes, _ = gram_codes([f" {w}" for w in words], order)
    # Position i of " w" is the character before position i of w, so its (n-1)-gram is the context.
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    keep = np.ones(int(sizes.sum()), bool)
    keep[np.cumsum(sizes) - 1] = False
    return [c[keep] for c in codes[: order - 1]]


@dataclass
class KneserNey:
    """Sorted hash arrays: n-gram -> discounted share, context -> weight of the lower order; a column for each language."""

    langs: list[str]
    order: int
    floor: float
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    temperature: float = 1.0
    usual: np.ndarray | None = None  # cross-entropy that nearly all texts of a language stay under
    spread: np.ndarray | None = None

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where((table[0][at] == keys)[:, None], table[1][at], np.float32(missing))

    def log_probability(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word for each language, and each word's number of characters, its end included."""
        codes, word = gram_codes(words, self.order)
        before = context_codes(words, self.order)
        p = np.full((len(word), len(self.langs)), self.floor, np.float32)
        for n in range(self.order):
            weight = self.contexts[0][1][0] if n == 0 else self.look(self.contexts[n], before[n - 1], 1.0)
            p = self.look(self.grams[n], codes[n], 0.0) + weight * p
        total = np.zeros((len(words), len(self.langs)), np.float64)
        np.add.at(total, word, np.log(p))
        return total, np.bincount(word, minlength=len(words))


def distinct_grams(words: list[str], times: np.ndarray, order: int) -> list[np.ndarray]:
    """The distinct n-grams of the highest order: hashes of their endings for n = 1..order, of their contexts for n = 2..order, and counts."""
    codes, word = gram_codes(words, order)
    _, first, inverse = np.unique(codes[-1], return_index=True, return_inverse=True)
    return [*(c[first] for c in (*codes, *context_codes(words, order))), np.bincount(inverse, times[word], len(first)).astype(np.int64)]


def fit(grams: dict[str, list[np.ndarray]], order: int, discount: float = 0.75) -> KneserNey:
    """From distinct_grams for each language. The highest order counts occurrences, lower ones distinct left neighbours."""
    langs = sorted(grams)
    model = KneserNey(langs, order, 1.0 / 4096)
    for n in range(order):
        parts, contexts = [], []
        for column, lang in enumerate(langs):
            codes, before, times = grams[lang][:order], grams[lang][order:-1], grams[lang][-1]
            if n == order - 1:
                keys, first, inverse = np.unique(codes[n], return_index=True, return_inverse=True)
                c = np.bincount(inverse, times)
            else:  # each distinct longer n-gram counts once for the n-gram that ends it
                _, longer = np.unique(codes[n + 1], return_index=True)
                keys, first_of, c = np.unique(codes[n][longer], return_index=True, return_counts=True)
                first = longer[first_of]
            ctx_keys, inverse = np.unique(before[n - 1][first] if n else np.zeros(len(first), np.uint64), return_inverse=True)
            total = np.bincount(inverse, c)
            parts.append((keys, np.maximum(c - discount, 0) / total[inverse]))
            contexts.append((ctx_keys, discount * np.bincount(inverse) / total))
        for source, into, fill in ((parts, model.grams, 0.0), (contexts, model.contexts, 1.0)):
            keys = np.unique(np.concatenate([k for k, _ in source]))
            values = np.full((len(keys), len(langs)), fill, np.float32)
            for column, (k, v) in enumerate(source):
                values[np.searchsorted(keys, k), column] = v
            into.append((keys, values))
    return model


def train(counts: dict[str, dict[str, int]], order: int = 4, discount: float = 0.75) -> KneserNey:
    """From word counts for each language."""
    words = {lang: sorted(c) for lang, c in counts.items()}
    return fit({lang: distinct_grams(w, np.array([counts[lang][x] for x in w], np.float64), order) for lang, w in words.items()}, order, discount)


class Scorer:
    """Texts -> cross-entropy for each language; words seen before in the task are not scored again."""

    def __init__(self, model: KneserNey, most: int = 200_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs) + 1))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) nats a character, and characters; no letter: zeros."""
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        for at in range(0, len(texts), 256):
            if len(self.ids) > self.most:
                self.reset()
            ids, known = self.ids, len(self.ids)
            rows = []
            for text in texts[at : at + 256]:
                tokens = text.split()
                rows.append(np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, len(tokens)))
            if len(ids) > known:
                self.scores = np.concatenate([self.scores, self._new(list(ids)[known:])])
            for i, row in enumerate(rows, at):
                if len(row):
                    out[i] = self.scores[row].sum(axis=0)
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n

    def _new(self, tokens: list[str]) -> np.ndarray:
        words = [letters(t) for t in tokens]
        full = [i for i, w in enumerate(words) if w]
        out = np.zeros((len(tokens), len(self.model.langs) + 1))
        for at in range(0, len(full), 1 << 14):
            some = full[at : at + (1 << 14)]
            out[some, :-1], out[some, -1] = self.model.log_probability([words[i] for i in some])
        return out


def calibrate(model: KneserNey, entropy: np.ndarray, n: np.ndarray, right: np.ndarray, least_score: float = 0.2) -> KneserNey:
    """A temperature for the posteriors by likelihood, and for each language the cross-entropies that speak for it.

    entropy (texts x languages), n (characters) and right (the language's column) are of texts not counted. Up to `usual`
    nothing is doubted. Texts of the other languages say where foreign texts begin, each held against the
    languages but its own; three quarters of the way there, so beyond texts half of which are foreign,
    the score falls under least_score.
    """
    use = n > 0
    entropy, n, right = entropy[use], n[use], right[use]
    model.usual = np.full(len(model.langs), np.log(4096.0))
    model.spread = np.ones(len(model.langs))
    if not len(n):
        return model
    evidence = -entropy * np.sqrt(n)[:, None]

    def loss(t: float) -> float:
        z = evidence / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), right] - np.log(np.exp(z).sum(axis=1))).mean())

    model.temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    others = entropy.copy()
    others[np.arange(len(right)), right] = np.inf
    foreign = np.sort(others.min(axis=1))[len(right) // 20] if len(model.langs) > 1 else np.log(4096.0)
    for column in range(len(model.langs)):
        own = entropy[right == column, column]
        if len(own):
            model.usual[column] = max(own.mean() + 6 * own.std(), own.max())
            edge = own.mean() + 0.75 * (foreign - own.mean())
            model.spread[column] = max(edge - model.usual[column], 0.5) / np.log(1 / least_score)  # half a nat more than usual is never enough
    return model


def decide(model: KneserNey, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of the least cross-entropy, and its calibrated posterior, lower where even that is unusually high; a few characters say little."""
    best = entropy.argmin(axis=1)
    root = np.sqrt(np.maximum(n, 1))
    z = -entropy * root[:, None] / model.temperature
    z = z - z.max(axis=1, keepdims=True)
    posterior = 1 / np.exp(z).sum(axis=1)
    excess = np.maximum(entropy[np.arange(len(best)), best] - model.usual[best] - 6 / root, 0) / model.spread[best]
    return best, np.where(n > 0, posterior * np.exp(-excess), 0.0)


def gram_counts(sample: DataFrame, order: int, most: int = 200_000) -> DataFrame:
    """distinct_grams of (lang, text) as rows, counted in the tasks and then summed; a task holds about `most` distinct words at once."""
    names = [*(f"c{k}" for k in range(1, order + 1)), *(f"x{k}" for k in range(2, order + 1)), "n"]

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, words in held.items():
                words.pop("", None)
                if words:
                    *codes, n = distinct_grams(list(words), np.fromiter(words.values(), np.float64, len(words)), order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(pa.array(c.view(np.int64)) for c in codes), pa.array(n)], ["lang", *names])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(map(letters, (text or "").split()))
                if sum(map(len, held.values())) > most:
                    yield from rows()
        yield from rows()

    top = f"c{order}"
    counted = sample.select("lang", "text").mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in names)}")
    return counted.groupBy("lang", top).agg(*[F.first(c).alias(c) for c in names if c not in (top, "n")], F.sum("n").alias("n")).select("lang", *names)


def entropies(texts: DataFrame, model: KneserNey) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (lang, text): cross-entropies, characters and the language's column; texts of languages not in the model are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            entropy, n = scorer([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shared.value.langs.index(x) for x in b.column("lang").to_pylist()], pa.int32()), pa.array(n), pa.array(list(entropy), pa.list_(pa.float64()))],
                ["lang", "n", "entropy"],
            )

    known = texts.select("lang", "text").where(F.col("lang").isin(model.langs))
    got = known.mapInArrow(run, "lang int, n double, entropy array<double>").toArrow()
    flat = got["entropy"].combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0)
    return flat.reshape(-1, len(model.langs)), got["n"].to_numpy(), got["lang"].to_numpy().astype(np.int64)


def learn(labelled: DataFrame, most: int = 1500, order: int = 4) -> KneserNey | None:
    """A model from (doc_id, text, lang); null langs are left out. None if no row has a lang and a letter.

    It is fitted on a sample of about `most` rows of each language, taken by a hash of the id and
    text, whole texts; a fifth of those only calibrate. Texts stay in the executors: hashes of distinct
    n-grams with their counts, and cross-entropies of the calibrating texts, reach the driver.
    """
    rows = labelled.where("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))]), F.col("lang"))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.where(pick < share).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(5)) == 0)
    counted = gram_counts(sample.where("NOT held"), order).toArrow()
    if not len(counted):
        return None
    which = counted["lang"].combine_chunks().dictionary_encode()
    column, codes = which.indices.to_numpy(), [c.to_numpy().view(np.uint64) for c in counted.columns[1:]]
    grams = {lang: [c[column == k] for c in codes[:-1]] + [codes[-1][column == k].view(np.int64)] for k, lang in enumerate(which.dictionary.to_pylist())}
    del counted, codes
    model = fit(grams, order)
    return calibrate(model, *entropies(sample.where("held"), model))


def identify(docs: DataFrame, model: KneserNey | None, text_col: str = "text", least_score: float = 0.2) -> DataFrame:
    """docs plus lang_pred, score (0 to 1) and rejected; columns of those names are replaced.

    Null texts and texts without a letter are `und` with score 0 and rejected; other texts get the
    language of the least cross-entropy a character and are rejected if its calibrated score is
    under least_score. Only the text is looked at, all of it. Without a model all rows are `und`.
    """
    base = without(docs, "lang_pred", "score", "rejected")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        scorer = Scorer(known) if known else None
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            langs, score = [UND] * len(texts), np.zeros(len(texts))
            if scorer and texts:
                entropy, n = scorer(texts)
                best, score = decide(known, entropy, n)
                langs = [known.langs[k] if m else UND for k, m in zip(best, n)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(score < least_score)],
                [*b.schema.names, "lang_pred", "score", "rejected"],
            )

    return base.mapInArrow(run, schema)
