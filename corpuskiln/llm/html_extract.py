"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import without
from .html_blocks import Block, blocks_of, marked_pages

PATHS, WORDS, SCALARS = 1024, 1024, 8


class Encoder:
    """Blocks -> hashed path names, hashed words, and a few numbers; hashes are computed once for each name or word."""

    def __init__(self, most: int = 200_000):
        self.most, self.paths, self.words = most, {}, {}

    def path(self, names: tuple[str, ...]) -> list[int]:
        got = self.paths.get(names)
        if got is None:
            if len(self.paths) > self.most:
                self.paths.clear()
            keys = [*names, *(f"{a}>{b}" for a, b in zip(names, names[1:]))] or ["-"]
            got = self.paths[names] = [zlib.crc32(k.encode()) % PATHS for k in keys]
        return got

    def word(self, text: str) -> list[int]:
        words, out = self.words, []
        if len(words) > self.most:
            words.clear()
        for w in text.split(" "):
            k = words.get(w)
            if k is None:
                k = words[w] = zlib.crc32(w.lower().strip(".,;:!?()").encode()) % WORDS
            out.append(k)
        return out

    def numbers(self, b: Block, at: int, total: int, n_words: int) -> tuple:
        n = len(b.text)
        return (np.log1p(n) / 6, b.link_chars / n, np.log1p(n_words) / 4, float(b.text[-1] in ".!?\"'”»…"), at / max(total - 1, 1), min(at, 8) / 8, min(total - 1 - at, 8) / 8, 1.0)


@dataclass
class Batch:
    """Pages padded to one length: flat hashes with where each block's begin, numbers, and which cells are blocks."""

    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray
    cell: np.ndarray  # flat position time * pages + page of each block
    shape: tuple[int, int]


def collate(pages: list[list[Block]], encoder: Encoder) -> Batch:
    longest, n = max(map(len, pages)), len(pages)
    path, path_at, word, word_at, numbers, cell = [], [], [], [], [], []
    for i, page in enumerate(pages):
        for t, b in enumerate(page):
            path_at.append(len(path))
            path += encoder.path(b.path)
            word_at.append(len(word))
            words = encoder.word(b.text)
            word += words
            numbers.append(encoder.numbers(b, t, len(page), len(words)))
            cell.append(t * n + i)
    return Batch(*(np.array(x, np.int64) for x in (path, path_at, word, word_at)), np.array(numbers, np.float64), np.array(cell, np.int64), (longest, n))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings of path names and words, an LSTM in each direction, and a logistic output for each block."""

    def __init__(self, embed: int = 16, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        size = 2 * embed + SCALARS
        self.hidden = hidden
        self.p = {"path": r.normal(0, 0.3, (PATHS, embed)), "word": r.normal(0, 0.3, (WORDS, embed)), "out": r.normal(0, 0.3, (2 * hidden, 1)), "skip": np.zeros((size, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"{d}x": r.normal(0, size**-0.5, (size, 4 * hidden)), f"{d}h": r.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"{d}b": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    def inputs(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n_path, n_word = np.diff([*b.path_at, len(b.path)]), np.diff([*b.word_at, len(b.word)])
        path = np.add.reduceat(self.p["path"][b.path], b.path_at) / np.sqrt(n_path)[:, None]
        word = np.add.reduceat(self.p["word"][b.word], b.word_at) / n_word[:, None]
        return np.concatenate([path, word, b.numbers], 1), n_path, n_word

    def run(self, b: Batch, keep: bool = False):
        """Logit of each block; with keep also what the gradient needs."""
        x, n_path, n_word = self.inputs(b)
        (steps, n), h = b.shape, self.hidden
        grid = np.zeros((steps * n, x.shape[1]))
        grid[b.cell] = x
        mask = np.zeros((steps * n, 1))
        mask[b.cell] = 1
        mask = mask.reshape(steps, n, 1)
        both, saved = [], {}
        for d in "fb":
            zx = (grid @ self.p[f"{d}x"] + self.p[f"{d}b"]).reshape(steps, n, 4 * h)
            hs, trace = np.zeros((steps, n, h)), []
            hid, mem = np.zeros((n, h)), np.zeros((n, h))
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = zx[t] + hid @ self.p[f"{d}h"]
                gates = sigmoid(z[:, : 3 * h])
                i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
                m = mask[t]  # padding leaves the state as it is
                mem_new = m * (f * mem + i * g) + (1 - m) * mem
                tm = np.tanh(mem_new)
                hid_new = m * (o * tm) + (1 - m) * hid
                if keep:
                    trace.append((t, i, f, o, g, mem, tm, hid, m))
                mem, hid = mem_new, hid_new
                hs[t] = hid
            both.append(hs.reshape(steps * n, h))
            saved[d] = trace
        state = np.concatenate(both, 1)[b.cell]
        logit = (state @ self.p["out"] + x @ self.p["skip"])[:, 0] + self.p["bias"][0]
        return (logit, (x, n_path, n_word, grid, state, saved)) if keep else logit

    def gradient(self, b: Batch, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logit, (x, n_path, n_word, grid, state, saved) = self.run(b, keep=True)
        (steps, n), h = b.shape, self.hidden
        p = sigmoid(logit)
        d = ((p - label) / len(label))[:, None]
        grad = {"out": state.T @ d, "skip": x.T @ d, "bias": d.sum(axis=0)}
        dx = d @ self.p["skip"].T
        d_grid = np.zeros_like(grid)
        d_state = d @ self.p["out"].T
        for k, way in enumerate("fb"):
            dh_all = np.zeros((steps * n, h))
            dh_all[b.cell] = d_state[:, k * h : (k + 1) * h]
            dh_all = dh_all.reshape(steps, n, h)
            dz_all = np.zeros((steps, n, 4 * h))
            dh, dm = np.zeros((n, h)), np.zeros((n, h))
            gh = np.zeros_like(self.p[f"{way}h"])
            for t, i, f, o, g, mem, tm, hid, m in reversed(saved[way]):
                dh = dh + dh_all[t]
                do = m * dh * tm
                dmem = dm + m * dh * o * (1 - tm * tm)
                act = m * dmem
                dz = np.concatenate([act * g * i * (1 - i), act * mem * f * (1 - f), do * o * (1 - o), act * i * (1 - g * g)], 1)
                dz_all[t] = dz
                gh += hid.T @ dz
                dm = act * f + (1 - m) * dmem
                dh = dz @ self.p[f"{way}h"].T + (1 - m) * dh
            flat = dz_all.reshape(steps * n, 4 * h)
            grad |= {f"{way}x": grid.T @ flat, f"{way}h": gh, f"{way}b": flat.sum(axis=0)}
            d_grid += flat @ self.p[f"{way}x"].T
        dx += d_grid[b.cell]
        e = self.p["path"].shape[1]
        for name, ids, counts, part in (("path", b.path, n_path, dx[:, :e] / np.sqrt(n_path)[:, None]), ("word", b.word, n_word, dx[:, e : 2 * e] / n_word[:, None])):
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], ids, np.repeat(part, counts, axis=0))
        loss = -np.log(np.where(label == 1, p, 1 - p) + 1e-12).mean()
        return float(loss), grad


@lru_cache(maxsize=2)  # it depends on its arguments only
def fit(pages: int = 1500, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 0) -> Labeller:
    """A labeller trained (Adam) on `pages` generated layouts whose blocks are known; no table is read."""
    rng, model, encoder = np.random.default_rng(seed), Labeller(seed=seed), Encoder()
    data = [p for p in marked_pages(pages, seed) if p]
    m, v, step = {k: np.zeros_like(a) for k, a in model.p.items()}, {k: np.zeros_like(a) for k, a in model.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(data), batch):
            part = [data[i] for i in order[at : at + batch]]
            _, g = model.gradient(collate([[b for b, _ in p] for p in part], encoder), np.array([y for p in part for _, y in p], np.float64))
            step += 1
            for k in model.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.p[k] -= rate * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(pages: list[str], model: Labeller, encoder: Encoder, cells: int = 20_000) -> list[tuple[str, int, int]]:
    """(text, blocks, kept blocks) of each page; pages of like length run together, all blocks of each."""
    parsed = [blocks_of(p) for p in pages]
    out: list[tuple[str, int, int]] = [("", 0, 0)] * len(pages)
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and (end - at + 1) * len(parsed[order[end]]) <= cells:
            end += 1
        group = [parsed[i] for i in order[at:end]]
        keep = model.run(collate(group, encoder)) > 0
        spot = 0
        for i, blocks in zip(order[at:end], group):
            chosen = [b.text for b, k in zip(blocks, keep[spot : spot + len(blocks)].tolist()) if k]
            spot += len(blocks)
            out[i] = ("\n".join(chosen), len(blocks), len(chosen))
        at = end
    return out


def extract(pages: DataFrame, model: Labeller | None = None, html_col: str = "html") -> DataFrame:
    """pages without the html, plus text, n_chars (its code points), n_blocks and n_kept; columns of those names are replaced.

    The text is the article: blocks that the labeller keeps, joined by line feeds in page order.
    White space inside a block is one space, character references are decoded, nothing is cut. Null, empty
    and text-free pages give empty text; repeated rows give equal texts. Broken markup is read as far
    as it goes.
    """
    base = without(pages, "text", "n_chars", "n_blocks", "n_kept")
    names = [f.name for f in base.schema.fields if f.name != html_col]
    added = [T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept"))]
    schema = T.StructType([*[f for f in base.schema.fields if f.name != html_col], *added])
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        encoder = Encoder()
        for b in batches:
            found = []
            column = b.column(html_col)
            for at in range(0, len(column), 500):
                found += main_texts([h or "" for h in column.slice(at, 500).to_pylist()], shared.value, encoder)
            texts = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                [*names, "text", "n_chars", "n_blocks", "n_kept"],
            )

    return base.mapInArrow(run, schema)
