"""Benchmark decontamination by templates: placeholders for slots, a hash join of template windows, slot checks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import own_name, text_bytes, written

#: Words that count as units of measure, money or time.
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons "
    b"ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"dollar dollars euro euros cent cents usd eur percent % degree degrees mph kmh km/h hz khz mhz ghz kb mb gb tb w kw kwh v volt volts".split()
)
NUMBER = re.compile(rb"[#$+\-]?\d[\d.,:/]*%?")
DIGIT = re.compile(rb"\d")
MEASURE = re.compile(rb"[$+\-]?\d[\d.,]*[A-Za-z%/]+")
STRIP = b".,;:!?\"'()[]{}<>*_|`~"
RAW = 1 << 32  # seed of hashes over tokens without placeholders
WORD, NUM, QTY, UNIT, NAME = range(5)
KINDS = np.array(["WORD", "NUM", "QTY", "UNIT", "NAME"])


class Ids(dict):
    """token -> number, in order of first sight; new tokens also wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self.fresh.append(token)
        value = self[token] = len(self)
        return value


class Canon:
    """Texts -> codes of canonical tokens. Numbers, measures and units are typed placeholders, and so
    are capitalised words inside a sentence; other tokens are lower-cased and stripped of punctuation.
    Each distinct token is looked at once, until there are over `most`."""

    def __init__(self, wanted: np.ndarray | None = None, most: int = 300_000):
        self.wanted, self.most = wanted, most
        self.reset()

    def reset(self) -> None:
        self.ids = Ids()
        self.table = [np.zeros(1024, t) for t in (np.uint64, np.int8, np.bool_, np.bool_, np.bool_, np.bool_)]

    def _row(self, token: bytes) -> tuple:
        core = token if token.isalpha() else token.strip(STRIP)
        low = core.lower()
        kind = WORD
        if low in UNITS:
            kind = UNIT
        elif not core.isalpha() and DIGIT.search(core):
            kind = NUM if NUMBER.fullmatch(core) else QTY if MEASURE.fullmatch(core) else WORD
        capital = kind == WORD and len(core) > 1 and core[:1].isupper() and core[1:].islower()
        code = xxhash.xxh64_intdigest(low)
        possible = kind != WORD or capital or not core or self.wanted is None
        return code, kind, capital, token[-1:] in b".!?:", not core, possible

    def __call__(self, text: bytes, width: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The tokens with a core, their codes, their kinds, whether a wanted window can hold them, and their codes without placeholders.
        With a width: None if no `width` tokens in a row can, which a look at each token alone tells."""
        if len(self.ids) > self.most:
            self.reset()
        tokens = text.split()
        known = len(self.ids)
        got = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if len(self.ids) > known:
            rows = list(map(self._row, self.ids.fresh))
            self.ids.fresh.clear()
            need = known + len(rows)
            if len(self.table[0]) < need:
                self.table = [np.concatenate([c, np.zeros(2 * need - len(c), c.dtype)]) for c in self.table]
            for c, values in zip(self.table, zip(*rows)):
                c[known:need] = values
            if self.wanted is not None and len(self.wanted):
                fresh = self.table[0][known:need]
                self.table[5][known:need] |= self.wanted[np.minimum(np.searchsorted(self.wanted, fresh), len(self.wanted) - 1)] == fresh
        if width:
            if len(got) < width:
                return None
            run = np.cumsum(self.table[5][got])
            if not (run[width - 1] == width or (run[width:] - run[:-width] == width).any()):
                return None
        if not len(got):
            return [], np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, np.uint64)
        raw, kind, capital, ends, empty, possible = (c[got] for c in self.table)
        inside = np.concatenate([[False], ~ends[:-1]])
        kind = np.where(capital & inside, NAME, kind)
        code = np.where(kind == WORD, raw, kind.astype(np.uint64) + np.uint64(1))
        if empty.any():
            tokens = [t for t, e in zip(tokens, empty) if not e]
            code, kind, possible, raw = code[~empty], kind[~empty], possible[~empty], raw[~empty]
        return tokens, code, kind, possible, raw


def window_hashes(code: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    h = np.full(len(at), seed + width, np.uint64)
    for j in range(width):
        h = (h ^ code[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def windows(texts: DataFrame, id_name: str, widths: list[int], literals: float, wanted=None, both: bool = False) -> DataFrame:
    """(id, h, at, slots, raw) of every window; with wanted (broadcast: sorted arrays of their hashes and of their tokens' codes) only of those.

    A template window has enough literal tokens. A window with fewer says little as a template, so it has a hash of
    its tokens as they are and no slots; with both, every window has that hash besides. Windows of a text
    that are equal and without slots are one row; those with slots come with each place.
    """

    def run(batches):
        keep, words = wanted.value if wanted is not None else (None, None)
        canon = Canon(words)
        for b in batches:
            ids, hashes, ats, slot_lists, raws = [], [], [], [], []
            for id_, text in zip(b.column(id_name).to_pylist(), b.column("text").to_pylist()):
                got = canon(text, min(widths) if keep is not None else 0)
                if got is None:
                    continue
                tokens, code, kind, possible, raw = got
                literal = np.concatenate([[0], np.cumsum(kind == WORD)])
                runs = np.concatenate([[0], np.cumsum(possible)])
                seen = set()
                for width in widths:
                    if len(code) < width:
                        continue
                    able = runs[width:] - runs[:-width] == width
                    rich = literal[width:] - literal[:-width] >= literals * width
                    for plain, which in ((False, able & rich), (True, able if both else able & ~rich)):
                        places = np.flatnonzero(which)
                        h = window_hashes(raw, places, width, RAW) if plain else window_hashes(code, places, width)
                        if keep is not None and len(h):
                            near = np.minimum(np.searchsorted(keep, h), len(keep) - 1)
                            here = keep[near] == h if len(keep) else np.zeros(len(h), bool)
                            places, h = places[here], h[here]
                        for i, value in zip(places.tolist(), h.view(np.int64).tolist()):
                            spots = [j for j in range(i, i + width) if kind[j] != WORD] if not plain and literal[i + width] - literal[i] < width else []
                            if not spots:
                                if value in seen:
                                    continue
                                seen.add(value)
                            ids.append(id_)
                            hashes.append(value)
                            ats.append(i)
                            slot_lists.append([f"{KINDS[kind[j]]}={tokens[j].strip(STRIP).lower().decode('utf-8', 'replace')}" for j in spots])
                            raws.append(plain)
                    if keep is None and len(ids) > 200_000:
                        yield _batch(ids, hashes, ats, slot_lists, raws)
                        ids, hashes, ats, slot_lists, raws = [], [], [], [], []
            yield _batch(ids, hashes, ats, slot_lists, raws)

    return texts.mapInArrow(run, "id long, h long, at int, slots array<string>, raw boolean")


def _batch(ids, hashes, ats, slots, raws) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(ats, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(raws, pa.bool_())],
        ["id", "h", "at", "slots", "raw"],
    )


def token_codes(texts: DataFrame) -> DataFrame:
    def run(batches):
        canon = Canon()
        for b in batches:
            codes = [raw for *_, raw in map(canon, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*codes, np.zeros(0, np.uint64)]).view(np.int64))], ["code"])

    return texts.mapInArrow(run, "code long")


def item_classes(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """One row for each distinct canonical text: the least item id, all item ids, one text, its number of tokens."""

    def run(batches):
        canon = Canon()
        for b in batches:
            keys, sizes = [], []
            for text in b.column("text").to_pylist():
                tokens, code, *_ = canon(text)
                slots = b" ".join(t.strip(STRIP).lower() for t in tokens)
                keys.append(xxhash.xxh3_128_hexdigest(slots + code.tobytes()))
                sizes.append(len(code))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string()), pa.array(sizes, pa.int32())], ["id", "text", "key", "size"])

    rows = items.select(F.col(item_id).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("text")).where("id IS NOT NULL")
    named = rows.mapInArrow(run, "id long, text binary, key string, size int")
    return named.groupBy("key").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("item_ids"), F.first("text").alias("text"), F.first("size").alias("size"))


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 8, least_tokens: int = 5, literals: float = 0.6, least_coverage: float = 0.5, least_run: int = 20,
    most_broadcast: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_ids, hits, coverage, slots, changed_slots, consistent, kind): a row for each
    document and distinct benchmark text that it holds.

    Texts become token templates with NUM, QTY, UNIT and NAME placeholders; windows with few literal tokens
    count by their tokens as they are. A document holds an item if an occurrence has least_coverage of the item's
    template windows or of all its windows, or windows over least_run tokens' worth of it, and its slots
    map consistently: equal slot values of the item always meet one value. Occurrences are the hits of one
    offset, of offsets close to each other (words put in or left out), and of the whole document; unchanged windows
    of the document count for each, and are an occurrence by themselves. The fullest one is
    reported: kind is `exact` (no slot changed) or `reparameterised`. Items shorter than a
    window use one window of their own length; items under least_tokens tokens are too common to
    tell and are skipped, as are null ids of items. Null and empty texts hold nothing. Rows of one
    doc_id are one document; rows with a null id are left out. item_ids lists all items with the
    same text. No items or no hits: no rows.

    Up to most_broadcast item windows and token codes are broadcast to drop other windows of documents before the
    shuffle; beyond that all windows are shuffled to the same hash join.
    """
    spark = docs.sparkSession
    classes = written(item_classes(items, item_id, item_text).where(F.col("size") >= least_tokens), "items")
    short = [r["size"] for r in classes.where(F.col("size") < width).select("size").distinct().collect()]  # at most width - 1 values
    plan = [(F.col("size") >= width, width), *[(F.col("size") == w, w) for w in sorted(short)]]
    asked = None
    for which, w in plan:
        part = windows(classes.where(which).select("id", "text"), "id", [w], literals)
        asked = part if asked is None else asked.union(part)
    asked = written(asked.toDF("item_id", "h", "item_at", "item_slots", "item_raw"), "item-windows")
    raw_too = not asked.where("item_raw").isEmpty()
    hashes = asked.select("h").distinct()
    wanted = None
    codes = token_codes(classes.select("text")).distinct()
    if hashes.count() + codes.count() <= most_broadcast:  # 8 bytes each
        sorted_array = lambda df: np.sort(df.toArrow().column(0).to_numpy().view(np.uint64))
        wanted = spark.sparkContext.broadcast((sorted_array(hashes), sorted_array(codes)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("text")).where("id IS NOT NULL")
    found = windows(rows, "id", [width, *sorted(short)], literals, wanted, raw_too).drop("raw").toDF("doc_id", "h", "at", "slots")
    sizes = asked.groupBy("item_id").agg(
        F.count_distinct("item_at").alias("windows"), F.count_distinct(F.when(~F.col("item_raw"), F.col("item_at"))).alias("templates"),
        F.max(F.col("item_at")).alias("last_at"),
    )
    met = found.join(asked, "h").join(F.broadcast(sizes.select("item_id", "last_at")), "item_id")
    met = met.select("doc_id", "item_id", "item_at", "item_raw", "item_slots", "slots", (F.col("at") - F.col("item_at")).alias("offset"), "last_at").distinct()
    met = written(met.withColumn("same", F.col("item_slots") == F.col("slots")), "met")
    half = F.greatest(F.floor((F.col("last_at") + 1) / 2), F.lit(1))
    near = lambda shift: F.floor((F.col("offset") + shift) / half).cast("long")
    group = lambda kind, at: F.struct(F.lit(kind).alias("way"), at.cast("long").alias("place"))
    ways = F.array(group(0, F.lit(0)), group(1, F.col("offset")), group(2, near(F.lit(0))), group(3, near(F.floor(half / 2))))
    key = ["doc_id", "item_id", "way", "place"]
    grouped = met.select("*", F.inline(F.when(F.col("same"), F.concat(ways, F.array(group(4, F.lit(0))))).otherwise(ways)))
    fits = (
        grouped.select(*key, F.inline(F.arrays_zip("item_slots", "slots"))).toDF(*key, "from", "to").distinct()
        .groupBy(*key, "from").agg(F.count("*").alias("ways"), F.max(F.col("from") != F.col("to")).alias("changed"))
        .groupBy(*key).agg(F.count("*").alias("slots"), F.count_if("changed").alias("changed_slots"), (F.max("ways") == 1).alias("consistent"))
    )
    place = F.struct("item_at", "item_raw")
    same = met.where("same").groupBy("doc_id", "item_id").agg(F.collect_set(place).alias("same_at"))
    hits = grouped.groupBy(*key).agg(F.collect_set(place).alias("own_at")).join(same, ["doc_id", "item_id"], "left")
    every = F.when(F.col("same_at").isNull(), F.col("own_at")).otherwise(F.array_union("own_at", "same_at"))
    counted = hits.select(*key, every.alias("e")).select(*key, F.size("e").alias("hits"), F.size(F.filter("e", lambda x: ~x["item_raw"])).alias("template_hits"))
    of_templates = F.when(F.col("templates") > 0, F.col("template_hits") / F.col("templates")).otherwise(0.0)
    verdicts = (
        counted.join(F.broadcast(sizes), "item_id").join(fits, key, "left")
        .select(
            "doc_id", "item_id", F.col("hits").cast("long").alias("hits"), F.greatest(F.col("hits") / F.col("windows"), of_templates).alias("coverage"),
            F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("changed_slots", F.lit(0)).cast("long").alias("changed_slots"),
            F.coalesce("consistent", F.lit(True)).alias("consistent"),
        )
        .where(((F.col("coverage") >= least_coverage) | (F.col("hits") + (width - 1) >= least_run)) & F.col("consistent"))
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("hits", (-F.col("changed_slots")).alias("kept"), "slots", "coverage", "changed_slots", "consistent")).alias("v"))
    )
    return (
        verdicts.join(classes.select(F.col("id").alias("item_id"), "item_ids"), "item_id")
        .select("doc_id", "item_id", "item_ids", "v.hits", "v.coverage", "v.slots", "v.changed_slots", "v.consistent")
        .withColumn("kind", F.when(F.col("changed_slots") > 0, "reparameterised").otherwise("exact"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows with a null id stay."""
    bad_id = own_name()
    bad = written(contamination(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].cast("long") == bad[bad_id], "left_anti")
