"""Near copies: SimHash links of word shingles, and a prefix-filtered set join for links beyond their reach, all verified on whole sets
where a parity sketch of both does not rule them out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, long_lists, longs, own_name, text_bytes, written
from .components import components
from .simhash import majority_bits, near_duplicates, shingle_hashes


def often(docs: DataFrame, words: int, sample: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about `sample` distinct texts hold, sorted, and in how many; they only order the
    shingles of a set, so that the search is exact whatever the sample holds."""
    text = text_bytes(F.col(text_col))
    share = F.lit(max(1, docs.count() // sample))
    some = docs.select(F.xxhash64(text).alias("version"), text.alias("text")).where(F.pmod("version", share) == 0).groupBy("version").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 200):
                sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([longs(np.concatenate([*sets, np.zeros(0, np.uint64)]))], ["h"])

    got = some.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2").toArrow()
    h, c = got["h"].to_numpy(), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def parity_sketch(own: np.ndarray) -> bytes:
    """A power of two of bits, twice as many as hashes at least; each tells whether an odd number of the hashes ends in its number.
    Of two sketches the bits that differ are at most as many as the hashes that one set has and the other has not."""
    bits = 64
    while bits < 2 * len(own):
        bits *= 2
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """How many bits differ, when the longer one is folded to the other's length: no more than the sets' hashes that are not shared."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = 8 * len(a), 8 * len(b)
    while p != q:
        if p < q:
            x, y, p, q = y, x, q, p
        p //= 2
        x = (x >> p) ^ (x & (1 << p) - 1)
    return (x ^ y).bit_count()


def shingle_sets(docs: DataFrame, words: int, similarity: float, known, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, node, fp, n, prefix, sketch) for every row: version is a hash of the text, node one of its set of
    shingles, fp the SimHash, n the set's size. prefix has the rarest shingles, rarest
    first, so many that two sets as similar as asked share one of them. sketch is the set's parity_sketch."""
    text = text_bytes(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))

    def run(batches):
        common, counts = known.value

        def prefix(own: np.ndarray) -> np.ndarray:
            values = own.view(np.int64)
            weight = np.zeros(len(own), np.int64)
            if len(common) and len(own):
                near = np.minimum(np.searchsorted(common, values), len(common) - 1)
                weight = np.where(common[near] == values, counts[near], 0)
            return own[np.lexsort((values, weight))[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]]

        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                every = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
                sets = list(map(np.unique, every))
                nodes = longs([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets])
                sizes = pa.array(list(map(len, sets)), pa.int32())
                sketches = pa.array(list(map(parity_sketch, sets)), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), nodes, longs(list(map(majority_bits, every))), sizes, long_lists(list(map(prefix, sets))), sketches],
                    ["doc_id", "version", "node", "fp", "n", "prefix", "sketch"],
                )

    return rows.mapInArrow(run, "doc_id long, version long, node long, fp long, n int, prefix array<long>, sketch binary")


def whole_sets(docs: DataFrame, every: DataFrame, asked: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shingles) of the nodes asked, worked out again from one text of each: stored sets of all texts would take more room than the texts. shingles has 32 bits
    of each, as a set is dealt out with each of its pairs: in two sets of a thousand one more or less may seem shared once in some thousand pairs."""
    one = every.join(small(asked), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("at"))
    one = written(one.select("node", F.col("at.doc_id").alias("at_id"), F.col("at.version").alias("at_version")), "asked-texts")
    text = text_bytes(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    texts = rows.join(small(one), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("version") == F.col("at_version"))).select("node", "text")

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
                sizes = list(map(len, sets))
                low = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes, pa.int32()), low], ["node", "n", "shingles"])

    return texts.mapInArrow(run, "node long, n int, shingles array<int>").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def shared_rows(sets: DataFrame, most: int = 4_000_000) -> DataFrame:
    """(h, node, n, at) for each shingle of a prefix that several prefixes hold. Up to `most` such shingles are broadcast (8 bytes
    each), so that the others, nearly all, need not be shuffled; more meet their rows in a join."""
    again = written(sets.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "again")
    if again.count() > most:
        return sets.select(F.posexplode("prefix").alias("at", "h"), "node", "n").join(again, "h").select("h", "node", "n", "at")
    wanted = sets.sparkSession.sparkContext.broadcast(np.sort(again.toArrow()["h"].to_numpy()))

    def run(batches):
        keep = wanted.value
        for b in batches:
            lists = b.column("prefix")
            sizes = lists.value_lengths().to_numpy()
            h = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            here = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
            node, n = (b.column(c).to_numpy()[row[here]] for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(h[here]), pa.array(node), pa.array(n), pa.array(at[here].astype(np.int32))], ["h", "node", "n", "at"])

    return sets.select("node", "n", "prefix").mapInArrow(run, "h long, node long, n int, at int")


def small(stored: DataFrame, most: int = 200_000) -> DataFrame:
    """A stored table, broadcast in joins if it is small, so that the other side need not be dealt out."""
    return F.broadcast(stored) if stored.count() <= most else stored


def nodes_of(pairs: DataFrame) -> DataFrame:
    return written(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), "asked")


def both_sides(pairs: DataFrame, of_node: DataFrame) -> DataFrame:
    """pairs with the columns of of_node, a table by node, twice: they end in _a and _b."""
    side = lambda x: of_node.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in of_node.columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def not_ruled_out(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches (node, n, sketch) do not differ in more bits than so similar sets can in shingles. None that is
    similar is left out; few of the others stay, and so whole sets are only dealt out for pairs that are mostly similar."""
    asked = nodes_of(pairs)
    some = written(sketches.join(small(asked), "node", "left_semi"), "sketches")
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for b in batches:
            apart = np.fromiter(map(sketch_distance, b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()), np.int64, len(b))
            most = share * (b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(apart <= most))

    left = written(both_sides(pairs, some).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long"), "likely")
    discard(asked, some)
    return left


def similar(pairs: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of `similarity` or more, as a written table."""
    pairs = written(pairs, "pairs")
    likely = not_ruled_out(pairs, sketches, similarity)
    asked = nodes_of(likely)
    sets = written(sets_of(asked), "sets")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    found = written(both_sides(likely, sets).where(both / (F.col("n_a") + F.col("n_b") - both) >= similarity).select("a", "b"), "similar")
    discard(pairs, likely, asked, sets)
    return found


def near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, sample: int = 5_000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, version, root) for every row: root names the texts reachable over links of texts whose
    sets of word shingles have a Jaccard similarity of `similarity` or more.

    Equal sets are one node. Links are found in two ways and verified on the whole sets. SimHash
    fingerprints link a node to the least one of its SimHash component. Two sets of that similarity may
    differ in more bits than a pigeonhole search can reach, but they share one of their rarest shingles.
    In each of some rounds a shingle has one node as its hub, and a node is held against the hub of another component
    that it shares most with: that shrinks dense clusters without pairs. Then every
    pair left between different components is tried, if what the rarest shingles share allows it.
    """
    known = docs.sparkSession.sparkContext.broadcast(often(docs, words, sample, text_col))
    every = written(shingle_sets(docs, words, similarity, known, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "shingles")
    copied = written(every.groupBy("node").agg(F.min("row").alias("first_row"), F.count("*").alias("c")).where("c > 1").select(F.col("node").alias("copied"), "first_row"), "copied")
    sets = every.where("n > 0").join(small(copied), F.col("node") == F.col("copied"), "left").where("first_row IS NULL OR row = first_row").select("node", "fp", "n", "prefix", "sketch")
    sketches = sets.select("node", "n", "sketch")
    sets_of = lambda asked: whole_sets(docs, every, asked, words, id_col, text_col)
    candidates = near_duplicates(sets.select(F.col("node").alias("doc_id"), "fp")).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    rows = written(shared_rows(sets), "rows")
    edges = similar(candidates, sketches, sets_of, similarity)
    labels = components(edges)
    for turn in range(rounds):
        classed = written(with_roots(rows, labels), "classed")
        stars = written(best_hubs(classed, turn, similarity), "stars")
        done = stars.isEmpty()
        if not done:
            edges = edges.union(similar(stars, sketches, sets_of, similarity))
            labels = components(edges)
        discard(classed, stars)
        if done:
            break
    classed = written(with_roots(rows, labels), "classed")
    labels = components(edges.union(similar(possible_pairs(classed, similarity), sketches, sets_of, similarity)))
    names = written(every.select("doc_id", "version", "node"), "names")
    discard(every, rows, classed, copied)
    linked = labels.toDF("link", "root")
    return names.join(linked, F.col("node") == F.col("link"), "left").select("doc_id", "version", F.coalesce("root", "node").alias("root"))


def with_roots(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(small(labels), "node", "left").select("h", "node", "n", "at", F.coalesce("root", "node").alias("root"))


def best_hubs(classed: DataFrame, turn: int, similarity: float, hubs_each: int = 4) -> DataFrame:
    """(a, b): for each node the hub of another component that it shares most shingles with. A shingle has some hubs,
    other ones in each turn."""
    ranked = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "node").alias("rank"), "node", "n", "at", "root")).alias(f"hub{k}") for k in range(hubs_each)]
    made = classed.groupBy("h").agg(*ranked)
    entry = lambda hub: F.struct(*[F.col(hub)[c].alias(c) for c in ("node", "n", "at", "root")])
    hubs = written(made.select("h", F.array_distinct(F.array(*[entry(f"hub{k}") for k in range(hubs_each)])).alias("hubs")), "hubs")
    near = lambda hub: (F.col("root") != hub["root"]) & may_link(F.col("n"), F.col("at"), hub["n"], hub["at"], similarity)
    met = classed.join(small(hubs), "h").select("node", "n", F.filter("hubs", near).alias("hubs")).where("size(hubs) > 0").select(F.col("node").alias("b"), "n", F.explode("hubs.node").alias("a"))
    likely = F.col("c") >= F.col("n") * (1 - similarity) / 5  # a fifth of the prefix; what else there is, the pairs find
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(likely).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")


def possible_pairs(classed: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components that may be similar enough: they share c of their rarest shingles, in one order for
    all sets, and so at most those and what comes after the last one. Shared places from which even all that follows is not enough
    are left out: the first place of a similar pair is none of these, and what they stand for is in what comes after the last one left."""
    x, y = classed.toDF("h", "a", "na", "ata", "ra"), classed.toDF("h", "b", "nb", "atb", "rb")
    meet = (x["h"] == y["h"]) & (x["ra"] < y["rb"]) & may_link(x["na"], x["ata"], y["nb"], y["atb"], similarity)
    met = x.join(y, meet).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("ata").alias("ata"), F.max("atb").alias("atb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    most = F.col("c") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) - 1
    return met.where(most >= (F.col("na") + F.col("nb")) * similarity / (1 + similarity) - 1e-6).select("a", "b")


def may_link(na: Column, ata: Column, nb: Column, atb: Column, similarity: float) -> Column:
    """Sets of na and nb shingles that share those at places ata and atb, counted from the rarest, and none before, can be similar enough."""
    left = F.least(na - ata, nb - atb)
    need = (na + nb) * similarity / (1 + similarity) - 1e-6
    return (F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-6) & (left >= need)


def keep_one_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each near_copies component, that of the smallest id; its columns stay as they are."""
    found = near_copies(docs, words, similarity, id_col=id_col, text_col=text_col)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version")).alias("s")).select("s.doc_id", "s.version")
    number, none, version = keys = [own_name() for _ in range(3)]
    by = lambda i, v: {number: F.coalesce(i, F.lit(0)), none: i.isNull(), version: v}
    here = docs.withColumns(by(F.col(id_col).cast("long"), F.xxhash64(text_bytes(F.col(text_col)))))
    # texts are dealt out once: the join and the removal of repeated rows have the same keys, none of them null
    return here.join(stay.withColumns(by(F.col("doc_id"), F.col("version"))).select(keys), keys).dropDuplicates(keys).drop(*keys)
