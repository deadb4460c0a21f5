"""SimHash near-duplicates by a generalised pigeonhole search."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import longs, own_name, text_bytes, written
from .components import components

BITS = 64


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; a shorter text is one shingle, no word gives none."""
    parts = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), seed)] if parts else [], np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = len(parts) - words + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text takes no more memory than this many shingles
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    return majority_bits(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, fp long) for every row; version is a hash of the text, null and empty texts have fingerprint 0."""
    text = text_bytes(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), longs(fps)], ["doc_id", "version", "fp"])

    return rows.mapInArrow(run, "doc_id long, version long, fp long")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all rows; 2,080 numbers reach the driver."""
    upper = np.triu_indices(BITS)

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "n"])

    got = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for i, j, n in got:
        out[i, j] = out[j, i] = n
    return out


def correlated_groups(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, correlated ones in one group: greedy growth by absolute phi."""
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    phi = np.abs(together / max(total, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(phi, 0)
    left, groups = set(range(BITS)), []
    for size in [BITS // parts + (i < BITS % parts) for i in range(parts)]:
        free = sorted(left)
        first = max(free, key=lambda b: (phi[b, free].max(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: (phi[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def thresholds(groups: list[list[int]], share: np.ndarray, total: int, radius: int) -> list[int]:
    """A threshold for each group, -1 for none, with sum(t + 1) = radius + 1: two fingerprints
    within the radius are within t in some group. Dynamic programming takes the cheapest, where
    a group costs its probes plus the candidate pairs expected from the bits' shares."""
    price = []
    for g in groups:
        apart = np.zeros(radius + 1)
        apart[0] = 1.0
        for q in 2 * share[g] * (1 - share[g]):
            apart = apart * (1 - q) + np.concatenate([[0], apart[:-1]]) * q
        pairs = np.cumsum(apart) * total * total / 2
        price.append([0.0, *(total * sum(comb(len(g), k) for k in range(t + 1)) + pairs[t] for t in range(radius + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in price:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for units in range(radius + 2 - spent):
                if units < len(row) and ((spent + units) not in step or cost + row[units] < step[spent + units][0]):
                    step[spent + units] = (cost + row[units], [*chosen, units - 1])
        best = step
    return best[radius + 1][1]


def block_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints that differ within one block of `radius` bits only. At most 2**radius
    share a key, so a bit mask holds each group: dense clusters shrink here, without pairs."""
    if radius < 1:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    blocks = [(at, (1 << min(radius, BITS - at)) - 1) for at in range(0, BITS, radius)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    keys = F.array(*[
        F.struct(F.lit(at).alias("at"), F.col("fp").bitwiseAND(F.lit(signed(~(m << at) & (1 << 64) - 1))).alias("rest"),
                 F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(m)).cast("int").alias("own"))
        for at, m in blocks
    ])
    groups = (
        distinct.select(F.inline(keys)).groupBy("at", "rest").agg(F.bit_or(F.expr("shiftleft(1L, own)")).alias("mask"))
        .where(F.bit_count("mask") > 1)
    )
    member = F.expr(f"transform(filter(sequence(0, {2 ** radius - 1}), i -> (shiftright(mask, i) & 1L) = 1L), i -> rest | shiftleft(cast(i as long), at))")
    return groups.select(member.alias("m")).select(F.get("m", F.lit(0)).alias("a"), F.explode("m").alias("b")).where("a <> b")


def probe_edges(classed: DataFrame, groups: list[list[int]], limits: list[int], radius: int) -> DataFrame:
    """Verified links between fingerprints of different classes: every fingerprint probes, for each
    group, all keys within the group's threshold. Unequal classes and the distance are join conditions.
    Spark sizes the probes like the rows before the explode, and would broadcast them all: the hint forbids it."""
    found = None
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for g, t in zip(groups, limits):
        if t < 0:
            continue
        mask = signed(sum(1 << b for b in g))
        flips = [signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(g, k)]
        key = F.col("fp").bitwiseAND(F.lit(mask))
        index = classed.select(key.alias("key"), F.col("fp").alias("b_fp"), F.col("root").alias("b"))
        flip = F.explode(F.expr(f"array({', '.join(f'{x}L' if x >= -(2**63) + 1 else 'cast(-9223372036854775808 as bigint)' for x in flips)})"))
        probe = classed.select(flip.alias("flip"), "fp", "root").select(key.bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("a_fp"), F.col("root").alias("a"))
        near = (probe["key"] == index["key"]) & (probe["a"] < index["b"]) & (F.bit_count(probe["a_fp"].bitwiseXOR(index["b_fp"])) <= radius)
        pairs = probe.join(index.hint("merge"), near).select("a", "b")
        found = pairs if found is None else found.union(pairs)
    return found


def near_duplicates(fps: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """fps, a table with doc_id and fp, plus root and component_id, the smallest doc_id reachable
    over links of fingerprints that differ in at most `radius` bits.

    Equal fingerprints are one node, so copies cost one row. Dense clusters shrink by block_edges;
    probe_edges adds every link left between different classes. The search is exact at every size:
    the bits' statistics only choose groups and thresholds. Empty texts share fingerprint 0.
    Repeated rows are linked like any other; a null id is never the smallest, and a component
    of null ids only has a null component_id. No rows: no rows.
    """
    fps = written(fps, "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    total = distinct.count()
    together = bit_statistics(distinct)
    groups = correlated_groups(together, total, parts)
    limits = thresholds(groups, np.diag(together) / max(total, 1), total, radius)
    first = components(block_edges(distinct, radius))
    classed = distinct.join(first, distinct["fp"] == first["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    classed = written(classed, "classed")
    second = components(probe_edges(classed, groups, limits, radius)).toDF("node", "top")
    final = classed.join(second, F.col("root") == F.col("node"), "left").select("fp", "least_id", F.coalesce("top", "root").alias("root"))
    final = written(final, "final")
    least = final.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = final.join(least, "root").select(F.col("fp").alias("link_fp"), "root", "component_id")
    return fps.join(of_fp.hint("merge"), fps["fp"] == of_fp["link_fp"]).drop("link_fp")  # copies take a few bytes each on disk: fps is larger than Spark sizes it


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each near_duplicates component, that of the smallest id; its columns stay as they are."""
    found = near_duplicates(fingerprints(docs, words, id_col=id_col, text_col=text_col), radius)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version")).alias("s")).select("s.doc_id", "s.version")
    stay_id, stay_version, version = (own_name() for _ in range(3))
    here = docs.withColumn(version, F.xxhash64(text_bytes(F.col(text_col))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(stay_id)) & (F.col(version) == F.col(stay_version))
    return here.join(stay.toDF(stay_id, stay_version), same).dropDuplicates([id_col, version]).drop(stay_id, stay_version, version)
