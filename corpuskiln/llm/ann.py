"""Approximate nearest neighbours with learned partitions of a neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written


@dataclass
class Router:
    """A small classifier: vector -> log probability of each partition, by one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k other rows of the largest inner product."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Labels 0..parts-1 of near-equal counts with few graph edges between them: a start by
    capacity-bound nearest centres, then moves of rows to the label that most of their neighbours have."""
    rng = np.random.default_rng(0)
    most = int(np.ceil(len(x) / parts * slack))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = unit[rng.choice(len(x), parts, replace=False)]
    for _ in range(10):
        near = unit @ centres.T
        label = np.full(len(x), -1)
        room = np.full(parts, most)
        for i in np.argsort(-near.max(axis=1)):
            for c in np.argsort(-near[i]):
                if room[c]:
                    label[i] = c
                    room[c] -= 1
                    break
        for c in range(parts):
            if (label == c).any():
                m = unit[label == c].mean(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    size = np.bincount(label, minlength=parts)
    links = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (links[:, 0], label[links[:, 1]]), 1)
        gain = votes - votes[np.arange(len(x)), label][:, None]
        for i in np.argsort(-gain.max(axis=1)):
            c = int(gain[i].argmax())
            if gain[i, c] <= 0:
                break
            if size[c] < most:
                size[label[i]] -= 1
                size[c] += 1
                label[i] = c
    return label


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 0.003) -> Router:
    """Trained (Adam) to give each row the partitions that its graph neighbours and itself lie in."""
    rng = np.random.default_rng(1)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    goal[np.arange(len(x)), label] += 1
    goal /= goal.sum(axis=1, keepdims=True)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    dim = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            a = x[rows] / scale
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            d = (q / q.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale)


def mass_for(router: Router, base: np.ndarray, queries: np.ndarray, k: int, recall: float) -> float:
    """How much probability a query must visit to find the share `recall` of its k nearest rows: read off queries that the router was
    not fitted on, against the rows that it was. Neighbours in the whole table are nearer than these, so easier to find."""
    filed = router.scores(base).argmax(axis=1)
    p = np.exp(router.scores(queries))
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.zeros_like(p)  # of each partition, the probability of those visited before it
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1), 1)
    needed = []
    for at in range(0, len(queries), 256):
        near = np.argpartition(-(queries[at : at + 256] @ base.T), min(k, len(base)) - 1, axis=1)[:, :k]
        needed.append(np.take_along_axis(before[at : at + 256], filed[near], 1).ravel())
    return float(np.quantile(np.concatenate(needed), recall)) + 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) without vectors that are null, empty, zero or hold a null or non-finite component."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def block_search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best of these rows for each of these queries; equal vectors are scored once."""
    out_ids, best = [], []
    if len(queries) and len(rows):
        q, x = matrix(queries["vec"]), matrix(rows["vec"])
        q_ids, x_ids = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(x_ids, kind="stable")
        x, x_ids = x[order], x_ids[order]
        distinct, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")  # ids ascend within each vector
        first = np.searchsorted(inverse[by], np.arange(len(distinct) + 1))
        top = min(k + 1, len(distinct))  # one more: a query's own vector may drop out
        for i in range(len(q)):
            if i % 256 == 0:
                near = q[i : i + 256] @ distinct.T
                floor = -np.partition(-near, top - 1, axis=1)[:, top - 1]
                slack = 1e-9 * (np.abs(near).max(axis=1) + 1)
            found = np.flatnonzero(near[i % 256] >= floor[i % 256] - slack[i % 256])
            exact = (distinct[found] * q[i]).sum(axis=1)  # one order of summation for every pair
            pairs = [(-s, int(v)) for s, c in zip(exact.tolist(), found.tolist()) for v in x_ids[by[first[c] : min(first[c + 1], first[c] + k + 1)]] if v != q_ids[i]]
            pairs.sort()
            out_ids.append(int(q_ids[i]))
            best.append([{"minus": s, "vec_id": v} for s, v in pairs[:k]])
    part = [queries["part"][0].as_py()] * len(out_ids) if len(queries) else []
    kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))
    return pa.table({"query_id": pa.array(out_ids, pa.int64()), "part": pa.array(part, pa.int32()), "best": pa.array(best, kind)})


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, rows_in_part: int = 1024, recall: float = 0.95, most_fit: int = 10_000, rows_in_block: int = 8192, queries_in_block: int = 8192,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k nearest other rows found.

    Nearness is the inner product in double precision, ties go to the smaller id. The graph, its balanced
    partition and the classifier are fitted on a hash sample of about most_fit vectors; every row is then
    filed under its most probable partition. There is a partition for rows_in_part rows of the table, as far as
    the sample has 64 vectors for each. A query visits its most probable partitions, where all rows are ranked
    exactly, until their probability reaches what a tenth of the sample, left out of the fit, needed for
    `recall`: few partitions where vectors cluster, most of them where they have no structure.
    Vectors that are null, zero, of another length than most, or hold a null or non-finite component
    take no part; of rows with one id and one vector one takes part. No usable vector: no rows.

    Large partitions and query sets are cut into blocks, so a vector that many rows share fills
    many small groups, each scored as one vector.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("vec") == dim)
    pick = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, most_fit / total)
    sample = np.unique(matrix(rows.where(pick).select("vec").toArrow()["vec"]), axis=0)
    parts = max(1, min(-(-total // rows_in_part), len(sample) * 9 // 10 // 64))
    router, mass = None, 1.0
    if parts > 1:
        apart = np.random.default_rng(2).permutation(len(sample))
        asked_for, fitted = sample[apart[: len(sample) // 10]], sample[apart[len(sample) // 10 :]]
        graph = neighbour_graph(fitted, 10)
        router = fit_router(fitted, graph, balanced_partition(fitted, graph, parts), parts)
        mass = mass_for(router, fitted, asked_for, k, recall)
    shared = spark.sparkContext.broadcast(router)

    def route(batches):
        for b in batches:
            x = matrix(b.column("vec"))
            routes = [[0]] * len(b)
            if shared.value and len(b):
                p = np.exp(shared.value.scores(x))
                order = np.argsort(-p, axis=1, kind="stable")
                sums = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
                visits = 1 + (sums[:, :-1] < mass).sum(axis=1)
                routes = [o[:n] for o, n in zip(order.tolist(), visits.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(routes, pa.list_(pa.int32()))], ["vec_id", "vec", "route"])

    routed = written(rows.mapInArrow(route, "vec_id long, vec array<double>, route array<int>").dropDuplicates(["vec_id", "vec"]), "routed")
    asked = routed.where(F.pmod("vec_id", F.lit(every)) == 0)
    filed = {r["part"]: r["n"] for r in routed.groupBy(F.get("route", F.lit(0)).alias("part")).agg(F.count("*").alias("n")).collect()}
    calls = {r["part"]: r["n"] for r in asked.select(F.explode("route").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    cuts = lambda n, most: [-(-n.get(p, 0) // most) or 1 for p in range(parts)]
    blocks, calls_cut = F.array(*map(F.lit, cuts(filed, rows_in_block))), F.array(*map(F.lit, cuts(calls, queries_in_block)))
    of_part = lambda a: F.get(a, F.col("part"))
    stored = routed.select("vec_id", "vec", F.get("route", F.lit(0)).alias("part")).withColumn("block", F.pmod(F.xxhash64("vec_id"), of_part(blocks)).cast("int"))
    stored = stored.withColumn("slice", F.explode(F.sequence(F.lit(0), of_part(calls_cut) - 1)))
    calling = asked.select(F.col("vec_id").alias("query_id"), "vec", F.explode("route").alias("part"))
    calling = calling.withColumn("slice", F.pmod(F.xxhash64("query_id"), of_part(calls_cut)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of_part(blocks) - 1)))
    keys = ["part", "block", "slice"]
    found = (
        calling.groupBy(*keys).cogroup(stored.groupBy(*keys))
        .applyInArrow(lambda q, x: block_search(q, x, k), "query_id long, part int, best array<struct<minus: double, vec_id: long>>")
    )
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best")
    top = found.groupBy("query_id", "part").agg(merged).groupBy("query_id").agg(merged)
    return top.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
