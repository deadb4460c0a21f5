"""What filters do to each other: every order of them, walked by swaps of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import own_name, written

BLANK_RUN = r"[\x20\x09-\x0D]+"
LETTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in LETTERS)


def swaps(n: int) -> Iterator[int]:
    """Places k whose item changes with the next one's: from the identity through all n! orders, each once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:  # the last item travels through the others, which move on by one swap in between
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if (k := next(inner, None)) is None:
            return
        yield k + down
        down = not down


class Walk:
    """All orders of n filters over a batch of parts; cells[part, mask, 3]: documents, good ones and toxic ones that fail exactly the filters of mask."""

    def __init__(self, cells: np.ndarray, names: str):
        self.cells, self.names, self.n = cells, names, len(names)
        self.masks = np.arange(1 << self.n)
        self.fails = np.stack([cells[:, self.masks >> f & 1 == 1, 0].sum(1) for f in range(self.n)])
        self.alone = np.stack([cells[:, 1 << f, 0] for f in range(self.n)])

    def step(self, before: int, f: int) -> np.ndarray:
        """(kept, removed, good lost, toxic lost) by part, of filter f after the filters of the mask `before`."""
        reach = self.masks & before == 0
        lost = self.cells[:, reach & (self.masks >> f & 1 == 1)].sum(1)
        kept = self.cells[:, reach & (self.masks >> f & 1 == 0), 0].sum(1)
        return np.stack([kept, lost[:, 0], lost[:, 1], lost[:, 2]])

    def run(self) -> tuple[list[str], np.ndarray]:
        """The orders, and values[order, step, column of LETTERS, part]. A swap at k leaves what stands before k and after k + 1
        as it was, so two steps are worked out again; a filter's Shapley sum changes by the difference times the orders left."""
        order, total = list(range(self.n)), factorial(self.n)
        parts = self.cells.shape[0]
        steps = np.zeros((self.n, 4, parts), np.int64)
        shapley = np.zeros((self.n, parts), np.int64)
        orders, values = [], np.zeros((total, self.n, len(LETTERS), parts), np.int64)

        def renew(k: int, left: int) -> None:
            f = order[k]
            steps[k] = self.step(sum(1 << x for x in order[:k]), f)
            shapley[f] += left * (steps[k, 1] - now[f])
            now[f] = steps[k, 1]

        now = np.zeros((self.n, parts), np.int64)  # what each filter removes in the present order
        walk = swaps(self.n)
        for at in range(total):
            if at == 0:
                for k in range(self.n):
                    renew(k, total)
            else:
                k = next(walk)
                order[k], order[k + 1] = order[k + 1], order[k]
                renew(k, total - at)
                renew(k + 1, total - at)
            orders.append("".join(self.names[f] for f in order))
            values[at, :, 0:2] = steps[:, 0:2]
            values[at, :, 2] = self.fails[order] - steps[:, 1]
            values[at, :, 3] = self.alone[order]
            values[at, :, 4:6] = steps[:, 2:4]
        by_name = {name: f for f, name in enumerate(self.names)}
        for at, said in enumerate(orders):
            values[at, :, 6] = shapley[[by_name[c] for c in said]]
        return orders, values


def walk_orders(cells: DataFrame, names: str, at_once: int = 64) -> DataFrame:
    """A row for each part, order and step (OUT), from one row for each part: (part, cells array of mask, n, good, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):  # 600 rows a part for five filters: bounded
                some = batch.slice(begin, at_once).to_pydict()
                parts = some["part"]
                counts = np.zeros((len(parts), 1 << len(names), 3), np.int64)
                for p, listed in enumerate(some["cells"]):
                    for c in listed:
                        counts[p, c["mask"]] += (c["n"], c["good"], c["toxic"])
                orders, values = Walk(counts, names).run()
                each = len(orders) * len(names)
                flat = values.reshape(each, len(LETTERS), len(parts))
                columns = [pa.array([p for p in parts for _ in range(each)], pa.string())]
                columns += [pa.array([o for o in orders for _ in names] * len(parts), pa.string())]
                columns += [pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders) * len(parts)))]
                columns += [pa.array(flat[:, k].T.reshape(-1)) for k in range(len(LETTERS))]
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in OUT.split(", ")])

    return cells.mapInArrow(run, OUT)


def text_filters(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words (1), B few distinct words (2), C capitals (4), D symbols (8)."""
    held = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(held, BLANK_RUN), "")
    capitals = F.octet_length(held) - F.octet_length(F.regexp_replace(held, "[A-Z]", ""))
    sizes = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    counts = F.get(F.transform(F.array(words), sizes), F.lit(0))
    bits = lambda c: (
        F.when(c["n"] < 100, 1).otherwise(0) + F.when(100 * c["d"] < 80 * c["n"], 2).otherwise(0)
        + F.when(100 * capitals > 10 * F.char_length(held), 4).otherwise(0) + F.when(held.rlike("[#$%&*|]"), 8).otherwise(0)
    )
    return F.get(F.transform(F.array(counts), bits), F.lit(0))


def interactions(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each of five filters removes at each place of each order of them, by part (OUT).

    A to D look at a text (`text_filters`), E holds for a text that a smaller id has too, in whatever part and whether or not that one is removed.
    Null texts are empty texts, null parts the empty string. A null id is no smaller id and has none; repeated
    rows of an id count each, and aren't copies of each other. labels (doc_id, quality, toxic): a document is good (toxic) if any row of its id says 1.
    No rows give no rows; a part's rows are the same 120 orders with zeros where nothing fails.

    Texts are read once, in the tasks that read them, to five bits and two 64-bit hashes, by which E compares. Rows of one text are summed
    by part and label before they meet, so a hot text is a few rows; the orders are walked over sums.
    """
    i, h, g = (own_name() for _ in range(3))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).alias(i), F.xxhash64(text).alias(h), F.xxhash64(F.lit(1), text).alias(g), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_filters(F.col(text_col)).alias("mask"))
    rows = written(marked.groupBy(i, h, g, "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    known = written(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")), "audit-labels")
    zero = F.lit(0)
    flagged = rows.where(F.col(i).isNotNull()).join(known, F.col(i) == F.col("doc_id"), "left").select(*rows.columns, F.coalesce("_quality", zero).alias("good"), F.coalesce("_toxic", zero).alias("toxic"))
    nameless = rows.where(F.col(i).isNull()).select(*rows.columns, zero.alias("good"), zero.alias("toxic"))
    # Of each text, by part and flags: rows in all, the least id, and that id's rows. Few rows a text, whatever its copies.
    alike = flagged.groupBy(h, g, "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(i).alias("least"), F.min_by("n", i).alias("n_least"))
    first = F.min("least").over(Window.partitionBy(h, g))
    split = alike.withColumn("first", first).withColumn("n_first", F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    cell = F.struct(F.col("mask").alias("mask"), F.col("n_first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("n_first")).alias("n"))
    both = split.select("part", "good", "toxic", F.inline(F.array(*cell)))
    cells = both.unionByName(nameless.select("part", "good", "toxic", "mask", "n")).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    return walk_orders(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "ABCDE")

