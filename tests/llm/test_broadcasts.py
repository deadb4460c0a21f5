"""What is broadcast: Spark sizes exploded rows like those before the explode, so they must not be left to its choice."""

import numpy as np
from pyspark.sql import functions as F

from corpuskiln.llm import near_copies, simhash
from corpuskiln.llm.common import written


def plans_of(spark, first):
    """The plans of the queries that ran since there were `first` of them."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = store.executionsList()
    return [every.apply(k).physicalPlanDescription() for k in range(first, every.size())]


def test_probes_are_not_broadcast(spark):
    fps = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63, 300)]
    near = [x ^ 5 for x in fps[:40]]  # two bits away
    classed = written(spark.createDataFrame([(x, x) for x in fps + near], "fp long, root long"), "classed")
    found = simhash.probe_edges(classed, [list(range(32)), list(range(32, 64))], [1, 1], 3)
    pairs = {(r.a, r.b) for r in found.distinct().collect()}
    assert pairs == {(min(x, y), max(x, y)) for x, y in zip(fps, near)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan, plan


def test_near_duplicates_broadcast_no_probes_and_no_rows_of_copies(spark):
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    fps = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 40).alias("fp"))
    found = simhash.near_duplicates(fps)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i % 40) for i in range(3000)}
    probing = [p for p in plans_of(spark, first) if "bit_count((a_fp" in p]
    assert probing and not any("Broadcast" in p for p in probing)
    assert "BroadcastHashJoin Inner BuildLeft" not in plans_of(spark, first)[-1]


def test_near_dedup_broadcasts_no_probes(spark):
    """The pipeline's near_dedup searches SimHash links, too."""
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    words = np.random.default_rng(2).integers(0, 5000, (120, 40))
    texts = [" ".join(f"w{x}" for x in row) for row in words]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one_similar(docs).collect()) == list(range(120))
    probing = [p for p in plans_of(spark, first) if "bit_count((a_fp" in p]
    assert probing and not any("Broadcast" in p for p in probing)
