"""Streams with a value for each key: the same as the finite table in whatever batches, and nothing left after the timeout."""

import random
import time

import pytest

from corpuskiln.operators import vectors
from corpuskiln.streaming import keyed, stateful


@pytest.fixture
def fed(spark, tmp_path):
    """feed(rows, n): one more batch, until n rows have come out in all; rows(): these."""
    old, started = spark.conf.get(keyed.PROVIDER, None), []

    def start(schema, transform, name):
        source = f"{tmp_path}/{name}"
        spark.createDataFrame([], schema).write.parquet(source)
        stream = transform(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{source}-state").trigger(processingTime="1 second").start()
        started.append(query)

        def feed(rows, n):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            for _ in range(60):  # such a query looks at its state again and again, so it is never without work
                if query.exception() or spark.table(name).count() >= n:
                    return
                time.sleep(0.5)

        return feed, lambda: spark.table(name).collect()

    yield start
    for query in started:
        query.stop()
    spark.conf.unset(keyed.PROVIDER) if old is None else spark.conf.set(keyed.PROVIDER, old)


@pytest.mark.parametrize("against", ["previous", "first"])
def test_drift_of_a_stream_is_that_of_the_table(spark, fed, against):
    r = random.Random(5)
    schema = "label string, n int, embedding array<float>"
    rows = [(r.choice("ab"), n, r.choice([[r.random(), r.random(), -1.0], [r.random(), r.random(), -1.0], [0.0, 0.0, 0.0], [1.0], None])) for n in range(40)]
    feed, got = fed(schema, lambda s: keyed.stream_drift(s, "label", "n", against=against), f"drift_{against}")
    for a, b in ((0, 1), (1, 17), (17, 40)):
        feed(rows[a:b], b)
    table = vectors.drift(spark.createDataFrame(rows, schema), "label", "n", against=against)
    assert sorted(map(repr, got())) == sorted(map(repr, table.select("label", "n", "drift").collect())) and len(rows) == 40


def test_onsets_of_a_stream_are_those_of_the_table(spark, fed):
    r = random.Random(9)
    schema = "stream_id string, frame_no bigint, is_speech boolean"
    rows = [(k, n, r.choice([True, True, False, None])) for n in range(60) for k in "xy"]
    feed, got = fed(schema, keyed.stream_onsets, "onsets")
    expected = stateful.onsets(spark.createDataFrame(rows, schema)).collect()
    for a, b in ((0, 3), (3, 50), (50, 120)):
        feed(rows[a:b], sum((x.frame_no, x.stream_id) <= (rows[b - 1][1], rows[b - 1][0]) for x in expected))
    assert sorted(got()) == sorted(expected) and len(expected) > 5


def test_a_silent_key_is_forgotten(spark, fed):
    schema = "label string, n int, embedding array<float>"
    feed, got = fed(schema, lambda s: keyed.stream_drift(s, "label", "n", idle_ms=3000), "forgotten")
    feed([("a", 0, [1.0, 0.0])], 1)
    time.sleep(4)
    feed([("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 0.0])], 3)
    assert [x.drift for x in sorted(got(), key=lambda x: x.n)] == [None, None, 1.0]
