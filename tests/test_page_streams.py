"""Streams over pages against walks: claimed targets, dirty blocks with their timer, lists and cards; and their forms for tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linewright.streaming import pages

RTL, LTR = "سلام دنیا", "latin"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def batches(spark, rows, schema, act, mode, path, cuts=2):
    """The rows that `act` gives for `rows`, put in as `cuts` micro-batches."""
    size = -(-len(rows) // cuts)
    put = lambda k: spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").json(f"{path}/in")
    put(0)
    name = "p" + path.replace("/", "_").replace("-", "_")
    query = act(spark.readStream.schema(schema).json(f"{path}/in")).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp").start()
    for k in range(cuts):
        if k:
            put(k)
        query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_targets_are_claimed_and_released(rocks, tmp_path):
    rng = random.Random(3)
    schema = "target_id string, seq long, detached boolean"
    rows = [("a", 0, True), ("b", 1, None)] + [(rng.choice("abc"), k, rng.random() < 0.4) for k in range(2, 60)]
    claimed, expected = set(), []
    for target, seq, detached in rows:
        if bool(detached) == (target in claimed):
            claimed ^= {target}
            expected.append((target, seq, "release" if detached else "attach"))
    assert sorted(r for r in map(tuple, pages.claims(rocks.createDataFrame(rows, schema)).collect())) == sorted(expected)
    assert sorted(batches(rocks, rows, schema, pages.claim_stream, "append", str(tmp_path))) == sorted(expected)


def changes():
    rng = random.Random(4)
    return [(rng.choice([1, 2]), rng.randrange(4), k, rng.choice([RTL, LTR, None, ""]), rng.random() < 0.3) for k in range(80)]


CHANGES = "parent_id long, child_id long, seq long, text string, removed boolean"


def walk(rows):
    held, out = {}, {}
    for parent, child, seq, text, removed in rows:
        own = held.setdefault(parent, {})
        own.pop(child, None)
        if not removed:
            own[child] = text == RTL
        n, right = len(own), sum(own.values())
        out[seq] = (parent, seq, n, right, "rtl" if n and 2 * right >= n else None, right > 0)
    return out


def test_parents_after_each_change(spark):
    frame = spark.createDataFrame(changes(), CHANGES)
    for chunk in (None, F.expr("seq div 11")):
        got = pages.parent_history(frame, chunk).collect()
        assert sorted(map(tuple, got)) == sorted(walk(changes()).values())
    assert pages.parent_history(frame.limit(0)).collect() == []


def test_parents_after_each_batch(rocks, tmp_path):
    rows = changes() + [(3, 1, 90, RTL, True)]
    told = walk(rows)
    half = -(-len(rows) // 2)
    expected = [told[max(r[2] for r in part if r[0] == parent)] for part in (rows[:half], rows[half:]) for parent in sorted({r[0] for r in part})]
    assert sorted(batches(rocks, rows, CHANGES, pages.parent_stream, "update", str(tmp_path)), key=str) == sorted(expected, key=str)


def test_dirty_blocks_are_flushed_once_after_the_first_mark(rocks, tmp_path):
    schema = "page_id string, block_id long, seq long, text string"
    put = lambda rows: rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put([("a", 1, 1, RTL), ("a", 1, 3, LTR + RTL * 9), ("a", 1, 2, LTR), ("a", 2, 4, LTR), ("b", 1, 5, None)])
    frame = pages.dirty_block_stream(rocks.readStream.schema(schema).json(f"{tmp_path}/in"))
    query = frame.writeStream.format("memory").queryName("dirty").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="50 milliseconds").start()

    def seen(n):
        end = time.time() + 60
        while rocks.table("dirty").count() < n and time.time() < end and query.exception() is None:
            time.sleep(0.2)
        return sorted(map(tuple, rocks.table("dirty").collect()))

    first = [("a", 1, 3, "rtl"), ("a", 2, 4, None), ("b", 1, 5, None)]
    assert seen(3) == first
    put([("a", 1, 6, RTL)])
    assert seen(4) == sorted([*first, ("a", 1, 6, "rtl")])
    query.stop()
