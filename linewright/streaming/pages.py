"""Pages as streams with state: which targets are attached, which blocks are dirty, what lists and cards hold.

The streams keep their state in maps of `transformWithState`, so they need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
Events are ordered by `seq` (never null) inside a micro-batch; across batches they must come in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.web import classify

#: Fixed value: milliseconds from the first mark of a page to its flush.
FLUSH_MS = 50


def _kind(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


class _Claims(StatefulProcessor):
    """A target is claimed when it is seen and free again when it is detached."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getValueState("claimed", "since long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        claimed = self.claimed.exists()
        for row in sorted(rows, key=lambda r: r.seq):
            if row.detached == claimed:
                claimed = not row.detached
                if claimed:
                    self.claimed.update((row.seq,))
                else:
                    self.claimed.clear()
                yield Row(target_id=key[0], seq=row.seq, action="attach" if claimed else "release")

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame) -> DataFrame:
    """Rows (target_id, seq, action) for a stream of events (target_id, seq, detached): `attach` when a free target is seen, `release` when an attached one is detached; other events give none. A null `detached` is false."""
    rows = events.select("target_id", F.col("seq").cast("long").alias("seq"), F.coalesce("detached", F.lit(False)).alias("detached"))
    return rows.groupBy("target_id").transformWithState(_Claims(), f"target_id {_kind(events, 'target_id')}, seq long, action string", "append", "none")


def claims(events: DataFrame) -> DataFrame:
    """As claim_stream for a table of events: the state after an event is the event's own kind, so an event acts when the one before it is of the other kind (the first: when it is no detachment)."""
    detached = F.coalesce("detached", F.lit(False))
    before = F.lag(detached, 1, True).over(Window.partitionBy("target_id").orderBy("seq"))
    rows = events.select("target_id", F.col("seq").cast("long").alias("seq"), detached.alias("now"), before.alias("before")).where("now != before")
    return rows.select("target_id", "seq", F.when(F.col("now"), F.lit("release")).otherwise(F.lit("attach")).alias("action"))


class _Dirty(StatefulProcessor):
    """Blocks marked since the last flush, each with its latest direction; the first mark sets the timer."""

    def __init__(self, block_kind: str, wait: int) -> None:
        self.block_kind, self.wait = block_kind, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dirty = handle.getMapState("dirty", f"block_id {self.block_kind}", "seq long, dir string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.dirty.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        for row in rows:
            block = (row.block_id,)
            if not self.dirty.containsKey(block) or self.dirty.getValue(block)[0] <= row.seq:
                self.dirty.updateValue(block, (row.seq, row.dir))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for block, (seq, direction) in self.dirty.iterator():
            yield Row(page_id=key[0], block_id=block[0], seq=seq, dir=direction)
        self.dirty.clear()

    def close(self) -> None:
        pass


def dirty_block_stream(changes: DataFrame, wait: int = FLUSH_MS) -> DataFrame:
    """Rows (page_id, block_id, seq, dir) for a stream of changes (page_id, block_id, seq, text): each page is flushed `wait` milliseconds after its first mark, with each block once and as its change of largest seq left it. Start the query with a trigger of about `wait`."""
    judged = changes.select("page_id", "block_id", F.col("seq").cast("long").alias("seq"), classify("text").alias("dir"))
    out = f"page_id {_kind(changes, 'page_id')}, block_id {_kind(changes, 'block_id')}, seq long, dir string"
    return judged.groupBy("page_id").transformWithState(_Dirty(_kind(changes, "block_id"), wait), out, "append", "processingTime")


class _Children(StatefulProcessor):
    """The children of a parent, an entry each, and their counts, which every change moves by its own difference."""

    def __init__(self, child_kind: str) -> None:
        self.child_kind = child_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.children = handle.getMapState("children", f"child_id {self.child_kind}", "rtl boolean")
        self.counts = handle.getValueState("counts", "items long, rtl_items long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        items, right = self.counts.get() if self.counts.exists() else (0, 0)
        seq = None
        for row in sorted(rows, key=lambda r: r.seq):
            child, seq = (row.child_id,), row.seq
            known = self.children.containsKey(child)
            was = known and self.children.getValue(child)[0]
            if row.removed:
                if known:
                    self.children.removeKey(child)
            elif not known or was != row.rtl:
                self.children.updateValue(child, (row.rtl,))
            items += (not row.removed) - known
            right += (not row.removed and row.rtl) - was
        if items:
            self.counts.update((items, right))
        else:
            self.counts.clear()
        yield Row(parent_id=key[0], seq=seq, items=items, rtl_items=right, dir="rtl" if items and 2 * right >= items else None, marked=right > 0)

    def close(self) -> None:
        pass


def _judged(changes: DataFrame, *more: Column) -> DataFrame:
    removed = F.coalesce("removed", F.lit(False))
    return changes.select("parent_id", "child_id", F.col("seq").cast("long").alias("seq"), removed.alias("removed"), (~removed & F.coalesce(classify("text") == "rtl", F.lit(False))).alias("rtl"), *more)


def parent_stream(changes: DataFrame) -> DataFrame:
    """Rows (parent_id, seq, items, rtl_items, dir, marked) for a stream of changes (parent_id, child_id, seq, text, removed): after each micro-batch, every parent that changed.

    A list is a parent of items and has `dir` rtl if at least half of them are; a card is a parent of blocks and is `marked` if any is rtl. A child counts as its last change
    left it; a removed one no longer counts, and a parent without children keeps no state. Output mode update.
    """
    out = f"parent_id {_kind(changes, 'parent_id')}, seq long, items long, rtl_items long, dir string, marked boolean"
    return _judged(changes).groupBy("parent_id").transformWithState(_Children(_kind(changes, "child_id")), out, "update", "none")


def parent_history(changes: DataFrame, chunk: Column | None = None) -> DataFrame:
    """As parent_stream for a table of changes: the parent after each of them (seq is unique in a parent).

    A change moves the counts by the difference from its child's change before; the counts are running sums of these, within chunks of a parent and over the totals of
    chunks, so that a parent with very many changes is not one task. `chunk` must grow with seq (all of a parent if not given).
    """
    rows = _judged(changes, (F.lit(0) if chunk is None else chunk).alias("__chunk"))
    child = Window.partitionBy("parent_id", "child_id").orderBy("seq")
    here, right = (~F.col("removed")).cast("long"), F.col("rtl").cast("long")
    rows = rows.withColumns({"__i": here - F.lag(here, 1, 0).over(child), "__r": right - F.lag(right, 1, 0).over(child)})
    inside = Window.partitionBy("parent_id", "__chunk").orderBy("seq")
    rows = rows.withColumns({"__own_i": F.sum("__i").over(inside), "__own_r": F.sum("__r").over(inside)})
    before = Window.partitionBy("__parent").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("parent_id").alias("__parent"), F.col("__chunk").alias("__of")).agg(F.sum("__i").alias("i"), F.sum("__r").alias("r"))
    totals = totals.select("__parent", "__of", F.coalesce(F.sum("i").over(before), F.lit(0)).alias("__before_i"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("__before_r"))
    both = rows.join(totals, F.col("parent_id").eqNullSafe(F.col("__parent")) & F.col("__chunk").eqNullSafe(F.col("__of")))
    out = both.select("parent_id", "seq", (F.col("__own_i") + F.col("__before_i")).alias("items"), (F.col("__own_r") + F.col("__before_r")).alias("rtl_items"))
    return out.select("*", F.when((F.col("items") > 0) & (2 * F.col("rtl_items") >= F.col("items")), F.lit("rtl")).alias("dir"), (F.col("rtl_items") > 0).alias("marked"))
