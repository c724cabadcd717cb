"""Captures as a stream: what a trigger does, analysis batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import trim_ws
from ..options import Options
from ..plans.pipeline import Analysis, analyse


def trigger_action(visible: str, pinned: str, has_selection: str, new_text: str | Column, last_text: str | Column) -> Column:
    """update or dismiss: a hidden window updates, a visible one that is not pinned goes; a pinned one goes without a selection or with the text it has."""
    new, last = trim_ws(new_text), trim_ws(F.coalesce(F.col(last_text) if isinstance(last_text, str) else last_text, F.lit("")))
    return F.when(~F.col(visible), F.lit("update")).when(~F.col(pinned) | ~F.col(has_selection) | (new == last), F.lit("dismiss")).otherwise(F.lit("update"))


def with_last_text(rows: DataFrame, key: str, order: str, visible: str, pinned: str, selected: str, text: str = "text", chunk: Column | None = None) -> DataFrame:
    """`rows` with `last_text`, what the key shows before the event (null: nothing yet).

    An event either sets what is shown, to its own text, or leaves it: one that finds the window hidden sets it, and one that finds it pinned with a
    selection sets it or has the same text. So events compose to the last of them that sets, a running value. It is found within chunks first, then over
    the totals of chunks, so that a key with very many events is not one task; `chunk` must grow with `order` (all of a key if not given).
    """
    sets = F.when(~F.col(visible) | (F.col(pinned) & F.col(selected)), F.struct(F.coalesce(text, F.lit("")).alias("t")))
    each = rows.withColumns({"__chunk": F.lit(0) if chunk is None else chunk, "__set": sets})
    inside = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__own", F.last("__set", ignorenulls=True).over(inside))
    totals = each.groupBy(key, "__chunk").agg(F.max_by("__set", F.when(F.col("__set").isNotNull(), F.col(order))).alias("__total"))
    before = totals.withColumn("__before", F.last("__total", ignorenulls=True).over(Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
    joined = each.join(before.select(F.col(key).alias("__key"), F.col("__chunk").alias("__of"), "__before"), F.col(key).eqNullSafe(F.col("__key")) & F.col("__chunk").eqNullSafe(F.col("__of")))
    return joined.withColumn("last_text", F.coalesce("__own", "__before")["t"]).drop("__chunk", "__set", "__own", "__before", "__key", "__of")


def latest(captures: DataFrame, order: str | None = None) -> DataFrame:
    """Rows (doc_id, text): of each document the text that is last in `order`; of equals, or without an order, the greatest."""
    by = F.struct(*([order] if order else []), F.col("text").isNotNull(), "text")
    return captures.groupBy("doc_id").agg(F.max_by("text", by).alias("text"))


def analyse_stream(captures: DataFrame, sink: Callable[[Analysis, int], None], checkpoint: str, options: Options = Options(), every: str = "2 seconds", order: str | None = "at") -> StreamingQuery:
    """Analyse a stream of captures in micro-batches; in a batch each doc_id counts once, with its latest text by the column `order`. A later batch gives a document anew."""

    def batch(frame: DataFrame, number: int) -> None:
        sink(analyse(latest(frame, order), options), number)

    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def trigger_stream(events: DataFrame, key: str) -> DataFrame:
    """Rows (key, event_id, action) for a stream of events (key, event_id, visible, pinned, selected, text): the last text of each key is state, events of a batch follow each other by event_id.

    As the tool does, a key remembers what it shows: a text that is dismissed does not become the last one.
    """

    def act(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_id")
        actions = []
        for row in rows.itertuples(index=False):
            text = (row.text or "").strip()
            update = not row.visible or (row.pinned and row.selected and text != (last or "").strip())
            actions.append("update" if update else "dismiss")
            last = row.text if update else last
        state.update((last,))
        yield pd.DataFrame({key: own[0], "event_id": rows["event_id"], "action": actions})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(act, f"{key} {kind}, event_id long, action string", "last string", "append", GroupStateTimeout.NoTimeout)
