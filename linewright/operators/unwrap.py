"""Joining hard-wrapped lines, as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A wrapped line is at least so wide, and so near to the widest of its block.
LEAST_WIDTH = 40
LEAST_SHARE = 0.9


def soft_unwrap(lines: DataFrame, members: str | None = None) -> DataFrame:
    """Rows (doc_id, line_no, …) with wrapped lines joined to the line that starts them; lines of tables (table_id), boxes, code, diffs or with a tail stay.

    A block is a run of such lines with equal gutter. Inside it a line ends a run where a sentence ends or the direction changes.
    In a run the first line that is wide enough and all after it are one line, as a joined line only grows; lines before stay alone. `members` names a column for the contents of the lines that were joined.
    """
    free = F.col("table_id").isNull() & ~F.col("boxed") & ~F.col("code") & ~F.col("diff") & (F.col("tail") == "") & ~T.is_blank("content")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("free", free)
    same = F.col("free") & F.lag("free", 1, False).over(order) & (F.lag("lead").over(order) == F.col("lead"))
    rows = rows.withColumn("block", F.sum(F.when(same, 0).otherwise(1)).over(order)).withColumn("w", T.width("content"))
    block = Window.partitionBy("doc_id", "block")
    inside = block.orderBy("line_no")
    hard = F.lag(T.ends_sentence("content")).over(inside) | (F.lag("dir").over(inside) != F.col("dir"))
    rows = rows.withColumn("widest", F.max("w").over(block)).withColumn("run", F.sum(F.when(hard, 1).otherwise(0)).over(inside))
    wide = (F.col("w") >= LEAST_WIDTH) & (F.col("w") >= LEAST_SHARE * F.col("widest"))
    run = Window.partitionBy("doc_id", "block", "run")
    rows = rows.withColumn("first_wide", F.min(F.when(wide, F.col("line_no"))).over(run)).withColumn("head", F.least("line_no", "first_wide"))
    kept = [c for c in lines.columns if c not in ("doc_id", "line_no", "content", "marked")]
    merged = F.sort_array(F.collect_list(F.struct("line_no", "content")))
    joined = rows.groupBy("doc_id", F.col("head").alias("line_no")).agg(F.min_by(F.struct(*kept), "line_no").alias("f"), merged.alias("m"))
    between = lambda x, i: F.when(F.size("m") == 1, x.content).otherwise(F.when(i == 0, T.trim_ws(x.content, "right")).when(i == F.size("m") - 1, T.trim_ws(x.content, "left")).otherwise(T.trim_ws(x.content)))
    out = joined.select("doc_id", "line_no", *(F.col(f"f.{c}").alias(c) for c in kept), F.array_join(F.transform("m", between), " ").alias("content"), *([F.transform("m", lambda x: x.content).alias(members)] if members else []))
    return out.withColumn("marked", T.marked("content"))
