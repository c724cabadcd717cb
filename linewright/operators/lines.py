"""The relation of lines: splitting, gutters, fences, diffs, directions. Rows of one document are ordered by line_no; windows partition by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chars import RULES
from ..options import Options


def cleaned(captures: DataFrame, options: Options = Options()) -> DataFrame:
    """`captures` (doc_id, text, …) with the text cleaned, its letters folded if asked, and line feeds at its end removed; null stays null."""
    text = T.clean("text", options.tab_width)
    if options.normalize_persian:
        text = T.let(text, T.fold_persian)
    return captures.withColumn("text", F.regexp_replace(text, r"\n+\z", ""))


def is_diff(text: str | Column) -> Column:
    """A git header line, or both a hunk line and a file line."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"(?:^|\n)diff --git ") | (text.rlike(r"(?:^|\n)@@ ") & text.rlike(r"(?:^|\n)(?:\+\+\+|---) "))


def unwelded(line: Column) -> Column:
    """One or two lines: a rule that stands right of a text, at least eight spaces away and of at least ten glyphs, is a line of its own."""
    end = F.regexp_extract(line, rf"(?<![{RULES}{T.WS}])[{RULES}{T.WS}]++\z", 0)
    pattern = rf"^([{RULES}{T.WS}]*?)(?<! ) {{8,}}+([{RULES}][{RULES}{T.WS}]*+)\z"
    rule = F.regexp_extract(end, pattern, 2)
    text = F.concat(F.left(line, F.length(line) - F.length(end)), F.regexp_extract(end, pattern, 1))
    apart = F.contains(line, F.lit(" " * 8))
    return F.when(apart & ~T.is_rule(line) & (F.regexp_count(rule, F.lit(f"[{RULES}]")) >= 10), F.array(T.trim_ws(text, "right"), rule)).otherwise(F.array(line))


def split_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, line, diff) of cleaned documents; an empty text is one empty line, a null text none."""
    parts = F.flatten(F.transform(F.split("text", "\n", -1), unwelded))
    return docs.select("doc_id", is_diff("text").alias("diff"), F.posexplode(parts).alias("line_no", "line"))


def with_gutters(lines: DataFrame) -> DataFrame:
    return lines.withColumn("g", T.gutter("line")).select(*(c for c in lines.columns if c != "line"), "g.lead", "g.content", "g.tail", "g.boxed")


def with_fences(lines: DataFrame) -> DataFrame:
    """With `code`: on a fence or between two; every fence, of either kind, toggles."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = T.is_fence("content")
    return lines.withColumn("fence", fence).withColumn("code", F.col("fence") | (F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)).drop("fence")


def with_directions(lines: DataFrame) -> DataFrame:
    """With `marked` (content with its code tokens marked), `dir` and `doc_dir`, the latter from the prose of lines that are not code."""
    marked = lines.withColumn("marked", T.marked("content"))
    prose = T.prose_only("marked")
    counted = marked.withColumn("left", F.when(F.col("code"), 0).otherwise(T.runs(prose, "ltr"))).withColumn("right", F.when(F.col("code"), 0).otherwise(T.runs(prose, "rtl")))
    doc = Window.partitionBy("doc_id")
    out = counted.withColumn("doc_dir", F.when(F.sum("right").over(doc) > F.sum("left").over(doc), F.lit("rtl")).otherwise(F.lit("ltr")))
    one = F.col("code") | F.col("diff") | T.is_prompt("content") | ((F.col("left") == 0) & (F.col("right") == 0))
    own = F.when(one, F.lit("ltr")).when(F.col("right") > F.col("left"), F.lit("rtl")).when(F.col("left") > F.col("right"), F.lit("ltr")).otherwise(F.col("doc_dir"))
    return out.withColumn("dir", own).drop("left", "right")


def analysed_lines(captures: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, diff, line_no, lead, content, tail, boxed, code, marked, doc_dir, dir) before tables and unwrapping."""
    return with_directions(with_fences(with_gutters(split_lines(cleaned(captures, options)))))
