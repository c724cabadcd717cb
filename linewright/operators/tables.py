"""Recovery of tables from aligned or ruled text, as bitwise aggregates, joins and windows over display columns.

A block is a run of lines that are neither blank nor code; it becomes one table or none. The ink of a line is packed in words of
columns, so a line of a block gives a row for each word, and one for each delimiter, but none for a glyph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chars import DELIMITERS, wide, zero
from ..storage import shuffled, stored

BLOCK = ("doc_id", "block")
LEAST_GAP = 2
#: Gaps of one column count so near to a gap of a rule.
NEAR = 2
#: Columns of a word of ink.
WORD = 60


def candidate_lines(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, block, line_no, painted, rule, delim) of the blocks that can be tables: two lines with content that share a delimiter, or have a wide gap, or a segmented rule.

    `delim` is the delimiter that two content lines of the block share: that on most lines, of equals the last in order.
    """
    painted = lines.where(~F.col("diff")).select("doc_id", "line_no", "code", F.concat("lead", "content").alias("painted"))
    apart = T.is_blank("painted") | F.col("code")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = painted.withColumn("apart", apart).withColumn("block", F.sum(F.col("apart").cast("int")).over(order)).where(~F.col("apart")).withColumn("rule", T.is_rule("painted"))
    block = Window.partitionBy(*BLOCK)
    content = ~F.col("rule")
    odd = rf"[^{T.WS}][{T.WS}{zero()}]{{{LEAST_GAP},}}[^{T.WS}]|[^{T.WS}]\x{{3000}}[^{T.WS}]"
    gap = F.when(T.is_plain("painted"), F.col("painted").rlike(rf"[^ ] {{{LEAST_GAP},}}[^ ]")).otherwise(F.col("painted").rlike(odd))
    shared = [F.sum((content & F.contains("painted", F.lit(d))).cast("int")).over(block) for d in DELIMITERS]
    best = F.greatest(*(F.when(n >= 2, F.struct(n.alias("n"), T.delimiter_order(F.lit(d)).alias("order"), F.lit(d).alias("d"))) for d, n in zip(DELIMITERS, shared, strict=True)))
    rows = rows.withColumn("delim", best["d"])
    can = F.col("delim").isNotNull() | (F.sum((content & gap).cast("int")).over(block) >= 2) | F.max(F.col("rule") & gap).over(block)
    rows = rows.withColumn("can", can & (F.sum(content.cast("int")).over(block) >= 2))
    return rows.where("can").select(*BLOCK, "line_no", "painted", "rule", "delim")


def _units(painted: Column) -> Column:
    """The characters that take columns, each behind the ones without width before it; such at the end of the line are one more unit."""
    return F.regexp_extract_all(painted, F.lit(rf"(?s)[{zero()}]*+[^{zero()}]|[{zero()}]++\z"), F.lit(0))


def grid(painted: str | Column) -> Column:
    """The text of each display column; the second column of a wide character is empty."""
    painted = F.col(painted) if isinstance(painted, str) else painted
    spread = F.flatten(F.transform(_units(painted), lambda u: F.when(u.rlike(rf"[{wide()}]\z"), F.array(u, F.lit(""))).otherwise(F.array(u))))
    return F.when(T.is_plain(painted), F.split(painted, "")).otherwise(spread)


def ink(painted: str | Column) -> Column:
    """1 for each display column with ink and 0 for each without."""
    painted = F.col(painted) if isinstance(painted, str) else painted

    def mark(u: Column) -> Column:
        one = F.when(u.rlike(rf"[{T.WS}]\z"), F.lit("0")).otherwise(F.lit("1"))
        return F.when(u.rlike(rf"^[{zero()}]*\z"), F.lit("")).when(u.rlike(rf"[{wide()}]\z"), F.repeat(one, F.lit(2))).otherwise(one)

    plain = F.regexp_replace(F.regexp_replace(painted, "[^ ]", "1"), " ", "0")
    return F.when(T.is_plain(painted), plain).otherwise(F.array_join(F.transform(_units(painted), mark), ""))


def gaps(bits: str | Column) -> Column:
    """The runs [s, e) of columns without ink."""
    bits = F.col(bits) if isinstance(bits, str) else bits

    def found(a: Column) -> Column:
        n = F.size(a)
        here = F.sequence(F.lit(0), n - 1)
        starts = F.filter(here, lambda i: (a[i] == "0") & ((i == 0) | (F.get(a, i - 1) == "1")))
        ends = F.filter(here, lambda i: (a[i] == "0") & ((i == n - 1) | (F.get(a, i + 1) == "1")))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    return F.when(bits == "", F.array().cast("array<struct<s:int,e:int>>")).otherwise(T.let(F.split(bits, ""), found))


def _block_ink(content: DataFrame) -> DataFrame:
    """Rows (doc_id, block, delim, width, bits): the columns of each block in which a content line has ink that is not the delimiter.

    Lines are packed in words of WORD columns, so that a block is a bitwise or over words, combined before the shuffle.
    """
    other = F.when(F.col("delim").isNull(), F.col("painted")).otherwise(F.replace("painted", F.col("delim"), F.lit(" ")))
    packed = F.transform(F.regexp_extract_all("bits", F.lit(f"[01]{{1,{WORD}}}"), F.lit(0)), lambda x: F.conv(F.rpad(x, WORD, "0"), 2, 10).cast("long"))
    words = content.select(*BLOCK, "delim", ink(other).alias("bits")).select(*BLOCK, "delim", F.length("bits").alias("width"), F.posexplode(packed).alias("word", "set"))
    words = words.groupBy(*BLOCK, "word").agg(F.bit_or("set").alias("set"), F.max("width").alias("width"), F.first("delim").alias("delim"))
    blocks = words.groupBy(*BLOCK).agg(F.sort_array(F.collect_list(F.struct("word", "set"))).alias("words"), F.max("width").alias("width"), F.first("delim").alias("delim"))
    joined = F.array_join(F.transform("words", lambda x: F.lpad(F.bin(x["set"]), WORD, "0")), "")
    return blocks.select(*BLOCK, "delim", "width", F.left(joined, F.col("width")).alias("bits"))


def column_ranges(candidates: DataFrame) -> DataFrame:
    """Rows (doc_id, block, sep, delim, ranges): the column ranges [s, e) of each block, by delimiter or else by gaps; blocks without bounds have no row."""
    content, rules = candidates.where("not rule"), candidates.where("rule")
    blocks = _block_ink(content)
    at = T.let(grid("painted"), lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.endswith(g[i], F.col("delim"))))
    hits = content.where("delim is not null").select(*BLOCK, F.explode(at).alias("at")).groupBy(*BLOCK, "at").count().where("count >= 2")
    hits = hits.groupBy(*BLOCK).agg(F.sort_array(F.collect_list("at")).alias("hits"))
    inner = T.let(ink("painted"), lambda bits: F.filter(gaps(bits), lambda g: (g["s"] > 0) & (g["e"] < F.length(bits)) & (g["e"] - g["s"] >= LEAST_GAP)))
    breaks = rules.select(*BLOCK, F.explode(inner).alias("gap")).distinct().groupBy(*BLOCK).agg(F.collect_list("gap").alias("breaks"))
    rows = blocks.join(shuffled(hits), list(BLOCK), "left").join(shuffled(breaks), list(BLOCK), "left")
    cuts = T.let(F.split("bits", ""), lambda a: F.filter("hits", lambda c: a[c] == "0"))
    near = lambda g: F.exists(F.coalesce("breaks", F.array()), lambda r: (g["s"] <= r["e"] + NEAR) & (g["e"] + NEAR >= r["s"]))
    apart = F.filter(gaps("bits"), lambda g: (g["e"] - g["s"] >= LEAST_GAP) | near(g))
    rows = rows.select(*BLOCK, "delim", "width", F.when(F.col("delim").isNotNull(), cuts).alias("cuts"), F.when(F.col("delim").isNull(), apart).alias("gaps"))
    by_delim = F.expr("transform(sequence(0, size(cuts)), i -> named_struct('s', case when i = 0 then 0 else cuts[i - 1] + 1 end, 'e', case when i = size(cuts) then greatest(width, cuts[i - 1] + 1) else cuts[i] end))")
    by_gap = F.expr("filter(transform(sequence(0, size(gaps)), i -> named_struct('s', case when i = 0 then 0 else gaps[i - 1].e end, 'e', case when i = size(gaps) then width else gaps[i].s end)), r -> r.s < r.e)")
    sep = F.when(F.col("delim").isNotNull(), F.lit("delimited")).otherwise(F.lit("spaced"))
    return rows.where("size(coalesce(cuts, array())) > 0 or size(coalesce(gaps, array())) > 0").select(*BLOCK, sep.alias("sep"), "delim", F.when(F.col("delim").isNotNull(), by_delim).otherwise(by_gap).alias("ranges"))


def recover(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and cells of the lines of `analysed_lines`.

    Tables: (doc_id, table_id, start, end, columns, sep, delim, framed). Cells: (doc_id, table_id, row_no, col_no, head, text). The first
    row is the head, with a rule or without. A row whose first cell is empty continues the one above, unless a rule stands between.
    """
    candidates = stored(candidate_lines(lines), "candidates")
    ranges = column_ranges(candidates).select(*BLOCK, "sep", "ranges")
    cut = T.let(grid("painted"), lambda g: F.transform("ranges", lambda r: T.trim_ws(F.array_join(F.slice(g, r["s"] + 1, r["e"] - r["s"]), ""))))
    cut = candidates.join(shuffled(ranges), list(BLOCK)).select(*BLOCK, "line_no", "rule", "sep", "delim", F.when(~F.col("rule"), cut).alias("parts"))
    cut = stored(cut.where("rule or exists(parts, x -> x != '')"), "slices")
    used = cut.where("not rule").select(*BLOCK, F.explode(F.expr("filter(sequence(0, size(parts) - 1), i -> parts[i] != '')")).alias("range_no"))
    used = used.groupBy(*BLOCK).agg(F.sort_array(F.collect_set("range_no")).alias("used")).where("size(used) >= 2")
    order = Window.partitionBy(*BLOCK).orderBy("line_no")
    marks = cut.join(shuffled(used), list(BLOCK)).withColumn("cells", F.expr("transform(used, k -> parts[k])")).withColumn("first", F.expr("cells[0] != ''"))
    marks = marks.withColumn("part", F.sum(F.col("rule").cast("int")).over(order)).where("not rule")
    before = Window.partitionBy(*BLOCK, "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("new", F.col("first") | ~F.coalesce(F.max("first").over(before), F.lit(False))).withColumn("row_no", (F.sum(F.col("new").cast("int")).over(order) - 1).cast("int"))
    join = lambda a, x: F.when(a == "", x).when(a.rlike(r"[-/\x{200C}]\z") | x.startswith("/"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
    merged = marks.groupBy(*BLOCK, "row_no").agg(F.first("sep").alias("sep"), F.first("delim").alias("delim"), F.first(F.size("used")).alias("columns"), F.sort_array(F.collect_list(F.struct("line_no", "cells"))).alias("m"))
    texts = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda k: F.aggregate(F.filter(F.transform("m", lambda x: x["cells"][k]), lambda x: x != ""), F.lit(""), join))
    rows = stored(merged.select(*BLOCK, "row_no", "sep", "delim", "columns", texts.alias("cells")), "rows")
    shape = rows.groupBy(*BLOCK).agg(F.first("sep").alias("sep"), F.first("delim").alias("delim"), F.first("columns").alias("columns"), F.count("*").alias("rows"), F.count_if(F.expr("size(filter(cells, x -> x != '')) >= 2")).alias("full")).where("rows >= 2 and full >= 2")
    extent = candidates.groupBy(*BLOCK).agg(F.min("line_no").alias("start"), (F.max("line_no") + 1).alias("end"), F.max(T.is_frame("painted")).alias("framed"))
    found = shape.join(shuffled(extent), list(BLOCK))
    found = stored(found.withColumn("table_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1), "tables")
    cells = rows.select(*BLOCK, "row_no", "cells").join(shuffled(found.select(*BLOCK, "table_id")), list(BLOCK)).select("doc_id", "table_id", "row_no", (F.col("row_no") == 0).alias("head"), F.posexplode("cells").alias("col_no", "text"))
    return found.select("doc_id", "table_id", "start", "end", "columns", "sep", "delim", "framed"), cells.select("doc_id", "table_id", "row_no", "col_no", "head", "text")


def directed_cells(cells: DataFrame, doc_dirs: DataFrame) -> DataFrame:
    """Cells with marked text, their direction, that of their column (`align`) and of the table; both latter count the runs of the raw cell texts."""
    rows = cells.join(shuffled(doc_dirs), "doc_id").withColumn("marked", T.marked("text")).withColumn("left", T.runs("text", "ltr")).withColumn("right", T.runs("text", "rtl"))
    side = lambda w: F.when(F.sum("right").over(w) > F.sum("left").over(w), F.lit("rtl")).otherwise(F.lit("ltr"))
    rows = rows.withColumn("align", side(Window.partitionBy("doc_id", "table_id", "col_no"))).withColumn("table_dir", side(Window.partitionBy("doc_id", "table_id")))
    return rows.withColumn("dir", T.direction(T.prose_only("marked"), F.col("text"), F.lit(False), F.col("doc_dir"))).drop("left", "right")


def fold(lines: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """The lines with those of each table replaced by one line for each of its rows, whose content is its cells that are not empty."""
    spans = tables.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("line_no"))
    rest = lines.join(shuffled(spans), ["doc_id", "line_no"], "left_anti").withColumns({"row_no": F.lit(0), "table_id": F.lit(None).cast("int")})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "text"))), lambda x: F.when(x.text != "", x.text)), "  ")
    rows = cells.groupBy("doc_id", "table_id", "row_no").agg(text.alias("content")).join(shuffled(tables.select("doc_id", "table_id", F.col("start").alias("line_no"))), ["doc_id", "table_id"])
    rows = rows.join(shuffled(lines.groupBy("doc_id").agg(F.first("doc_dir").alias("doc_dir"), F.first("diff").alias("diff"))), "doc_id").withColumn("marked", T.marked("content"))
    rows = rows.withColumns({"lead": F.lit(""), "tail": F.lit(""), "boxed": F.lit(False), "code": F.lit(False), "dir": T.direction(T.prose_only("marked"), F.col("content"), F.lit(False), F.col("doc_dir"))})
    both = rest.unionByName(rows.select(*rest.columns))
    order = Window.partitionBy("doc_id").orderBy("line_no", "row_no")
    return both.withColumn("line_no", F.row_number().over(order) - 1)
