"""Serialisers: copied text (plain, markdown, bidi-safe), HTML, JSON. Each makes one text of a document from its lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import shuffled

LRI, RLI, PDI = "\u2066", "\u2067", "\u2069"
#: The glyphs of rebuilt tables by delimiter: vertical, horizontal, then left, middle and right of the top, the rule under the head and the bottom.
FRAMES = {"│": "│─┌┬┐├┼┤└┴┘", "┃": "┃━┏┳┓┣╋┫┗┻┛", "║": "║═╔╦╗╠╬╣╚╩╝", "|": "|-+++++++++"}


def body(marked: str | Column, mode: str = "plain", strip_backticks: bool = True, whole: Column | None = None) -> Column:
    """Marked text as copied: code tokens bare, in backticks (markdown) or isolated (bidi). `whole`: where true the text is one code token."""
    before, after = {"plain": ("", ""), "markdown": ("`", "`"), "bidi": (LRI, PDI)}[mode]
    joined = F.array_join(F.transform(T.segments(marked, strip_backticks), lambda s: F.when(s.kind == "code", F.concat(F.lit(before), s.text, F.lit(after))).otherwise(s.text)), "")
    if whole is None:
        return joined
    bare = F.translate(F.col(marked) if isinstance(marked, str) else marked, T.OPEN + T.CLOSE, "")
    return F.when(whole & (bare != ""), F.concat(F.lit(before), bare, F.lit(after))).otherwise(joined)


def _whole() -> Column:
    return F.col("code") | F.col("diff")


def copy_lines(lines: DataFrame, mode: str = "plain", strip_backticks: bool = True) -> DataFrame:
    """Rows (doc_id, line_no, out) for lines outside tables. Boxed lines are padded to the widest box line of the document and one column more."""
    text = body("marked", mode, strip_backticks, _whole())
    shown = body("marked", "markdown" if mode == "markdown" else "plain", strip_backticks, _whole())
    rows = lines.withColumn("text", text).withColumn("head_w", T.width(F.concat("lead", shown)))
    rows = rows.withColumn("target", F.max(F.when(F.col("boxed"), F.col("head_w"))).over(Window.partitionBy("doc_id")))
    pad = F.repeat(F.lit(" "), F.greatest(F.col("target") - F.col("head_w"), F.lit(0)) + 1)
    tail = T.trim_ws("tail", "left")
    if mode == "bidi":
        isolate = lambda x, sign: F.concat(sign, x, F.lit(PDI))
        lead = F.when(F.col("lead") != "", isolate(F.col("lead"), F.lit(LRI))).otherwise(F.lit(""))
        middle = F.when(F.col("content") != "", isolate(F.col("text"), F.when(F.col("dir") == "rtl", F.lit(RLI)).otherwise(F.lit(LRI)))).otherwise(F.lit(""))
        end = F.when(F.col("tail") == "", F.lit("")).otherwise(F.concat(F.when(F.col("boxed"), pad).otherwise(F.lit("")), isolate(tail, F.lit(LRI))))
        out = F.concat(lead, middle, end)
    else:
        out = F.concat("lead", "text", F.when(F.col("boxed"), F.concat(pad, tail)).otherwise(F.col("tail")))
    return rows.select("doc_id", "line_no", out.alias("out"))


def copy_tables(tables: DataFrame, cells: DataFrame, mode: str = "plain", strip_backticks: bool = True) -> DataFrame:
    """Rows (doc_id, table_id, out): each table drawn again, from cells with `marked`, `dir`."""
    inner = body("marked", mode, strip_backticks)
    shown = body("marked", "markdown" if mode == "markdown" else "plain", strip_backticks)
    if mode == "bidi":
        inner = F.concat(F.when(F.col("dir") == "rtl", F.lit(RLI)).otherwise(F.lit(LRI)), inner, F.lit(PDI))
    rows = cells.withColumn("w", T.width(shown))
    rows = rows.withColumn("widest", F.max("w").over(Window.partitionBy("doc_id", "table_id", "col_no")))
    rows = rows.withColumn("padded", F.concat(inner, F.repeat(F.lit(" "), F.col("widest") - F.col("w"))))
    line = rows.groupBy("doc_id", "table_id", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "padded", "widest"))), lambda x: F.struct(x.padded.alias("t"), x.widest.alias("w"))).alias("c"))
    known = tables.select("doc_id", "table_id", "sep", "framed", F.coalesce("delim", F.lit("")).alias("delim"))
    line = line.join(shuffled(known), ["doc_id", "table_id"])
    frame = F.create_map(*(F.lit(x) for k, v in FRAMES.items() for x in (k, v)))
    line = line.withColumn("f", F.coalesce(F.try_element_at(frame, "delim"), F.lit(FRAMES["│"])))
    glyph = lambda k: F.substring("f", k + 1, 1)
    join = lambda sep: F.aggregate(F.slice("c", 2, F.size("c")), F.element_at("c", 1).t, lambda a, x: F.concat(a, sep, x.t))
    rule = lambda ends: F.concat(glyph(ends), F.aggregate(F.slice("c", 2, F.size("c")), F.repeat(glyph(1), F.element_at("c", 1).w + 2), lambda a, x: F.concat(a, glyph(ends + 1), F.repeat(glyph(1), x.w + 2))), glyph(ends + 2))
    first, last = F.col("row_no") == 0, F.col("row_no") == F.max("row_no").over(Window.partitionBy("doc_id", "table_id"))
    none = F.lit(None).cast("string")
    if mode == "markdown":
        dashes = F.array_join(F.transform("c", lambda x: F.repeat(F.lit("-"), F.greatest(x.w, F.lit(3)))), " | ")
        out = F.array(F.concat(F.lit("| "), join(F.lit(" | ")), F.lit(" |")), F.when(first, F.concat(F.lit("| "), dashes, F.lit(" |"))))
    else:
        bars = F.array_join(F.transform("c", lambda x: F.repeat(F.lit("─"), x.w)), "  ")
        framed = F.array(F.when(first & F.col("framed"), rule(2)), F.concat(glyph(0), F.lit(" "), join(F.concat(F.lit(" "), glyph(0), F.lit(" "))), F.lit(" "), glyph(0)), F.when(first, rule(5)), F.when(last & F.col("framed"), rule(8)))
        spaced = F.array(none, T.trim_ws(join(F.lit("  ")), "right"), F.when(first, bars), none)
        out = F.when(F.col("sep") == "delimited", framed).otherwise(spaced)
    drawn = line.select("doc_id", "table_id", "row_no", F.array_join(out, "\n").alias("out"))
    return drawn.groupBy("doc_id", "table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "out"))), lambda x: x.out), "\n").alias("out"))


def _segments_html(marked: str | Column, strip_backticks: bool, whole: Column | None = None) -> Column:
    code = lambda x: F.concat(F.lit('<span class="rtl-code" dir="ltr">'), T.html_escape(x), F.lit("</span>"))
    joined = F.array_join(F.transform(T.segments(marked, strip_backticks), lambda s: F.when(s.kind == "code", code(s.text)).otherwise(T.html_escape(s.text))), "")
    if whole is None:
        return joined
    bare = F.translate(F.col(marked) if isinstance(marked, str) else marked, T.OPEN + T.CLOSE, "")
    return F.when(whole & (bare != ""), code(bare)).otherwise(joined)


def html_lines(lines: DataFrame, strip_backticks: bool = True) -> DataFrame:
    """Rows (doc_id, line_no, out): lines outside tables as HTML, in the classes and order that the layout expects."""
    blank = T.is_blank("content") & T.is_blank("lead") & T.is_blank("tail")
    classes = F.concat_ws(" ", F.lit("rtl-line"), F.when(F.col("code"), F.lit("rtl-line--code")), F.when(blank, F.lit("rtl-line--blank")), F.when(~F.col("boxed") & (F.col("dir") == "rtl") & (F.col("lead") != ""), F.lit("rtl-line--rtl")))
    span = lambda cls, x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(f'<span class="{cls}">'), T.html_escape(x), F.lit("</span>")))
    out = F.concat(F.lit('<div class="'), classes, F.lit('">'), span("rtl-gutter", F.col("lead")), F.lit('<span class="rtl-content" dir="'), F.col("dir"), F.lit('">'), _segments_html("marked", strip_backticks, _whole()), F.lit("</span>"), span("rtl-gutter rtl-gutter--tail", F.col("tail")), F.lit("</div>"))
    return lines.select("doc_id", "line_no", out.alias("out"))


def html_tables(tables: DataFrame, cells: DataFrame, strip_backticks: bool = True) -> DataFrame:
    """Rows (doc_id, table_id, out): tables as HTML grids, from cells with `marked`, `dir`, `align`, `table_dir`."""
    cell = F.concat(F.lit('<div class="rtl-cell rtl-cell--'), F.col("align"), F.lit('" dir="'), F.col("dir"), F.lit('">'), _segments_html("marked", strip_backticks), F.lit("</div>"))
    rows = cells.withColumn("cell", cell).groupBy("doc_id", "table_id", "table_dir", "row_no", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "cell"))), lambda x: x.cell), "").alias("cells"))
    row = F.concat(F.lit('<div class="rtl-row'), F.when(F.col("head"), F.lit(" rtl-row--head")).otherwise(F.lit("")), F.lit('">'), F.col("cells"), F.lit("</div>"))
    whole = rows.withColumn("row", row).groupBy("doc_id", "table_id", "table_dir").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "row"))), lambda x: x.row), "").alias("rows"))
    whole = whole.join(shuffled(tables.select("doc_id", "table_id", "framed", "columns")), ["doc_id", "table_id"])
    out = F.concat(F.lit('<div class="rtl-table'), F.when(F.col("framed"), F.lit(" rtl-table--framed")).otherwise(F.lit("")), F.lit('" dir="'), F.col("table_dir"), F.lit('" style="--rtl-cols:'), F.col("columns").cast("string"), F.lit('">'), F.col("rows"), F.lit("</div>"))
    return whole.select("doc_id", "table_id", out.alias("out"))


def assemble(lines: DataFrame, drawn_lines: DataFrame, drawn_tables: DataFrame) -> DataFrame:
    """Rows (doc_id, out): the drawn lines of each document in order, a table where its first row stands, joined by line feeds."""
    firsts = lines.where("table_id is not null").groupBy("doc_id", "table_id").agg(F.min("line_no").alias("line_no"))
    plain = lines.where("table_id is null").select("doc_id", "line_no").join(shuffled(drawn_lines), ["doc_id", "line_no"])
    both = plain.select("doc_id", "line_no", "out").union(firsts.join(shuffled(drawn_tables), ["doc_id", "table_id"]).select("doc_id", "line_no", "out"))
    return both.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "out"))), lambda x: x.out), "\n").alias("out"))


def html_page(fragments: DataFrame, title: str = "", css: str = "") -> DataFrame:
    """Rows (doc_id, out): each fragment as a page of its own."""
    head = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8">\n<title>'), T.html_escape(F.lit(title)), F.lit(f"</title>\n<style>\n{css}\n</style></head>\n<body>\n"))
    return fragments.select("doc_id", F.concat(head, "out", F.lit("\n</body></html>\n")).alias("out"))


def json_documents(lines: DataFrame, cells: DataFrame, tables: DataFrame, sources: DataFrame | None = None, strip_backticks: bool = True) -> DataFrame:
    """Rows (doc_id, out): each document as JSON, with its lines, their segments and the table row where a line is one."""
    seg = F.when(F.col("content") == "", F.expr("cast(array() as array<struct<kind:string,text:string>>)")).when(_whole(), F.array(F.struct(F.lit("code").alias("kind"), F.col("content").alias("text")))).otherwise(T.segments("marked", strip_backticks))
    row_of = cells.groupBy("doc_id", "table_id", "row_no", "head", "table_dir").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "dir", "align", "marked"))), lambda x: F.struct(x.dir.alias("dir"), x.align.alias("align"), T.segments(x.marked, strip_backticks).alias("segments"))).alias("cells"))
    row_of = row_of.join(shuffled(tables.select("doc_id", "table_id", "columns", "framed", "sep", "delim")), ["doc_id", "table_id"])
    table = F.when(F.col("table_id").isNotNull(), F.struct(F.col("table_id").alias("id"), "columns", F.col("table_dir").alias("dir"), "head", "framed", F.struct(F.col("sep").alias("kind"), "delim").alias("sep"), "cells"))
    rows = lines.join(shuffled(row_of), ["doc_id", "table_id", "row_no"], "left").select("doc_id", "diff", "line_no", F.struct("lead", "tail", "boxed", "code", lines["dir"], seg.alias("segments"), table.alias("table")).alias("line"))
    docs = rows.groupBy("doc_id").agg(F.first("diff").alias("diff"), F.sort_array(F.collect_list(F.struct("line_no", F.to_json("line").alias("json")))).alias("l"))
    source = F.lit("selection")
    if sources is not None:
        docs, source = docs.join(shuffled(sources), "doc_id", "left"), F.coalesce("source", F.lit("selection"))
    return docs.select("doc_id", F.concat(F.lit('{"lines":['), F.array_join(F.transform("l", lambda x: x.json), ","), F.lit('],"source":"'), source, F.lit('","diffMode":'), F.col("diff").cast("string"), F.lit("}")).alias("out"))
