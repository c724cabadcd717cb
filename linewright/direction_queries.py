"""Queries whose captures mix directions, wrap, refuse or nest: recovered tables, unwrapping, copies, pages and streams' batch forms, each with DuckDB SQL that computes the same from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.chars import WS, strong
from .operators import render, web
from .operators.lines import analysed_lines
from .plans.batch import dump
from .plans.pipeline import Analysis, analyse
from .queries import _MIXED, _MIXED_MARKED, _mixed, q, query, read, sql_prose, sql_runs, sql_width, sql_walk
from .streaming.captures import latest
from .streaming.pages import claims, parent_history

_SIDE = "CASE WHEN {r} > {l} THEN 'rtl' ELSE 'ltr' END"

# Framed tables of customers, with headers and some names from right to left.

_WHO = "CASE WHEN c_custkey % 3 = 0 THEN concat('شرکت ', c_custkey) ELSE c_name END"
_HEADS = ("مشتری", "segment", "کلید")
_WIDTHS = (20, 12, 10)


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table of each eight customers."""
    rows = read(spark, sf_dir, "customer").select(F.expr("c_custkey div 8").alias("doc_id"), "c_custkey", F.array(F.expr(_WHO), "c_mktsegment", F.col("c_custkey").cast("string")).alias("cells"))
    line = lambda cells: F.concat(F.lit("│ "), F.array_join(F.array(*(F.rpad(cells[k], w, " ") for k, w in enumerate(_WIDTHS))), " │ "), F.lit(" │"))
    edge = lambda a, b, c: F.lit(a + b.join("─" * (w + 2) for w in _WIDTHS) + c)
    groups = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "cells"))), lambda x: line(x.cells)).alias("rows"))
    text = F.array_join(F.concat(F.array(edge("┌", "┬", "┐"), line(F.array(*map(F.lit, _HEADS))), edge("├", "┼", "┤")), F.col("rows"), F.array(edge("└", "┴", "┘"))), "\n")
    return groups.select("doc_id", text.alias("text"))


_CELLS = f"""
base AS (SELECT c_custkey // 8 AS doc_id, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS row_no, [{_WHO}, c_mktsegment, CAST(c_custkey AS VARCHAR)] AS t FROM customer),
raw AS (SELECT doc_id, row_no, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS col_no FROM (SELECT * FROM base UNION ALL SELECT DISTINCT doc_id, 0, ['{_HEADS[0]}', '{_HEADS[1]}', '{_HEADS[2]}'] FROM base)),
counted AS (SELECT *, {sql_runs('text', 'ltr')} AS l, {sql_runs('text', 'rtl')} AS r FROM raw),
cells AS (SELECT doc_id, row_no, col_no, text, {_SIDE.format(l='l', r='r')} AS dir, CASE WHEN sum(r) OVER (PARTITION BY doc_id, col_no) > sum(l) OVER (PARTITION BY doc_id, col_no) THEN 'rtl' ELSE 'ltr' END AS align,
  CASE WHEN sum(r) OVER (PARTITION BY doc_id) > sum(l) OVER (PARTITION BY doc_id) THEN 'rtl' ELSE 'ltr' END AS table_dir, max({sql_width('text')}) OVER (PARTITION BY doc_id, col_no) AS w FROM counted)"""


@query(f"WITH {_CELLS} SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, row_no = 0 AS head, dir, align, table_dir, text FROM cells")
def table_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of framed tables with their direction, that of their column and that of their table."""
    cells = analyse(_framed(spark, sf_dir)).cells
    return cells.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "head", "dir", "align", "table_dir", "text")


def _sql_drawn(cell: str) -> str:
    edge = lambda a, b, c: f"(SELECT '{a}' || string_agg(repeat('─', CAST(w + 2 AS INT)), '{b}' ORDER BY col_no) || '{c}' FROM cells c2 WHERE c2.doc_id = rows.doc_id AND c2.row_no = 0)"
    return f"""WITH {_CELLS}, rows AS (SELECT doc_id, row_no, '│ ' || string_agg({cell} || repeat(' ', CAST(w - {sql_width('text')} AS INT)), ' │ ' ORDER BY col_no) || ' │' AS line FROM cells GROUP BY doc_id, row_no),
heads AS (SELECT doc_id, line, {edge('┌', '┬', '┐')} AS top, {edge('├', '┼', '┤')} AS middle, {edge('└', '┴', '┘')} AS bottom FROM rows WHERE row_no = 0),
bodies AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY row_no) AS body FROM rows WHERE row_no > 0 GROUP BY doc_id)
SELECT doc_id, top || chr(10) || line || chr(10) || middle || chr(10) || body || chr(10) || bottom AS out FROM heads JOIN bodies USING (doc_id)"""


@query(_sql_drawn("text"))
def table_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed tables drawn again as plain text."""
    return analyse(_framed(spark, sf_dir)).copied("plain")


@query(_sql_drawn("CASE WHEN dir = 'rtl' THEN chr(8295) ELSE chr(8294) END || text || chr(8297)"))
def table_bidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed tables drawn again with every cell isolated in its direction."""
    return analyse(_framed(spark, sf_dir)).copied("bidi")


@query(f"""WITH {_CELLS}, rows AS (SELECT doc_id, table_dir, row_no, '<div class="rtl-row' || CASE WHEN row_no = 0 THEN ' rtl-row--head' ELSE '' END || '">' || string_agg('<div class="rtl-cell rtl-cell--' || align || '" dir="' || dir || '">' || text || '</div>', '' ORDER BY col_no) || '</div>' AS line FROM cells GROUP BY doc_id, table_dir, row_no)
SELECT doc_id, '<div class="rtl-doc"><div class="rtl-table rtl-table--framed" dir="' || table_dir || '" style="--rtl-cols:3">' || string_agg(line, '' ORDER BY row_no) || '</div></div>' AS out FROM rows GROUP BY doc_id, table_dir""")
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed tables as HTML grids."""
    return dump(_framed(spark, sf_dir), "fragment")


@query(f"""WITH {_CELLS}, docs AS (SELECT doc_id, {_SIDE.format(l='sum(l)', r='sum(r)')} AS doc_dir FROM counted GROUP BY doc_id),
rows AS (SELECT doc_id, table_dir, row_no, sum(l) AS l, sum(r) AS r, string_agg(text, '  ' ORDER BY col_no) AS content, string_agg('{{"dir":"' || dir || '","align":"' || align || '","segments":[{{"kind":"text","text":"' || text || '"}}]}}', ',' ORDER BY col_no) AS c FROM (SELECT cells.*, l, r FROM cells JOIN counted USING (doc_id, row_no, col_no)) GROUP BY doc_id, table_dir, row_no)
SELECT doc_id, '{{"lines":[' || string_agg('{{"lead":"","tail":"","boxed":false,"code":false,"dir":"' || CASE WHEN l = r THEN doc_dir ELSE {_SIDE.format(l='l', r='r')} END || '","segments":[{{"kind":"text","text":"' || content || '"}}],"table":{{"id":0,"columns":3,"dir":"' || table_dir || '","head":' || CASE WHEN row_no = 0 THEN 'true' ELSE 'false' END || ',"framed":true,"sep":{{"kind":"delimited","delim":"│"}},"cells":[' || c || ']}}}}', ',' ORDER BY row_no) || '],"source":"selection","diffMode":false}}' AS out FROM rows JOIN docs USING (doc_id) GROUP BY doc_id""")
def table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed tables as JSON documents: a line for each row, with the row's cells."""
    return dump(_framed(spark, sf_dir), "json")


# Aligned tables whose columns are one space apart, told by the gap of a rule, with rows that go on in the next line.

_NOTE = "CASE c_custkey % 3 WHEN 1 THEN concat(c_mktsegment, '-') ELSE c_mktsegment END"
_MORE = "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'and more' END"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.expr("c_custkey div 8").alias("doc_id"), "c_custkey", F.rpad("c_name", 18, "#").alias("name"), F.expr(_NOTE).alias("note"), F.expr(_MORE).alias("more"))
    lines = F.concat("name", F.lit(" "), "note", F.when(F.col("more") != "", F.concat(F.lit("\n" + " " * 19), F.col("more"))).otherwise(""))
    groups = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", lines.alias("line")))), lambda x: x.line), "\n").alias("body"))
    return groups.select("doc_id", F.concat(F.lit(f"{'customer':18} segment\n{'─' * 17}  {'─' * 9}\n"), "body").alias("text"))


_ALIGNED = f"""
base AS (SELECT c_custkey // 8 AS doc_id, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS row_no, rpad(c_name, 18, '#') AS name, {_NOTE} || CASE c_custkey % 3 WHEN 2 THEN ' ' ELSE '' END || {_MORE} AS note FROM customer),
cells AS (SELECT doc_id, row_no, 0 AS col_no, name AS text FROM base UNION ALL SELECT doc_id, row_no, 1, note FROM base UNION ALL SELECT DISTINCT doc_id, 0, 0, 'customer' FROM base UNION ALL SELECT DISTINCT doc_id, 0, 1, 'segment' FROM base)"""


@query(f"WITH {_ALIGNED} SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, row_no = 0 AS head, text FROM cells")
def table_wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of aligned tables whose rows go on in the next line."""
    cells = analyse(_aligned(spark, sf_dir)).cells
    return cells.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "head", "text")


@query(f"""WITH {_ALIGNED}, wide AS (SELECT *, max({sql_width('text')}) OVER (PARTITION BY doc_id, col_no) AS w FROM cells),
rows AS (SELECT doc_id, row_no, rtrim(string_agg(text || repeat(' ', CAST(w - {sql_width('text')} AS INT)), '  ' ORDER BY col_no)) || CASE WHEN row_no = 0 THEN chr(10) || string_agg(repeat('─', CAST(w AS INT)), '  ' ORDER BY col_no) ELSE '' END AS line FROM wide GROUP BY doc_id, row_no)
SELECT doc_id, string_agg(line, chr(10) ORDER BY row_no) AS out FROM rows GROUP BY doc_id""")
def table_spaced_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tables drawn again."""
    return dump(_aligned(spark, sf_dir), "text")


# Blocks that are no tables, and a delimiter that wins a tie.

_REFUSED = """CASE p_partkey % 4 WHEN 0 THEN concat('┏━━━━┳━━━━┓\\n┃ a  ┃ b  ┃\\n┣━━━━╋━━━━┫\\n┃ ', rpad(p_size, 2, ' '), ' ┃ 1  ┃\\n┗━━━━┻━━━━┛') WHEN 1 THEN concat('diff --git a b\\na    b\\nc    ', p_size, '\\nd    e')
  WHEN 2 THEN concat('a │ b | c\\nd │ e | ', p_size, '\\ng │ h | i') ELSE concat('only   one row ', p_size, '\\nand prose') END"""


@query("SELECT p_partkey AS doc_id, CAST(CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS tables, CASE WHEN p_partkey % 4 = 2 THEN '|' END AS delim, CASE WHEN p_partkey % 4 = 2 THEN 'a │ b;c;d │ e;' || p_size || ';g │ h;i' END AS cells FROM part")
def table_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy frames, diffs and prose give no table; of two delimiters on equally many rows the later wins."""
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_REFUSED).alias("text"))
    found = analyse(docs)
    shapes = found.tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.min("delim").alias("delim"))
    cells = found.cells.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "col_no", "text"))), lambda x: x.text), ";").alias("cells"))
    return docs.select("doc_id").join(shapes, "doc_id", "left").join(cells, "doc_id", "left").select("doc_id", F.coalesce("tables", F.lit(0)).cast("long").alias("tables"), "delim", "cells")


# Wrapped lines of both directions.

_LATIN, _PERSIAN = "rpad(p_name, 60, ' words go on')", "rpad('سلام دنیا', 60, ' خوب است')"
_WRAPPED = f"CASE p_partkey % 5 WHEN 0 THEN concat({_LATIN}, '\\n', {_LATIN}) WHEN 1 THEN concat({_LATIN}, '\\n', {_PERSIAN}, '\\n', {_PERSIAN}) WHEN 2 THEN concat({_LATIN}, '.\\n', {_LATIN}) WHEN 3 THEN concat('@@ 1\\n+++ b\\n', {_LATIN}, '\\n', {_LATIN}) ELSE concat('- ', {_LATIN}, '\\n* ', {_LATIN}, '\\n', p_name) END"
_WRAPPED_LINES = """
kinds AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS kind, p_name, rtrim({a}) AS a, rtrim({b}) AS b FROM part),
parts AS (SELECT doc_id, CASE kind WHEN 0 THEN [{joined0}] WHEN 1 THEN [a, {joined1}] WHEN 2 THEN [rpad(p_name, 60, ' words go on') || '.', a] WHEN 3 THEN ['@@ 1', '+++ b', a, a] ELSE [a, a, p_name] END AS p FROM kinds)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, content FROM (SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) - 1 AS i FROM parts)"""


@query("WITH" + _WRAPPED_LINES.format(a=_LATIN, b=_PERSIAN, joined0="a || ' ' || a", joined1="b || ' ' || b"))
def unwrap_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped lines are joined unless the direction or the marker changes, a sentence ends or the document is a diff."""
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_WRAPPED).alias("text"))
    lines = analyse(docs).lines
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("line_no"), "content")


@query(f"""WITH lines AS (SELECT p_partkey AS doc_id, string_split({_WRAPPED.replace("'\\n'", 'chr(10)').replace("\\n* ", "' || chr(10) || '* ").replace(".\\n'", ".' || chr(10)").replace("'@@ 1\\n+++ b\\n'", "'@@ 1' || chr(10) || '+++ b' || chr(10)")}, chr(10)) AS p FROM part)
SELECT doc_id, CAST(len(p) AS BIGINT) AS lines FROM lines""")
def unwrap_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With unwrapping off every line stays."""
    from .options import Options

    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_WRAPPED).alias("text"))
    return analyse(docs, Options(soft_unwrap=False)).lines.groupBy("doc_id").agg(F.count("*").alias("lines"))


# Cleaning, prompts, fences and ties.


@query("SELECT event_id AS doc_id, left(event_type, length(event_type) - 1) || 'x' || chr(10) || chr(10) || 'Z' || substr(event_type, 2) || chr(10) || user_id AS text FROM events")
def clean_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backspace, a blank line, a stand-in for a carriage return, stray marks and controls."""
    raw = F.concat("event_type", F.lit("\bx\n \t \n"), "event_type", F.lit("Z\n‏‫"), F.col("user_id").cast("string"), F.lit("⁩\x07﻿"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), T.clean(raw).alias("text"))


_TALK = "CASE c_custkey % 4 WHEN 0 THEN concat('PS سلام دنیا ', c_mktsegment) WHEN 1 THEN concat('➜ سلام ', c_mktsegment) WHEN 2 THEN 'سلام دنیا خوب است' ELSE concat('plain ', c_mktsegment) END"
_FENCED = ("```", "کد سلام دنیا", "```")


@query(f"""WITH lines AS (SELECT c_custkey AS doc_id, unnest([{_TALK}, concat('سلام ', c_mktsegment), '{_FENCED[0]}', '{_FENCED[1]}', '{_FENCED[2]}']) AS content, unnest([0, 1, 2, 3, 4]) AS line_no FROM customer),
counted AS (SELECT *, line_no >= 2 AS code, {sql_runs('content', 'ltr')} AS l, {sql_runs('content', 'rtl')} AS r FROM lines),
docs AS (SELECT doc_id, {_SIDE.format(l='sum(l)', r='sum(r)')} AS doc_dir FROM counted WHERE NOT code GROUP BY doc_id)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, code, doc_dir, CASE WHEN code OR regexp_matches(content, '^(PS |➜ )') OR (l = 0 AND r = 0) THEN 'ltr' WHEN l = r THEN doc_dir ELSE {_SIDE.format(l='l', r='r')} END AS dir FROM counted JOIN docs USING (doc_id)""")
def prompt_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of prompts, of ties and of fenced lines, which do not count for the document."""
    text = F.concat(F.expr(_TALK), F.lit("\nسلام "), "c_mktsegment", F.lit("\n" + "\n".join(_FENCED)))
    lines = analysed_lines(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "code", "doc_dir", "dir")


@query(f"SELECT doc_id, CASE WHEN f = '' THEN NULL WHEN regexp_matches(f, '[{strong('rtl', True)}]') THEN 'rtl' ELSE 'ltr' END AS dir FROM (SELECT p_partkey AS doc_id, regexp_extract({_MIXED.replace('THEN p_name', 'THEN p_size')}, '[{strong('ltr', True)}{strong('rtl', True)}]') AS f FROM part)")
def first_strong_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions by the first strong character."""
    text = F.expr(_MIXED.replace("THEN p_name", "THEN p_size"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), T.first_strong(text).alias("dir"))


@query(f"SELECT doc_id, CASE WHEN r > l THEN chr(8295) ELSE chr(8294) END || replace(replace(marked, chr(1), chr(8294)), chr(2), chr(8297)) || chr(8297) AS out FROM (SELECT doc_id, marked, {sql_runs(sql_prose('marked'), 'ltr')} AS l, {sql_runs(sql_prose('marked'), 'rtl')} AS r FROM ({_MIXED_MARKED}))")
def copy_bidi_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed texts copied with the whole and each code token isolated."""
    return dump(_mixed(spark, sf_dir), "copy", "bidi-safe")


@query("""SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS seg_no, 'code' AS kind, '`' || p_name || '`' AS text FROM part UNION ALL SELECT p_partkey, 1, 'text', ' ي' FROM part""")
def segments_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their backticks and letters as they came."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("`"), "p_name", F.lit("` ي")).alias("text"))
    pieces = rows.select("doc_id", F.posexplode(T.segments(T.marked("text"), strip_backticks=False)).alias("seg_no", "s"))
    return pieces.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "s.kind", "s.text")


@query("""SELECT c_custkey AS doc_id, '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8">' || chr(10) || '<title>a &lt; b</title>' || chr(10) || '<style>' || chr(10) || 'p{}' || chr(10) || '</style></head>' || chr(10) || '<body>' || chr(10) || '<div class="rtl-doc"><div class="rtl-line"><span class="rtl-content" dir="' || CASE WHEN c_custkey % 2 = 0 THEN 'rtl' ELSE 'ltr' END || '">' || CASE WHEN c_custkey % 2 = 0 THEN 'سلام دنیا' ELSE c_mktsegment END || '</span></div></div>' || chr(10) || '</body></html>' || chr(10) AS out FROM customer""")
def pages_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as whole HTML pages."""
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "سلام دنیا").otherwise(F.col("c_mktsegment")).alias("text"))
    return dump(docs, "html", title="a < b", css="p{}")


# Web pages with blocks, lists and cards from right to left.

_RTL_P = """replace(CASE WHEN page_id % 2 = 0 THEN replace(html, '<p>', '<p>سلام دنیا خوب است و این یک متن است ') ELSE html END, '</article>', concat('<blockquote>abc<p>in</p> سلام دنیا ', url, ' سلام</blockquote><p>a ', url, ' <code>', url, '</code> سلام دنیا خوب است و این یک متن است<pre><code>x</code> سلام</pre>',
  '<button><svg></svg>سلام<p>no</p></button><p>q <button>سلام</button></p><div role="button"><h3>سلام</h3></div><p>one<p>دو</article>'))"""


@query(rf"""WITH RECURSIVE {sql_walk(f'(SELECT page_id, {_RTL_P} AS html FROM pages)')}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS block_no, name AS tag, dir FROM found WHERE free AND name IN ({', '.join(f"'{x}'" for x in web.BLOCK_TAGS)})""")
def page_blocks_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the blocks of pages: both directions, blocks in blocks, code in blocks, controls, paragraphs without an end."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.expr(_RTL_P).alias("html"))
    return web.page_blocks(pages).select("page_id", F.col("block_no").cast("long").alias("block_no"), "tag", "dir")


_CARDS = """concat(replace(html, '</article>', ''), '<div class="x artifact-card"><span>', CASE WHEN page_id % 2 = 0 THEN 'سلام' ELSE 'hello' END, ' ', url, '</span><div><p>x</p></div></div><p>سلام</p><section class="artifact-card"><p>plain</p><p>سلام <b>', CASE WHEN page_id % 3 = 0 THEN url ELSE 'x' END, '</b></p><div class="artifact-card"><span>', url, '</span></div></section></article>')"""


@query(rf"""WITH RECURSIVE {sql_walk(f'(SELECT page_id, {_CARDS} AS html FROM pages)')},
cards AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS card_no FROM found WHERE contains(tag, 'artifact-card')),
blocks AS (SELECT page_id, dir, unnest(list_filter(around, lambda e: contains(e.tag, 'artifact-card'))) AS e FROM found WHERE free AND name IN ('span', {', '.join(f"'{x}'" for x in web.BLOCK_TAGS)}))
SELECT cards.page_id, card_no, count(*) AS blocks, count(*) FILTER (WHERE dir = 'rtl') AS rtl_blocks, count(*) FILTER (WHERE dir = 'rtl') > 0 AS marked FROM cards JOIN blocks ON cards.page_id = blocks.page_id AND cards.pos = blocks.e.pos GROUP BY cards.page_id, card_no""")
def page_card_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of pages, marked if something in them is right to left; what is beside a card does not count, a card inside a card counts for both."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.expr(_CARDS).alias("html"))
    cards = web.page_cards(pages)
    return cards.select("page_id", F.col("card_no").cast("long").alias("card_no"), "blocks", "rtl_blocks", "marked")


@query("SELECT doc_id, text FROM (SELECT user_id AS doc_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events) WHERE n = 1")
def latest_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the latest text."""
    return latest(read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("text")), "ts")


# Targets that come and go, lists whose items change: the tables of events as what the streams see.


@query("""WITH marked AS (SELECT user_id, event_id, value < 10 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 10 ORDER BY event_id) AS island FROM events),
firsts AS (SELECT user_id, gone, island, min(event_id) AS seq FROM marked GROUP BY ALL)
SELECT user_id AS target_id, seq, CASE WHEN gone THEN 'release' ELSE 'attach' END AS action FROM firsts WHERE NOT gone OR seq > (SELECT min(event_id) FROM events WHERE events.user_id = firsts.user_id)""")
def target_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's target is attached and released; events of small value detach it."""
    return claims(read(spark, sf_dir, "events").select(F.col("user_id").alias("target_id"), F.col("event_id").alias("seq"), (F.col("value") < 10).alias("detached")))


@query("""WITH changes AS (SELECT user_id AS parent_id, event_id AS seq, value < 5 AS removed, event_id % 3 = 0 AND 4 >= 0.4 * (4 + len(regexp_extract_all(event_type, '[A-Za-z]'))) AS rtl,
  lead(event_id) OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS next FROM events),
counted AS (SELECT e.parent_id, e.seq, count(c.seq) AS items, count(c.seq) FILTER (c.rtl) AS rtl_items FROM changes AS e LEFT JOIN changes AS c ON c.parent_id = e.parent_id AND NOT c.removed AND c.seq <= e.seq AND (c.next IS NULL OR c.next > e.seq) GROUP BY e.parent_id, e.seq)
SELECT *, CASE WHEN items > 0 AND 2 * rtl_items >= items THEN 'rtl' END AS dir, rtl_items > 0 AS marked FROM counted""")
def parent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of each user after each event, which puts, changes or (of small value) removes one of seven items."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("سلام "), "event_type")).otherwise(F.col("event_type"))
    changes = read(spark, sf_dir, "events").select(F.col("user_id").alias("parent_id"), (F.col("event_id") % 7).alias("child_id"), F.col("event_id").alias("seq"), text.alias("text"), (F.col("value") < 5).alias("removed"))
    return parent_history(changes, F.expr("seq div 500"))
