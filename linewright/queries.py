"""Queries over the given tables, by name, with DuckDB SQL for the same rows. Captures are composed from columns and literals, alike in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.chars import CORNERS, RULES, STRUCT, WS, strong
from .operators import render, tables, web
from .operators.lines import analysed_lines, is_diff, split_lines, with_fences, with_gutters
from .operators.unwrap import soft_unwrap
from .plans.pipeline import analyse
from .sources.captures import capture_source
from .streaming.captures import trigger_action, with_last_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over as many tasks as the session shuffles with: a small file is read by few tasks, however much is then made of each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# Pieces of SQL that several oracles share.


def q(pattern: str) -> str:
    """A regular expression as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_LAST = rf"[{T.AFTER}]"
_SHORTER = "list_reduce(list_prepend(t, list_transform(range(24), lambda k: '')), lambda s, k: CASE WHEN regexp_matches(right(s, 1), {a}) OR (regexp_matches(right(s, 1), '[)\\]}}]') AND length(replace(s, right(s, 1), '')) < length(replace(s, translate(right(s, 1), ')]}}', '([{{'), ''))) THEN left(s, length(s) - 1) ELSE s END)".format(a=q(_LAST))
_TILES = q(f"(?s:{T.TOKEN}|.)")
_BOUND = q(rf"[{WS}{T.BEFORE}]\z")


def sql_marked(source: str, keep: str, content: str) -> str:
    """A query with the columns `keep` and `marked`, code tokens between chr(1) and chr(2)."""
    return f"""SELECT {keep}, array_to_string(list_transform(ts, lambda t, i: CASE WHEN length(t) > 1 AND (i = 1 OR regexp_matches(ts[i - 1], {_BOUND}))
      THEN list_transform([{_SHORTER}], lambda c: CASE WHEN length(c) > 1 AND NOT regexp_full_match(c, '[a-f]+') THEN chr(1) || c || chr(2) || substr(t, length(c) + 1) ELSE t END)[1] ELSE t END), '') AS marked
      FROM (SELECT {keep}, regexp_extract_all({content}, {_TILES}) AS ts FROM ({source}))"""


def sql_runs(text: str, side: str) -> str:
    joined = rf"regexp_replace({text}, '[_\x{{200C}}\x{{200D}}]', '', 'g')"
    return f"CAST(len(regexp_extract_all({joined}, '[{strong(side, True)}]+')) AS BIGINT)"


def sql_prose(marked: str) -> str:
    return f"regexp_replace({marked}, chr(1) || '[^' || chr(2) || ']*' || chr(2), ' ', 'g')"


def sql_width(text: str) -> str:
    """The columns of a text without wide characters, marks and emoji; lam and alef are one."""
    return f"(length({text}) - len(regexp_extract_all({text}, 'ل[اآأإ]')))"


# Captures.

_MIXED = "CASE p_partkey % 3 WHEN 0 THEN 'سلام دنیا ' || p_name WHEN 1 THEN p_name || ' in src/item_' || p_partkey || '.rs.' ELSE 'فایل data/part-' || p_partkey || '.csv را با --size=' || p_size || ' بساز' END"
_BOX = "CASE c_custkey % 4 WHEN 0 THEN '│ ' || c_name || ' │' WHEN 1 THEN '- ' || c_name WHEN 2 THEN c_custkey || ') ' || c_name ELSE '>> ' || c_name || ' |' END"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_MIXED).alias("text"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_BOX).alias("text"))


_DOC_LINES = "SELECT lang, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM documents"


@query(f"SELECT lang, count(*) AS lines, CAST(sum(len(regexp_extract_all(marked, chr(1)))) AS BIGINT) AS code_tokens FROM ({sql_marked(_DOC_LINES, 'lang', 'line')}) GROUP BY lang")
def tok_code_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-like tokens of the lines of documents, by language."""
    lines = read(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n", -1)).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.size(T.code_tokens(T.marked("line"))).cast("long")).alias("code_tokens"))


@query(f"SELECT lang, count(*) AS lines, CAST(count_if(regexp_matches(line, {q(rf'[.!?:؛؟۔。][{WS}]*$')})) AS BIGINT) AS sentence_ends, CAST(max(length(line)) AS BIGINT) AS longest FROM ({_DOC_LINES}) GROUP BY lang")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and those that end a sentence."""
    lines = read(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n", -1)).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(T.ends_sentence("line")).alias("sentence_ends"), F.max(F.length("line")).cast("long").alias("longest"))


@query(f"SELECT doc_id, {sql_runs('text', 'ltr')} AS ltr_runs, {sql_runs('text', 'rtl')} AS rtl_runs, CASE WHEN {sql_runs('text', 'rtl')} > {sql_runs('text', 'ltr')} THEN 'rtl' ELSE 'ltr' END AS dir FROM (SELECT p_partkey AS doc_id, {_MIXED} AS text FROM part)")
def dir_runs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of strong characters of mixed texts, and the direction of the text."""
    rows = _mixed(spark, sf_dir).select("doc_id", T.runs("text", "ltr").cast("long").alias("ltr_runs"), T.runs("text", "rtl").cast("long").alias("rtl_runs"))
    return rows.withColumn("dir", F.when(F.col("rtl_runs") > F.col("ltr_runs"), "rtl").otherwise("ltr"))


_MIXED_MARKED = sql_marked(f"SELECT p_partkey AS doc_id, {_MIXED} AS text FROM part", "doc_id", "text")


@query(f"SELECT doc_id, CAST(0 AS BIGINT) AS line_no, prose, CASE WHEN r > l THEN 'rtl' ELSE 'ltr' END AS doc_dir, CASE WHEN r > l THEN 'rtl' ELSE 'ltr' END AS dir FROM (SELECT doc_id, prose, {sql_runs('prose', 'ltr')} AS l, {sql_runs('prose', 'rtl')} AS r FROM (SELECT doc_id, {sql_prose('marked')} AS prose FROM ({_MIXED_MARKED})))")
def dir_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the lines of mixed texts, by their prose."""
    lines = analysed_lines(_mixed(spark, sf_dir))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.prose_only("marked").alias("prose"), "doc_dir", "dir")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS seg_no, CASE WHEN i % 2 = 0 THEN 'code' ELSE 'text' END AS kind, text FROM (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(replace(marked, chr(2), chr(1)), chr(1)) AS parts FROM ({_MIXED_MARKED}))) WHERE i % 2 = 0 OR text <> ''")
def segments_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and code segments of mixed texts."""
    rows = _mixed(spark, sf_dir).select("doc_id", F.posexplode(T.segments(T.marked("text"))).alias("seg_no", "s"))
    return rows.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "s.kind", "s.text")


_RUN_UNIT = "CASE p_partkey % 8 WHEN 0 THEN '.' WHEN 1 THEN '%' WHEN 2 THEN '-' WHEN 3 THEN 'a-_' WHEN 4 THEN '9' WHEN 5 THEN 'q' WHEN 6 THEN '+@' ELSE 'x7%' END"
_RUN_END = "CASE p_partkey % 7 WHEN 0 THEN 'name=' WHEN 1 THEN 'name()=' WHEN 2 THEN '=' WHEN 3 THEN 'http://' WHEN 4 THEN '/' WHEN 5 THEN '(' ELSE '::b->c=' END"
_RUNS = f"repeat({_RUN_UNIT}, CAST(p_partkey * 37 % 300 AS INT)) || {_RUN_END} || 'foo.bar ' || p_name || '.rs'"


@query(f"SELECT doc_id, len(string_split(marked, chr(1))) - 1 AS tokens, marked FROM ({sql_marked(f'SELECT p_partkey AS doc_id, {_RUNS} AS text FROM part', 'doc_id', 'text')})")
def tokens_behind_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code tokens behind unbroken runs of up to 900 characters, which a match inside the run can take along."""
    part = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = part.select(F.col("p_partkey").alias("doc_id"), F.expr(_RUNS).alias("text"))
    return rows.select("doc_id", T.marked("text").alias("marked")).select("doc_id", F.size(T.code_tokens("marked")).cast("long").alias("tokens"), "marked")


_LEAD = rf"^(?:[{WS}{STRUCT}]|[-*+$][{WS}]|>+[{WS}]|[0-9]+[.)][{WS}])*"
_GUTTERS = f"SELECT doc_id, lead, regexp_extract(rest, {q(rf'[{WS}{STRUCT}]*$')}) AS tail, rest FROM (SELECT doc_id, regexp_extract(text, {q(_LEAD)}) AS lead, substr(text, length(regexp_extract(text, {q(_LEAD)})) + 1) AS rest FROM (SELECT c_custkey AS doc_id, {_BOX} AS text FROM customer))"


@query(f"SELECT doc_id, lead, CASE WHEN boxed THEN left(rest, length(rest) - length(tail)) ELSE rtrim(rest) END AS content, CASE WHEN boxed THEN tail ELSE '' END AS tail, boxed FROM (SELECT *, trim(lead) <> '' AND trim(tail) <> '' AND length(rest) > length(tail) AS boxed FROM ({_GUTTERS}))")
def gutter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gutters of boxed lines, list items and quotes."""
    return with_gutters(split_lines(_boxed(spark, sf_dir))).select("doc_id", "lead", "content", "tail", "boxed")


@query(f"SELECT doc_id, regexp_full_match(text, {q(rf'[{WS}]*(?:[{RULES}][{WS}]*){{3,}}')}) AS rule, regexp_full_match(text, {q(rf'[{WS}]*(?:[{RULES}][{WS}]*){{3,}}')}) AND regexp_matches(text, '[{CORNERS}]') AS frame FROM (SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN '┌' || repeat('─', p_size) || '┐' WHEN 1 THEN repeat('- ', p_size) WHEN 2 THEN '--' ELSE '── ' || p_name END AS text FROM part)")
def rules_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are rules, and rules that are frames."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN '┌' || repeat('─', p_size) || '┐' WHEN 1 THEN repeat('- ', p_size) WHEN 2 THEN '--' ELSE '── ' || p_name END")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")).select("doc_id", T.is_rule("text").alias("rule"), T.is_frame("text").alias("frame"))


@query("SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 0 THEN p_name ELSE repeat('─', 12) END AS line FROM part, range(0, 2) AS r(i) WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 0, p_name || repeat(' ', 10) || '─────' FROM part WHERE p_partkey % 2 = 1")
def welded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the line of a text go to a line of their own if they are long."""
    text = F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name || repeat(' ', 10) || repeat('─', 12) ELSE p_name || repeat(' ', 10) || '─────' END")
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return split_lines(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


_TURNS = "SELECT conv_id AS doc_id, CASE WHEN turn % 4 = 1 THEN '```' ELSE replace(text, chr(10), ' ') END AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS line_no FROM conversations"


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, fence OR coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM (SELECT *, line = '```' AS fence FROM ({_TURNS}))")
def fence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns of conversations, each as a line, inside code fences."""
    turns = read(spark, sf_dir, "conversations").withColumn("line", F.expr("CASE WHEN turn % 4 = 1 THEN '```' ELSE replace(text, char(10), ' ') END"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = turns.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("line_no"), "line", F.lit(False).alias("diff"))
    return with_fences(with_gutters(lines)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "code")


_TURN_LINES = "SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, text, pos) - 1 AS line_no FROM (SELECT conv_id AS doc_id, turn, role, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT *, string_split(CASE WHEN turn % 4 = 1 THEN '```' || chr(10) || text ELSE text END, chr(10)) AS parts FROM conversations))"
_FENCE = rf"^[{WS}]*(?:```|~~~)"


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, fence OR coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM (SELECT *, regexp_matches(substr(line, length(regexp_extract(line, {q(_LEAD)})) + 1), {q(_FENCE)}) AS fence FROM ({_TURN_LINES}))")
def fence_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of whole turns of conversations, and whether they are inside code fences; a fence opens every fourth turn."""
    turns = read(spark, sf_dir, "conversations")
    text = F.expr("CASE WHEN turn % 4 = 1 THEN concat('```', char(10), text) ELSE text END")
    parts = turns.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("turn", "role", "text", "pos")
    lines = parts.select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), "line", F.col("line").alias("whole"), F.lit(False).alias("diff"))
    return with_fences(with_gutters(lines)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("whole").alias("line"), "code")


_DIFF = "CASE o_orderkey % 4 WHEN 0 THEN 'diff --git a/x b/x\n+' || o_orderstatus WHEN 1 THEN '@@ -1 +1 @@\n+++ b/' || o_orderkey WHEN 2 THEN '@@ ' || o_orderstatus ELSE '--- ' || o_orderstatus END"


@query("SELECT o_orderkey AS doc_id, o_orderkey % 4 < 2 AS diff FROM orders")
def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are diffs."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), is_diff(F.expr(_DIFF.replace("\n", "\\n"))).alias("diff"))


@query("SELECT event_id AS doc_id, event_type || chr(10) || u || repeat(' ', CAST(4 - length(u) % 4 AS INT)) || 'end' || substr('frame one', length(u) + 5) AS text FROM (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS u FROM events)")
def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes removed, a carriage return replayed, a tab expanded."""
    raw = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m\r\nframe one\r"), F.col("user_id").cast("string"), F.lit("\tend"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), T.clean(raw).alias("text"))


_SEQUENCE = "CASE event_id % 11 WHEN 0 THEN '[1;31m' WHEN 1 THEN '[3' || {n} || '1' WHEN 2 THEN ']8;;http://x' || {n} || {bel} WHEN 3 THEN ']0;title ' WHEN 4 THEN 'Pq#0' || {n} WHEN 5 THEN '(B' WHEN 6 THEN '[12' || {can} WHEN 7 THEN '^note' || {sub} WHEN 8 THEN {n} || '[2J' WHEN 9 THEN '# 7é' ELSE '[4é;2' END"
_NEXT = "CASE event_id % 7 WHEN 0 THEN {esc} || {st} WHEN 1 THEN {esc} || '[0m' WHEN 2 THEN '' WHEN 3 THEN {esc} || {esc} || 'c' ELSE {can} END"
_CHARACTERS = {"n": 10, "bel": 7, "can": 24, "sub": 26, "esc": 27, "st": 92}
_ESCAPED = f"event_type || {{esc}} || {_SEQUENCE} || user_id || {_NEXT} || ' end ' || event_id"
_SEQUENCES_SQL = r"""list_transform(string_split(raw, chr(27)), lambda p, i: CASE WHEN i = 1 THEN p
  WHEN regexp_matches(p, '^[^\x18\x1A\x20-\x7E]*[\]PX^_]') THEN regexp_replace(regexp_extract(p, '^[^\x18\x1A\x20-\x7E]*'), '[^\n]', '', 'g') || regexp_replace(p, '(?s)^[^\x18\x1A\x20-\x7E]*(?:\][^\x07\x18\x1A]*[\x07\x18\x1A]?|[PX^_][^\x18\x1A]*[\x18\x1A]?)', '')
  ELSE list_transform([regexp_extract(p, '^[^\x18\x1A\x20-\x7E]*(?:[\x18\x1A]|\[[^\x18\x1A\x40-\x7E]*[\x18\x1A\x40-\x7E]?|[\x20-\x2F][^\x18\x1A\x30-\x7E]*[\x18\x1A\x30-\x7E]?|[\x30-\x7E])?')], lambda m: regexp_replace(m, '[^\n]', '', 'g') || substr(p, length(m) + 1))[1] END)"""


@query(f"SELECT doc_id, regexp_replace(array_to_string({_SEQUENCES_SQL}, ''), '[\\x00-\\x07\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS text FROM (SELECT event_id AS doc_id, {_ESCAPED.format(**{k: f'chr({v})' for k, v in _CHARACTERS.items()})} AS raw FROM events)")
def escape_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their escape sequences, of which some do not end, are cancelled, or have others or line feeds inside."""
    raw = F.expr(_ESCAPED.format(**{k: f"char({v})" for k, v in _CHARACTERS.items()}))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), T.strip_escapes(raw).alias("text"))


@query("SELECT c_custkey AS doc_id, 'یک ' || c_name || ' لا الله ی' AS text FROM customer")
def fold_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentation forms and Arabic letters folded."""
    raw = F.concat(F.lit("يك "), "c_name", F.lit(" ﻻ ﷲ ى"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), T.fold_persian(raw).alias("text"))


_PAIR = "'│ ' || c_name || ' │' || chr(10) || '│ see a.py │'"
_W = "greatest(length(c_name), 8)"


def _copies(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    text = F.concat(F.lit("│ "), "c_name", F.lit(" │\n│ see a.py │"))
    lines = analysed_lines(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    return render.copy_lines(lines, mode).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "out")


@query(f"SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 0 THEN '│ ' || c_name || repeat(' ', CAST({_W} - length(c_name) + 1 AS INT)) || '│' ELSE '│ see a.py' || repeat(' ', CAST({_W} - 8 + 1 AS INT)) || '│' END AS out FROM customer, range(0, 2) AS r(i)")
def copy_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as plain text, their right sides aligned."""
    return _copies(spark, sf_dir, "plain")


@query(f"SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 0 THEN '│ ' || c_name || repeat(' ', CAST(greatest(length(c_name), 10) - length(c_name) + 1 AS INT)) || '│' ELSE '│ see `a.py`' || repeat(' ', CAST(greatest(length(c_name), 10) - 10 + 1 AS INT)) || '│' END AS out FROM customer, range(0, 2) AS r(i)")
def copy_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as Markdown, code in backticks."""
    return _copies(spark, sf_dir, "markdown")


@query(f"SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, chr(8294) || '│ ' || chr(8297) || CASE WHEN i = 0 THEN chr(8294) || c_name || chr(8297) || repeat(' ', CAST({_W} - length(c_name) + 1 AS INT)) ELSE chr(8294) || 'see ' || chr(8294) || 'a.py' || chr(8297) || chr(8297) || repeat(' ', CAST({_W} - 8 + 1 AS INT)) END || chr(8294) || '│' || chr(8297) AS out FROM customer, range(0, 2) AS r(i)")
def copy_bidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with every part isolated."""
    return _copies(spark, sf_dir, "bidi")


@query("SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS line_no, '<div class=\"rtl-line\"><span class=\"rtl-gutter\">- </span><span class=\"rtl-content\" dir=\"ltr\">&lt;' || c_name || '&gt; &amp; <span class=\"rtl-code\" dir=\"ltr\">a.py</span></span></div>' AS out FROM customer")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items as HTML."""
    text = F.concat(F.lit("- <"), "c_name", F.lit("> & a.py"))
    lines = analysed_lines(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    return render.html_lines(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "out")


_CUT = "SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS line_no FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([^\n]{80})', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS parts FROM documents)"
_UNWRAP = f"""
WITH cut AS ({_CUT}),
hard AS (SELECT *, length(content) AS w, max(length(content)) OVER (PARTITION BY doc_id) AS widest,
  coalesce(lag(regexp_matches(content, {q(rf'[.!?:؛؟۔。][{WS}]*$')})) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS h FROM (SELECT doc_id, line_no, rtrim(content) AS content FROM cut)),
runs AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM hard),
heads AS (SELECT *, least(line_no, coalesce(min(CASE WHEN w >= 40 AND w >= 0.9 * widest THEN line_no END) OVER (PARTITION BY doc_id, run), line_no)) AS head FROM runs)
SELECT doc_id, CAST(head AS BIGINT) AS line_no, count(*) AS joined, CAST(sum(length(trim(content))) AS BIGINT) AS chars FROM heads GROUP BY doc_id, head"""


@query(_UNWRAP)
def unwrap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at 80 columns, joined again."""
    cut = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"([^\n]{80})", "$1\n"), "\n", -1), lambda x: F.trim(x) != "")).alias("line_no", "content"))
    fixed = {"lead": "", "tail": "", "boxed": False, "code": False, "diff": False, "dir": "ltr"}
    lines = cut.withColumn("content", F.rtrim("content")).withColumns({k: F.lit(v) for k, v in fixed.items()} | {"table_id": F.lit(None).cast("int"), "row_no": F.lit(0)})
    joined = soft_unwrap(lines, members="members")
    return joined.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("members").cast("long").alias("joined"), F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + F.length(F.trim(x))).alias("chars"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table and one of aligned columns of each ten suppliers."""
    rows = read(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 10").alias("g")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.translate("s_name", "#", "_").alias("s_name")))).alias("n"))
    framed = F.concat(F.lit("┌──────────────────────┬────────────┐\n│ supplier             │ key        │\n├──────────────────────┼────────────┤\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("│ "), F.rpad(x.s_name, 20, " "), F.lit(" │ "), F.rpad(x.s_suppkey.cast("string"), 10, " "), F.lit(" │"))), "\n"), F.lit("\n└──────────────────────┴────────────┘"))
    spaced = F.concat(F.lit("supplier                key\n"), F.array_join(F.transform("n", lambda x: F.concat(F.rpad(x.s_name, 24, " "), x.s_suppkey.cast("string"))), "\n"))
    return rows.select((2 * F.col("g")).cast("long").alias("doc_id"), framed.alias("text")).union(rows.select((2 * F.col("g") + 1).cast("long"), spaced))


_SUPPLIERS = "SELECT s_suppkey // 10 AS g, s_suppkey, translate(s_name, '#', '_') AS s_name, row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) AS r FROM supplier"
_CELLS = f"""
WITH n AS ({_SUPPLIERS}), k AS (SELECT unnest([0, 1]) AS k), cells AS (
SELECT g, r, 0 AS c, s_name AS text FROM n UNION ALL SELECT g, r, 1, CAST(s_suppkey AS VARCHAR) FROM n
UNION ALL SELECT DISTINCT g, 0, 0, 'supplier' FROM n UNION ALL SELECT DISTINCT g, 0, 1, 'key' FROM n)
SELECT CAST(2 * g + k AS BIGINT) AS doc_id, CAST(r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, r = 0 AS head, text FROM cells, k"""


@query(_CELLS)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables recovered from framed and from aligned text."""
    out = analyse(_tables(spark, sf_dir)).cells
    return out.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "head", "text")


@query("SELECT CAST(2 * (s_suppkey // 10) + k AS BIGINT) AS doc_id, CAST(2 AS BIGINT) AS columns, CASE WHEN k = 0 THEN 'delimited' ELSE 'spaced' END AS sep, k = 0 AS framed, 'ltr' AS dir, count(*) + 1 AS n_rows FROM supplier, (SELECT unnest([0, 1]) AS k) GROUP BY s_suppkey // 10, k HAVING count(*) > 1")
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables themselves."""
    out = analyse(_tables(spark, sf_dir))
    sizes = out.cells.groupBy("doc_id", "table_id", "table_dir").agg(F.countDistinct("row_no").alias("n_rows"))
    return out.tables.join(sizes, ["doc_id", "table_id"]).select("doc_id", F.col("columns").cast("long").alias("columns"), "sep", "framed", F.col("table_dir").alias("dir"), "n_rows")


@query(f"""
WITH n AS (SELECT g, s_suppkey, '`' || s_name || '`' AS name FROM ({_SUPPLIERS})),
wide AS (SELECT *, greatest(max(length(name)) OVER (PARTITION BY g), 8) AS w, greatest(max(length(CAST(s_suppkey AS VARCHAR))) OVER (PARTITION BY g), 3) AS v FROM n),
body AS (SELECT g, w, v, string_agg('| ' || rpad(name, CAST(w AS INT), ' ') || ' | ' || rpad(CAST(s_suppkey AS VARCHAR), CAST(v AS INT), ' ') || ' |', chr(10) ORDER BY s_suppkey) AS b FROM wide GROUP BY g, w, v)
SELECT CAST(2 * g + k AS BIGINT) AS doc_id, '| ' || rpad('supplier', CAST(w AS INT), ' ') || ' | ' || rpad('key', CAST(v AS INT), ' ') || ' |' || chr(10) || '| ' || repeat('-', CAST(w AS INT)) || ' | ' || repeat('-', CAST(v AS INT)) || ' |' || chr(10) || b AS out FROM body, (SELECT unnest([0, 1]) AS k)""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered tables as Markdown."""
    return analyse(_tables(spark, sf_dir)).copied("markdown")


def _customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table and one of aligned columns of each eight customers; their number grows with the table."""
    customers = read(spark, sf_dir, "customer").withColumn("g", F.expr("c_custkey div 8"))
    rows = customers.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("n"))
    framed = F.concat(F.lit(f"┌{'─' * 22}┬{'─' * 14}┬{'─' * 12}┐\n│ {'customer':20} │ {'segment':12} │ {'key':10} │\n├{'─' * 22}┼{'─' * 14}┼{'─' * 12}┤\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("│ "), F.rpad(x.c_name, 20, " "), F.lit(" │ "), F.rpad(x.c_mktsegment, 12, " "), F.lit(" │ "), F.rpad(x.c_custkey.cast("string"), 10, " "), F.lit(" │"))), "\n"), F.lit(f"\n└{'─' * 22}┴{'─' * 14}┴{'─' * 12}┘"))
    spaced = F.concat(F.lit(f"{'customer':24}{'segment':16}key\n"), F.array_join(F.transform("n", lambda x: F.concat(F.rpad(x.c_name, 24, " "), F.rpad(x.c_mktsegment, 16, " "), x.c_custkey.cast("string"))), "\n"))
    return rows.select((2 * F.col("g")).cast("long").alias("doc_id"), framed.alias("text")).union(rows.select((2 * F.col("g") + 1).cast("long"), spaced))


_CUSTOMERS = "SELECT c_custkey // 8 AS g, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS r FROM customer"


@query(f"""
WITH n AS ({_CUSTOMERS}), k AS (SELECT unnest([0, 1]) AS k), cells AS (
SELECT g, r, 0 AS c, c_name AS text FROM n UNION ALL SELECT g, r, 1, c_mktsegment FROM n UNION ALL SELECT g, r, 2, CAST(c_custkey AS VARCHAR) FROM n
UNION ALL SELECT DISTINCT g, 0, 0, 'customer' FROM n UNION ALL SELECT DISTINCT g, 0, 1, 'segment' FROM n UNION ALL SELECT DISTINCT g, 0, 2, 'key' FROM n)
SELECT CAST(2 * g + k AS BIGINT) AS doc_id, CAST(r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, r = 0 AS head, text FROM cells, k""")
def table_cells_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables recovered from framed and from aligned text of all customers."""
    out = analyse(_customer_tables(spark, sf_dir)).cells
    return out.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "head", "text")


@query("SELECT CAST(2 * (c_custkey // 8) + k AS BIGINT) AS doc_id, CAST(3 AS BIGINT) AS columns, CASE WHEN k = 0 THEN 'delimited' ELSE 'spaced' END AS sep, k = 0 AS framed, 'ltr' AS dir, count(*) + 1 AS n_rows FROM customer, (SELECT unnest([0, 1]) AS k) GROUP BY c_custkey // 8, k")
def table_shapes_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all customers themselves."""
    out = analyse(_customer_tables(spark, sf_dir))
    sizes = out.cells.groupBy("doc_id", "table_id", "table_dir").agg(F.countDistinct("row_no").alias("n_rows"))
    return out.tables.join(sizes, ["doc_id", "table_id"]).select("doc_id", F.col("columns").cast("long").alias("columns"), "sep", "framed", F.col("table_dir").alias("dir"), "n_rows")


_TAGS = "p|li|blockquote|h1|h2|h3|h4|h5|h6"


@query(rf"""SELECT page_id, tag, count(*) AS blocks, CAST(0 AS BIGINT) AS rtl FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(?:script|style|pre|code|textarea|select|button)\b[^>]*>.*?</(?:script|style|pre|code|textarea|select|button)\s*>', '', 'g'), '(?is)<({_TAGS})\b[^>]*>', 1))) AS tag FROM pages) GROUP BY page_id, tag""")
def page_block_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages by tag, and how many run from right to left."""
    blocks = web.page_blocks(read(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id", "tag").agg(F.count("*").alias("blocks"), F.count_if(web.classify("text") == "rtl").alias("rtl"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li\\b')) AS BIGINT) AS items, CAST(0 AS BIGINT) AS rtl_items, CAST(NULL AS VARCHAR) AS dir FROM pages WHERE len(regexp_extract_all(html, '<li\\b')) > 0""")
def page_list_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of all items of each page together."""
    items = web.page_blocks(read(spark, sf_dir, "pages")).where("tag = 'li'")
    counts = items.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(F.col("dir") == "rtl").alias("rtl_items"))
    return counts.withColumn("dir", web.list_side("items", "rtl_items"))


def sql_walk(pages: str) -> str:
    """CTEs that walk pages (page_id, html) tag by tag with a stack of open elements: `found` has for each element its name, what it is inside of and the letters of its subtree but code."""
    return rf"""
src AS (SELECT page_id, string_split(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<') AS parts FROM {pages}),
walk AS (SELECT page_id, parts, 1 AS i, CAST([] AS STRUCT(pos INTEGER, name VARCHAR, tag VARCHAR)[]) AS stack FROM src UNION ALL
  SELECT page_id, parts, i + 1, CASE WHEN p[1] = '/' THEN CASE WHEN len(list_filter(stack, lambda e: e.name = name)) > 0 THEN stack[:list_max(list_transform(stack, lambda e, k: CASE WHEN e.name = name THEN k ELSE 0 END)) - 1] ELSE stack END
    WHEN NOT regexp_matches(p, '^[a-z]') OR name IN ('br', 'hr', 'img', 'input', 'link', 'meta') THEN stack ELSE list_append(CASE WHEN len(list_filter(stack, lambda e: e.name = 'p')) > 0 AND name IN ('p', 'ul', 'ol', 'pre', 'div', 'section', 'blockquote', 'article', 'footer', 'h2', 'h3') THEN stack[:list_max(list_transform(stack, lambda e, k: CASE WHEN e.name = 'p' THEN k ELSE 0 END)) - 1] ELSE stack END, {{'pos': i + 1, 'name': name, 'tag': split_part(p, '>', 1)}}) END
  FROM (SELECT *, parts[i + 1] AS p, lower(regexp_extract(parts[i + 1], '^/?([a-zA-Z0-9]+)', 1)) AS name FROM walk WHERE i < len(parts))),
texts AS (SELECT page_id, i, stack, len(list_filter(stack, lambda e: e.name IN ('pre', 'code'))) = 0 AS prose, CASE WHEN i = 1 THEN parts[1] ELSE substr(parts[i], strpos(parts[i], '>') + 1) END AS text FROM walk),
counted AS (SELECT page_id, e.pos AS pos, sum(CASE WHEN prose THEN len(regexp_extract_all(text, '[{web.RTL_LETTERS}]')) ELSE 0 END) AS r, sum(CASE WHEN prose THEN len(regexp_extract_all(text, '[{web.LTR_LETTERS}]')) ELSE 0 END) AS l FROM (SELECT page_id, prose, text, unnest(stack) AS e FROM texts) GROUP BY ALL),
found AS (SELECT counted.*, stack[-1].name AS name, stack[-1].tag AS tag, stack[:-2] AS around, stack[-2].pos AS parent, stack[-2].name AS parent_name, CASE WHEN r = 0 THEN NULL WHEN r >= 0.4 * (r + l) THEN 'rtl' ELSE 'ltr' END AS dir,
  len(list_filter(stack, lambda e: e.name IN ('pre', 'code', 'svg', 'button') OR contains(e.tag, 'role="button"') OR contains(e.tag, 'contenteditable'))) = 0 AS free FROM counted JOIN texts ON counted.page_id = texts.page_id AND counted.pos = texts.i)"""


def _list_sql(pages: str) -> str:
    return f"""
WITH RECURSIVE {sql_walk(pages)}, lists AS (SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS list_no FROM found WHERE name IN ('ul', 'ol')),
items AS (SELECT page_id, parent AS pos, count(*) AS items, count(*) FILTER (WHERE dir = 'rtl') AS rtl_items FROM found WHERE name = 'li' AND free AND parent_name IN ('ul', 'ol') GROUP BY ALL)
SELECT page_id, list_no, items, rtl_items, CASE WHEN 2 * rtl_items >= items THEN 'rtl' END AS dir FROM items JOIN lists USING (page_id, pos)"""


@query(_list_sql("pages"))
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of each list of each page, by its own items."""
    return web.page_lists(read(spark, sf_dir, "pages"))


_RTL_LISTS = "replace(html, '</article>', CASE WHEN page_id % 2 = 0 THEN '<ol><li>سلام</li><li>دنیا خوب<ul><li>abc</li><li>defg<p>in</p> سلام دنیا خوب</li></ul>abc</li><li>latin <pre><code>x</code> سلام</pre></li></ol></article>' ELSE '<ul><li>ab</li></ul><div contenteditable=\"true\"><ul><li>سلام</li></ul></div></article>' END)"


@query(_list_sql(f"(SELECT page_id, {_RTL_LISTS} AS html FROM pages)").replace('\\"', '"'))
def page_lists_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of lists, some with items from right to left, lists, blocks and code inside."""
    return web.page_lists(read(spark, sf_dir, "pages").select("page_id", F.expr(_RTL_LISTS).alias("html")))


_MIXED_BLOCK = "CASE p_partkey % 3 WHEN 0 THEN 'سلام دنیا ' || p_name WHEN 1 THEN 'سلام دنیا خوب است ' || left(p_name, 4) ELSE p_name END"


@query(f"""SELECT doc_id, CASE WHEN r = 0 THEN NULL WHEN r >= 0.4 * (r + l) THEN 'rtl' ELSE 'ltr' END AS dir FROM (SELECT doc_id, len(regexp_extract_all(text, '[{web.RTL_LETTERS}]')) AS r, len(regexp_extract_all(text, '[{web.LTR_LETTERS}]')) AS l FROM (SELECT p_partkey AS doc_id, {_MIXED_BLOCK} AS text FROM part))""")
def share_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions by the share of letters."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), web.classify(F.expr(_MIXED_BLOCK)).alias("dir"))


@query("""
WITH RECURSIVE numbered AS (SELECT event_id, user_id, trim(event_type) AS text, event_id % 3 <> 0 AS visible, event_id % 2 <> 0 AS pinned, value >= 5 AS selected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT user_id, 0 AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS action, '' AS shown FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN update THEN 'update' ELSE 'dismiss' END, CASE WHEN update THEN text ELSE shown END
  FROM (SELECT e.*, shown, NOT visible OR (pinned AND selected AND text <> shown) AS update FROM walk JOIN numbered AS e ON walk.user_id = e.user_id AND e.n = walk.n + 1) AS e)
SELECT event_id, action FROM walk WHERE n > 0""")
def trigger_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event does to the window of its user, which keeps what it shows until an event updates it."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("text"), (F.col("event_id") % 3 != 0).alias("visible"), (F.col("event_id") % 2 != 0).alias("pinned"), (F.col("value") >= 5).alias("selected"))
    told = with_last_text(rows, "user_id", "at", "visible", "pinned", "selected", chunk=F.date_trunc("month", "ts"))
    return told.select("event_id", trigger_action("visible", "pinned", "selected", F.concat(F.lit(" "), "text"), "last_text").alias("action"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND t <> '' THEN 'selection' WHEN event_id % 3 = 0 AND t <> '' THEN 'clipboardFallback' ELSE 'empty' END AS source FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS t FROM events)")
def capture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each capture came from."""
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("t"), (F.col("event_id") % 2 == 0).alias("c"), (F.col("event_id") % 3 == 0).alias("f"))
    return rows.select("event_id", capture_source("t", "c", "f").alias("source"))


@query("""SELECT c_custkey AS doc_id, '{"lines":[{"lead":"- ","tail":"","boxed":false,"code":false,"dir":"ltr","segments":[{"kind":"text","text":"' || c_name || ' "},{"kind":"code","text":"a.py"}]}],"source":"selection","diffMode":false}' AS out FROM customer""")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items as JSON documents."""
    text = F.concat(F.lit("- "), "c_name", F.lit(" a.py"))
    return analyse(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).json()
