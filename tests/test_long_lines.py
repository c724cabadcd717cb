"""Token marks against a walk in Python, and lines of a million characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.functions.chars import WS
from linewright.operators import tables, web
from linewright.operators.lines import unwelded
from linewright.plans.pipeline import analyse


def python_pattern(java):
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", java), re.S)


PIECES = python_pattern(f"{T.TOKEN}|.")
BOUND = python_pattern(f"[{WS}{T.BEFORE}]")
OPENERS = {")": "(", "]": "[", "}": "{"}


def trimmed(tile):
    while tile and (tile[-1] in T.AFTER or (tile[-1] in OPENERS and tile.count(tile[-1]) > tile.count(OPENERS[tile[-1]]))):
        tile = tile[:-1]
    return tile


def marked(text):
    out, last = [], None
    for m in PIECES.finditer(text):
        tile = m[0]
        cut = trimmed(tile) if len(tile) > 1 and (last is None or BOUND.match(last)) else ""
        out.append(f"{T.OPEN}{cut}{T.CLOSE}{tile[len(cut):]}" if len(cut) > 1 and not re.fullmatch("[a-f]+", cut) else tile)
        last = tile[-1]
    return "".join(out)


def test_marks_are_those_of_a_walk(spark):
    rng = random.Random(7)
    parts = [" ", " ", ".", "..", "/", "-", "--", "_", "__", "::", "->", "(", ")", "()", "]", "[", "=", "@", "`", ":", ":\\", "http://", "~/", "é", "ß", "سلام", "a", "b", "word", "Q", "x1", "12", "3", "deadbeef9", "0123456", "facade", ",", "!", "؟", "»", "'", "\"", "|", "\u00a0", "%", "+", "漢"]
    texts = list({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(20000)})
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.marked("x").alias("m")).collect()
    assert [(r["x"], r["m"], marked(r["x"])) for r in got if r["m"] != marked(r["x"])] == []


def test_marks_behind_runs_of_any_length(spark):
    units = [".", "%", "-", "_", "+", "@", "a", "9", "z", "a-_", "w.", "x7%", "q@", "é"]
    ends = ["name=foo.bar", "name()=foo.bar x.py", "=foo.bar", "a::b=c.d", "->b.c", "/x/y=foo.bar", "http://x.y z.w", "C:\\x y.z", "(x.py)", "()=x.py", "1.2-abc=foo.bar", "x@b.name=foo.bar", "-x=foo.bar p.q", " x.py", "é=foo.bar", "aaaaaaac:\\x"]
    texts = [u * n + e for u in units for n in (1, 9, 199, 200, 260) for e in ends]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.marked("x").alias("m")).collect()
    assert [(r["x"], r["m"]) for r in got if r["m"] != marked(r["x"])] == []


def test_marks_behind_runs_of_several_kinds(spark):
    """Units of tokens, parts of tokens and other characters, repeated; what stands behind them takes text of them or does not."""
    rng = random.Random(11)
    parts = [".", "..", "/", "-", "--", "_", "__", "::", "->", "()", "@", "é", "a", "b", "v1", "Q", "x1", "1", "12", "3", "deadbeef9", "0123456", "%", "+", "a.b", "a-b", "1.2", "_a", "b_", "x@y.z", "a1a1a1a1", "9a", "x_y"]
    ends = ["", "=", "=x.y", "::b.c", "->q", "()=z", "(x.py)", " x.py", "://a b.c", ":\\x y.z", "http://a b.c"]
    texts = list({rng.choice(["", " ", *parts]) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) * rng.randrange(1, 9) + rng.choice(parts) + rng.choice(ends) for _ in range(20000)})
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.marked("x").alias("m")).collect()
    assert [(r["x"], r["m"], marked(r["x"])) for r in got if r["m"] != marked(r["x"])] == []


@pytest.mark.parametrize("unit", ["+@", "a-_", "a-_b-c_", "a1", "1a", "a.b%", "a.b@", "é", "a@b.c-", "-x_b_c"])
@pytest.mark.parametrize("end", ["name=foo.bar", "", "://x y.z"])
def test_runs_that_something_follows_take_few_tiles(spark, unit, end):
    """A tile for each character, or a look at the whole run for each, would take time that grows with the square of the run."""
    text = unit * (20_000 // len(unit)) + end
    made = spark.createDataFrame([(text,)], "x string").select(F.size(T.tiles("x")).alias("n"), F.array_join(T.tiles("x"), "").alias("whole")).collect()[0]
    assert made["whole"] == text and made["n"] < 12


N = 1_000_000
LONG = {
    "rule glyphs": "─" * N,
    "hyphens": "-" * N,
    "spaces": "a" + " " * N + "b",
    "leading spaces": " " * N + "b",
    "dotted": "a." * (N // 2) + "a",
    "snake": "a_" * (N // 2) + "a",
    "underscores": "_" * N,
    "dots": "." * N,
    "dots and a key": "." * N + "name=foo.bar",
    "letters and a call": "q" * N + "()=x",
    "percent signs and a colon": "a%" * (N // 2) + ":",
    "letters and digits": "a1" * (N // 2),
    "accented": "é" * N + "1",
    "kebab": "a-" * (N // 2) + "a",
    "closers": "x.y" + ")" * N,
    "markers": "1. " * (N // 3) + "x",
    "quotes": ">" * N + " x",
    "spaced rule": "text" + " " * 20 + "─ " * (N // 2),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_lines_of_a_million_characters(spark, name):
    frame = spark.createDataFrame([(1, LONG[name])], "doc_id long, x string").repartition(2)
    made = frame.select(T.is_rule("x").alias("rule"), T.gutter("x").alias("g"), T.marked("x").alias("m"), unwelded(F.col("x")).alias("u"), T.ends_sentence("x").alias("e"), T.runs("x", "ltr").alias("r")).collect()[0]
    assert made["g"]["lead"] + made["g"]["content"] + made["g"]["tail"] == LONG[name].rstrip() or name in ("rule glyphs",)
    assert T.OPEN not in made["m"] or made["m"].replace(T.OPEN, "").replace(T.CLOSE, "") == LONG[name]
    assert made["rule"] == (name in ("rule glyphs", "hyphens", "underscores"))
    assert len(made["u"]) == (2 if name == "spaced rule" else 1)


def test_a_block_with_many_inline_tags(spark):
    html = "<p>" + "<b>x</b> " * 100_000 + "</p><p>next</p>"
    blocks = web.page_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(b["tag"], len(b["text"])) for b in blocks] == [("p", 200_000), ("p", 4)]


def test_whole_analysis_of_long_lines(spark):
    text = "\n".join(["─" * 50_000, "a" + " " * 50_000 + "b", "a.a." * 20_000, "x" * 100_000])
    out = analyse(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert out.lines.count() >= 1 and tables.candidate_lines(out.lines.withColumn("marked", F.lit(""))) is not None
