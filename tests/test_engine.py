"""Hand-derived expectations of the text-structuring operators."""

import random

import pytest
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.operators import web
from linewright.operators.lines import analysed_lines, is_diff
from linewright.options import Options
from linewright.plans.pipeline import analyse
from linewright.sources.captures import capture_source
from linewright.streaming.captures import trigger_action

FA = "سلام دنیا"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("\x1b[31mred\x1b[0m", "red"),
        ("10%\r100", "100"),
        ("abcdef\rxy", "xycdef"),
        ("ab\bc", "ac"),
        ("a\tb", "a   b"),
        ("\x1b]8;;http://x\x07label\x1b]8;;\x07", "label"),
        ("a\r\nb", "a\nb"),
        ("   \nx", "\nx"),
        ("a‏b‌", "ab‌"),
        ("", ""),
    ],
)
def test_clean(spark, raw, shown):
    assert one(spark, raw, T.clean("x")) == shown


def replayed(line):
    shown, at = [], 0
    for ch in line:
        if ch == "\r":
            at = 0
        elif ch == "\b":
            at = max(at - 1, 0)
        else:
            shown[at : at + 1] = [ch]
            at += 1
    return "".join(shown)


def test_cursor_replay_is_that_of_a_walk(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abé🙂\b\b\r") for _ in range(rng.randrange(30))) for _ in range(3000)] + ["x" * 1_000_000 + "\b\by", "|\b/\b-\b" * 100_000]
    got = spark.createDataFrame(enumerate(lines), "i long, x string").select("i", T.replay_cursor(F.col("x")).alias("y")).collect()
    assert [r["i"] for r in got if r["y"] != replayed(lines[r["i"]])] == []


def test_fold_persian(spark):
    assert one(spark, "يكى ﻻ 12", T.fold_persian("x")) == "یکی لا 12"


@pytest.mark.parametrize(
    ("content", "tokens"),
    [
        ("see main.rs.", ["main.rs"]),
        ("john.doe@example.com", ["john.doe"]),
        ("ops@host7.x", ["ops@host7.x"]),
        ("e-mail and 2024-01-01", []),
        ("run --save-dev now", ["--save-dev"]),
        ("took 3.1s", ["3.1"]),
        ("defaced abc1234", ["abc1234"]),
        ("[a] and [b]", ["[a] and [b]"]),
        ("(tile::draw()) x", ["tile::draw()"]),
        ("set MAX_RETRIES=5, ok", ["MAX_RETRIES=5"]),
        ("`x y` z", ["`x y`"]),
        ("فایل /usr/bin/x و", ["/usr/bin/x"]),
        ("plain words only.", []),
    ],
)
def test_tokens(spark, content, tokens):
    assert one(spark, content, T.code_tokens(T.marked("x"))) == tokens


def test_segments_are_lossless(spark):
    text = "Open `a b`, then src/x.py: it's 3.1s (see README.md)."
    parts = one(spark, text, T.segments(T.marked("x"), strip_backticks=False))
    assert "".join(p["text"] for p in parts) == text
    assert [p["text"] for p in parts if p["kind"] == "code"] == ["`a b`", "src/x.py", "3.1", "README.md"]


@pytest.mark.parametrize(
    ("line", "lead", "content", "tail", "boxed"),
    [
        ("│ hi │", "│ ", "hi", " │", True),
        ("- item", "- ", "item", "", False),
        ("12) x", "12) ", "x", "", False),
        ("-x", "", "-x", "", False),
        (">>x", ">", ">x", "", False),
        ("text │", "", "text │", "", False),
        ("╭────╮", "╭────╮", "", "", False),
    ],
)
def test_gutter(spark, line, lead, content, tail, boxed):
    assert tuple(one(spark, line, T.gutter("x"))) == (lead, content, tail, boxed)


def test_runs(spark):
    assert one(spark, "abc1def a_b", T.runs("x", "ltr")) == 3
    assert one(spark, FA, T.runs("x", "rtl")) == 2
    assert one(spark, "漢字 abc", T.runs("x", "ltr")) == 2


def test_fences_and_directions(spark):
    text = f"{FA}\n```\ncode {FA}\n```\nEnglish words here"
    rows = analysed_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()
    assert [r["code"] for r in rows] == [False, True, True, True, False]
    assert [r["dir"] for r in rows] == ["rtl", "ltr", "ltr", "ltr", "ltr"]


@pytest.mark.parametrize(("text", "diff"), [("diff --git a b", True), ("@@ -1 +1\n+++ b", True), ("@@ -1", False), ("--- a\n+++ b", False)])
def test_diff(spark, text, diff):
    assert one(spark, text, is_diff("x")) is diff


SPACED = "name    size  note\nalpha   10    first\nbeta    200   second one\n              and more"
FRAMED = "┌──────┬─────┐\n│ a    │ b   │\n├──────┼─────┤\n│ x    │ 1   │\n│ y    │ 2   │\n└──────┴─────┘"


def cells_of(analysis):
    return [(r["row_no"], r["col_no"], r["text"]) for r in analysis.cells.orderBy("row_no", "col_no").collect()]


def test_spaced_table(spark):
    out = analyse(spark.createDataFrame([(1, SPACED)], "doc_id long, text string"))
    assert [c[2] for c in cells_of(out)] == ["name", "size", "note", "alpha", "10", "first", "beta", "200", "second one and more"]
    table = out.tables.first()
    assert (table["columns"], table["sep"], table["framed"]) == (3, "spaced", False)
    assert out.copied("plain").first()["out"].split("\n")[0] == "name   size  note"


def test_framed_table(spark):
    out = analyse(spark.createDataFrame([(1, f"Before\n\n{FRAMED}\n\nAfter")], "doc_id long, text string"))
    assert [c[2] for c in cells_of(out)] == ["a", "b", "x", "1", "y", "2"]
    table = out.tables.first()
    assert (table["delim"], table["framed"], table["columns"]) == ("│", True, 2)
    assert out.copied("plain").first()["out"] == "Before\n\n┌───┬───┐\n│ a │ b │\n├───┼───┤\n│ x │ 1 │\n│ y │ 2 │\n└───┴───┘\n\nAfter"
    assert out.copied("markdown").first()["out"].split("\n")[2:4] == ["| a | b |", "| --- | --- |"]
    assert 'style="--rtl-cols:2"' in out.html().first()["out"]
    assert '"delim":"│"' in out.json().first()["out"]


@pytest.mark.parametrize("text", ["just prose\nand more prose", "one  row", "a\n\n  b", "wide    gap here\nno gap"])
def test_not_a_table(spark, text):
    assert analyse(spark.createDataFrame([(1, text)], "doc_id long, text string")).tables.isEmpty()


def test_unwrap(spark):
    a, b, c = "w" * 30 + " " + "x" * 30, "y" * 58, "tail."
    text = f"{a}\n{b}\n{c}\n\n- one\n- two"
    out = analyse(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r["content"] for r in out.lines.orderBy("line_no").collect()] == [f"{a} {b} {c}", "", "one", "two"]
    kept = analyse(spark.createDataFrame([(1, text)], "doc_id long, text string"), Options(soft_unwrap=False))
    assert kept.lines.count() == 6


def test_copies_of_boxes(spark):
    text = f"╭──────╮\n│ {FA} │\n│ run x.py │\n╰──────╯"
    out = analyse(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    safe = out.copied("bidi").first()["out"]
    stripped = "".join(ch for ch in safe if ch not in "⁦⁧⁩")
    assert stripped == out.copied("plain").first()["out"]
    assert "⁧" in safe


def test_html_of_a_line(spark):
    out = analyse(spark.createDataFrame([(1, "- a <b> x.py")], "doc_id long, text string"))
    assert out.html().first()["out"] == '<div class="rtl-doc"><div class="rtl-line"><span class="rtl-gutter">- </span><span class="rtl-content" dir="ltr">a &lt;b&gt; <span class="rtl-code" dir="ltr">x.py</span></span></div></div>'


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")
    rows = {(r["doc_id"], r["line_no"], r["content"]) for r in analyse(docs).lines.collect()}
    assert rows == {(2, 0, ""), (3, 0, "")}
    assert analyse(docs.limit(0)).copied().count() == 0


def test_classify(spark):
    assert one(spark, "hello", web.classify("x")) is None
    assert one(spark, FA, web.classify("x")) == "rtl"
    assert one(spark, "many latin letters here ا", web.classify("x")) == "ltr"


def test_trigger_and_source(spark):
    rows = spark.createDataFrame([(False, False, True, "a", "a"), (True, False, True, "b", "a"), (True, True, True, " a", "a "), (True, True, True, "b", "a"), (True, True, False, "b", "a")], "v boolean, p boolean, h boolean, n string, l string")
    assert [r[0] for r in rows.select(trigger_action("v", "p", "h", "n", "l")).collect()] == ["update", "dismiss", "dismiss", "update", "dismiss"]
    rows = spark.createDataFrame([("t", True, False), ("t", False, True), ("t", False, False), ("", True, True)], "t string, c boolean, f boolean")
    assert [r[0] for r in rows.select(capture_source("t", "c", "f")).collect()] == ["selection", "clipboardFallback", "empty", "empty"]


def test_file_stream(spark, tmp_path):
    from linewright.sources.captures import read_captures, stream_captures
    from linewright.streaming.captures import analyse_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x.py\nnext")
    assert read_captures(spark, str(folder)).count() == 1
    seen = []
    query = analyse_stream(stream_captures(spark, str(folder)), lambda out, n: seen.append(out.lines.count()), str(tmp_path / "cp"), every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert seen == [2]


def test_width(spark):
    assert one(spark, "ab漢字", F.expr("0") + T.width("x")) == 6
    assert one(spark, "á‌b", T.width("x")) == 2
