"""Columns of sequences that are one glyph."""

import pytest

from linewright.functions import text as T
from linewright.operators.lines import analysed_lines
from linewright.operators.render import copy_lines

WIDTHS = {
    "": 0,
    "abc": 3,
    "سلام": 3,
    "سلام دنیا": 8,
    "لا": 1,
    "لآ لأ لإ لٱ": 7,
    "ڵا": 1,
    "لَا": 1,
    "ل\u200dا": 2,
    "ل\u200cا": 2,
    "الله": 4,
    "کالا and لا": 9,
    "漢字": 4,
    "❤": 1,
    "❤\ufe0f": 2,
    "❤\ufe0f\u200d🔥": 2,
    "👍": 2,
    "👍🏽": 2,
    "☝🏽": 2,
    "👩\u200d🔬": 2,
    "👩🏽\u200d⚕\ufe0f": 2,
    "👨\u200d👩\u200d👧\u200d👦!": 3,
    "👍👍": 4,
    "1\ufe0f\u20e3": 2,
    "🇫🇷": 2,
    "⌚": 2,
    "⌚\ufe0e": 1,
    "e\u0301": 1,
}


def test_widths(spark):
    frame = spark.createDataFrame([(x,) for x in WIDTHS], "x string").select("x", T.width("x").alias("w"))
    assert {r["x"]: r["w"] for r in frame.collect()} == WIDTHS


def test_boxes_with_sequences_are_square(spark):
    text = "\n".join(f"│ {x} │" for x in ("سلام دنیا", "a.py", "👩\u200d🔬 ok", "کالا لا", "plain words"))
    lines = copy_lines(analysed_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    found = lines.select(T.width("out").alias("w")).distinct().collect()
    assert len(found) == 1


@pytest.mark.parametrize("n", [1, 100_000])
def test_long_sequences(spark, n):
    texts = {"لا" * n: n, "👩\u200d" * n + "👩": 2, "ل" + "\u064e" * n + "ا": 1}
    frame = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.width("x").alias("w"))
    assert {r["x"]: r["w"] for r in frame.collect()} == texts
