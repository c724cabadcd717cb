"""Escape sequences against a walk through the states of a terminal's parser."""

import random

import pytest

from linewright.functions import text as T


def walked(text):
    """What the parser prints, and the line feeds that it executes, character by character."""
    state, out = "ground", []
    for ch in text:
        if ch == "\x1b":
            state = "escape"
        elif ch in "\x18\x1a":
            state = "ground"
        elif state == "ground":
            out.append(ch if ch >= " " or ch in "\n\r\t\b" else "")
        elif state == "osc":
            state = "ground" if ch == "\x07" else state
        elif state == "string":
            pass
        elif ch == "\n":
            out.append(ch)
        elif not " " <= ch <= "~":
            pass
        elif state == "escape":
            state = {"[": "csi", "]": "osc", "P": "string", "X": "string", "^": "string", "_": "string"}.get(ch, "intermediate" if ch < "0" else "ground")
        elif state == "csi":
            state = "ground" if ch >= "@" else state
        else:
            state = "ground" if ch >= "0" else state
    return "".join(out).replace("\x7f", "").replace("\r\n", "\n")


def stripped(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return [r["t"] for r in frame.select("k", T.strip_escapes("text").alias("t")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("a\x1b[1;31mb\x1b[0mc", "abc"),
        ("\x1b]8;;http://x\x1b\\label\x1b]8;;\x07.", "label."),
        ("a\x1b]0;title\x1b[31mb", "ab"),
        ("a\x1bPq\x1b[31mb\x1b\\c", "abc"),
        ("a\x1b[31\nhello", "a\nello"),
        ("a\x1b\n[31mb", "a\nb"),
        ("a\x1b]x\ny\x18b", "ab"),
        ("a\x1b[3\x1ab\x1b(\x18c", "abc"),
        ("a\x1b\x1b\x1b[mb", "ab"),
        ("a\x1b[4\u00e9\t;mb", "ab"),
        ("a\x1b", "a"),
        ("a\x1b[31", "a"),
        ("a\x1b]never\nends", "a"),
        ("a\x1b[\n\x1b]x\n\x07b", "a\nb"),
        ("", ""),
    ],
)
def test_sequences(spark, raw, expected):
    assert walked(raw) == expected
    assert stripped(spark, [raw]) == [expected]


def test_random_texts_are_those_of_a_walk(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("\x1b\x1b\x1b[]P^_X(# 0;m~a\\\n\n\r\t\x07\x18\x1a\x7f\u00e9\u0633") for _ in range(rng.randrange(40))) for _ in range(4000)]
    assert stripped(spark, texts) == [walked(t) for t in texts]
    assert stripped(spark, [None]) == [None]


def test_long_sequences(spark):
    n = 300_000
    texts = ["\x1b[" + "1;" * n + "mx", "\x1b]" + "a" * n, "\x1b[1\n" * n + "mx", "\x1b[0m" * n + "x", "\x1b" * n + "cx"]
    assert stripped(spark, texts) == ["x", "", "\n" * n + "x", "x", "x"]
