"""Columns of tables against a walk over display cells: wide characters, marks without width, delimiters, rules."""

import random
import unicodedata

from pyspark.sql import functions as F

from linewright.operators import tables

DELIMITERS = "│┃║|"
PIECES = ["ab", "سلام", "漢字", "é", "می‌شود", "　", " ", "  ", "   ", "|", "│", " | ", "x", "‍", "تست  "]


def columns(line):
    """[(text, has ink)] for each display column; marks go before what follows them."""
    out, held = [], ""
    for ch in line:
        if unicodedata.category(ch) in ("Mn", "Me", "Cf", "Cc"):
            held += ch
            continue
        seen = not ch.isspace()
        out += [(held + ch, seen)] + ([("", seen)] if unicodedata.east_asian_width(ch) in "WF" else [])
        held = ""
    return out, held


def bounds(content, rules):
    """The ranges of a block as a walk over its columns finds them, or None."""
    lines = [columns(x)[0] for x in content]
    width = max(map(len, lines))
    shared = [(sum(d in x for x in content), k, d) for k, d in enumerate(DELIMITERS) if sum(d in x for x in content) >= 2]
    delim = max(shared)[2] if shared else None
    inked = [[c < len(line) and line[c][1] and not (delim and line[c][0].endswith(delim)) for c in range(width)] for line in lines]
    ink = [any(row[c] for row in inked) for c in range(width)]
    if delim:
        cuts = [c for c in range(width) if not ink[c] and sum(c < len(x) and x[c][0].endswith(delim) for x in lines) >= 2]
        return [(s, e) for s, e in zip([0, *(c + 1 for c in cuts)], [*cuts, max(width, cuts[-1] + 1)], strict=True)] if cuts else None

    def empty(flags):
        edges = [c for c in range(len(flags) + 1) if (c == len(flags) or flags[c]) != (c == 0 or flags[c - 1])]
        return list(zip(edges[::2], edges[1::2], strict=True))

    breaks = [(s, e) for r in rules for s, e in empty([x[1] for x in columns(r)[0]]) if s > 0 and e < len(columns(r)[0]) and e - s >= 2]
    found = [(s, e) for s, e in empty(ink) if e - s >= 2 or any(s <= re + 2 and e + 2 >= rs for rs, re in breaks)]
    if not found:
        return None
    return [(s, e) for s, e in zip([0, *(e for _, e in found)], [*(s for s, _ in found), width], strict=True) if s < e]


def test_grid_and_ink(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(300)] + ["", "́", "á"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", tables.grid("t").alias("g"), tables.ink("t").alias("k")).collect()
    for r in got:
        cells, rest = columns(lines[r["i"]])
        assert r["k"] == "".join("01"[seen] for _, seen in cells)
        assert r["g"] == [text for text, _ in cells] + ([rest] if rest else []) or lines[r["i"]] == ""


def test_ranges_are_those_of_a_walk(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for block in range(250):
        kinds = rng.sample(PIECES, 6)
        content = ["".join(rng.choices(kinds, k=rng.randint(2, 8))) + "x" * (rng.random() < 0.1) * 130 for _ in range(rng.randint(2, 4))]
        rules = ["".join(rng.choices(["---", "  ", " ", "=="], k=rng.randint(2, 6))) + "-" for _ in range(rng.randint(0, 2))]
        shared = [(sum(d in x for x in content), k, d) for k, d in enumerate(DELIMITERS) if sum(d in x for x in content) >= 2]
        delim = max(shared)[2] if shared else None
        rows += [(block, 0, n, text, n >= len(content), delim) for n, text in enumerate(content + rules)]
        expected[block] = bounds(content, rules)
    frame = spark.createDataFrame(rows, "doc_id long, block long, line_no int, painted string, rule boolean, delim string")
    got = {r["doc_id"]: [tuple(x) for x in r["ranges"]] for r in tables.column_ranges(frame).collect()}
    assert {b: got.get(b) or None for b in expected} == {b: r or None for b, r in expected.items()}


def test_shared_delimiter_and_a_wide_block(spark):
    long = "a" * 100_000
    lines = [(1, 0, "a │ b | c"), (1, 1, "d │ e | f"), (1, 2, "g | h"), (2, 0, f"{long}  b"), (2, 1, f"{long}  c")]
    frame = spark.createDataFrame(lines, "doc_id long, line_no int, content string").withColumns({"lead": F.lit(""), "code": F.lit(False), "diff": F.lit(False)})
    candidates = tables.candidate_lines(frame)
    assert {(r["doc_id"], r["delim"]) for r in candidates.collect()} == {(1, "|"), (2, None)}
    assert [tuple(x) for x in tables.column_ranges(candidates).where("doc_id = 2").first()["ranges"]] == [(0, 100_000), (100_002, 100_003)]
