"""Streams with state, the batch job and what pages skip."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from linewright.operators import web
from linewright.plans import batch
from linewright.streaming import captures as streams


def run(frame, mode, path):
    name = "s" + path.replace("/", "_").replace("-", "_")
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).start()
    query.processAllAvailable()
    return query, name


def test_trigger_state_across_batches(spark, tmp_path):
    schema = "user string, event_id long, visible boolean, pinned boolean, selected boolean, text string"
    rows = [("a", 1, False, False, True, "one"), ("a", 2, True, True, True, " one "), ("a", 3, True, True, True, "two"), ("b", 4, True, False, True, "x"), ("b", 5, False, False, False, None)]
    spark.createDataFrame(rows, schema).repartition(1).write.json(f"{tmp_path}/in")
    query, name = run(streams.trigger_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), "user"), "append", f"{tmp_path}/cp")
    spark.createDataFrame([("a", 6, True, True, True, "two"), ("a", 7, True, True, False, "three"), ("b", 8, True, True, True, "")], schema).repartition(1).write.mode("append").json(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    got = [r["action"] for r in spark.table(name).orderBy("event_id").collect()]
    assert got == ["update", "dismiss", "update", "dismiss", "update", "dismiss", "dismiss", "dismiss"]


def test_batch_actions_are_those_of_a_walk(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), k, rng.random() < 0.8, rng.random() < 0.7, rng.random() < 0.8, rng.choice(["one", " one ", "two", "", None])) for k in range(600)]
    shown, expected = {}, {}
    for user, k, visible, pinned, selected, text in rows:
        update = not visible or (pinned and selected and (text or "").strip() != shown.get(user, "").strip())
        expected[k] = "update" if update else "dismiss"
        if update:
            shown[user] = text or ""
    frame = spark.createDataFrame(rows, "user string, event_id long, visible boolean, pinned boolean, selected boolean, text string").withColumn("n", F.col("event_id"))
    for chunk in (None, F.expr("event_id div 37")):
        told = streams.with_last_text(frame, "user", "n", "visible", "pinned", "selected", chunk=chunk)
        got = {r["event_id"]: r["a"] for r in told.select("event_id", streams.trigger_action("visible", "pinned", "selected", F.coalesce("text", F.lit("")), "last_text").alias("a")).collect()}
        assert got == expected


def test_a_dismissed_text_is_not_the_last_one(spark):
    frame = spark.createDataFrame([("u", 1, False, True, True, "A"), ("u", 2, True, False, True, "B"), ("u", 3, True, True, True, "A")], "user string, n long, visible boolean, pinned boolean, selected boolean, text string")
    told = streams.with_last_text(frame, "user", "n", "visible", "pinned", "selected")
    assert [r["a"] for r in told.orderBy("n").select(streams.trigger_action("visible", "pinned", "selected", "text", "last_text").alias("a")).collect()] == ["update", "dismiss", "dismiss"]


def test_latest_text_of_each_document(spark):
    rows = spark.createDataFrame([(1, 5, "zz"), (1, 9, "aa"), (2, 1, None), (3, 2, "b"), (3, 2, "c")], "doc_id long, at long, text string")
    assert sorted(tuple(r) for r in streams.latest(rows, "at").collect()) == [(1, "aa"), (2, None), (3, "c")]
    assert {r["doc_id"]: r["text"] for r in streams.latest(rows).collect()}[1] == "zz"


def test_batch_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("b one.txt", "- `x.py` a"), ("a one.txt", "سلام دنیا"), ("c two.txt", "no"), ("d one.md", "no")):
        (tmp_path / "in" / name).write_text(text)
    from linewright.sources.captures import read_captures

    names = [r["path"].rsplit("/", 1)[1].replace("%20", " ") for r in read_captures(spark, str(tmp_path / "in"), "one").orderBy("path").collect()]
    assert names == ["a one.txt", "b one.txt"]
    batch.main([str(tmp_path / "in"), str(tmp_path / "out"), "--copy", "markdown"])
    assert {r["out"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"- `x.py` a", "سلام دنیا", "no"}
    batch.main([str(tmp_path / "in"), str(tmp_path / "out"), "--title", "T", "--keep-backticks"])
    pages = [r["out"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert all("<title>T</title>" in p for p in pages) and any("`x.py`" in p for p in pages)


def test_arguments(spark):
    asked = batch.parsed(["a", "b", "--json", "--no-unwrap", "--no-normalize"])
    assert (asked.output, asked.soft_unwrap, asked.normalize_persian, asked.strip_backticks) == ("json", False, False, True)
    with pytest.raises(SystemExit) as stopped:
        batch.parsed(["a", "b", "--what"])
    assert stopped.value.code == 2
    docs = spark.createDataFrame([(1, "a.py")], "doc_id long, text string")
    assert batch.dump(docs, "copy", "no such way").first()["out"] == "a.py"
    assert '"kind":"code"' in batch.dump(docs, "json").first()["out"] and batch.dump(docs, "text").first()["out"] == "a.py"
    with pytest.raises(ValueError):
        batch.dump(docs, "pdf")


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def blocks(spark, html):
    return [(b["tag"], b["text"], b["dir"]) for b in web.page_blocks(page(spark, html)).orderBy("block_no").collect()]


def test_what_pages_skip(spark):
    html = '<p>one <code>x</code> two</p><pre><p>no</p></pre><div contenteditable="true"><p>no</p></div><div role="button"><p>no</p></div><div class="a monaco-editor b"><p>no</p></div><svg><p>no</p></svg><p>three<svg/>'
    assert [b[1] for b in blocks(spark, html)] == ["one  two", "three"]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<li>abc<p>in</p> سلام دنیا سلام دنیا</li>", [("li", "abcin سلام دنیا سلام دنیا", "rtl"), ("p", "in", None)]),
        ("<blockquote>a<pre><code>x</code> سلام</pre><p>b</p></blockquote>", [("blockquote", "ab", None), ("p", "b", None)]),
        ("<button><svg></svg>سلام<p>x</p></button><p>q <button>سلام</button></p>", [("p", "q سلام", "rtl")]),
        ('<div data-testid="conversation-row-sidebar" role="button"><b class="a truncate">سلام</b></div><b class="truncate">no</b>', [("b", "سلام", "rtl")]),
        ('<div aria-label="User message"><div data-quotable="true">سلام <code>abcdefgh</code></div></div><div data-quotable="true">no</div>', [("div", "سلام ", "rtl")]),
        ("<p>one<!-- <p> --> <br>two<b>x<p>three</b></p></p>", [("p", "one two" + "x", None), ("p", "three", None)]),
        ("<div><h1>a</div><p>b", [("h1", "a", None), ("p", "b", None)]),
        ("", []),
        ("a < b </p> <", []),
        (None, []),
    ],
)
def test_blocks_have_the_text_of_their_subtree(spark, html, expected):
    assert blocks(spark, html) == expected


def test_lists_and_cards_nest(spark):
    html = "<ul><li>abc<p>in</p> سلام دنیا سلام</li><li>x<ol><li>y<li>سلام</ol>tail</li></ul><li>loose</li><pre><ul><li>سلام</li></ul></pre>"
    assert [tuple(r)[1:] for r in web.page_lists(page(spark, html)).orderBy("list_no").collect()] == [(0, 2, 2, "rtl"), (1, 2, 1, "rtl")]
    html = '<div class="artifact-card"><span>x</span><section class="big artifact-card"><p>سلام</p></section></div><div class="artifact-cards"><p>سلام</p></div><div class="artifact-card"><p>no</p></div>'
    assert [tuple(r)[1:] for r in web.page_cards(page(spark, html)).orderBy("card_no").collect()] == [(0, 2, 1, True), (1, 1, 1, True), (2, 1, 0, False)]
