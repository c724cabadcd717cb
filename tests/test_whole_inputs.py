"""Queries read whole inputs: fences on later lines, lists apart from each other, tables whose number grows; none of it is broadcast."""

import duckdb

import __spark_entry__ as entry_points
from linewright.operators import tables
from linewright.plans import pipeline
from linewright.storage import stored


def test_fences_on_later_lines_and_past_30_characters(spark, tmp_path):
    rows = [(1, 2, "user", "see\n" + "x" * 40 + "\n```\ncode\n```\nend")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry_points.queries()["fence_scan_lines"](spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], len(r["line"]), r["code"]) for r in got] == [(0, 3, False), (1, 40, False), (2, 3, True), (3, 4, True), (4, 3, True), (5, 3, False)]


def test_number_of_tables_grows_with_the_input(spark):
    shapes = entry_points.queries()["table_shapes_customers"](spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert shapes.count() == 2 * customers.selectExpr("c_custkey div 8").distinct().count() > 10


def test_each_list_has_its_own_direction(spark, tmp_path):
    html = "<ul><li>one</li><li>two</li><li>three<ol><li>سلام</li></ol></li><li>four</li></ul><p>x</p><ul><li>سلام دنیا</li><li>خوب</li></ul>"
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(path)
    got = sorted(tuple(r) for r in entry_points.queries()["page_lists"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 4, 1, None), (1, 1, 1, 1, "rtl"), (1, 2, 2, 2, "rtl")]  # the third item has its inner list's text too
    theirs = duckdb.sql(entry_points.oracle_sql()["page_lists"].replace("FROM pages", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(theirs) == got


def test_no_relation_of_an_analysis_is_broadcast(spark, monkeypatch):
    """Stored relations are small as files only: the lines of tables, once exploded, are as many as those of the captures."""
    plans = {}

    def planned(frame, label):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return stored(frame, label)

    for module in (tables, pipeline):
        monkeypatch.setattr(module, "stored", planned)
    text = "name    size\n────    ────\none      1\ntwo      2\n\n│ a │ b │\n│ c │ d │"
    out = pipeline.analyse(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string"))
    drawn = {"copied": out.copied(), "html": out.html(), "json": out.json(spark.createDataFrame([(0, "file")], "doc_id long, source string"))}
    for name, frame in drawn.items():
        assert len(frame.collect()) == 3
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
    assert {"folded", "cells", "rows", "tables", "slices", *drawn} <= set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
