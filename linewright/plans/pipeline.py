"""The whole analysis of captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import render, tables
from ..operators.lines import analysed_lines
from ..operators.unwrap import soft_unwrap
from ..options import Options
from ..storage import stored


@dataclass(frozen=True)
class Analysis:
    """The relations of analysed captures, as stored tables."""

    lines: DataFrame
    tables: DataFrame
    cells: DataFrame
    options: Options

    def copied(self, mode: str = "plain") -> DataFrame:
        """Rows (doc_id, out) in mode plain, markdown or bidi."""
        strip = self.options.strip_backticks
        return render.assemble(self.lines, render.copy_lines(self.lines, mode, strip), render.copy_tables(self.tables, self.cells, mode, strip))

    def html(self) -> DataFrame:
        strip = self.options.strip_backticks
        body = render.assemble(self.lines, render.html_lines(self.lines, strip), render.html_tables(self.tables, self.cells, strip))
        return body.select("doc_id", F.concat(F.lit('<div class="rtl-doc">'), "out", F.lit("</div>")).alias("out"))

    def json(self, sources: DataFrame | None = None) -> DataFrame:
        return render.json_documents(self.lines, self.cells, self.tables, sources, self.options.strip_backticks)

    def documents(self) -> DataFrame:
        """Rows (doc_id, diff_mode, doc_dir)."""
        return self.lines.groupBy("doc_id").agg(F.first("diff").alias("diff_mode"), F.first("doc_dir").alias("doc_dir"))


def analyse(captures: DataFrame, options: Options = Options()) -> Analysis:
    """`captures` (doc_id, text): clean, fold letters, split, find direction, recover tables, join wrapped lines.

    The direction of lines is found before tables and wrapping, on lines as they came; documents that are diffs have neither tables nor
    joined lines. A null text has no lines, an empty one has an empty line. Ids must be unique.
    """
    raw = stored(analysed_lines(captures.select("doc_id", "text"), options), "lines")
    found, cells = tables.recover(raw)
    directed = stored(tables.directed_cells(cells, raw.groupBy("doc_id").agg(F.first("doc_dir").alias("doc_dir"))), "cells")
    lines = tables.fold(raw, found, cells)
    if options.soft_unwrap:
        lines = soft_unwrap(lines)
    return Analysis(stored(lines, "folded"), found, directed, options)
