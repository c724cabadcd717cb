"""Captures in, one text of each out, as a caller of the batch job asks."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.render import html_page
from ..options import Options
from ..sources.captures import read_captures
from .pipeline import analyse

OUTPUTS = ("html", "json", "text", "fragment", "copy")
#: The names of the ways to copy.
COPIES = {"plain": "plain", "markdown": "markdown", "bidi-safe": "bidi"}


def dump(captures: DataFrame, output: str = "html", copy: str = "plain", title: str = "", css: str = "", options: Options = Options()) -> DataFrame:
    """Rows (doc_id, out) of captures (doc_id, text): a page, JSON, plain text, an HTML fragment or copied text; an unknown way to copy is plain, an unknown output an error."""
    if output not in OUTPUTS:
        raise ValueError(f"unknown output {output}")
    found = analyse(captures, options)
    if output == "json":
        return found.json()
    if output in ("text", "copy"):
        return found.copied("plain" if output == "text" else COPIES.get(copy, "plain"))
    return found.html() if output == "fragment" else html_page(found.html(), title, css)


def parsed(arguments: Sequence[str]) -> argparse.Namespace:
    """The arguments of the batch job; an unknown one ends it with status 2."""
    parser = argparse.ArgumentParser(prog="linewright", allow_abbrev=False)
    parser.add_argument("source", help="a folder or files of texts")
    parser.add_argument("target", help="a folder for the results")
    for name in OUTPUTS[:-1]:
        parser.add_argument(f"--{name}", dest="output", action="store_const", const=name, default="html")
    parser.add_argument("--copy", nargs="?", const="plain")
    parser.add_argument("--title", default="")
    parser.add_argument("--name", help="a substring of the files' names")
    for flag, option in (("--no-unwrap", "soft_unwrap"), ("--no-normalize", "normalize_persian"), ("--keep-backticks", "strip_backticks")):
        parser.add_argument(flag, dest=option, action="store_false")
    return parser.parse_args(arguments)


def main(arguments: Sequence[str] = sys.argv[1:]) -> None:
    """Read captures, analyse them and write a Parquet table (path, out)."""
    asked = parsed(arguments)
    options = Options(soft_unwrap=asked.soft_unwrap, normalize_persian=asked.normalize_persian, strip_backticks=asked.strip_backticks)
    captures = read_captures(SparkSession.builder.getOrCreate(), asked.source, asked.name)
    out = dump(captures, "copy" if asked.copy is not None else asked.output, asked.copy or "plain", asked.title, options=options)
    captures.select("doc_id", "path").join(out, "doc_id").select("path", "out").write.mode("overwrite").parquet(asked.target)
