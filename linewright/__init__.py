"""Structuring of text captures as Spark relations: lines, tokens, directions, tables, serialisations."""
