"""Column expressions: character classes, cleaning, tokens, direction, widths."""
