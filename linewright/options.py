"""What a caller can ask of the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    normalize_persian: bool = True
    soft_unwrap: bool = True
    strip_backticks: bool = True
    tab_width: int = 4


CAPTURE_SOURCES = ("selection", "clipboardFallback", "empty")
