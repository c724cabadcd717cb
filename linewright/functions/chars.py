"""Character classes as regular-expression fragments that Java and RE2 both read; ranges come from the Unicode database."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

#: Unicode white space, structural glyphs of terminal frames, rule glyphs, frame corners, column delimiters.
WS = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRUCT = r"\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2500}-\x{25FF}\x{2713}-\x{2718}\x{276E}-\x{2771}\x{2022}\x{2023}\x{2043}\x{B7}\x{2027}\x{7C}"
RULES = "─━═╌┄┈╍\\-=_~┌┬┐├┼┤└┴┘╭╮╰╯╞╡╪╔╦╗╠╬╣╚╩╝│┃║|+"
CORNERS = "┌┐└┘╭╮╰╯╔╗╚╝"
DELIMITERS = "│┃║|"
#: Characters that cleaning drops, besides controls.
STRAY = r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{61C}\x{FEFF}"

#: Code points that the quick classes cover: Latin, Arabic, punctuation and symbols.
QUICK = (range(0x250), range(0x600, 0x700), range(0x2000, 0x2C00))


def ranges(members: Iterable[int]) -> str:
    """Ascending code points as a class body."""
    out: list[list[int]] = []
    for c in members:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in out)


def _all(keep: Callable[[str], bool], points: Iterable[int]) -> list[int]:
    return [c for c in points if not 0xD800 <= c < 0xE000 and keep(chr(c))]


@cache
def strong(direction: str, quick: bool = False) -> str:
    """The class body of characters that are strongly of a direction, ltr or rtl; `quick`: those below, of QUICK only."""
    kinds = ("L",) if direction == "ltr" else ("R", "AL")
    points = [c for r in QUICK for c in r] if quick else range(0x110000)
    return ranges(_all(lambda x: unicodedata.bidirectional(x) in kinds, points))


@cache
def quick_text() -> str:
    return "".join(rf"\x{{{r.start:X}}}-\x{{{r.stop - 1:X}}}" for r in QUICK)


@cache
def wide() -> str:
    """Characters two columns wide."""
    return ranges(_all(lambda x: unicodedata.east_asian_width(x) in "WF", range(0x1100, 0x110000)))


@cache
def zero() -> str:
    """Characters without width: controls, combining marks, joiners and other format characters."""
    return ranges(_all(lambda x: unicodedata.category(x) in ("Mn", "Me", "Cf", "Cc") and x != "\u00AD", range(0x110000)))


#: Letters that join as lam and as alef, which together are one glyph.
LAM, ALEF = r"\x{644}\x{6B5}-\x{6B8}\x{76A}\x{8A6}\x{8C7}", r"\x{622}\x{623}\x{625}\x{627}\x{671}-\x{673}\x{675}\x{773}\x{774}\x{870}-\x{882}"
#: Skin tones, and signs other than symbols that can be shown as emoji.
TONES, SIGNS = r"\x{1F3FB}-\x{1F3FF}", r"\x{203C}\x{2049}"


@cache
def marks() -> str:
    """Combining marks without width."""
    return ranges(_all(lambda x: unicodedata.category(x) in ("Mn", "Me"), range(0x110000)))


@cache
def symbols() -> str:
    """What can be shown as emoji; unicodedata does not tell which symbols cannot."""
    return ranges(_all(lambda x: unicodedata.category(x) in ("So", "Sm"), range(0xA0, 0x110000))) + SIGNS


@cache
def presentation_forms() -> tuple[tuple[str, str], ...]:
    """Arabic presentation forms and what they stand for, letters folded."""
    fold = str.maketrans(*FOLDED)
    points = [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD)]
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c)).translate(fold)) for c in points)
    return tuple((a, b) for a, b in pairs if a != b)


#: Arabic letters and the Persian ones they fold to.
FOLDED = ("يىك", "ییک")
