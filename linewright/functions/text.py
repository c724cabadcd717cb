"""Cleaning, token, direction and width expressions over string columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import ALEF, DELIMITERS, FOLDED, LAM, RULES, STRAY, STRUCT, TONES, WS, marks, presentation_forms, quick_text, strong, symbols, wide, zero

#: The kinds of code-like tokens, in order of precedence.
TOKEN_KINDS = (
    r"`[^`\n]+`",
    rf"(?:https?|ftp|file)://[^{WS}]+",
    rf"[A-Za-z]:\\[^{WS}]+",
    r"(?:~|\.{1,2})?/[A-Za-z0-9._@+-]+(?:/[A-Za-z0-9._@+-]*)*",
    r"[A-Za-z0-9._@+-]+(?:/[A-Za-z0-9._@+-]+)+",
    rf"--?[A-Za-z][A-Za-z0-9-]*(?:=[^{WS}]+)?",
    r"[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.|->)[A-Za-z_][A-Za-z0-9_]*)*(?:\(\))?=[A-Za-z0-9._/+-]+",
    r"[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.|->)[A-Za-z_][A-Za-z0-9_]*)+(?:\(\))?",
    r"[A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+)+",
    r"_*[A-Za-z0-9]+(?:_+[A-Za-z0-9]+)+_*",
    r"__[A-Za-z0-9]+__",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9]+",
    r"v?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][A-Za-z0-9.]+)?",
    r"[0-9a-f]{7,40}",
    r"\[[\x21-\x7E][\x20-\x7E]*\]",
)
#: What may stand before a token besides white space, and what is pushed out of its end.
BEFORE = "(\\[{\"'«،,:=|"
AFTER = ".,:;!?،؛؟»"
TOKEN = "|".join(TOKEN_KINDS)
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{620}-\x{64A}"
#: Words of letters that end in white space or with the text hold no token, nor a match that reaches beyond them; taken whole they spare a tile for each letter.
_PLAIN = rf"[{_LETTERS}]++[.,;!?]?(?:[{WS}]++|\z)"
#: The characters of a run. A match that starts inside a run has no boundary before it, so it is no token; it still takes its text, which can reach beyond the run.
_IN_RUN = r"A-Za-z0-9._%+@\-"
#: Where no token starts, the rest of a run holds none; and none of it reaches beyond the run unless one of these follows (a path that does is met again at its slash, and ends alike).
_RUN = rf"[{_LETTERS}{_IN_RUN}]++(?![:(=>])"


def possessive(kind: str) -> str:
    """A token kind with loops that give nothing back, which Java walks without recursion. What follows such a loop cannot start inside it, so matches are the same; the loops of which this is not true stay."""
    stay = {TOKEN_KINDS[11]: 1, TOKEN_KINDS[14]: -1}.get(kind, 0)
    return kind if stay < 0 else re.sub(r"(?<=[\])])[+*]", lambda m: m[0] + "+", kind, count=stay)


def _java_token() -> str:
    kinds = [possessive(k) for k in TOKEN_KINDS]
    kinds[4] = rf"(?<![{_IN_RUN}]){kinds[4]}"  # inside a run it would take what the tiles take without it, at a walk to the run's end for each character
    return "|".join(kinds)


def _skipped() -> str:
    """What is passed at once inside a run that something follows: the tiles up to the next match that may reach beyond the run.

    What failed here fails further on for the same reason, so it is not tried again, or a run of n characters would take n * n steps:
    a name or dotted name in the same word, a dotted name with hyphens up to the next character that is none of its own, an address up
    to the next @. Where the next @ makes an address, it begins where nothing before it in order does, and no match before that @ leaves the run.
    """
    k = [possessive(x) for x in TOKEN_KINDS]
    flag, name, digits, marks = r"--?[A-Za-z][A-Za-z0-9-]*+", r"[A-Za-z_][A-Za-z0-9_]*+", "[0-9]++", r"_(?:_(?=__))*+"
    names, snake = rf"{name}(?:\.{name})++", rf"(?<![A-Za-z0-9]){k[9]}"
    out = rf"(?!{k[1]}|{k[2]}|{flag}=[^{WS}]|{k[6]}|{name}(?:\.{name})*+(?:::|->)[A-Za-z_]|{names}\(\))"
    word = rf"(?=[A-Za-z])(?:{k[13]}|[A-Za-z])(?:(?!{k[1]}|{k[2]})(?:{k[13]}|[A-Za-z0-9]))*+"
    undotted = r"(?![A-Za-z0-9_-]*+\.[A-Za-z0-9_-])"
    rest = rf"{k[10]}|{word}|{k[13]}|{digits}|{marks}|-"
    # Up to a dot that begins no further part of a name; up to the first letter of what has such a dot.
    plain = rf"{undotted}(?:{flag}|{k[9]}|{rest})(?:{out}(?:{flag}|{snake}|{rest}))*+"
    numbers = rf"(?:{flag}|{k[9]}|{k[12]}|{k[13]}|{digits}|-)(?:{out}(?![A-Za-z_])(?:{flag}|{snake}|{k[12]}|{k[13]}|{digits}|-))*+"
    without = rf"(?:{out}(?:{names}|{k[8]}|{plain}|{numbers}|[.%+]))++"
    address = rf"(?={k[11]})(?:{names}|{k[8]}|{undotted}(?:{flag}|{k[9]}|{k[10]})++|{flag}|{k[9]})*+{k[11]}"
    return rf"(?:@|[{_LETTERS}&&[^A-Za-z]]++|{address}|{without})++"


#: Stand around code tokens in marked text; cleaned text has no control characters.
OPEN, CLOSE = "\x01", "\x02"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(x: str | Column, where: str = "both") -> Column:
    """Without Unicode white space at both ends, or at one (left, right)."""
    right = rf"(?<![{WS}])[{WS}]++\z"
    pattern = {"both": rf"^[{WS}]++|{right}", "left": rf"^[{WS}]++", "right": right}[where]
    return F.regexp_replace(_c(x), pattern, "")


def is_blank(x: str | Column) -> Column:
    return _c(x).rlike(rf"^[{WS}]*\z")


#: What an escape sequence passes without leaving its state, after ESC, ESC [, and ESC with an intermediate. CAN, SUB and ESC always leave.
_AFTER_ESC, _AFTER_CSI, _AFTER_INTER = r"\x18\x1A\x1B\x20-\x7E", r"\x18\x1A\x1B\x40-\x7E", r"\x18\x1A\x1B\x30-\x7E"
#: Strings that go up to their end, whatever they hold: OSC, and DCS, SOS, PM and APC.
_STRINGS = r"\][^\x07\x18\x1A\x1B]*+\x07?|[PX^_][^\x18\x1A\x1B]*+"
_ESCAPE = rf"\x1B[^{_AFTER_ESC}]*+(?:\[[^{_AFTER_CSI}]*+[\x40-\x7E]?|[\x20-\x2F][^{_AFTER_INTER}]*+[\x30-\x7E]?|{_STRINGS}|[\x30-\x7E])?[\x18\x1A]?"
#: An escape sequence that passes a line feed, which stays.
_ESCAPED_LINE = rf"\x1B[^{_AFTER_ESC}\n]*+(?:\n|\[[^{_AFTER_CSI}\n]*+\n|[\x20-\x2F][^{_AFTER_INTER}\n]*+\n)"


def strip_escapes(x: str | Column) -> Column:
    """Without terminal escape sequences and without controls but line feed, CR, tab and backspace. The private-use stand-ins of the last three become these.

    A sequence is what the state machine of a terminal takes: CAN and SUB end it, ESC ends it and starts another, other characters that do not
    belong in it are taken along, but line feeds, which stay where they are unless inside a string. One that does not end goes up to the end.
    Each ESC starts a sequence, so those of a text are independent and one pass finds them.
    """
    x = F.translate(_c(x), "\uE000\uE001\uE002", "\r\t\b")

    def lines_of(piece: Column) -> Column:
        return F.when(piece.startswith("\x1B"), F.regexp_replace(F.regexp_replace(piece, rf"(?s)^(\x1B[^{_AFTER_ESC}]*+)[PX^_\]].*", "$1"), r"[^\n]++", "")).otherwise(piece)

    # After each sequence what is left up to the next ESC is a piece of its own.
    pieces = F.array_join(F.transform(F.regexp_extract_all(x, F.lit(rf"{_ESCAPE}|[^\x1B]++"), F.lit(0)), lines_of), "")
    x = F.when(~F.contains(x, F.lit("\x1B")), x).when(x.rlike(_ESCAPED_LINE), pieces).otherwise(F.regexp_replace(x, _ESCAPE, ""))
    return F.replace(F.regexp_replace(x, r"[\x00-\x07\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit("\r\n"), F.lit("\n"))


def replay_cursor(line: Column) -> Column:
    """What a terminal shows after carriage returns and backspaces: later characters overwrite, nothing is erased."""
    returns = F.aggregate(F.split(line, "\r", -1), F.lit(""), lambda shown, new: F.concat(new, F.substring(shown, F.length(new) + 1, F.length(shown))))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))

    def put(a: Column, run: Column) -> Column:
        n = F.length(run)
        typed = F.concat(F.left(a.s, a.at), run, F.substring(a.s, a.at + n + 1, F.length(a.s)))
        back = F.struct(a.s.alias("s"), F.greatest(a.at - n, F.lit(0)).alias("at"))
        return F.when(run == "\r", F.struct(a.s.alias("s"), F.lit(0).alias("at"))).when(run.startswith("\b"), back).otherwise(F.struct(typed.alias("s"), (a.at + n).alias("at")))

    runs = F.regexp_extract_all(line, F.lit(r"\r|\x08++|[^\r\x08]++"), F.lit(0))  # a step for each run, not for each character
    steps = F.aggregate(runs, start, put, lambda a: a.s)
    return F.when(F.contains(line, F.lit("\b")), steps).when(F.contains(line, F.lit("\r")), returns).otherwise(line)


def expand_tabs(line: Column, width: int = 4) -> Column:
    width = max(width, 1)
    parts = F.split(line, "\t", -1)
    padded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.element_at(parts, 1), lambda a, x: F.concat(a, F.repeat(F.lit(" "), F.lit(width) - F.length(a) % width), x))
    return F.when(F.contains(line, F.lit("\t")), padded).otherwise(line)


def clean(x: str | Column, tab_width: int = 4) -> Column:
    """A capture as its reader saw it: escapes out, cursor movements replayed, tabs expanded, blank lines emptied, stray direction marks dropped."""

    def printable(shown: Column) -> Column:
        return F.when(is_blank(shown), F.lit("")).otherwise(F.regexp_replace(shown, rf"[{STRAY}\p{{Cc}}]", ""))

    def line(raw: Column) -> Column:
        moved = raw.rlike(r"[\t\r\x08]")
        return F.when(moved, let(let(replay_cursor(raw), lambda x: expand_tabs(x, tab_width)), printable)).otherwise(printable(raw))

    return F.array_join(F.transform(F.split(strip_escapes(x), "\n", -1), line), "\n")


def fold_persian(x: str | Column) -> Column:
    """Arabic letter forms as Persian text has them: presentation forms resolved one by one, yeh and kaf folded."""
    x = _c(x)
    table = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in presentation_forms()))
    resolved = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    return F.translate(F.when(x.rlike(r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]"), resolved).otherwise(x), *FOLDED)


def is_rule(x: str | Column) -> Column:
    """Only rule glyphs and white space, and at least three glyphs."""
    return _c(x).rlike(rf"^(?:[{WS}]*+[{RULES}]){{3}}[{WS}{RULES}]*+\z")


def is_frame(x: str | Column) -> Column:
    from .chars import CORNERS

    return is_rule(x) & _c(x).rlike(f"[{CORNERS}]")


def is_fence(content: str | Column) -> Column:
    return _c(content).rlike(rf"^[{WS}]*(?:```|~~~)")


def gutter_lead(line: str | Column) -> Column:
    """The longest start of white space, structural glyphs and list or prompt markers."""
    return F.regexp_extract(_c(line), rf"^(?:[{WS}{STRUCT}]++|[-*+$](?=[{WS}])|>(?=[{WS}>])|[0-9]++[.)](?=[{WS}]))*+", 0)


def gutter(line: str | Column) -> Column:
    """A struct (lead, content, tail, boxed). A line is boxed if both ends have more than white space and something is between."""
    line = _c(line)

    def parts(lead: Column) -> Column:
        return let(F.substring(line, F.length(lead) + 1, F.length(line)), lambda rest: ends(lead, rest))

    def ends(lead: Column, rest: Column) -> Column:
        return let(F.regexp_extract(rest, rf"(?<![{WS}{STRUCT}])[{WS}{STRUCT}]++\z", 0), lambda tail: made(lead, rest, tail))

    def made(lead: Column, rest: Column, tail: Column) -> Column:
        boxed = ~is_blank(lead) & ~is_blank(tail) & (F.length(rest) > F.length(tail))
        inner = F.left(rest, F.length(rest) - F.length(tail))
        return F.struct(lead.alias("lead"), trim_ws(F.when(boxed, inner).otherwise(rest), "right").alias("content"), F.when(boxed, tail).otherwise(F.lit("")).alias("tail"), boxed.alias("boxed"))

    return let(gutter_lead(line), parts)


#: Pieces that join to the whole: plain words, what is left of a run, matches of the token pattern, runs or parts of runs without a token, single characters.
_TILE = rf"(?s:(?<![{_LETTERS}]){_PLAIN}|(?<=[{_LETTERS}{_IN_RUN}])(?:{_RUN}|{_skipped()})|{_java_token()}|{_RUN}|{_skipped()}|.)"
#: What a line with a token has somewhere.
_SIGN = r"[`/\\_@=\[0-9]|[.:-][A-Za-z:>-]"


def tiles(content: str | Column) -> Column:
    """The content in pieces that join to the whole."""
    return F.regexp_extract_all(_c(content), F.lit(_TILE), F.lit(0))


def _trimmed(tile: Column) -> Column:
    """Without sentence marks at the end, and without closing brackets that it does not open."""
    pairs = ("()", "[]", "{}")

    def count(text: Column, ch: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))

    def step(state: Column, ch: Column) -> Column:
        spare = [state[f"s{k}"] for k in range(3)]
        drop = ~state.stop & (ch.rlike(f"[{AFTER}]") | F.coalesce(*(F.when(ch == p[1], spare[k] > 0) for k, p in enumerate(pairs)), F.lit(False)))
        left = [F.when(drop & (ch == p[1]), spare[k] - 1).otherwise(spare[k]).alias(f"s{k}") for k, p in enumerate(pairs)]
        return F.struct((state.n + drop.cast("int")).alias("n"), (~drop).alias("stop"), *left)

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"), *((count(tile, p[1]) - count(tile, p[0])).alias(f"s{k}") for k, p in enumerate(pairs)))
    end = F.regexp_extract(tile, rf"(?<![{AFTER})\]}}])[{AFTER})\]}}]++\z", 0)
    kept = F.aggregate(F.reverse(F.split(end, "")), start, step, lambda state: F.left(tile, F.length(tile) - state.n))
    return F.when(tile.rlike(rf"[{AFTER})\]}}]\z"), kept).otherwise(tile)


def marked(content: str | Column) -> Column:
    """The content with each code token between OPEN and CLOSE."""

    def shown(tile: Column, cut: Column) -> Column:
        keep = (F.length(cut) > 1) & ~cut.rlike(r"^[a-f]+\z")
        return F.when(keep, F.concat(F.lit(OPEN), cut, F.lit(CLOSE), F.substring(tile, F.length(cut) + 1, F.length(tile)))).otherwise(tile)

    def wrap(tile: Column, at: Column, every: Column) -> Column:
        bounded = (at == 0) | F.get(every, at - 1).rlike(rf"[{WS}{BEFORE}]\z")
        word = tile.rlike(f"^{_PLAIN}\\z") | ~tile.rlike(f"^(?:{_java_token()})")
        return F.when((F.length(tile) == 1) | ~bounded | word, tile).otherwise(let(_trimmed(tile), lambda cut: shown(tile, cut)))

    content = _c(content)
    found = let(tiles(content), lambda every: F.array_join(F.transform(every, lambda t, i: wrap(t, i, every)), ""))
    return F.when(content.rlike(_SIGN), found).otherwise(content)


def code_tokens(marked_text: str | Column) -> Column:
    return F.regexp_extract_all(_c(marked_text), F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))


def prose_only(marked_text: str | Column) -> Column:
    """Marked text with each code token as one space."""
    return F.regexp_replace(_c(marked_text), f"{OPEN}[^{CLOSE}]*{CLOSE}", " ")


def segments(marked_text: str | Column, strip_backticks: bool = True) -> Column:
    """Marked text as an array of (kind, text), kind text or code; backticks around a code token go if asked."""
    pieces = F.transform(F.split(_c(marked_text), f"[{OPEN}{CLOSE}]", -1), lambda x, i: F.struct(F.when(i % 2 == 1, F.lit("code")).otherwise(F.lit("text")).alias("kind"), x.alias("text")))
    if strip_backticks:
        pieces = F.transform(pieces, lambda s: F.struct(s.kind.alias("kind"), F.when((s.kind == "code") & s.text.rlike("(?s)^`.*`\\z") & (F.length(s.text) >= 2), F.substring(s.text, F.lit(2), F.length(s.text) - 2)).otherwise(s.text).alias("text")))
    return F.filter(pieces, lambda s: (s.kind == "code") | (s.text != ""))


def runs(x: str | Column, direction: str) -> Column:
    """How many runs of strong characters of a direction a text has; joiners and underscores do not end a run."""

    def counted(joined: Column) -> Column:
        count = lambda body: F.regexp_count(joined, F.lit(f"[{body}]+"))
        quick = joined.rlike(rf"^[{quick_text()}]*\z")
        both = F.when(quick, count(strong(direction, True))).otherwise(count(strong(direction)))
        return F.when(~joined.rlike(r"[\x{590}-\x{10FFFF}]"), F.lit(0)).otherwise(both) if direction == "rtl" else both

    return let(F.regexp_replace(_c(x), r"[_\x{200C}\x{200D}]", ""), counted)


def first_strong(x: str | Column) -> Column:
    """The direction of the first strong character, ltr or rtl; null without one."""
    first = F.regexp_extract(_c(x), f"[{strong('ltr')}{strong('rtl')}]", 0)
    return F.when(first == "", F.lit(None).cast("string")).when(first.rlike(f"[{strong('rtl')}]"), F.lit("rtl")).otherwise(F.lit("ltr"))


def is_prompt(content: str | Column) -> Column:
    return _c(content).rlike(rf"^[{WS}]*(?:\$ |PS |➜ |❯)")


def direction(prose: Column, content: Column, ltr_only: Column, doc_dir: Column) -> Column:
    """ltr for code, diffs and prompts; else by the runs of the prose, a tie by the document, nothing strong ltr."""
    pair = F.struct(runs(prose, "ltr").alias("l"), runs(prose, "rtl").alias("r"))
    return let(pair, lambda p: _sided(p.l, p.r, content, ltr_only, doc_dir))


def _sided(left: Column, right: Column, content: Column, ltr_only: Column, doc_dir: Column) -> Column:
    return F.when(ltr_only | is_prompt(content) | ((left == 0) & (right == 0)), F.lit("ltr")).when(right > left, F.lit("rtl")).when(left > right, F.lit("ltr")).otherwise(doc_dir)


def is_plain(x: str | Column) -> Column:
    """Only characters one column wide of which the space alone is white space: printable ASCII, Latin, Arabic letters, box drawing."""
    return _c(x).rlike(r"^[\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{2FF}\x{620}-\x{64A}\x{671}-\x{6D3}\x{2500}-\x{257F}]*+\z")


def _sequences(x: Column) -> Column:
    """The text with each sequence that is shown as one glyph as one character of its width."""
    one = rf"[{symbols()}]\x{{FE0F}}?[{TONES}]?"
    emoji = rf"{one}(?:\x{{200D}}{one})++|[{symbols()}](?:\x{{FE0F}}[{TONES}]?|[{TONES}])|[#*0-9]\x{{FE0F}}\x{{20E3}}?"
    x = F.regexp_replace(x, rf"[{LAM}][{marks()}]*+[{ALEF}]", "\u0644")
    return F.when(x.rlike(rf"[\x{{200D}}\x{{FE0E}}\x{{FE0F}}{TONES}]"), F.regexp_replace(F.regexp_replace(x, emoji, "\U0001F600"), rf"[{symbols()}]\x{{FE0E}}", "x")).otherwise(x)


def width(x: str | Column) -> Column:
    """Columns that a text takes: two for wide characters and for emoji sequences, none for marks, joiners and controls, one for lam and alef together."""

    def counted(s: Column) -> Column:
        return F.length(s) - F.regexp_count(s, F.lit(f"[{zero()}]")) + F.regexp_count(s, F.lit(f"[{wide()}]"))

    x = _c(x)
    return F.when(is_plain(x), F.length(x) - F.regexp_count(x, F.lit(f"[{LAM}][{ALEF}]"))).otherwise(let(_sequences(x), counted))


def ends_sentence(content: str | Column) -> Column:
    return _c(content).rlike(rf"[.!?:؛؟۔。][{WS}]*+\z")


def html_escape(x: str | Column) -> Column:
    x = _c(x)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def delimiter_order(d: Column) -> Column:
    return F.instr(F.lit(DELIMITERS), d)
