"""Token ids of whole texts by the `tokenizers` library: each distinct chunk of a slice is encoded once and its ids are gathered by offsets."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .textkit import utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks that a worker keeps with their ids, of about 200 bytes each; past that it starts anew. Spark uses workers again, so they hold this for later stages too.
MEMO_CHUNKS = 300_000
#: Bits of the hashes by which a worker knows chunks that it has met before; a chunk is kept from the second slice on that has it.
MET_BITS = 23
#: Longer chunks (in bytes) are encoded each time they occur.
MEMO_BYTES = 48
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Marks before which a word ends, whatever follows; none may be in a special token.
MARKS = ".,;:!?)"
_MARK = np.isin(np.arange(256), np.frombuffer(MARKS.encode(), np.uint8))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: White space beyond ASCII, as UTF-8 read big-endian.
_WIDE = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), np.int64)


def can_be_cut(path: str) -> bool:
    """Whether the file is a plain byte-level BPE whose pre-tokens are words with the space before them, so that texts may be cut at single spaces and line feeds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") is not None or spec.get("model", {}).get("type") != "BPE" or spec["model"].get("dropout"):
        return False
    cutter = spec.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() or c in MARKS for c in t["content"]) for t in spec.get("added_tokens", []))


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts, one after the other in UTF-8, may be cut: at their starts, before a single space or line feed between other characters, after such a line feed, and between a letter (ASCII or Latin-1) and one of MARKS.

    There a pre-token starts whatever is before it; what is between two cuts can be encoded alone.
    """
    n = len(raw)
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    at = at[~_SPACE[raw[at - 1]] & ~_SPACE[raw[at + 1]]]
    wide = np.flatnonzero((raw[at - 1] >= 0x80) | (raw[at + 1] >= 0x80))
    if len(wide):
        p = at[wide]
        padded = np.concatenate([np.zeros(3, np.int64), raw.astype(np.int64), np.zeros(3, np.int64)])
        before = padded[p] << 16 | padded[p + 1] << 8 | padded[p + 2]
        after = padded[p + 4] << 16 | padded[p + 5] << 8 | padded[p + 6]
        bad = np.isin(before, _WIDE) | np.isin(before & 0xFFFF, _WIDE) | np.isin(after, _WIDE) | np.isin(after >> 8, _WIDE)
        at = np.delete(at, wide[bad])
    edge = np.searchsorted(offsets, at, "right") - 1
    at = at[(at > offsets[edge]) & (at + 1 < offsets[edge + 1])]  # not next to the edge of a text
    marks = np.flatnonzero(_MARK[raw])
    marks = marks[marks > 1]
    last = raw[marks - 1]
    marks = marks[_LETTER[last] | ((raw[marks - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]
    out = np.concatenate([offsets[:-1], at, at[raw[at] == 0x0A] + 1, marks])
    out.sort(kind="stable")
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


class Encoder:
    """Encodes by a tokenizer file; texts are cut where that changes nothing, and encoded whole where the file does not allow it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cut = can_be_cut(path)
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.met = np.zeros(1 << MET_BITS, bool)
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32)
        self.known = self.filled = 0

    def _append(self, chunks: list[bytes]) -> np.ndarray:
        """Encode chunks and put their ids behind the others; their numbers."""
        found = [x.ids for x in self.library.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        numbers = np.arange(self.known, self.known + len(chunks))
        while self.known + len(chunks) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[numbers] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.known += len(chunks)
        self.filled += len(ids)
        return numbers

    def flat_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after the other, and where each text's begin (with the total last); null counts as empty."""
        raw, offsets = utf8(column)
        places = cuts(raw, offsets) if self.cut else np.array(sorted(set(offsets[:-1].tolist())), np.int64)
        places = np.append(places[places < len(raw)], len(raw)).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > MEMO_CHUNKS or self.filled > 8 * MEMO_CHUNKS:
            self._clear()
        numbers = np.fromiter(map(self.memo.get, distinct, [-1] * len(distinct)), np.int64, len(distinct))
        short = np.array([k for k in np.flatnonzero(numbers < 0).tolist() if len(distinct[k]) <= MEMO_BYTES], np.int64)
        slot = np.fromiter((hash(distinct[k]) for k in short.tolist()), np.int64, len(short)) & ((1 << MET_BITS) - 1)
        again = short[self.met[slot]].tolist()
        self.met[slot] = True
        if again:
            numbers[again] = self._append([distinct[k] for k in again])
            self.memo.update((distinct[k], int(numbers[k])) for k in again)
        kept = self.known, self.filled
        rest = np.flatnonzero(numbers < 0)
        if len(rest):
            numbers[rest] = self._append([distinct[k] for k in rest.tolist()])
        which = numbers[chunks.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[which] - ends + lengths, lengths)]
        self.known, self.filled = kept  # what is not to be kept is overwritten
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(places, offsets)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.flat_ids(pa.array(texts, pa.large_string()))
        return [ids[s:e].astype("<u4").tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; made once."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
