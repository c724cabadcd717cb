"""Language identification by unigram piece models, summed over all segmentations of each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix, remainder, slices, span_hashes, table, words

#: Models are fitted on about so many documents of each language at most, drawn by a hash of their ids.
SAMPLE_DOCS = 400
ROUNDS = 4
#: Pseudo-count of each piece, and of all letters without a piece together.
PRIOR = 0.01
UNDETERMINED = "und"
SLICE = 4_000_000
#: Letters of words that are worked on at once, a longer word alone; after so many letters probabilities are scaled.
BLOCK_LETTERS = 300_000
RESCALE = 8
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_BASE = np.uint64(0x5851F42D4C957F2D)
_SLOT_BITS = 20


@dataclass
class Pieces:
    """The letter pieces of a public vocabulary by hash; a word starts with the mark that the vocabulary uses for word starts. Each hash is in one of its two slots."""

    keys: np.ndarray
    slots: tuple[np.ndarray, np.ndarray]
    salt: np.uint64
    longest: int

    @property
    def unknown(self) -> int:
        return len(self.keys) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        one, two = _two_slots(hashes, self.salt)
        first, second = self.slots[0][one], self.slots[1][two]
        return np.where(self.keys[first] == hashes, first, np.where(self.keys[second] == hashes, second, np.int32(self.unknown)))


def _two_slots(hashes: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(hashes ^ salt)
    return (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), (mixed & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)


_PIECES: dict[str, Pieces] = {}
MARK = "▁"


def pieces(path: str) -> Pieces:
    """The vocabulary at `path` (a sentencepiece model): all its pieces of letters, in lower case."""
    if path not in _PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(k) for k in range(model.get_piece_size())}
        texts = sorted(x for x in found if x == x.lower() and (x.removeprefix(MARK) or "a").isalpha())
        codes, lengths = _codes(texts)
        at = np.concatenate([[0], np.cumsum(lengths)])
        hashes = np.array([_hash(codes[at[k] : at[k + 1]]) for k in range(len(texts))], np.uint64)
        _PIECES[path] = _placed(hashes, int(lengths.max(initial=1)))
    return _PIECES[path]


def _placed(hashes: np.ndarray, longest: int) -> Pieces:
    """Both slot tables; a salt is sought under which what finds its first slot taken has its second slot alone."""
    n, salt = len(hashes), 0
    while True:
        one, two = _two_slots(hashes, np.uint64(salt))
        _, first = np.unique(one, return_index=True)
        rest = np.setdiff1d(np.arange(n), first)
        if len(np.unique(two[rest])) == len(rest):
            break
        salt += 1
    slots = tuple(np.full(1 << _SLOT_BITS, n, np.int32) for _ in range(2))
    slots[0][one[first]], slots[1][two[rest]] = first, rest
    return Pieces(np.append(hashes, np.uint64(0)), slots, np.uint64(salt), longest)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(x) for x in texts], np.int64)


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = h * _BASE + mix(np.array([c], np.uint64) + np.uint64(1))
    return mix(h + np.uint64(len(codes)))[0]


@dataclass
class Words:
    """Code points of marked, lower-case words, one after the other; words by length: where each starts, its length and the number of its text."""

    codes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Words in bounded parts, each as a matrix with a row for each place and a column for each word."""
        at, n = 0, len(self.size)
        while at < n:
            to = at + max(1, BLOCK_LETTERS // int(self.size[at]))
            while to > at + 1 and (to > n or (to - at) * int(self.size[to - 1]) > BLOCK_LETTERS):
                to = at + max(1, min(n - at, (to - at) * 3 // 4))
            place = np.arange(int(self.size[to - 1]))[:, None]
            inside = place < self.size[at:to]
            yield slice(at, to), np.where(inside, self.codes[np.where(inside, self.first[at:to] + place, 0)], 0)
            at = to


def words_of(texts: list[str]) -> Words:
    """What is not a letter is left out; texts without letters are no words."""
    codes, lengths = _codes([x.lower() for x in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    kinds, inverse = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    keep = letter[inverse] if len(codes) else np.zeros(0, bool)
    codes, owner = codes[keep], owner[keep]
    named, at, counts = np.unique(owner, return_index=True, return_counts=True)
    marked = np.insert(codes, at, ord(MARK))
    order = np.argsort(counts, kind="stable")
    return Words(marked, (at + np.arange(len(at)))[order], counts[order] + 1, named[order])


def _lattice(vocabulary: Pieces, matrix: np.ndarray) -> list[np.ndarray]:
    """For each length l, the piece from each place on; letters without a piece of their own count as unknown, other runs as nothing (-1)."""
    values = mix(matrix.astype(np.uint64) + np.uint64(1))
    out, rolling = [], np.zeros_like(values)
    for l in range(1, min(vocabulary.longest, matrix.shape[0]) + 1):
        rolling = rolling[: matrix.shape[0] - l + 1] * _BASE + values[l - 1 :]
        found = vocabulary.find(mix(rolling + np.uint64(l)))
        if l > 1:
            found = np.where(found == vocabulary.unknown, np.int32(-1), found)
        out.append(found)
    return out


def _steps(lattice: list[np.ndarray]) -> list[list[int]]:
    """For each place the lengths of pieces of more than one letter that end there in some word."""
    out: list[list[int]] = [[] for _ in range(lattice[0].shape[0] + 1)]
    for l in range(2, len(lattice) + 1):
        for j in np.flatnonzero((lattice[l - 1] >= 0).any(axis=1)).tolist():
            out[j + l].append(l)
    return out


def forward(lattice: list[np.ndarray], probabilities: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The log probability of each word (of ascending sizes) in each language, summed over all segmentations; scaled on the way, so that long words do not underflow."""
    width, n = lattice[0].shape
    window = [np.ones((n, probabilities.shape[1]))]
    out, scale = np.zeros_like(window[0]), np.zeros_like(window[0])
    ends = np.searchsorted(size, np.arange(width + 2))
    for j, lengths in enumerate(_steps(lattice)):
        if j == 0:
            continue
        new = window[-1] * probabilities[lattice[0][j - 1]]
        for l in lengths:
            found = lattice[l - 1][j - l]
            hit = np.flatnonzero(found >= 0)
            new[hit] += window[-l][hit] * probabilities[found[hit]]
        window.append(new)
        if len(window) > len(lattice):
            window.pop(0)
        done = slice(ends[j], ends[j + 1])
        out[done] = np.log(new[done]) + scale[done]
        if j % RESCALE == 0:
            by = np.where(new > 0, new, 1.0)
            scale += np.log(by)
            window = [w / by for w in window]
    return out


def word_logs(vocabulary: Pieces, probabilities: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text (a word) in each language, and whether it has a letter."""
    found = words_of(texts)
    out, has = np.zeros((len(texts), probabilities.shape[1])), np.zeros(len(texts), bool)
    for part, matrix in found.blocks():
        out[found.owner[part]] = forward(_lattice(vocabulary, matrix), probabilities, found.size[part])
    has[found.owner] = True
    return out, has


def fit(vocabulary: Pieces, texts: list[str], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language, by expectation-maximisation over all segmentations of its counted words; sums are scaled on the way, so that words of any length count."""
    found = words_of(texts)
    weight = counts[found.owner].astype(float)
    n = vocabulary.unknown + 1
    p = np.full(n + 1, 1.0 / n)
    p[n] = 0.0
    for _ in range(ROUNDS):
        expected = np.full(n + 1, PRIOR)
        for part, matrix in found.blocks():
            lattice, ends = _lattice(vocabulary, matrix), found.size[part]
            steps, width, rows = _steps(lattice), len(matrix), np.arange(matrix.shape[1])
            alpha, beta, scale = (np.zeros((width + 1, len(rows))) for _ in range(3))  # alpha is scaled by exp(-scale), beta by exp(scale) over the word's sum
            alpha[0] = 1
            for j in range(1, width + 1):
                for l in (1, *steps[j]):
                    step = alpha[j - l] * p[lattice[l - 1][j - l]]
                    alpha[j] += step * np.exp(scale[j - l] - scale[j - 1]) if (j - 1) // RESCALE > (j - l) // RESCALE else step
                scale[j] = scale[j - 1]
                if j % RESCALE == 0:
                    by = np.where(alpha[j] > 0, alpha[j], 1.0)
                    alpha[j] /= by
                    scale[j] += np.log(by)
            whole = alpha[ends, rows]
            beta[ends, rows] = np.where(whole > 0, 1 / np.where(whole > 0, whole, 1.0), 0.0)
            for j in range(width, 0, -1):
                for l in (1, *steps[j]):
                    piece = lattice[l - 1][j - l]
                    share = p[piece] * beta[j]
                    if j // RESCALE > (j - l) // RESCALE:
                        share = share * np.exp(scale[j - l] - scale[j])
                    expected += np.bincount(np.where(piece < 0, n, piece), alpha[j - l] * share * weight[part], minlength=n + 1)
                    beta[j - l] += share
        expected[n] = 0
        p = expected / expected.sum()
    return np.maximum(p[:n], 1e-12)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in slices(batches, "text", SLICE):
        starts, ends, bounds = words(raw, offsets, _BETWEEN)
        langs = batch.column("lang").dictionary_encode()
        code = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(bounds))
        _, first, times = np.unique(mix(span_hashes(raw, starts, ends, lower=True) ^ mix(code.astype(np.uint64))), return_index=True, return_counts=True)
        found = [raw[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").lower() for k in first]
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(code[first])), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray
    path: str


def train(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on documents with a language whose crc32(doc_id as text) mod 4 is not 2, at most about `sample_docs` of each language."""
    learn = docs.where("lang is not null and text is not null").where(remainder("doc_id", 4) != 2)
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, sample_docs / v)) for k, v in sizes.items()], "lang string, share double")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = learn.select("doc_id", "lang", "text").join(F.broadcast(shares) if len(sizes) <= 10_000 else shares, "lang").where(share < F.col("share")).select("lang", "text")
    rows = sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow()
    found = rows.to_pandas()
    vocabulary = pieces(vocabulary_path)
    languages = sorted(found["lang"].unique().tolist())
    columns = [fit(vocabulary, own["word"].tolist(), own["n"].to_numpy()) for lang in languages for own in [found[found["lang"] == lang]]]
    return Model(languages, np.stack(columns, axis=1) if columns else np.zeros((vocabulary.unknown + 1, 0)), vocabulary_path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score): the language that makes the whole text likeliest, and its share of the probability.

    `und` and 0 where text is null or has no letter, or nothing was learned; a tie goes to the first language in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model.path)
        for batch, raw, offsets in slices(batches, "text", SLICE):
            starts, ends, bounds = words(raw, offsets, _BETWEEN)
            _, first, inverse = np.unique(span_hashes(raw, starts, ends, lower=True), return_index=True, return_inverse=True)
            logs, has = word_logs(vocabulary, model.probabilities, [raw[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in first])
            sums = np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(logs[inverse], axis=0)]) if len(inverse) else np.zeros((1, logs.shape[1]))
            total = sums[bounds[1:]] - sums[bounds[:-1]]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            letters = np.bincount(doc, has[inverse] if len(inverse) else None, minlength=batch.num_rows) > 0
            if total.shape[1]:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                letters[:] = False
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all `documents`."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
