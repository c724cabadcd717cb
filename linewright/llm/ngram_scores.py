"""Language-model scores by deleted interpolation of a bigram, a unigram and a uniform model.

The texts are read once: each task turns its documents into parts of bounded size, with the distinct words of a part and the tokens as
numbers of these. A part then asks for the training counts of its distinct words and bigrams, in blobs of sorted hashes for each bucket of
hashes; a bucket adds up what all parts have seen and answers each part in the order of its question. So an n-gram travels once
for each part that has it, not once for each time it occurs, and a frequent one is no larger a load than a rare one. Parts and answers
are tables bucketed alike, so that they meet without a shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix, remainder, scratch, slices, span_hashes, stored, table, words

#: Tokens of a part, and requests that one bucket of hashes answers.
PART_TOKENS = 600_000
BUCKET_KEYS = 1_000_000
#: Bytes of text behind one table bucket.
TABLE_BYTES = 24_000_000
#: Mixture weights are learned for each power of two of the context's count.
CONTEXT_BINS = 40
#: Bins of a probability's logarithm in the table that the weights are learned from, DECADE_BINS for each factor of ten from 1e-14 up to 1, and one for 0. A cell of it stands for its tokens by the means of their probabilities.
DECADE_BINS = 8
LOG_BINS = 14 * DECADE_BINS + 1
EM_ROUNDS = 60
END = np.uint64(0x1E5D0C0FFEE15EAD)
START = np.uint64(0x57A27D0C0FFEE001)
WORD, PAIR, TOTAL = 0, 1, 2


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, in no more bytes each than the largest needs."""
    steps = np.diff(x, prepend=np.uint64(0)) if len(x) else x
    first, rest = steps[:1], steps[1:]
    width = max(1, -(-int(rest.max(initial=0)).bit_length() // 8))
    return bytes([width]) + first.astype("<u8").tobytes() + np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    first = np.frombuffer(blob[1:9], "<u8")
    raw = np.frombuffer(blob[9:], np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(np.concatenate([first, full.view("<u8").ravel()]), dtype=np.uint64)


PARTS = "part long, ids array<long>, held array<boolean>, lengths binary, tokens binary, vocabulary binary, seen binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of documents: token numbers by falling frequency, the hashes of these words, and how often training documents have each."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    held: list[tuple] = []
    size = 0

    def given() -> pa.RecordBatch:
        nonlocal number, size
        ids = [x for h in held for x in h[0]]
        out = [x for h in held for x in h[1]]
        lengths = np.concatenate([h[2] for h in held])
        hashes = np.concatenate([h[3] for h in held])
        keys, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        train = np.repeat(~np.array(out, bool), lengths)
        seen = np.bincount(inverse[train], minlength=len(keys))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number += 1
        held.clear()
        size = 0
        values = [[number], [ids], [out], [pack_numbers(lengths)], [pack_numbers(rank[inverse])], [keys[order].tobytes()], [pack_numbers(seen[order])]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    for batch, raw, offsets in slices(batches, "text"):
        starts, ends, bounds = words(raw, offsets)
        hashes = np.insert(span_hashes(raw, starts, ends, lower=True), bounds[1:], END)
        held.append((batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), np.diff(bounds) + 1, hashes))
        size += len(hashes)
        if size >= PART_TOKENS:
            yield given()
    if held:
        yield given()


class Part:
    """A part as its row holds it, with the hashes of its bigrams."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = unpack_numbers(row["lengths"]).astype(np.int64)
        self.tokens = unpack_numbers(row["tokens"]).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.seen = unpack_numbers(row["seen"])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        hashes = self.vocabulary[self.tokens]
        before = np.concatenate([[START], hashes[:-1]])
        before[self.first] = START
        self.pairs = mix(before * np.uint64(0xD1342543DE82EF95) + hashes)


def _asked(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row)
                order = np.argsort(part.vocabulary)
                pairs, inverse = np.unique(part.pairs, return_inverse=True)
                seen = np.bincount(inverse[part.train], minlength=len(pairs))
                for kind, keys, counts in ((WORD, part.vocabulary[order], part.seen[order]), (PAIR, pairs, seen)):
                    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    there, at = np.unique(bucket, return_index=True)
                    cuts = np.append(at, len(keys))
                    rows = [(int(b), row["part"], kind, pack_sorted(keys[s:e]), pack_numbers(counts[s:e])) for b, s, e in zip(there, cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "kind", "keys", "counts"])

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """For each question of a bucket the total training counts in the order asked; and one row with the tokens and the words that training documents have."""
    out: list[tuple] = []
    for kind in (WORD, PAIR):
        rows = [r for r in asked.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        keys = [unpack_sorted(r["keys"]) for r in rows]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack_numbers(r["counts"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
        at = np.cumsum([0, *(len(k) for k in keys)])
        out += [(r["part"], kind, r["bucket"], pack_numbers(totals[inverse[at[k] : at[k + 1]]])) for k, r in enumerate(rows)]
        if kind == WORD:
            out.append((-1, TOTAL, rows[0]["bucket"], pack_numbers(np.array([totals.sum(), (totals > 0).sum()]))))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "bucket", "counts"])


def _counts(row: dict, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the training counts of the word, of its context and of both together."""
    found = {kind: np.concatenate([unpack_numbers(a["counts"]) for a in sorted((a for a in row["answers"] if a["kind"] == kind), key=lambda a: a["bucket"])]).astype(np.int64) for kind in (WORD, PAIR)}
    by_rank = np.empty(len(part.vocabulary), np.int64)
    by_rank[np.argsort(part.vocabulary)] = found[WORD]
    word = by_rank[part.tokens]
    context = np.concatenate([[0], word[:-1]])
    ends = np.flatnonzero(part.vocabulary == END)
    context[part.first] = by_rank[ends[0]]  # as many documents start as end
    return word, context, found[PAIR][np.unique(part.pairs, return_inverse=True)[1]]


def _bin(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), CONTEXT_BINS - 1)


def _log_bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.round(DECADE_BINS * (14 + np.log10(np.maximum(p, 1e-14)))), 0, LOG_BINS - 1).astype(np.int64) + 1, 0)


CELLS = "cell int, n long, one double, two double"


def cells_of(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Of training tokens, by their counts, the cell of each and its estimates (unigram, bigram), made without the token itself."""
    word, context, pair = word - 1, context - 1, pair - 1
    p = np.stack([word / max(n_tokens - 1, 1), pair / np.maximum(context, 1)])
    return (_bin(context) * (LOG_BINS + 1) + _log_bin(p[1])) * (LOG_BINS + 1) + _log_bin(p[0]), p


def _deleted(n_tokens: int):
    """How training tokens fall by context count and by the logarithms of both estimates: rows of CELLS, with sums of the estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = CONTEXT_BINS * (LOG_BINS + 1) ** 2
        total = np.zeros((3, size))
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row)
                cell, p = cells_of(*(c[part.train] for c in _counts(row, part)), n_tokens)
                total += [np.bincount(cell, w, minlength=size) for w in (None, *p)]
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some].astype(np.int64)), pa.array(total[1][some]), pa.array(total[2][some])], ["cell", "n", "one", "two"])

    return run


def learn_weights(cell: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, n_words: int) -> np.ndarray:
    """weights[context bin, (uniform, unigram, bigram)], by expectation-maximisation of the likelihood of the deleted tokens: n of each cell, with mean estimates one and two."""
    bins = cell // (LOG_BINS + 1) ** 2
    p = np.stack([np.full(len(cell), 1 / (n_words + 1)), one, two])
    weights = np.full((CONTEXT_BINS, 3), 1 / 3)
    every = np.bincount(bins, n, minlength=CONTEXT_BINS)
    known = np.flatnonzero(every)
    for _ in range(EM_ROUNDS):
        share = weights[bins].T * p
        share *= n / share.sum(axis=0)
        gained = np.stack([np.bincount(bins, x, minlength=CONTEXT_BINS) for x in share], axis=1)
        weights[known] = gained[known] / every[known, None]
    for b in np.flatnonzero(every == 0):  # the nearest bin that has tokens
        weights[b] = weights[known[np.abs(known - b).argmin()]] if len(known) else (0.5, 0.5, 0.0)
    return np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum(axis=1, keepdims=True)


def _scored(weights: np.ndarray, n_tokens: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row)
                word, context, pair = _counts(row, part)
                base = np.log10((word + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
                w = weights[_bin(context)]
                p = w[:, 0] / (n_words + 1) + w[:, 1] * word / max(n_tokens, 1) + w[:, 2] * pair / np.maximum(context, 1)
                doc = np.repeat(np.arange(len(part.ids)), part.lengths)
                sums = [np.bincount(doc, x, minlength=len(part.ids)) for x in (word > 0, base, np.log10(p))]
                columns = [pa.array(part.ids, pa.int64()), pa.array(part.held), pa.array(part.lengths), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(part.ids), n_tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _as_table(frame: DataFrame, n: int) -> DataFrame:
    """Written in the shared folder as a table bucketed by part."""
    name = f"ngrams_{uuid.uuid4().hex}"
    frame.write.bucketBy(n, "part").option("path", scratch(frame.sparkSession, "ngrams")).saveAsTable(name)
    return frame.sparkSession.table(name)


def interpolated_scores(docs: DataFrame, held: str = "held") -> DataFrame:
    """One row per row of `docs` (doc_id, text and a column that is true where a document must not be learned from).

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text has one token, its end; a null id
    is learned from. Repeated rows are scored each, and learned from each. With nothing to learn from, words get the uniform probability. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    n = max(1, -(-size // TABLE_BYTES))
    parts = _as_table(texts.mapInArrow(_parts, PARTS), n)
    buckets = max(1, -(-size // 5 // BUCKET_KEYS))
    asked = parts.mapInArrow(_asked(buckets), "bucket int, part long, kind int, keys binary, counts binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answer, "part long, kind int, bucket int, counts binary"), "answers")
    n_tokens, n_words = (int(x) for x in sum((unpack_numbers(r["counts"]) for r in answers.where(f"kind = {TOTAL}").select("counts").toLocalIterator()), np.zeros(2, np.uint64)))
    grouped = _as_table(answers.where(f"kind != {TOTAL}").repartition(n, "part").groupBy("part").agg(F.collect_list(F.struct("kind", "bucket", "counts")).alias("answers")), n)
    met = parts.join(grouped, "part")
    cells = met.mapInArrow(_deleted(n_tokens), CELLS).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).orderBy("cell").toArrow()
    cell, n, one, two = (cells.column(k).to_numpy() for k in range(4))
    weights = learn_weights(cell, n, one / np.maximum(n, 1), two / np.maximum(n, 1), n_words)
    return met.mapInArrow(_scored(weights, n_tokens, n_words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from those whose crc32(doc_id as text) mod 5 is not 1."""
    return interpolated_scores(table(spark, sf_dir, "documents").withColumn("held", remainder("doc_id", 5) == 1))
