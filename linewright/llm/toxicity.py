"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .textkit import remainder, shielded, slices, span_hashes, table, words

BUCKET_BITS = 18
#: The model is fitted on about so many labelled rows that are not toxic (0) and that are (1) at most, drawn by a hash of their ids.
SAMPLE_ROWS = {0: 12_000, 1: 4000}
#: To get a weight, a word must occur in so many sampled documents, and the number of toxic ones among them must be so many standard deviations off. Only such words leave the tasks.
LEAST_DOCS = 5
LEAST_DEVIATION = 3.5
EPOCHS = 200
#: Strength of the absolute penalty, over the square root of the number of sampled rows: words that tell nothing get no weight.
PENALTY = 0.002
RATE = 0.1
_CLOSERS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]*#$%&|", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, the first word of each sentence, the document of each sentence, and the spans of the words.

    A sentence ends after a word whose last character is . ! or ?, at a line's end and at the document's end.
    """
    starts, ends, bounds = words(raw, offsets)
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    raw = raw + (capital * 32).astype(np.uint8)  # the two-byte capitals of Latin-1
    trimmed = ends.copy()
    for _ in range(6):
        strip = (trimmed - starts > 1) & _CLOSERS[raw[np.maximum(trimmed - 1, 0)]] if len(raw) else np.zeros(0, bool)
        trimmed -= strip
    buckets = (span_hashes(raw, starts, trimmed, lower=True) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    first = np.ones(len(starts), bool)
    if len(starts):
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        first[1:] = _STOPS[raw[ends[:-1] - 1]] | (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
    heads = np.flatnonzero(first)
    return buckets, heads, doc[heads], starts, ends


def sentence_logits(model: Model, buckets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.weights[buckets], heads) + model.bias if len(heads) else np.zeros(0)


def noisy_or(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each document; 0 without sentences."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), minlength=n))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, bad): how many documents of a slice, and toxic ones, have each bucket; bucket -1 counts the documents."""
    size = 1 << BUCKET_BITS
    for batch, raw, offsets in slices(batches, "text"):
        buckets, heads, doc, _, _ = sentences(raw, offsets)
        owner = np.repeat(doc, np.diff(np.append(heads, len(buckets))))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        present = np.unique(owner * size + buckets)
        found, inverse, n = np.unique(present % size, return_inverse=True, return_counts=True)
        bad = np.bincount(inverse, toxic[present // size], minlength=len(found)).astype(np.int64) if len(found) else n
        columns = [np.append(found, -1), np.append(n, len(toxic)), np.append(bad, toxic.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "n", "bad"])


def _features(known: np.ndarray):
    """Rows of the numbers of known words, the lengths in these of sentences that have any, and how many sentences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << BUCKET_BITS, -1)
        column[known] = np.arange(len(known))
        for batch, raw, offsets in slices(batches, "text"):
            buckets, heads, doc, _, _ = sentences(raw, offsets)
            x = column[buckets]
            counts = np.add.reduceat((x >= 0).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
            x, plain = x[x >= 0], np.bincount(doc[counts == 0], minlength=batch.num_rows)
            doc, counts = doc[counts > 0], counts[counts > 0]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            edge = np.concatenate([[0], np.cumsum(counts)])[cuts]
            spans = [(x[edge[k] : edge[k + 1]].astype("<u4").tobytes(), counts[cuts[k] : cuts[k + 1]].astype("<u4").tobytes()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array([a for a, _ in spans], pa.binary()), pa.array([b for _, b in spans], pa.binary()), pa.array(plain, pa.int64())], ["id", "toxic", "words", "lengths", "plain"])

    return run


def fit(known: np.ndarray, x: np.ndarray, sentence: np.ndarray, doc: np.ndarray, plain: np.ndarray, toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Weights that maximise the likelihood of the document labels under the noisy-or, less an absolute penalty, by proximal steps with a rate for each weight.

    x: words by number, in the sentences that have any; doc: of these; plain: sentences of each document that have none. `weight`: of rows that are not toxic and that are, which undoes unequal sampling.
    """
    w, n = np.zeros(len(known) + 1), len(toxic)
    w[-1] = -5.0
    mean, square, limit = np.zeros_like(w), np.zeros_like(w), PENALTY / np.sqrt(n)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(sentence, w[x], minlength=len(doc)) + w[-1]
        total = np.bincount(doc, np.logaddexp(0, z), minlength=n) + plain * np.logaddexp(0, w[-1])
        pull = np.where(toxic == 1, -weight[1] / np.expm1(np.clip(total, 1e-6, 500)), weight[0])
        g = pull[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        rest = (pull * plain).sum() / (1 + np.exp(-w[-1]))
        grad = np.append(np.bincount(x, g[sentence], minlength=len(known)), g.sum() + rest) / n
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        rate = RATE / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w -= rate * mean
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(rate[:-1] * limit, RATE), 0)
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    weights[known] = w[:-1]
    return Model(weights, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most about SAMPLE_ROWS of each class.

    The words that leave the tasks are screened there by keyed counts, so what comes to the driver are the sampled rows' known words. A document with several labels counts as toxic if one says so. Without labelled rows of both classes the model gives every sentence the same low score.
    """
    learn = labels.where("toxic is not null").where(remainder("doc_id", 5) != 0).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    sample = learn.where(" or ".join(f"toxic = {t}" for t in (0, 1))).where(F.when(F.col("toxic") == 1, share < SAMPLE_ROWS[1] / max(counts.get(1, 1), 1)).otherwise(share < SAMPLE_ROWS[0] / max(counts.get(0, 1), 1)))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "id").select(F.col("id").cast("string").alias("id"), F.col("toxic").cast("int").alias("toxic"), "text")
    seen = texts.mapInArrow(_present, "bucket long, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where((F.col("n") >= LEAST_DOCS) | (F.col("bucket") < 0)).orderBy("bucket").toArrow()
    bucket, spread, bad = (seen.column(k).to_numpy() for k in range(3))
    if not len(bucket) or bucket[0] >= 0 or not 0 < bad[0] < spread[0]:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -8.0)
    usual = bad[0] / spread[0]
    known = bucket[1:][np.abs(bad - spread * usual)[1:] >= LEAST_DEVIATION * np.sqrt(spread * usual * (1 - usual))[1:]]
    rows = texts.mapInArrow(_features(known), "id string, toxic int, words binary, lengths binary, plain long").orderBy("id", "words", "lengths").collect()
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    x = np.frombuffer(b"".join(r["words"] for r in rows), "<u4").astype(np.int64)
    lengths = np.frombuffer(b"".join(r["lengths"] for r in rows), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r["lengths"]) // 4 for r in rows])
    every = [max(counts.get(t, 1), SAMPLE_ROWS[t]) / SAMPLE_ROWS[t] for t in (0, 1)]
    mean = (every[0] * (toxic == 0).sum() + every[1] * (toxic == 1).sum()) / len(toxic)
    return fit(known, x, np.repeat(np.arange(len(lengths)), lengths), doc, np.array([r["plain"] for r in rows], float), toxic, (every[0] / mean, every[1] / mean))


def score(docs: DataFrame, model: Model, name: str = "__toxicity", located: str | None = None) -> DataFrame:
    """The columns of `docs` and `name`, its toxicity; a null or empty text scores 0. `located`: a column for the likeliest offending sentence of texts that score at least one half, null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in slices(batches, "text"):
            buckets, heads, doc, starts, ends = sentences(raw, offsets)
            logits = sentence_logits(model, buckets, heads)
            values = noisy_or(logits, doc, batch.num_rows)
            columns, names = [*batch.columns, pa.array(values)], [*batch.schema.names, name]
            if located:
                order = np.lexsort((-logits, doc))
                first = order[np.append(True, doc[order][1:] != doc[order][:-1])] if len(order) else order
                last = np.append(heads[1:], len(buckets)) - 1
                worst = {int(doc[k]): raw[starts[heads[k]] : ends[last[k]]].tobytes().decode("utf-8", "replace") for k in first if values[doc[k]] >= 0.5}
                columns, names = [*columns, pa.array([worst.get(k) for k in range(batch.num_rows)], pa.string())], [*names, located]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = [StructField(name, DoubleType()), *([StructField(located, StringType())] if located else [])]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, sentence, score) for the sentences that score at least `least`, in no fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in slices(batches, "text"):
            buckets, heads, doc, starts, ends = sentences(raw, offsets)
            p = 1 / (1 + np.exp(-sentence_logits(model, buckets, heads)))
            hit = np.flatnonzero(p >= least)
            last = np.append(heads[1:], len(buckets)) - 1
            found = [raw[starts[heads[k]] : ends[last[k]]].tobytes().decode("utf-8", "replace") for k in hit]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[hit])), pa.array(found, pa.string()), pa.array(p[hit], pa.float64())], ["doc_id", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score under one half, with its columns."""
    packed, unpacked = shielded(docs, "doc_id", "text")
    return unpacked(score(packed, train(docs.select("doc_id", "text"), labels)).where(F.col("__toxicity") < 0.5))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), located="worst_sentence")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"), "worst_sentence")
