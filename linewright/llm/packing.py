"""Best-fit packing of documents into sequences, with large items matched first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder
from .textkit import slices, stored, table

CAPACITY = 1024
#: A document's closing id.
END_ID = 2
#: Tokens and pieces that one task packs; a shard leaves at most one sequence badly filled, so larger shards gain little.
SHARD_TOKENS = 1 << 21
SHARD_PIECES = 100_000
#: Bytes of text that are encoded at once; what a slice takes besides its ids stays with the worker, whose allocators give little back.
ENCODE_BYTES = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, seq long"


def match_and_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    Items above a third of the capacity go two to a bin at most: from the largest down, each above a half takes the largest
    unmatched one that fits, which gives as many pairs as there can be; what stays of those up to a half pairs among itself.
    Smaller items follow in descending order, each into the fullest bin that holds it, or a new one. Equal lengths keep their order.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    order = order.tolist()
    halves = [k for k, s in enumerate(sizes) if 3 * s > capacity and 2 * s <= capacity][::-1]
    n_big = sum(2 * s > capacity for s in sizes)
    bins: list[list[int]] = []
    stack: list[int] = []
    at = 0
    for k in range(n_big):
        room = capacity - sizes[k]
        while at < len(halves) and sizes[halves[at]] <= room:
            stack.append(halves[at])
            at += 1
        bins.append([k, stack.pop()] if stack else [k])
    rest = sorted(stack + halves[at:])
    bins += [rest[k : k + 2] for k in range(0, len(rest), 2)]
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    for b, members in enumerate(bins):
        gap = capacity - sum(sizes[k] for k in members)
        gaps[gap].append(b)
        open_gaps |= 1 << gap
    for k in range(n_big + len(halves), len(sizes)):
        s = sizes[k]
        fitting = open_gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            bins[b].append(k)
        else:
            gap, b = capacity, len(bins)
            bins.append([k])
        gaps[gap - s].append(b)
        open_gaps |= 1 << (gap - s)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, members in enumerate(bins):
        filled = 0
        for k in members:
            bin_of[order[k]], offset[order[k]] = b, filled
            filled += sizes[k]
    return bin_of, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: its ids and the closing id, cut so that only the first piece may be shorter than the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch, _, _ in slices(batches, "text", ENCODE_BYTES):
            ids, bounds = encoder(tokenizer_path).flat_ids(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            sizes = np.diff(bounds) + 1
            first = np.cumsum(sizes) - sizes
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = sizes - (n - 1) * capacity
            start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[doc])
            raw, at = memoryview(ids.tobytes()), 4 * (first[doc] + start)
            crc = np.fromiter((zlib.crc32(raw[s:e]) for s, e in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(doc))
            columns = [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (piece.astype(np.int32), start, length, crc, np.arange(seq, seq + len(doc))))]
            seq += len(doc)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "seq"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The lengths are written once, then dealt by hash over shards of bounded size, each of which is packed in one task; no text or
    ids are shuffled. A null or empty text is a piece with the closing id only; repeated rows are packed each; a null id stays
    null; an empty table gives no rows. The numbers of sequences are unique but not consecutive.
    """
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    n, total = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_TOKENS), -(-n // SHARD_PIECES))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "seq"], ascending=[False, True, True, True], ignore_index=True)
        bin_of, offset = match_and_fit(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (np.int64(key[0]) << 32) + bin_of
        group["offset"] = offset
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "seq"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
