"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder
from .textkit import scratch, slices, table

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 4_000_000
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library's version: a cached count holds for equal digests only."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes` and `n_tokens`.

    The digest of each text (null: empty; a byte-level vocabulary needs no other normalisation) and of the tokenizer's version is
    looked up in the cache, a Parquet table at `cache_path`. Only the distinct texts that it lacks are encoded; their counts are
    appended. Without a path the cache is a new one in the shared folder. Repeated rows and equal texts give one row each with
    equal counts; an empty table gives no rows; other columns are ignored. Spans of special strings count as the library counts
    them. A run that is broken off appends nothing or whole files; a digest that two runs append at once is counted once.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    path = cache_path or scratch(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
    if _exists(spark, path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).select("digest").distinct()
        distinct = distinct.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text", ENCODE_BYTES):
            _, bounds = encoder(tokenizer_path).flat_ids(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.diff(bounds))], ["digest", "n_tokens"])

    missing = distinct.mapInArrow(encode, "digest binary, n_tokens long")
    missing.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return narrow.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of `documents` by byte_bpe_50k.json, from an empty cache."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
