"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import shielded, stored, table

SEED = "mix-1"
#: Sources beyond this number are joined, not broadcast.
BROADCAST_SOURCES = 10_000
#: Stands for a null source.
NO_SOURCE = "\x00"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 digest of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0) -> DataFrame:
    """Rows (source_key, weight, rate, cdf): the bytes of each source, how often its documents are repeated in the mean, and the cumulated Poisson probabilities.

    A source's rate is its target share of budget times all bytes, over its own bytes. Without targets all sources weigh the same.
    Sources without a target, and those without bytes, have rate 0.
    """
    spark = docs.sparkSession
    own = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source_key")).agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("weight"))
    if targets is None:
        wanted = own.withColumn("wanted", F.lit(1.0))
    else:
        given = spark.createDataFrame([(NO_SOURCE if k is None else k, float(v)) for k, v in targets.items()], "source_key string, wanted double")
        wanted = own.join(given, "source_key", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0.0)))
    sums = wanted.agg(F.sum("weight").alias("all_weight"), F.sum("wanted").alias("all_wanted"))
    rate = F.when((F.col("weight") > 0) & (F.col("wanted") > 0), F.col("wanted") / F.col("all_wanted") * F.lit(budget) * F.col("all_weight") / F.col("weight")).otherwise(0.0)
    rated = wanted.join(F.broadcast(sums)).select("source_key", "weight", rate.alias("rate"))
    cdf = F.expr("aggregate(sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) as int)), named_struct('p', -rate, 'c', array(exp(-rate))), (s, k) -> named_struct('p', s.p + ln(rate / k), 'c', array_append(s.c, element_at(s.c, -1) + exp(s.p + ln(rate / k)))), s -> s.c)")
    return rated.withColumn("cdf", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(1.0))))


def replicate(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as its inverted Poisson number says, with __copy (from 0), __rate and __order.

    The number is the inverse of the Poisson distribution with the source's rate at a hash of seed and doc_id, so repeated rows get
    equal numbers and a new run gives the same rows. Null texts weigh nothing but are drawn like others; a null source is a
    source. __order is a hash of seed, doc_id and copy; sorting by it shuffles globally.
    """
    rates = stored(source_rates(docs, targets, budget), "rates").select("source_key", F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = docs.withColumn("source_key", F.coalesce("source", F.lit(NO_SOURCE))).withColumn("__u", uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    times = F.expr("size(filter(__cdf, c -> c <= __u))")
    placed = drawn.join(rates, "source_key").withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.expr("sequence(0, __times - 1)")))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("doc_id").cast("string"), F.col("__copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return placed.withColumn("__order", order).drop("source_key", "__u", "__cdf", "__times")


def shuffled(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """`docs` replicated and shuffled globally, with its own columns, __copy and __order."""
    return replicate(docs, targets, budget, seed).orderBy("__order").select(*(F.col(f"`{c}`") for c in [*docs.columns, "__copy", "__order"]))


def mixed(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """`docs` replicated and shuffled globally, with its own columns."""
    packed, unpacked = shielded(docs, "doc_id", "text", "source")
    return unpacked(replicate(packed, targets, budget, seed).orderBy("__order"))


def op9_mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, whole rows with their texts, repeated and globally shuffled when their sources are to weigh the same."""
    out = shuffled(table(spark, sf_dir, "documents"))
    return out.withColumn("__copy", F.col("__copy").cast("int")).withColumnsRenamed({"__copy": "copy", "__order": "shuffle_key"})


OP9_SQL = f"""
WITH own AS (SELECT coalesce(source, chr(1)) AS k, sum(octet_length(encode(text))) AS weight FROM documents GROUP BY 1),
rates AS (SELECT k, 1.0 / (SELECT count(*) FROM own) * (SELECT sum(weight) FROM own) / weight AS rate FROM own WHERE weight > 0),
steps AS (SELECT k, rate, i, CASE WHEN i = 0 THEN -rate ELSE ln(rate / i) END AS term FROM rates, range(0, 400) AS r(i)),
logs AS (SELECT k, i, sum(term) OVER (PARTITION BY k ORDER BY i) AS lp FROM steps),
cdf AS (SELECT k, i, sum(exp(lp)) OVER (PARTITION BY k ORDER BY i) AS c FROM logs),
drawn AS (SELECT doc_id, source, octet_length(encode(text)) AS n_bytes, coalesce(source, chr(1)) AS k,
  CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
times AS (SELECT doc_id, source, n_bytes, count(*) AS n FROM drawn JOIN cdf ON drawn.k = cdf.k AND cdf.c <= drawn.u GROUP BY ALL)
SELECT doc_id, source, n_bytes, CAST(c AS INTEGER) AS copy,
  CAST('0x' || substr(md5('{SEED}:order:' || doc_id || ':' || c), 1, 15) AS BIGINT) AS shuffle_key
FROM times, range(0, 400) AS r(c) WHERE c < n
"""

OP9_DOCUMENTS_SQL = f"SELECT documents.*, copy, shuffle_key FROM documents JOIN ({OP9_SQL}) AS drawn USING (doc_id)"
