"""Quality rules whose cutoffs are chosen under risk control."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .textkit import mix, shielded, slices, span_hashes, stored, table, words

WINDOW = 8
#: All rules of a stratum together may reject this share of its good documents at most; the bounds of all strata hold at once with the confidence below.
RISK = 0.01
CONFIDENCE = 0.95
#: Good rows that must be held out in a stratum to try rules there; with fewer, no bound could be proved and only the base rule holds.
LEAST_GOOD = 500
#: A cutoff must reject so many times larger a share of bad than of good rows.
GAIN = 5.0
#: Strata beyond this number are joined, not broadcast.
BROADCAST_STRATA = 10_000
#: Rules: a share of words, lines or characters that is suspicious when high, and the cutoffs that are tried.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "marks": ("n_marks / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "capitals": ("n_capitals / word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "stutter": ("n_stutter / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / n_words", (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3)),
    "lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_stutter", "n_lines")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))


def measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The measures of each document, a column each."""
    n = len(offsets) - 1
    starts, ends, bounds = words(raw, offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(n), counts)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = per_doc(inside & ((raw & 0xC0) != 0x80))
    capitals = (raw >= 65) & (raw <= 90)
    capitals[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    hashes = span_hashes(raw, starts, ends)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    windows = np.zeros(max(len(hashes) - WINDOW + 1, 0), np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0xD1342543DE82EF95) + hashes[k : k + len(windows)]
    at = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :][: len(windows)])
    _, inverse, times = np.unique(mix(windows[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, twice + WINDOW, 1)
    repeated = np.cumsum(cover[:-1]) > 0

    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, line_starts)], offsets[np.searchsorted(offsets, line_starts, "right")])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    _, first = np.unique(mix(span_hashes(raw, line_starts, line_ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    unlike = np.bincount(line_doc[first], minlength=n)
    by_word = [np.bincount(doc[m], minlength=n) for m in (repeated, stutter)]
    return np.stack([counts, chars, per_doc(_SYMBOL[raw]), lines - unlike, by_word[0], per_doc(_MARK[raw]), per_doc(capitals), by_word[1], lines], axis=1).astype(np.int64)


def with_measures(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of `docs` (without the text, if asked) and those of MEASURES, each with two underscores before its name; null counts as empty."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in slices(batches, text_col):
            columns = measure(raw, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(c) for c in columns.T)], [*(f.name for f in kept), *(f"__{m}" for m in MEASURES)])

    return docs.mapInArrow(run, StructType([*kept, *(StructField(f"__{m}", LongType()) for m in MEASURES)]))


def binomial_tail(hits: int, trials: int, p: float) -> float:
    """The probability of at most `hits` successes: the regularised incomplete beta function I(1-p; trials-hits, hits+1), by its continued fraction."""
    if hits >= trials or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = trials - hits, hits + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from the front by ratios of its numerators and denominators."""
    tiny = 1e-300
    upper, lower = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value, m = lower, 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            lower = 1 / ((1 + term * lower) or tiny)
            upper = (1 + term / upper) or tiny
            value *= upper * lower
        if abs(upper * lower - 1) < 1e-14 or m > 100_000:
            return value
        m += 1


def binomial_bound(hits: int, trials: int, alpha: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a rate, at level 1 - alpha."""
    if hits >= trials:
        return 1.0
    low, high = hits / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(hits, trials, mid) > alpha else (low, mid)
    return high


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < 20 or 100 * {prefix}n_repeat_words > 30 * {prefix}n_words")


def _value(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(f"__{bottom}") > 0, F.col(f"__{top}") / F.col(f"__{bottom}")).otherwise(0.0)


def _proposals(row: dict) -> list[tuple[str, float]]:
    """From the counts of the proposing half of a stratum, for each rule the cutoff that gains most (a tie stays loose), the safest rules first."""
    found = []
    for rule, (_, cuts) in RULES.items():
        shares = [(row[f"{rule}:{k}:1"] / max(row["good"], 1), row[f"{rule}:{k}:0"] / max(row["bad"], 1), c) for k, c in enumerate(cuts)]
        good, bad, cut = max(reversed(shares), key=lambda s: s[1] - GAIN * s[0])
        if bad > GAIN * good:
            found.append((good, -bad, rule, cut))
    return [(rule, cut) for _, _, rule, cut in sorted(found)]


def _limits(spark: SparkSession, strata: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """A row for each stratum: of each rule its cutoff and its place in the order, null where it is off."""
    rows = []
    for stratum, rules in strata.items():
        place = {rule: k for k, (rule, _) in enumerate(rules)}
        rows.append((stratum, *(x for r in RULES for x in ((rules[place[r]][1], place[r]) if r in place else (None, None)))))
    out = spark.createDataFrame(rows, "__stratum string, " + ", ".join(f"__c_{r} double, __k_{r} int" for r in RULES))
    return F.broadcast(out) if len(rows) <= BROADCAST_STRATA else out


def _over(rule: str) -> Column:
    return F.coalesce(_value(rule) > F.col(f"__c_{rule}"), F.lit(False))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id") -> dict[str, list[tuple[str, float]]]:
    """For each stratum with enough labels the rules that hold there, as (rule, cutoff).

    Half of the labelled rows, by a hash of their ids, propose: in each stratum the cutoff of each rule that gains most there, and an
    order of these rules. The other half proves: the rules are tried in that order, each together with those before it, and the first
    whose exact binomial bound of good rows that any of them rejects is over RISK ends the sequence. A sequence needs no correction in
    itself; between the strata the level is divided by their number (Bonferroni). So with probability CONFIDENCE, in all strata at once,
    the rules together reject at most RISK of the good documents that pass the base rule. Strata with fewer than LEAST_GOOD good rows in
    the second half, or none, have no rules. A document with several labels counts as bad if one says so; null labels are left out.
    """
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__good"))
    tops = sorted({c for rule, _ in RULES.values() for c in rule.split(" / ")})
    rows = measured.where(~base_failed("__")).select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum), F.lit("")).alias("__stratum"), *(f"__{c}" for c in tops)).join(quality, "__id")
    rows = stored(rows.withColumn("__proves", F.pmod(F.xxhash64("__id"), F.lit(2)) == 1), "labelled")
    cells = [F.count_if((F.col("__good") == g) & (_value(r) > c)).alias(f"{r}:{k}:{g}") for r, (_, cuts) in RULES.items() for k, c in enumerate(cuts) for g in (0, 1)]
    proving = rows.where("__proves and __good = 1").groupBy("__stratum").agg(F.count("*").alias("proving")).where(F.col("proving") >= LEAST_GOOD)
    grid = rows.where("not __proves").groupBy("__stratum").agg(F.count_if(F.col("__good") == 1).alias("good"), F.count_if(F.col("__good") == 0).alias("bad"), *cells)
    own = [r.asDict() for r in grid.join(proving, "__stratum").orderBy("__stratum").collect()]
    proposed = {r["__stratum"]: _proposals(r) for r in own}
    if not own:
        return {}
    step = F.least(*(F.when(_over(r), F.col(f"__k_{r}")).otherwise(len(RULES)) for r in RULES))
    tried = rows.where("__proves and __good = 1").join(_limits(measured.sparkSession, proposed), "__stratum").groupBy("__stratum", step.alias("step")).count()
    hits = {(r["__stratum"], r["step"]): r["count"] for r in tried.collect()}
    level = (1 - CONFIDENCE) / len(own)
    found = {}
    for row in own:
        name, wrong, kept = row["__stratum"], 0, []
        for k, pair in enumerate(proposed[name]):
            wrong += hits.get((name, k), 0)
            if binomial_bound(wrong, row["proving"], level) > RISK:
                break
            kept.append(pair)
        found[name] = kept
    return found


def verdict(measured: DataFrame, cutoffs: dict[str, list[tuple[str, float]]], stratum: str = "lang") -> DataFrame:
    """`measured` with __base_failed, __reason (the first rule that rejects, or null) and __kept; in a stratum without cutoffs only the base rule rejects."""
    out = measured.withColumn("__stratum", F.coalesce(F.col(stratum), F.lit(""))).join(_limits(measured.sparkSession, cutoffs), "__stratum", "left").withColumn("__base_failed", base_failed("__"))
    reason = F.coalesce(F.when(F.col("__base_failed"), F.lit("base")), *(F.when(_over(r), F.lit(r)) for r in RULES))
    return out.withColumn("__reason", reason).withColumn("__kept", F.col("__reason").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with its columns. Cutoffs are learned from the labelled rows of `docs`.

    Empty texts fail the base rule; equal rows share their fate; an empty table stays empty.
    """
    narrow = stored(with_measures(docs.select("doc_id", "lang", "text"), keep_text=False), "measures")
    cutoffs = choose_cutoffs(narrow, labels)
    packed, unpacked = shielded(docs, "doc_id", "lang", "text")
    return unpacked(verdict(with_measures(packed), cutoffs).where("__kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stored(with_measures(docs, keep_text=False), "measures")
    judged = verdict(measured, choose_cutoffs(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(F.col(f"__{m}").alias(m) for m in MEASURES[:5]), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__reason").alias("reason"))
