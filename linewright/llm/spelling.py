"""Groups of spelling variants: an edit-distance join of words by asymmetric q-chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import _LOWER, slices, span_hashes, stored, table

#: A form must be so many times as frequent as the word it stands for.
RATIO = 5
#: Bytes of text whose words are counted at once before Spark adds the counts up.
SLICE = 4_000_000
#: Production parameters of the query: of how many runs one loses a code point, the least code points and the least occurrences of a word.
SLIP, LEAST_CHARS, LEAST_N = 199, 6, 5


def chunks(word: Column) -> Column:
    """The two disjoint chunks of a word of n code points, each of q = n div 2, as structs (n, m, pos, gram, rank) for each length m of a partner and each place where an insertion can have put the chunk in it. `rank` orders them, so that a pair can be kept at its first match alone."""
    n = F.length(word)
    q = F.floor(n / 2).cast("int")
    first, second = F.substring(word, F.lit(1), q), F.substring(word, q + 1, q)
    places = [(0, first, 0, 0), (0, second, 0, 1), (1, first, 0, 0), (1, first, 1, 1), (1, second, 0, 2), (1, second, 1, 3)]
    return F.array(*(F.struct(n.alias("n"), (n + more).alias("m"), ((F.lit(0) if gram is first else q) + shift).alias("pos"), gram.alias("gram"), F.lit(rank).alias("rank")) for more, gram, shift, rank in places))


def grams(word: Column) -> Column:
    """All positional grams of a word of m code points, as structs (n, m, pos, gram), for partners of n = m and of n = m - 1 code points."""
    m = F.length(word)

    def of(n: Column) -> Column:
        q = F.floor(n / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), m - q), lambda p: F.struct(n.alias("n"), m.alias("m"), p.alias("pos"), F.substring(word, p + 1, q).alias("gram")))

    return F.concat(of(m), F.when(m > 2, of(m - 1)).otherwise(F.filter(of(m), lambda _: F.lit(False))))


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, a_n, b, b_n), one for each two rows of the distinct words (word, n) that differ by one inserted, deleted or replaced code point; a is the shorter, of equal lengths the smaller.

    The shorter word gives two disjoint chunks, the other all its grams with their places. One edit leaves a chunk as it is, at its place
    or one further (behind an insertion), so an equality join on lengths, place and gram finds every pair, and only such pairs are
    verified. A pair that meets in several ways counts at the first of them. The join has no key but these four; sorted partitions
    that a frequent gram makes large are split by Spark, which is told to merge: it takes the grams for no larger than the stored words
    that they come from and would send them through the driver. Words of fewer than two code points have no pairs.
    """
    words = words.where(F.length("word") >= 2)
    left = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(chunks(F.col("word"))).alias("k")).select("a", "a_n", "k.*")
    right = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(grams(F.col("word"))).alias("k")).select("b", "b_n", "k.*")
    met = left.join(right.hint("merge"), ["n", "m", "pos", "gram"]).where("(n < m or a < b) and levenshtein(a, b, 1) = 1")
    q, at = F.floor(F.col("n") / 2).cast("int"), lambda word, p: F.substring(F.col(word), p + 1, F.floor(F.col("n") / 2).cast("int"))
    zero = F.lit(0)
    ways = [at("b", zero) == at("a", zero), at("b", zero + 1) == at("a", zero), at("b", q) == at("a", q)]
    seen = F.when(F.col("n") == F.col("m"), (F.col("rank") == 1) & ways[0]).otherwise(((F.col("rank") > 0) & ways[0]) | ((F.col("rank") > 1) & ways[1]) | ((F.col("rank") > 2) & ways[2]))
    return met.where(~seen).select("a", "a_n", "b", "b_n")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of words (word, n).

    n_near counts the words one edit away. The form of a word is the most frequent of them (ties: the smallest), if it is at least
    `ratio` (more than 1) times as frequent; the root is where following forms ends, the word itself if it has none. Frequencies grow along the way,
    so it has no circle and few steps. Rows of the same word are added up, null words are left out, other columns are ignored;
    an empty table gives no rows. Nothing that grows with the words is broadcast: stored words take several times their files' size in memory.
    """
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")), "words")
    both = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    own = words.join(best.hint("merge"), "word", "left")
    good = -F.col("top.minus") >= ratio * F.col("n")
    formed = stored(own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("top.near")).alias("form"), F.when(good, -F.col("top.minus")).alias("form_n")), "forms")
    return formed.join(roots(formed.where("form is not null").select("word", "form")).hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame) -> DataFrame:
    """Rows (word, root) of links (word, form) without circles: each round every word takes the end that its present end has, so the steps halve."""
    ends = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(ends.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return ends


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of [A-Za-z\\u00C0-\\u00FF] in texts, and the text of each. The latter letters are the byte C3 and one after it, in UTF-8."""
    lower = raw | 32
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] == 0xC3
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ((lower >= 97) & (lower <= 122)) | (raw == 0xC3) | second
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text's end cuts a run that would go on in the next text
    starts = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | edge))
    ends = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _crc_table() -> np.ndarray:
    """The table of CRC-32 (polynomial EDB88320), from its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of lower-cased spans that follow what `seeds` are the CRC-32 of, all spans one byte further at a time."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, size = starts[order], (ends - starts)[order]
    state = ~seeds[order]
    longest = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(longest), "left")  # how many have a byte at each place
    for k, n in enumerate(left):
        state[:n] = _CRC[(state[:n] ^ _LOWER[raw[at[:n] + k]]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def slipped_words(docs: DataFrame, slip: int = SLIP, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Rows (word, n), not yet added up, of the letter runs of texts (doc_id, text), in lower case (A-Z only): where `slip` divides the CRC-32 of `<doc_id>:<run>`, the run has lost the code point at that number modulo its length. Words of fewer code points than `least_chars` are left out. A null text has no runs, a null id is an empty one."""
    import zlib

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in slices(batches, "text", SLICE):
            starts, ends, owner = _letters(raw, offsets)
            if not len(starts):
                continue
            seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
            crc = _crcs(raw, starts, ends, seeds[owner])
            slips = crc % np.uint32(slip) == 0
            chars = (np.cumsum(np.append(0, (raw & 0xC0) != 0x80)))[np.stack([starts, ends])]
            size = chars[1] - chars[0]
            whole = ~slips & (size >= least_chars)
            hashes = span_hashes(raw, starts[whole], ends[whole], lower=True)
            _, first, n = np.unique(hashes, return_index=True, return_counts=True)
            data = _LOWER[raw].tobytes()
            found = [data[a:b].decode() for a, b in zip(starts[whole][first].tolist(), ends[whole][first].tolist(), strict=True)]
            counts = n.tolist()
            odd = np.flatnonzero(slips & (size > least_chars))
            for a, b, h in zip(starts[odd].tolist(), ends[odd].tolist(), crc[odd].tolist(), strict=True):
                word = data[a:b].decode()
                at = h % len(word)
                found.append(word[:at] + word[at + 1 :])
                counts.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all `documents` with at least 6 code points and 5 occurrences, their near words, forms and roots."""
    counted = slipped_words(table(spark, sf_dir, "documents")).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)
    return spelling_groups(counted).select("word", "form", "root", "n", "n_near", "form_n")


_CRC_SQL = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))"

OP11_SQL = f"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) AS r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (SELECT run, n, xor({_CRC_SQL}, 4294967295) AS h FROM each, bytes),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_N}),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cut AS c JOIN words AS w ON c.rest = w.word),
near AS (SELECT long AS word, short AS near, short_n AS near_n FROM pairs UNION ALL SELECT short, long, long_n FROM pairs
  UNION ALL SELECT DISTINCT a.word, b.word, b.n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS top, max(near_n) AS top_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {RATIO} * n THEN top END AS form, CASE WHEN top_n >= {RATIO} * n THEN top_n END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, form AS next FROM forms UNION ALL SELECT way.word, forms.word, forms.form FROM way JOIN forms ON way.next = forms.word)
SELECT word, form, here AS root, n, n_near, form_n FROM forms JOIN (SELECT word, here FROM way WHERE next IS NULL) USING (word)"""
