"""Invertible Bloom lookup sketches of documents, in DataFrame operations only.

A text is cut into paragraph cells: its lines, in pieces of few words that end where their content says so. The digests of the cells are a set. A sketch of a set has three
subtables; each digest goes to one cell of each, where a count, the XOR of digests and the XOR of their checks are kept. The sketches
of two versions subtract, what both have cancels, and peeling gives the digests that differ: a cell whose count is one either way and
whose check agrees holds one digest, which is then taken out of the other two subtables. The smallest sketch is the fingerprint. Two
fingerprints that differ in more than it can hold are tried again as larger sketches of the same digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import scratch, stored, table

#: Most words of a cell, which ends with a word of a certain kind: its last two characters are of Latin-1 and have these remainders by 4, as one word in about twelve has, or it ends a clause in another script.
CELL_WORDS = 64
CUT = (1, 0)
CLAUSE = ".,;:!?،؛؟۔。"
_SPACE, _WORD = r"[\x20\x09\x0B-\x0D]++", r"[^\x20\x09-\x0D]++"
_ENDS = ["".join(rf"\x{c:02X}" for c in range(0x21, 0x100) if c % 4 == remainder) for remainder in CUT]
#: Words that end no cell, up to the most, and one more. What ends a cell is in its own text, so a word put in or taken out changes the cells around it alone.
_CELL = rf"(?:{_WORD}(?<![{_ENDS[0]}][{_ENDS[1]}]|[\x{{100}}-\x{{10FFFF}}][{CLAUSE}]){_SPACE}){{0,{CELL_WORDS - 1}}}{_WORD}"
#: Cells of each subtable of the fingerprint; rounds of peeling; room for each digest when a pair is tried again.
PRINT_WIDTH = 8
ROUNDS = 9
ROOM = 2.0
#: Attempts, each after the second with twice the cells of the one before; what then is left is compared digest by digest.
ATTEMPTS = 6
#: Text bytes that a bucket of neighbouring ids holds, the most buckets that a table may be written in, and the most edges of buckets that are broadcast.
BUCKET_BYTES = 8_000_000
TABLE_BUCKETS = 50_000
BROADCAST_EDGES = 4_000_000
#: Pairs that a later attempt may broadcast.
BROADCAST_PAIRS = 500_000


def digests(text: str) -> Column:
    """The distinct digests of the paragraph cells of a text column; none for a text without words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(_CELL), F.lit(0)), lambda cell: F.xxhash64(cell)))


def sketch(hashes: str, width: int = PRINT_WIDTH) -> Column:
    """The cells (n, k, c) of a sketch of an array of digests, three subtables one after the other."""
    placed = f"transform({hashes}, h -> named_struct('k', h, 'c', {_check('h')}, 'p', array({', '.join(_place(str(t), 'h', str(width)) for t in range(3))})))"
    one = "element_at(transform(array(filter(placed, x -> x.p[t] = j)), f -> named_struct('n', cast(size(f) as long), 'k', aggregate(f, 0L, (a, x) -> a ^ x.k), 'c', aggregate(f, 0L, (a, x) -> a ^ x.c))), 1)"
    return F.expr(f"element_at(transform(array({placed}), placed -> flatten(transform(sequence(0, 2), t -> transform(sequence(0, {width - 1}), j -> {one})))), 1)")


def printed(cells: str) -> Column:
    """A sketch as text; equal sets give equal texts."""
    return F.expr(f"array_join(transform({cells}, x -> concat_ws(':', hex(x.n), hex(x.k), hex(x.c))), ',')")


def _bucketed_ids(texts: DataFrame) -> tuple[DataFrame, int]:
    """`texts` with `bucket`, which grows with doc_id, and the number of buckets, by approximate quantiles in two levels."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BUCKET_BYTES))
    if n == 1:
        return texts.withColumn("bucket", F.lit(0).cast("long")), 1
    coarse = int(n**0.5)
    fine = -(-n // coarse)
    cuts = texts.select(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)] or [0.5], 20 * coarse)).first()[0] or []
    edges = ", ".join(f"{x}L" for x in sorted(set(cuts)))
    rough = texts.withColumn("coarse", F.coalesce(F.expr(f"size(filter(array({edges}), b -> b <= doc_id))") if edges else F.lit(0), F.lit(0)))
    inner = rough.groupBy("coarse").agg(F.percentile_approx("doc_id", [k / fine for k in range(1, fine)] or [0.5], 20 * fine).alias("edges"))
    inner = stored(inner.select("coarse", F.array_sort(F.array_distinct("edges")).alias("edges")), "edges")
    placed = rough.join(F.broadcast(inner) if n <= BROADCAST_EDGES else inner, "coarse", "left")
    bucket = F.col("coarse").cast("long") * (fine + 1) + F.coalesce(F.expr("size(filter(edges, b -> b <= doc_id))"), F.lit(0))
    return placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket).cast("long")).drop("coarse", "edges"), n


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, place, doc_id, text, next_text) in ascending doc_id (ties by text, nulls first), after the last the first; and the number of buckets.

    The ids are dealt by approximate quantiles into buckets of bounded size, so there is one shuffle of the texts, and only the last row of
    each bucket needs the first of another.
    """
    texts, n = _bucketed_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = texts.repartition(n, "bucket").select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("doc_id"))
    firsts = stored(texts.groupBy("bucket").agg(F.min(key).alias("first")).select("bucket", F.col("first.doc_id").alias("first_id")), "firsts")
    every = Window.orderBy("bucket")  # a row for each bucket only
    after = firsts.select("bucket", F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(every)).alias("after"))
    heads = texts.join(F.broadcast(firsts.withColumnRenamed("bucket", "of")) if n <= BROADCAST_EDGES else firsts.withColumnRenamed("bucket", "of"), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy(F.col("bucket").alias("after")).agg(F.min("text").alias("first_text"))
    first_texts = after.join(heads, "after").select("bucket", "first_text")
    return rows.join(first_texts, "bucket", "left").withColumn("next_text", F.coalesce("next_text", "first_text")).drop("first_text"), n


def _place(t: str, key: str, width: str = "width") -> str:
    return f"pmod(xxhash64({key}, {t}), {width})"


def _check(key: str) -> str:
    return f"xxhash64({key}, 77L)"


_KEY = ("key", "pair")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY, "cell").agg(F.max("width").alias("width"), F.sum("n").alias("n"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(c)").alias("c")).where("n != 0 or k != 0 or c != 0")


def subtracted(pairs: DataFrame) -> DataFrame:
    """For rows (key, pair, width, ours, theirs), the last two arrays of digests, the cells of their sketches' difference: rows (key, pair, width, cell, n, k, c).

    Rows must be distributed by key already for the sums to need no shuffle.
    """
    entry = "transform({0}, h -> named_struct('h', h, 's', {1}L))"
    entries = pairs.select(*_KEY, "width", F.explode(F.expr(f"concat({entry.format('ours', 1)}, {entry.format('theirs', -1)})")).alias("e")).select(*_KEY, "width", F.col("e.h").alias("k"), F.col("e.s").alias("n"))
    spread = entries.withColumn("c", F.expr(_check("k"))).withColumn("cell", F.explode(F.expr("array(" + ", ".join(f"{t}L * width + {_place(str(t), 'k')}" for t in range(3)) + ")")))
    return _summed(spread)


def peel(cells: DataFrame, keep: bool = False) -> DataFrame:
    """For cells of differences as of `subtracted` rows of the same key that tell what peeling found.

    cell -1 counts the digests that only ours has, -2 (negative) those that only theirs has; cells from 0 on are left over, so that pair
    failed. With `keep` each digest found is a row of its own, with cell below -2, the digest as k and the side as n.
    """
    for turn in range(ROUNDS):
        t = turn % 3
        others = [o for o in range(3) if o != t]
        pure = f"cell >= {t}L * width and cell < {t + 1}L * width and abs(n) = 1 and c = {_check('k')}"
        found = "-3L - (k & 4611686018427387903L)" if keep else "case when n > 0 then -1L else -2L end"
        taken = ", ".join(f"named_struct('cell', {o}L * width + {_place(str(o), 'k')}, 'n', -n, 'k', k, 'c', c)" for o in others)
        split = f"case when {pure} then array({taken}, named_struct('cell', {found}, 'n', n, 'k', k, 'c', c)) else array(named_struct('cell', cell, 'n', n, 'k', k, 'c', c)) end"
        cells = _summed(cells.select(*_KEY, "width", F.explode(F.expr(split)).alias("e")).select(*_KEY, "width", "e.cell", "e.n", "e.k", "e.c"))
    return cells


def peeled(ours: str, theirs: str, width: int = PRINT_WIDTH) -> str:
    """SQL for what peeling finds in the difference of two fingerprints' cells: a struct (done, ours_only, theirs_only)."""
    pure = f"abs(x.n) = 1 and x.c = {_check('x.k')}"
    hit = f"filter(pure, p -> {_place('cast(i div ' + str(width) + ' as int)', 'p.k', str(width))} = i % {width})"
    taken = f"element_at(transform(array({hit}), h -> named_struct('n', x.n - aggregate(h, 0L, (a, p) -> a + p.n), 'k', aggregate(h, x.k, (a, p) -> a ^ p.k), 'c', aggregate(h, x.c, (a, p) -> a ^ p.c))), 1)"
    cells = f"transform(s.cells, (x, i) -> if(i div {width} = turn % 3, if({pure}, named_struct('n', 0L, 'k', 0L, 'c', 0L), x), {taken}))"
    step = f"element_at(transform(array(filter(slice(s.cells, (turn % 3) * {width} + 1, {width}), x -> {pure})), pure -> if(size(pure) = 0, s, named_struct('cells', {cells}, 'a', s.a + size(filter(pure, p -> p.n = 1)), 'b', s.b + size(filter(pure, p -> p.n = -1))))), 1)"
    start = f"named_struct('cells', zip_with({ours}, {theirs}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'c', a.c ^ b.c)), 'a', 0L, 'b', 0L)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, turn) -> {step}, s -> named_struct('done', not exists(s.cells, x -> x.n != 0 or x.k != 0 or x.c != 0), 'ours_only', s.a, 'theirs_only', s.b))"


def likeness(rows: DataFrame, pairs: list[tuple[str, str]]) -> list[DataFrame]:
    """Frames of rows (key, pair, ours_only, theirs_only), the last two null for 0, one for each attempt with the pairs that it solved.

    `rows` is distributed by key and has for each name in `pairs` an array of digests, and `first`, an array of what peeling the fingerprints
    found for each pair. A pair whose difference they cannot hold is tried again with sketches sized by both sets, then with
    twice the cells each time, and at last, exactly, by the arrays.
    """
    listed = [F.struct(F.lit(k).alias("pair"), F.col(a).alias("ours"), F.col(b).alias("theirs"), F.element_at("first", k + 1).alias("first")) for k, (a, b) in enumerate(pairs)]
    every = rows.select("key", F.explode(F.array(*listed)).alias("p")).select("key", "p.*")
    solved = [every.where("first.done").select(*_KEY, "first.ours_only", "first.theirs_only")]
    each = every.where("not first.done").drop("first")
    for attempt in range(1, ATTEMPTS):
        width = F.expr(f"cast(greatest({2 * PRINT_WIDTH}, ceil((size(ours) + size(theirs)) * {ROOM / 3})) * {2 ** (attempt - 1)} as long)")
        state = peel(subtracted(each.withColumn("width", width))).groupBy(*_KEY).agg(F.max("cell").alias("left"), F.sum(F.when(F.col("cell") == -1, F.col("n"))).alias("ours_only"), F.sum(F.when(F.col("cell") == -2, -F.col("n"))).alias("theirs_only"))
        state = stored(state, "peeled")
        solved.append(state.where("left < 0").drop("left"))
        todo = state.where("left >= 0").select(*_KEY)
        n = todo.count()
        if not n:
            return solved
        each = each.join(F.broadcast(todo) if n <= BROADCAST_PAIRS else todo, list(_KEY), "left_semi")
    count = lambda a, b: F.size(F.array_except(a, b)).cast("long")
    return [*solved, each.select(*_KEY, count("ours", "theirs").alias("ours_only"), count("theirs", "ours").alias("theirs_only"))]


def op4_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents` and of their edited texts, and their likeness as sets: twice the common digests over all digests.

    A null text is empty; two empty sets are alike (1). Repeated rows each have the next row of the order as neighbour.
    """
    near, n = neighbours(table(spark, sf_dir, "documents"))
    edited = near.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 4) as int)), left(next_text, cast(floor(n_chars / 4) as int)))"))
    rows = edited.select(F.expr("shiftleft(bucket, 32) + place").alias("key"), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("new"), digests("next_text").alias("next"))
    first = F.expr(f"element_at(transform(array(named_struct('own', sketch_own, 'new', sketch_new, 'next', sketch_next)), f -> array({peeled('f.own', 'f.new')}, {peeled('f.own', 'f.next')})), 1)")
    rows = rows.withColumns({f"sketch_{x}": sketch(x) for x in ("own", "new", "next")}).withColumn("first", first).drop("sketch_own", "sketch_new", "sketch_next")
    kept = _bucketed(rows, min(n, TABLE_BUCKETS))
    every, *more = likeness(kept, [("own", "new"), ("own", "next")])
    for part in more:
        every = every.union(part)
    gone = every.groupBy("key").agg(*(F.sum(F.when(F.col("pair") == k, F.coalesce("ours_only", F.lit(0)) + F.coalesce("theirs_only", F.lit(0)))).alias(f"gone_{k}") for k in (0, 1)))
    both = kept.join(gone, "key", "left").select("doc_id", "n_chars", "edited_sha256", sketch("own").alias("sketch_own"), sketch("new").alias("sketch_new"), F.expr("size(own) + size(new)").alias("all_0"), F.expr("size(own) + size(next)").alias("all_1"), "gone_0", "gone_1")
    alike = [F.when(F.col(f"all_{k}") > 0, 1 - F.coalesce(f"gone_{k}", F.lit(0)) / F.col(f"all_{k}")).otherwise(1.0).alias(name) for k, name in enumerate(("near_edited", "near_next"))]
    return both.select("doc_id", "n_chars", "edited_sha256", printed("sketch_own").alias("fingerprint"), printed("sketch_new").alias("edited_fingerprint"), *alike)


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """The rows as a table in the shared folder that is bucketed by key, so that later sums and joins by key need no shuffle of them."""
    spark = rows.sparkSession
    name = f"sketch_{uuid.uuid4().hex}"
    rows.repartition(n, "key").write.bucketBy(n, "key").option("path", scratch(spark, "sketch")).saveAsTable(name)
    return spark.table(name)
