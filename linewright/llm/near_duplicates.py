"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by at least 80 per cent, and the classes that such links form.

Equal sets are one class from the start, so copies cost one row each. Each class emits the rarest fifth of its n-grams (frequencies come
from a table of counters that grows with the input up to a bounded size, which any order keeps right and a good one keeps fast); classes that share one of these meet,
pass length, positional and suffix filters, and are verified once per pair on their whole sets. In each group all members meet its first
few, the pivots, which is all pairs of a small group. Of large groups then members in different components are compared, in blocks
of bounded size, so no link between components is lost. When the components are known, the members of large groups in each are compared,
all pairs, in blocks of whole sets that give counts alone, so every class has all of its links counted and no row is made per link.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix, scratch, shielded, shingles, slices, span_hashes, stored, table, words

NGRAM = 5
#: Similarity in hundredths.
PER_CENT = 80
#: Bytes of text for each counter of n-gram frequencies, and the least and most counters, as powers of two; counters travel in chunks.
COUNTER_TEXT = 512
COUNTER_BITS = (16, 22)
CHUNK = 1 << 16
#: Parts into which the suffix filter divides a set; it passes sets with a part of 255 or more.
PARTS = 256
#: Members of each group that all others meet at once.
PIVOTS = 8
#: Members of a block of a large group.
BLOCK = 256
#: Bytes of n-grams of a block of whole sets.
BLOCK_BYTES = 2 << 20
SLICE = 1_000_000
#: A filter with so many bits for each id says whose sets are asked for, up to a number of ids that may be broadcast; beyond it texts are joined with the ids. Sets behind one table bucket.
FILTER_BITS = 16
FILTER_IDS = 2_000_000
BUCKET_SETS = 2000
#: Spark allows a table no more buckets than about this.
TABLE_BUCKETS = 50_000


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least size of the intersection of two sets that link."""
    return -(-PER_CENT * (a + b) // (100 + PER_CENT))


def distinct_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each document, one after the other, the sizes, and two digests of each set, [2, document]."""
    starts, ends, bounds = words(raw, offsets)
    grams, owner = shingles(span_hashes(raw, starts, ends, lower=True), bounds, NGRAM)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    sizes = np.bincount(owner, minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    digests = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
        digests.append(mix((sums[at[1:]] - sums[at[:-1]]) + sizes.astype(np.uint64)).view(np.int64))
    return grams, sizes, np.stack(digests)


def classes(digests: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The class of each set: its first digest, or the second where the first is one of those that different sets share."""
    return np.where(np.isin(digests[0], shared), mix(digests[1].view(np.uint64)).view(np.int64), digests[0]) if len(shared) else digests[0]


DESCRIBED = "doc_id long, n_shingles long, cls long, twin long, parts binary, chunk int, counters binary"


def _packed(counters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(counters), CHUNK):
        if counters[k : k + CHUNK].any():
            yield k // CHUNK, zlib.compress(counters[k : k + CHUNK].astype("<i8").tobytes(), 1)


def _describe(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.int32)
        names = [x.split()[0] for x in DESCRIBED.split(", ")]
        for batch, raw, offsets in slices(batches, "text", SLICE):
            grams, sizes, digests = distinct_sets(raw, offsets)
            np.add.at(counters, (grams >> np.uint64(64 - bits)).astype(np.int64), np.int32(1))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            part = (grams % np.uint64(PARTS)).astype(np.int64)
            parts = np.bincount(owner * PARTS + part, minlength=len(sizes) * PARTS)
            parts = np.minimum(parts, 255).astype(np.uint8).reshape(-1, PARTS)
            two = [pa.array(d, pa.int64(), mask=sizes == 0) for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *two, pa.array([x.tobytes() for x in parts], pa.binary()), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names)
        for chunk, blob in _packed(counters):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, counters), added up by chunk; holds a chunk's counters for each chunk that comes along."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(blob), "<i8")
            totals[chunk] = totals[chunk] + own if chunk in totals else own
    for chunk, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "counters"])


def _frequencies(described: DataFrame, bits: int) -> np.ndarray:
    """Eight times the binary logarithm of each counter over all documents, in a byte. Counters are added up inside tasks first, then by chunk."""
    rows = described.where("counters is not null").select("chunk", "counters").mapInArrow(_added, "chunk int, counters binary").repartition("chunk").mapInArrow(_added, "chunk int, counters binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.minimum(255, np.round(8 * np.log2(1.0 + np.frombuffer(zlib.decompress(r["counters"]), "<i8"))))
    return out


def _unseen(digests: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which documents are the first of their class in this task and not empty."""
    fresh = np.zeros(len(digests), bool)
    for k in np.flatnonzero(sizes):
        if (d := int(digests[k])) not in seen:
            seen.add(d)
            fresh[k] = True
    return fresh


def _prefixes(frequency: np.ndarray, shared: np.ndarray):
    shift = np.uint64(64 - int(len(frequency)).bit_length() + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, raw, offsets in slices(batches, "text", SLICE):
            grams, sizes, both = distinct_sets(raw, offsets)
            digests = classes(both, shared)
            fresh = _unseen(digests, sizes, seen)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            grams, owner = grams[fresh[owner]], owner[fresh[owner]]
            order = np.lexsort((grams, frequency[(grams >> shift).astype(np.int64)], owner))
            grams = grams[order]
            firsts = np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))])[:-1]
            place = np.arange(len(grams)) - firsts[owner]
            prefix = sizes - (-(-PER_CENT * sizes // 100)) + 1
            head = place < prefix[owner]
            owner = owner[head]
            yield pa.RecordBatch.from_arrays([pa.array(grams[head].view(np.int64)), pa.array(digests[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(place[head].astype(np.int32))], ["token", "cls", "size", "place"])

    return emit


def _met(columns: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Of the pairs of rows those that pass the length and positional filters, as (a, b) with a < b."""
    _, cls, size, place = columns
    x, y = size[one].astype(np.int64), size[two].astype(np.int64)
    ok = np.minimum(x - place[one], y - place[two]) >= least_overlap(x, y)
    ok &= 100 * np.minimum(x, y) >= PER_CENT * np.maximum(x, y)
    left, right = cls[one[ok]], cls[two[ok]]
    return [np.minimum(left, right), np.maximum(left, right)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and class become the pairs of each group's members with its first PIVOTS (token null) and, from the row after these on, the members themselves.

    Holds a batch, the pivots of the group that it ends in, and that group's size.
    """
    kinds = (np.int64, np.int64, np.int32, np.int32)
    held, count = [np.zeros(0, k) for k in kinds], 0
    last: tuple[int, int] | None = None
    for batch in batches:
        new = [batch.column(k).to_numpy() for k in range(4)]
        fresh = np.ones(len(new[0]), bool)
        fresh[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])
        if len(fresh) and last is not None:
            fresh[0] = (new[0][0], new[1][0]) != last
        if not fresh.any():
            continue
        last = (new[0][-1], new[1][-1])
        n_held = len(held[0])
        columns = [np.concatenate([h, c[fresh]]) for h, c in zip(held, new, strict=True)]
        token = columns[0]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        run = np.repeat(starts, np.diff(np.append(starts, len(token))))
        rank = np.arange(len(token)) - run
        if n_held:
            first = np.searchsorted(run, 0, "right")  # the run that goes on from the batch before
            rank[n_held:first] += count - n_held
        pairs = []
        for k in range(PIVOTS):
            later = np.flatnonzero(rank > k)
            later = later[later >= n_held]
            if not len(later):
                break
            pairs.append(_met(columns, run[later] + k, later))
        rows = np.flatnonzero(rank >= PIVOTS)
        rows = rows[rows >= n_held]
        if pairs:
            both = np.unique(np.stack([np.concatenate([p[k] for p in pairs]) for k in (0, 1)]), axis=1)
            gone = len(rows)
            out = [pa.array(np.concatenate([columns[k][rows], np.zeros(both.shape[1], kinds[k])]), mask=np.arange(gone + both.shape[1]) >= gone) for k in range(4)]
            out += [pa.array(np.concatenate([np.zeros(gone, np.int64), both[k]]), mask=np.arange(gone + both.shape[1]) < gone) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, ["token", "cls", "size", "place", "a", "b"])
        count = int(rank[-1]) + 1
        keep = np.arange(run[-1], min(run[-1] + PIVOTS, len(token)))
        held = [c[keep] for c in columns]


def _sets(wanted: np.ndarray | None, shared: np.ndarray):
    """The whole sets of the documents that the filter `wanted` lets through, or of all; and as 16-bit hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, raw, offsets in slices(batches, "text", SLICE):
            grams, sizes, both = distinct_sets(raw, offsets)
            digests = classes(both, shared)
            at = np.concatenate([[0], np.cumsum(sizes)])
            asked = sizes
            if wanted is not None:
                ids = batch.column("doc_id")
                slot = _slot(np.where(np.asarray(ids.is_null()), digests, ids.fill_null(0).to_numpy(zero_copy_only=False)), len(wanted))
                asked = np.where((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1, sizes, 0)
            fresh = np.flatnonzero(_unseen(digests, asked, seen))
            if len(fresh):
                own = [grams[at[k] : at[k + 1]] for k in fresh]
                short = [np.sort(x.astype(np.uint16)).tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(digests[fresh]), pa.array(short, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["cls", "short", "grams"])

    return emit


def _slot(keys: np.ndarray, n_bytes: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - int(8 * n_bytes).bit_length() + 1)).astype(np.int64)


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for each slot of the keys (key), FILTER_BITS slots for each of `n` keys; made by chunk, so that no task holds all."""
    n_bytes = max(CHUNK // 8, 1 << int(n * FILTER_BITS // 8).bit_length())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(), n_bytes)
            yield pa.RecordBatch.from_arrays([pa.array((slot // CHUNK).astype(np.int32)), pa.array((slot % CHUNK).astype(np.int32))], ["chunk", "place"])

    def bits(group: pa.Table) -> pa.Table:
        mask = np.zeros(CHUNK, bool)
        mask[group.column("place").to_numpy()] = True
        return pa.table([group.column("chunk").slice(0, 1), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(n_bytes, np.uint8)
    for r in keys.mapInArrow(numbered, "chunk int, place int").groupBy("chunk").applyInArrow(bits, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _enough(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets may overlap enough, by the sizes of their parts."""
    most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
    full = (left == 255).any(axis=1) | (right == 255).any(axis=1)
    return full | (most >= least_overlap(left.sum(axis=1, dtype=np.int64), right.sum(axis=1, dtype=np.int64)))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, one, two), the two blocks of a group that meet, the pairs in different components that pass all filters."""
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table_ = held
        if batch is not None:
            table_ = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table_ is None or not table_.num_rows:
            continue
        token, one, two, cls, size, place, root, block = (table_.column(k).to_numpy() for k in range(8))
        change = np.flatnonzero((token[1:] != token[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        starts = np.concatenate([[0], change])
        stops = np.append(change, len(token))
        if batch is not None:  # the last run may go on
            held = table_.slice(int(starts[-1]))
            starts, stops = starts[:-1], stops[:-1]
        found = []
        for s, e in zip(starts, stops, strict=True):
            n = e - s
            i, j = np.triu_indices(n, 1)
            i, j = i + s, j + s
            ok = root[i] != root[j]
            if one[s] != two[s]:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            x, y = size[i].astype(np.int64), size[j].astype(np.int64)
            ok = (np.minimum(x - place[i], y - place[j]) >= least_overlap(x, y)) & (100 * np.minimum(x, y) >= PER_CENT * np.maximum(x, y))
            if ok.any():
                i, j = i[ok], j[ok]
                parts = np.frombuffer(b"".join(table_.column(8).slice(int(s), int(n)).to_pylist()), np.uint8).reshape(-1, PARTS)
                ok = np.concatenate([_enough(parts[i[k : k + 20_000] - s], parts[j[k : k + 20_000] - s]) for k in range(0, len(i), 20_000)])
                found.append(np.stack([np.minimum(cls[i[ok]], cls[j[ok]]), np.maximum(cls[i[ok]], cls[j[ok]])]))
        if found:
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (root, one, two, cls), the two blocks of a component that meet, how many sets of the other block (of its own, if it meets itself) each class links to.

    Holds the rows of one such run; a class that repeats in it counts once.
    """
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table_ = held
        if batch is not None:
            table_ = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table_ is None or not table_.num_rows:
            continue
        root, one, two, cls, block = (table_.column(k).to_numpy() for k in range(5))
        change = np.flatnonzero((root[1:] != root[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        starts = np.concatenate([[0], change])
        stops = np.append(change, len(root))
        if batch is not None:  # the last run may go on
            held = table_.slice(int(starts[-1]))
            starts, stops = starts[:-1], stops[:-1]
        for s, e in zip(starts, stops, strict=True):
            at = s + np.flatnonzero(np.append(True, cls[s + 1 : e] != cls[s : e - 1]))
            sets = [np.frombuffer(x, np.uint64) for x in table_.column(5).slice(int(s), int(e - s)).take(pa.array(at - s)).to_pylist()]
            counts = _links_among(sets, None if one[s] == two[s] else block[at] == one[s])
            some = np.flatnonzero(counts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(cls[at[some]]), pa.array(counts[some])], ["cls", "n"])


def _links_among(sets: list[np.ndarray], left: np.ndarray | None) -> np.ndarray:
    """How many of the other sets each links to; with `left`, only of those on the other side."""
    sizes = np.array([len(x) for x in sets], np.int64)
    counts = np.zeros(len(sets), np.int64)
    firsts, seconds = (np.arange(len(sets)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    if not len(firsts) or not len(seconds):
        return counts
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    gram_of = [place[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    tiled = np.concatenate([gram_of[k] for k in seconds])
    tile_at = np.concatenate([[0], np.cumsum(sizes[seconds])])[:-1]
    marked = np.zeros(len(distinct), np.int32)
    for k in firsts:
        marked[gram_of[k]] = 1
        common = np.add.reduceat(marked[tiled], tile_at)
        marked[gram_of[k]] = 0
        ok = 100 * common >= PER_CENT * (sizes[k] + sizes[seconds] - common)
        if left is None:
            ok[k] = False
        else:
            counts[seconds[ok]] += 1
        counts[k] += ok.sum()
    return counts


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix filter: sets whose parts, by hash, cannot overlap enough in sum are let go."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("parts_a", "parts_b"))
        ok = _enough(left, right)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _verify(kind: str):
    """Keeps the pairs whose sets overlap enough: of 16-bit hashes (short), where chance can only add, or of whole ones (grams)."""
    dtype = np.uint16 if kind == "short" else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(f"{kind}_a"), batch.column(f"{kind}_b")
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(a[k].as_buffer(), dtype), np.frombuffer(b[k].as_buffer(), dtype)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * common >= PER_CENT * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, root) for the nodes of edges (a, b): the smallest node is not sure to be the root, but each component has one.

    In each round every node moves to its smallest neighbour and edges are drawn anew between the new places; as ids are hashes,
    the number of rounds grows with the logarithm of the longest path.
    """
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        step = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("r")), "step")
        found = step.select("v", F.col("r").alias("root")) if found is None else stored(found.join(step.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("r", "root").alias("root")), "roots")
        edges = edges.join(step.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(step.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        edges = stored(edges.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    n_links counts all links to other classes, not those to copies. A null or empty text, or one without words, has
    an empty set and is a component alone, with its own id. Repeated rows and equal sets are one class. A component's id is its
    smallest non-null doc_id. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(int(size // COUNTER_TEXT).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])
    seen = stored(texts.mapInArrow(_describe(bits), DESCRIBED), "classes")
    described = seen.where("counters is null").drop("chunk", "counters")
    # Of N sets some N * N / 2**65 share their first digest with another: none, or a few that the driver can hold.
    shared = np.array([r["cls"] for r in described.where("cls is not null").groupBy("cls").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a != b").select("cls").collect()], np.int64)
    if len(shared):
        described = described.mapInArrow(_renamed(shared), described.schema)
    rows = texts.select("text").mapInArrow(_prefixes(_frequencies(seen, bits), shared), "token long, cls long, size int, place int")
    groups = stored(rows.repartition(F.col("token")).sortWithinPartitions("token", "cls").mapInArrow(_shared, "token long, cls long, size int, place int, a long, b long"), "groups")
    degree, roots = _link(texts, described, groups, shared)
    keyed = described.select("doc_id", "n_shingles", "cls")
    if degree is not None:
        facts = roots.withColumnRenamed("v", "cls").join(degree, "cls")
        keyed = keyed.join(facts, "cls", "left")
    else:
        keyed = keyed.withColumns({"root": F.lit(None).cast("long"), "n_links": F.lit(None).cast("long")})
    keyed = keyed.withColumn("place", F.coalesce("root", "cls"))
    smallest = keyed.where("place is not null").groupBy("place").agg(F.min("doc_id").alias("component_id"))
    return keyed.join(smallest, "place", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _renamed(shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column("cls").is_null())
            both = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("cls", "twin")])
            at = batch.schema.get_field_index("cls")
            yield batch.set_column(at, "cls", pa.array(classes(both, shared), pa.int64(), mask=none))

    return run


def _link(texts: DataFrame, described: DataFrame, groups: DataFrame, shared: np.ndarray) -> tuple[DataFrame | None, DataFrame | None]:
    """The number of links of each class that has any (cls, n_links) and the roots of their components (v, root); None if no two classes meet."""
    pairs, member = groups.where("token is null").select("a", "b").distinct(), groups.where("token is not null").select("token", "cls", "size", "place")
    if groups.isEmpty():
        return None, None
    classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(member.select("cls")).distinct()
    parts = stored(described.where("cls is not null").join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("parts").alias("parts")), "parts")
    tried = _candidates(pairs, parts)
    sets = _sets_of(texts, described, shared, tried.select(F.explode(F.array("a", "b")).alias("cls")).union(member.select("cls")))
    links = _verified(tried, sets)
    roots = components(links)
    rooted = member.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    count = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
    sizes = count.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    sizes = sizes.select("token", "main", F.expr(f"cast(ceil((n - inside) / {BLOCK}) as int)").alias("outer"), F.expr(f"cast(ceil(inside / {BLOCK}) as int)").alias("inner"))
    mixed = rooted.join(sizes, "token").join(parts, "cls").withColumn("block", F.expr("cast(if(root = main, outer + pmod(xxhash64(cls), inner), pmod(xxhash64(cls), outer)) as int)"))
    placed = mixed.withColumn("other", F.explode(F.expr("sequence(0, if(root = main, outer, outer + inner) - 1)"))).select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "size", "place", "root", "block", "parts")
    rest = placed.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "cls").mapInArrow(_crossed, "a long, b long")
    more = _verified(stored(rest.distinct().join(tried, ["a", "b"], "left_anti"), "pairs"), sets)
    if not more.isEmpty():
        links = links.union(more)
        roots = components(links)
    return _degrees(links, roots, member, sets), roots


def _degrees(links: DataFrame, roots: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (cls, n_links) of all links.

    Pairs that were not tried are of two classes in `member` and, if they link, in one component. So all such pairs are compared
    there, and the links found before count only where one end is not in `member`.
    """
    placed = stored(member.select(F.col("cls").alias("v")).distinct().join(roots, "v").join(sets.groupBy(F.col("cls").alias("v")).agg(F.max(F.length("grams")).alias("bytes")), "v"), "members")
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    sizes = sizes.select("root", F.expr(f"cast(greatest(ceil(n / {BLOCK}), ceil(bytes / {BLOCK_BYTES})) as int)").alias("blocks"))
    blocks = placed.select("root", F.col("v").alias("cls")).join(sizes, "root").withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    whole = blocks.join(sets.select("cls", "grams"), "cls").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    whole = whole.select("root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "block", "grams")
    within = whole.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "cls").mapInArrow(_counted, "cls long, n long")
    inner = placed.select("v", F.lit(True).alias("inner"))
    for side in "ab":
        links = links.join(inner.select(F.col("v").alias(side), F.col("inner").alias(f"inner_{side}")), side, "left")
    outer = links.where("inner_a is null or inner_b is null").select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("n"))
    return stored(within.union(outer).groupBy("cls").agg(F.sum("n").alias("n_links")), "degrees")


def _candidates(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    for side in "ab":
        pairs = pairs.join(parts.select(F.col("cls").alias(side), F.col("parts").alias(f"parts_{side}")), side)
    return stored(pairs.mapInArrow(_may_link, "a long, b long"), "pairs")


def _sets_of(texts: DataFrame, described: DataFrame, shared: np.ndarray, asked: DataFrame) -> DataFrame:
    """The whole sets of the classes in `asked`, made anew from the text of the first document of each, as a table bucketed by class.

    A filter of ids tells the tasks which to give out; it lets through a few more, and some classes more than once. Where there are too many
    ids for a filter, texts are joined with them.
    """
    first = stored(described.where("cls is not null").join(asked.distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "firsts")
    n = first.count()
    if n <= FILTER_IDS:
        sets = texts.mapInArrow(_sets(_filter(first.select(F.coalesce("doc_id", "cls").alias("key")), n), shared), "cls long, short binary, grams binary")
    else:
        ids = first.select("doc_id").distinct()
        sets = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(_sets(None, shared), "cls long, short binary, grams binary")
    name = f"sets_{uuid.uuid4().hex}"
    sets.write.bucketBy(min(TABLE_BUCKETS, max(1, -(-n // BUCKET_SETS))), "cls").option("path", scratch(texts.sparkSession, "sets")).saveAsTable(name)
    return texts.sparkSession.table(name)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link: first by 16-bit hashes, what is left by whole sets."""
    for kind in ("short", "grams"):
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col(kind).alias(f"{kind}_{side}")), side)
        pairs = stored(pairs.mapInArrow(_verify(kind), "a long, b long").distinct(), "links")
    return pairs


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with its columns, one for each component: that with the smallest id, one row if it repeats.

    Rows without an id cannot be told apart from each other and all stay.
    """
    packed, unpacked = shielded(docs, "doc_id", "text")
    found = stored(near_duplicates(packed), "components")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    named = packed.join(first, F.col("doc_id").cast("long") == F.col("__first"), "left_semi").dropDuplicates(["doc_id"])
    if not found.where("doc_id is null").isEmpty():
        named = named.union(packed.where("doc_id is null"))
    return unpacked(named)
