"""Spelling variants, license scans and centroid clusters against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewright.llm import centroids, licenses, spelling

SCHEMA = "doc_id long, text string, word string, n int, label string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def slips(rows, slip, least):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts, ratio):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, counts[w], len(near[w]), form[w] or "", counts[form[w]] if form[w] else 0, root(w)) for w in counts)


def groups_of(frame):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bag = ["banana", "Bananas", "banane", "bananna", "aaaaaaa", "aaaaaa", "aaaaaaaa", "élèves", "élève", "eleves", "×÷××÷×", "co-operate", "operate", "ßtraße", "漢字漢字漢字"]
    rows = [(k, " ".join(rng.choice(bag) + rng.choice(["", "", ".", "é"]) for _ in range(rng.randrange(1, 80)))) for k in range(60)]
    return [*rows, rows[0], (None, "banana banana"), (91, None), (92, ""), (93, "x" * 5000 + " " + "banana " * 300), (94, "abcé"), (95, "éabc" + "\n" + "y" * 12)]


def test_slipped_words(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("x"))
    for slip, least in ((199, 6), (3, 2)):
        got = {r["word"]: r["n"] for r in spelling.slipped_words(docs, slip, least).groupBy("word").agg(F.sum("n").alias("n")).collect()}
        assert got == slips(texts, slip, least)


def test_spelling_groups_against_brute_force(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé🙂") for _ in range(rng.randrange(2, 9))) for _ in range(500)}
    counts = {w: rng.choice((1, 1, 2, 5, 9, 30, 200, 1000)) for w in sorted(words)}
    counts["ab"] = counts.get("ab", 3)
    rows = [(None, None, w, n, None) for w, n in counts.items()] + [(None, None, None, 7, None)]
    assert groups_of(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), ratio=5)) == brute_groups(counts, 5)


def test_each_pair_is_met_once_and_chains_end(spark):
    words = [("aaaaaa", 5), ("aaaaaaa", 30), ("aaaaaaaa", 200), ("aaaaaaaaa", 1200), ("a", 9), ("b", 90), ("", 3), ("aaaaaa", 1)]
    frame = spark.createDataFrame(words, "word string, n int")
    assert spelling.near_pairs(frame.groupBy("word").agg(F.sum("n").alias("n"))).count() == 3
    assert {r["word"]: r["root"] for r in spelling.spelling_groups(frame).collect()} == {**dict.fromkeys(["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"], "aaaaaaaaa"), "a": "a", "b": "b", "": ""}
    assert spelling.spelling_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_what_grows_with_the_words_is_not_broadcast(spark, adaptive):
    """Spark takes the grams of words for no larger than the words' files."""
    frame = spark.createDataFrame([("a" * k, 10**k) for k in range(6, 10)], "word string, n long")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        grouped = spelling.spelling_groups(frame)
        assert grouped.count() == 4
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in (grouped, spelling.near_pairs(frame.groupBy("word").agg(F.sum("n").alias("n"))))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [("SortMergeJoin" in p, "Broadcast" in p) for p in plans] == [(True, False)] * 2


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text, phrases, templates, share):
    found, at, base, more = WORDS.findall(lowered(text)), [], set(), {}
    for phrase, label in phrases:
        p = phrase.split()
        here = [k for k in range(len(found)) if found[k : k + len(p)] == p]
        at += here
        base |= {label} if here else set()
    for label, notice in templates:
        words = WORDS.findall(lowered(notice))
        own, span = set(words), max(16, 2 ** math.ceil(math.log2(len(words))))
        for k in range(0, len(found), span):
            both = len(own & set(found[k : k + 2 * span]))
            if both >= math.ceil(share * len(own) - 1e-9):
                more[label] = max(more.get(label, 0), both / len(own))
    return (len(found), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | set(more)), 1.0 if base else max(more.values(), default=0.0))


def test_license_scan_against_brute_force(spark):
    rng = random.Random(8)
    notices = [t for _, t in licenses.TEMPLATES]
    bag = sorted({w for t in notices for w in WORDS.findall(lowered(t))})
    texts = ["cc by cc by CC-BY mit\nlicense gnu general public gnu general public license", "MITlicense", None, "", "...", "Apache  License", "İ Kcc by"]
    for notice in notices:
        words = notice.split()
        texts += [notice, " ".join(["pad"] * rng.randrange(70) + words + ["end"] * 50), " ".join(w for w in words if rng.random() > 0.06), notice.upper().replace(" ", "\n")]
    texts += [" ".join(rng.choice(bag) for _ in range(rng.choice((5, 200, 3000)))) for _ in range(12)]
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, notices[2], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for share in (0.9, 0.6):
        got = {}
        for r in licenses.scanned(docs, containment=share).collect():
            value = (r["__n_words"], r["__n_base"], r["__first_word"], r["__last_word"], r["__base_labels"], r["__labels"], r["__score"])
            assert value == brute_scan(r["text"], licenses.PHRASES, licenses.TEMPLATES, share)
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert sum(got.values()) == len(rows)
    assert licenses.scanned(docs.limit(0)).count() == 0
    assert licenses.scanned(docs, templates=[("none", "...")]).where("size(__labels) > size(__base_labels)").count() == 0


def brute_lloyd(vectors, clusters, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    places = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(places))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(places)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == k]
            if members:
                places[k] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return sorted(((-1 if i is None else i), nearest(v)[1], nearest(v)[0]) for i, v in kept), places


@pytest.mark.parametrize("big", [1.0, 3e5])
def test_lloyd_against_brute_force(spark, big):
    rng = random.Random(4)
    vectors = [(k, [rng.choice((-1, 0, 1)) * rng.random() * big for _ in range(4)]) for k in range(80)]
    vectors += [vectors[3], (3, [0.0] * 4), (None, [0.5] * 4), (101, None), (102, [1.0]), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors], "vec_id long, embedding array<double>, cluster int, x int").repartition(3)
    rows = centroids.scaled(frame, 4, 256)
    for clusters, rounds in ((6, 3), (200, 1), (1, 2)):
        first = centroids.first_centroids(rows, clusters, "2")
        found, last = centroids.lloyd(rows, first, rounds, block_dims=3, chunk=7)
        expected, places = brute_lloyd(vectors, clusters, rounds, "2")
        assert last.tolist() == places
        got = centroids.cluster_report(found, last).collect()
        assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got) == expected
        assert {r["inertia"] for r in got} == {sum(e[2] for e in expected)}
        assert all(r["cluster_inertia"] == sum(e[2] for e in expected if e[1] == r["cluster"]) for r in got)


def test_queries_on_empty_and_odd_tables(spark, tmp_path):
    from linewright.llm.queries import QUERIES

    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/e/embeddings.parquet")
    spark.createDataFrame([(1, [1.0] * 64, 0), (2, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/o/embeddings.parquet")
    for name in ("op11_spelling_variants", "op12_license_scan", "op13_centroid_clusters"):
        assert QUERIES[name](spark, f"{tmp_path}/e").count() == 0
    assert [(r["cluster"], r["distance"]) for r in QUERIES["op13_centroid_clusters"](spark, f"{tmp_path}/o").collect()] == [(0, 0)]
