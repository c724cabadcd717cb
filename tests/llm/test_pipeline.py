"""Each stage of the pipeline, and all of them, against brute force on a small corpus."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linewright.llm import mixing, stages

sys.path.insert(0, os.path.dirname(__file__))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, __toxicity double, __n_words int, __copy int, cdf double, digest string, shard int, id int, cell int, `odd name` string"


def corpus():
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, toxic = [], {}
    for k in range(900):
        words = [word() for _ in range(rng.randrange(25, 60))]
        toxic[k] = int(k % 4 == 0)
        if toxic[k]:
            words[rng.randrange(len(words))] = "VILE"
        rows.append([k, " ".join(words) + ".", rng.choice(("en", "fr", None)), "big" if rng.random() < 0.7 else rng.choice(("small", None)), 0])
    for k in range(60):  # copies, near copies, short and repetitive documents
        base = rows[4 * k + 1]
        rows.append([1000 + k, base[1] if k % 2 else base[1] + " tail", base[2], base[3], 0])
        rows.append([2000 + k, "too short", "en", "big", 0])
    rows += [[3000, "again and again it is said here " * 9, "en", "big", 0], [3001, None, "en", "big", 0], [3002, "", None, None, 0]]
    return [tuple(r) for r in rows], toxic


def failed_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


def grams(text):
    words = WORD.findall(text.lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def firsts(rows):
    """The rows whose id is the smallest of their component."""
    sets = {r[0]: grams(r[1]) for r in rows}
    owner = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            owner[g].add(k)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, s in sets.items():
        for b in {b for g in s for b in owner[g]}:
            if a < b and 100 * len(s & sets[b]) >= 80 * len(s | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def repeated(rows):
    weight = defaultdict(int)
    for r in rows:
        weight[r[3]] += len((r[1] or "").encode())
    rate = {s: sum(weight.values()) / len(weight) / w for s, w in weight.items()}
    out = []
    for r in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, math.exp(-rate[r[3]]), math.exp(-rate[r[3]])
        while c <= u:
            n += 1
            p *= rate[r[3]] / n
            c += p
        out += [r] * n
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_and_run_against_brute_force(spark, folder):
    rows, toxic = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = [r for r in rows if not failed_base(r[1])]
    steps = [expected]
    for make in (lambda x: [r for r in x if "VILE" not in r[1]], firsts, repeated):
        steps.append(make(steps[-1]))
    for (name, stage), want in zip(stages.STAGES, steps, strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        got = sorted(tuple(r) for r in docs.collect())
        assert got == sorted(want), name
        docs = spark.createDataFrame(want, SCHEMA)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(int)
    for r in steps[-1]:
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
        pieces[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1  # all are shorter than a sequence
    laid = stages.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in laid) == Counter(pieces)
    sequences = defaultdict(list)
    for r in laid:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in sequences.values():
        members.sort()
        assert [o for o, _ in members] == np.cumsum([0, *(n for _, n in members[:-1])]).tolist() and sum(n for _, n in members) <= 1024


def test_stages_on_odd_tables(spark, folder):
    odd = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 30_000, None, "a", 0), (None, " ".join(f"v{k}" for k in range(40)), "en", None, 0)]
    odd += [(4, " ".join(f"u{k}" for k in range(40)), "en", "a", 0)] * 2
    wide = [(*r, 0.5, 1, 2, 0.1, "d", 3, 4, 5, "o") for r in odd]
    for frame in (spark.createDataFrame(wide, CLASH), spark.createDataFrame([], CLASH)):
        docs = frame
        for _, stage in stages.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.schema.names == frame.schema.names
            rows = docs.collect()
            assert all(tuple(r) in set(wide) for r in rows)
            docs = spark.createDataFrame(rows, frame.schema)
        assert stages.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    kept = stages.quality_rules(spark, spark.createDataFrame(wide, CLASH), folder).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "4", "None"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from linewright.llm import queries

    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
