"""The training-data operators on a small table with all odd cases, against brute force."""

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
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linewright.llm import fingerprints, html_text, language, mixing, near_duplicates, ngram_scores, packing, quality, textkit, token_counts, toxicity
from linewright.llm.encoder import Encoder
from linewright.llm.textkit import remainder

sys.path.insert(0, os.path.dirname(__file__))
import held_pages  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls string"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    bag = [f"w{k}" for k in range(400)]
    base = " ".join(rng.choice(bag) for _ in range(60))
    near = base.replace(base.split()[30], "other", 1)
    texts = [base, base, near, None, "", "   \n\t", "one two", "one two", "<|endoftext|> a  b c   d", "Ünïcödé – 漢字 🙂", "A" * 5000, " ".join(rng.choice(bag) for _ in range(3000))]
    texts += ["\n".join(" ".join(rng.choice(bag) for _ in range(9)) for _ in range(6)) for _ in range(12)]
    out = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 3], 0, 0.5, "x") for k, t in enumerate(texts)]
    return [*out, out[0], (None, "one two", "en", "a", 0, 0.0, "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_memo_gives_the_ids_of_whole_texts(rows):
    library, ours = Tokenizer.from_file(BPE), Encoder(BPE)
    texts = [r[1] for r in rows] + ["  lead", "trail  ", "a \n b", "x\n\ny", "it's we'll", "a　b c"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_cut_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "a", "bc", "'s", "'ll", "12", "é", "漢", "<|endoftext|>", "<|endoftext|", "–", "\u200b", "\x1c", "\x1f", "!", "...", "🙂", "\x00", "«", ",", "it's", "É", "×", "ß", "A.", "%%%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    library, ours = Tokenizer.from_file(BPE), Encoder(BPE)
    for at in range(0, len(texts), 500):
        expected = [x.ids for x in library.encode_batch(texts[at : at + 500], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts[at : at + 500])] == expected


def test_chunks_are_kept_from_their_second_slice_on():
    library, ours = Tokenizer.from_file(BPE), Encoder(BPE)
    for k in range(6):
        texts = [" ".join(["often", *(f"only{k}x{j}" for j in range(400))])] * 2
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == expected
        assert len(ours.memo) < 40  # "often" and a few whose hashes meet; not the 400 words that each slice has alone
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == expected
    assert 400 <= len(ours.memo) < 440 and ours.known == len(ours.memo)


def test_other_files_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), Encoder(path)
    texts = ["One two.  Three\nfour", "", "a b", None]
    assert not ours.cut and [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, docs, none, rows, tmp_path):
    library = Tokenizer.from_file(BPE)
    cache = str(tmp_path / "cache")
    expected = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for _ in range(2):
        got = token_counts.token_counts(docs, BPE, cache).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})
    assert token_counts.token_counts(none, BPE).count() == 0


def test_match_and_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 1025, int(rng.integers(1, 300)))
        bins, offsets = packing.match_and_fit(lengths)
        used = defaultdict(list)
        for b, o, n in zip(bins, offsets, lengths, strict=True):
            used[b].append((o, n))
        for members in used.values():
            members.sort()
            assert [o for o, _ in members] == np.cumsum([0, *(n for _, n in members[:-1])]).tolist()
            assert sum(n for _, n in members) <= 1024 and sum(3 * n > 1024 for _, n in members) <= 2
        assert len(used) <= 1.1 * math.ceil(lengths.sum() / 1024) + (2 * lengths > 1024).sum()


def test_packing(docs, none, rows):
    library = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        starts = [0, *range(head, len(ids), 1024)]
        expected = [(k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
        assert sorted(by_doc[doc_id]) == sorted(expected * sum(r[0] == doc_id for r in rows))
    laid = defaultdict(list)
    for r in got:
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in laid.values():
        members.sort()
        assert [o for o, _ in members] == np.cumsum([0, *(n for _, n in members[:-1])]).tolist() and sum(n for _, n in members) <= 1024
    assert len(laid) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.pack(none, BPE).count() == 0


def test_scores(docs, none, rows):
    got = ngram_scores.interpolated_scores(docs.withColumn("held", remainder("doc_id", 5) == 1)).collect()
    tokens = [(r[0], WORD.findall(lowered(r[1])) + [None]) for r in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    seen = Counter(w for k, t in tokens for w in t if not held(k))
    n, v = sum(seen.values()), len(seen)
    expected = sorted((k is None, k or 0, held(k), len(t), sum(seen[w] > 0 for w in t), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for k, t in tokens)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    assert ngram_scores.interpolated_scores(none.withColumn("held", F.lit(False))).count() == 0


def brute_scores(rows):
    """Scores by dictionaries: every training token deleted, weights by expectation-maximisation over the tokens one by one."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    texts = [(k, held(k), WORD.findall(lowered(t)) + [None]) for k, t in rows]
    train = [w for _, h, w in texts if not h]
    one, two, before = Counter(w for t in train for w in t), Counter(), Counter()
    for t in train:
        for a, b in zip(["start", *t], t, strict=False):
            two[(a, b) if a != "start" else (0, b)] += 1
            before[a if a != "start" else 0] += 1
    n, v = sum(one.values()), len(one)
    bin_of = lambda c: int(math.log2(c + 1))
    deleted = defaultdict(list)
    for t in train:
        for a, b in zip([0, *t], t, strict=False):
            c = before[a] - 1
            deleted[bin_of(c)].append((1 / (v + 1), (one[b] - 1) / max(n - 1, 1), (two[a, b] - 1) / max(c, 1)))
    weights = {}
    for b, p in deleted.items():
        p, w = np.array(p), np.full(3, 1 / 3)
        for _ in range(ngram_scores.EM_ROUNDS):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    nearest = lambda b: weights[min(weights, key=lambda k: (abs(k - b), k))]
    out = []
    for k, _, t in texts:
        total = 0.0
        for a, b in zip([0, *t], t, strict=False):
            w = nearest(bin_of(before[a]))
            total += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + w[2] * two[a, b] / max(before[a], 1))
        out.append((k, len(t), total))
    return out


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    bag = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    rows = []
    for k in range(120):
        words = [rng.choice(bag)]
        for _ in range(rng.randrange(80)):
            words.append(f"n{words[-1]}" if rng.random() < 0.4 and len(words[-1]) < 8 else rng.choice(bag))
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held", remainder("doc_id", 5) == 1)
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in ngram_scores.interpolated_scores(frame).collect())
    for (k, n, s), (k2, n2, s2) in zip(got, sorted(brute_scores(rows)), strict=True):
        assert (k, n) == (k2, n2) and abs(s - s2) < 2e-3 * n, (k, n, s, s2)


def test_learned_weights_sum_to_one_and_prefer_what_predicts():
    side = (ngram_scores.LOG_BINS + 1) ** 2
    weights = ngram_scores.learn_weights(np.array([3 * side, 5 * side]), np.array([100, 100]), np.array([1e-6, 0.1]), np.array([0.5, 0.0]), 1000)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[3, 2] > 0.9 and weights[5, 1] > 0.9


def test_number_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (ngram_scores.unpack_sorted(ngram_scores.pack_sorted(x)) == x).all()
    assert (ngram_scores.unpack_numbers(ngram_scores.pack_numbers(x)) == x).all()


def test_sketches(docs, none, rows):
    near, n = fingerprints.neighbours(docs)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    following = [(r[0], r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order)]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["next_text"]) for r in near.collect()))) == sorted(map(repr, following))
    assert fingerprints.neighbours(none)[0].count() == 0


def test_peeling_recovers_the_differences(spark, monkeypatch):
    ours, theirs = list(range(1, 60)), list(range(40, 90))
    rows = spark.createDataFrame([(0, 0, 60, ours, theirs)], "key long, pair int, width long, ours array<long>, theirs array<long>")
    found = fingerprints.peel(fingerprints.subtracted(rows), keep=True).collect()
    assert {r["k"] for r in found if r["n"] == 1 and r["cell"] < 0} == set(range(1, 40))
    assert {r["k"] for r in found if r["n"] == -1 and r["cell"] < 0} == set(range(60, 90))
    small = spark.createDataFrame([(0, ours, theirs), (1, ours, ours), (2, ours, ours[3:]), (3, [], []), (4, ours[:9], theirs[:1])], "key long, a array<long>, b array<long>")
    small = small.withColumns({f"sketch_{x}": fingerprints.sketch(x) for x in "ab"}).withColumn("first", F.expr(f"array({fingerprints.peeled('sketch_a', 'sketch_b')})"))
    for attempts in (6, 1):  # the second: what the fingerprints cannot hold is compared exactly
        monkeypatch.setattr(fingerprints, "ATTEMPTS", attempts)
        parts = fingerprints.likeness(small, [("a", "b")])
        assert sorted((r["key"], r["ours_only"] or 0, r["theirs_only"] or 0) for part in parts for r in part.collect()) == [(0, 39, 30), (1, 0, 0), (2, 3, 0), (3, 0, 0), (4, 9, 1)]
        assert len(parts) == 2 and sorted(r["key"] for r in parts[0].collect()) == [1, 2, 3, 4]


def test_one_word_put_in_changes_few_cells(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).select("text").collect()
    words = [w for r in found for w in WORD.findall(r["text"] or "")][:600]
    texts = [" ".join(words)] + [" ".join([*words[:at], "new", *words[at:]]) for at in (0, 1, 299, 600)] + [" ".join(words[:50] + words[51:]), " ".join(words) + " \n ", " ".join(["مرحبا"] * 100), "a  b \t\n c "]
    rows = [set(r[0]) for r in spark.createDataFrame(list(enumerate(texts)), "i long, x string").orderBy("i").select(fingerprints.digests("x")).collect()]
    alike = [2 * len(rows[0] & x) / (len(rows[0]) + len(x)) for x in rows]
    assert 20 < len(rows[0]) < 120 and min(alike[1:6]) > 0.9, alike
    assert len(rows[8]) == 2


def test_ids_are_dealt_in_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 500)
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) ** 2, f"text {k} " * 4) for k in range(400)] + [(None, "x" * 40), (7, "a"), (7, "b")]
    near, n = fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near.collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert n > 20 and len({r["bucket"] for r in got}) > 10
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got), key=repr) == sorted(((r[0], r[1], order[(k + 1) % len(order)][1]) for k, r in enumerate(order)), key=repr)


def test_language(spark, none):
    rng = random.Random(2)
    words = {"aa": ["katalu", "merito", "savane"], "bb": ["zwischt", "krempf", "stulz"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k, lang in enumerate(("aa", "bb") * 40)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", None), (1003, "KATALU Merito", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows[:80])
    assert [got[k][0] for k in range(1000, 1004)] == ["und", "und", "und", "aa"]
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def brute_logs(vocabulary, p, word):
    """Log probabilities of a marked word by exact fractions over all segmentations, piece by piece from a dictionary of strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    number = {x: int(vocabulary.find(np.array([language._hash(language._codes([x])[0])], np.uint64))[0]) for x in names if x == x.lower() and (x.removeprefix("▁") or "a").isalpha()}
    assert len(set(number.values())) == len(number) and vocabulary.unknown not in number.values()
    text = "▁" + word
    total = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        terms = []
        for l in range(1, j + 1):
            piece = text[j - l : j]
            k = number.get(piece, vocabulary.unknown if l == 1 else None)
            if k is not None:
                terms.append(total[j - l] + math.log(p[k]))
        top = max(terms)
        total[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = language.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.maximum(np.random.default_rng(0).dirichlet(np.ones(pieces.unknown + 1), 2).T, 1e-12)
    texts = ["then", "internationalisation", "ß", "漢字", "x" * 700, "12", "Donaudampfschifffahrtsgesellschaft" * 4]
    logs, has = language.word_logs(pieces, p, texts)
    assert has.tolist() == [True, True, True, True, True, False, True]
    for k in (0, 1, 2, 3, 4, 6):
        assert np.isclose(logs[k, 1], brute_logs(pieces, p[:, 1], texts[k].lower()), rtol=1e-9)


def test_fit_scales_words_of_any_length(monkeypatch):
    vocabulary = language.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    texts = ["".join(rng.choice(["the", "ing", "o", "é", "漢", "stra"]) for _ in range(rng.randrange(1, 25))) for _ in range(30)]
    counts = np.arange(1, 31)
    fine = language.fit(vocabulary, texts, counts)
    monkeypatch.setattr(language, "RESCALE", 10_000)
    assert np.allclose(fine, language.fit(vocabulary, texts, counts), rtol=1e-9)
    monkeypatch.undo()
    long = language.fit(vocabulary, ["the" * 2000, "a"], np.array([1, 1]))
    assert np.isfinite(long).all() and abs(long.sum() - 1) < 1e-6
    logs, _ = language.word_logs(vocabulary, np.stack([long, fine], axis=1), ["the" * 2000])
    assert logs[0, 0] > logs[0, 1]


def test_fit_gains_likelihood_and_counts_whole_pieces():
    vocabulary = language.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts, counts = ["the", "then", "other", "mother", "a" * 100], np.array([50, 20, 10, 5, 1])
    p = language.fit(vocabulary, texts, counts)[:, None]
    flat = np.full((vocabulary.unknown + 1, 1), 1 / (vocabulary.unknown + 1))
    assert np.isclose(p.sum(), 1, atol=1e-6)
    assert (counts[:4] @ language.word_logs(vocabulary, p, texts[:4])[0] > counts[:4] @ language.word_logs(vocabulary, flat, texts[:4])[0]).all()


def test_measures(rows, docs, none):
    def brute(text):
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))

    got = quality.with_measures(docs).collect()
    assert sorted(tuple(r[f"__{m}"] for m in quality.MEASURES[:5]) for r in got) == sorted(brute(r[1]) for r in rows)
    assert quality.with_measures(none).count() == 0


def test_binomial_bound():
    for hits, trials in ((0, 50), (3, 200), (20, 400)):
        p = quality.binomial_bound(hits, trials, 0.01)
        assert np.isclose(sum(math.comb(trials, k) * p**k * (1 - p) ** (trials - k) for k in range(hits + 1)), 0.01, rtol=1e-6)
    assert quality.binomial_bound(5, 5, 0.1) == 1.0
    assert 0.01 < quality.binomial_bound(1_000_000, 100_000_000, 0.001) < 0.0101


def test_cutoffs_keep_good_rows(spark, none):
    rng = random.Random(3)
    good = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(40)), "en") for k in range(2500)]
    bad = [(5000 + k, " ".join(f"w{rng.randrange(5000)}###" for _ in range(40)), "en") for k in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000), 0) for r in good + bad], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r[0] for r in good}
    assert quality.keep_good(none, labels).count() == 0


def brute_cutoffs(rows, labels, halves):
    """The rules of each stratum by lists of labelled rows: proposed by one half, proved in order by the other."""

    def values(text):
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        n, chars = len(words), sum(map(len, words))
        tops = {"symbols": len(re.findall(r"[#*$%&|<>]", text)), "marks": len(re.findall("[!?]", text)), "capitals": len(re.findall("[A-ZÀ-Þ]", text)), "stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)), "repeats": len(covered), "lines": len(lines) - len(set(lines))}
        bottoms = {"capitals": chars, "lines": len(lines)}
        return n < 20 or 100 * len(covered) > 30 * n, {r: t / bottoms.get(r, n) if bottoms.get(r, n) else 0.0 for r, t in tops.items()}

    known = [(i, lang, labels[i], *values(t)) for i, t, lang in rows if i in labels]
    known = [x for x in known if not x[3]]
    strata = sorted({lang for i, lang, good, *_ in known if sum(1 for j, m, g, *_ in known if m == lang and g and halves[j]) >= quality.LEAST_GOOD})
    found = {}
    for lang in strata:
        half = [[(good, v) for i, m, good, _, v in known if m == lang and halves[i] == side] for side in (0, 1)]
        sums = [sum(g == side for g, _ in half[0]) for side in (0, 1)]
        proposed = []
        for rule, (_, cuts) in quality.RULES.items():
            share = lambda cut, side: sum(g == side and v[rule] > cut for g, v in half[0]) / max(sums[side], 1)  # noqa: E731, B023
            good, bad, cut = max(((share(c, 1), share(c, 0), c) for c in reversed(cuts)), key=lambda x: x[1] - quality.GAIN * x[0])
            if bad > quality.GAIN * good:
                proposed.append((good, -bad, rule, cut))
        kept = []
        for _, _, rule, cut in sorted(proposed):
            trial, good = [*kept, (rule, cut)], [v for g, v in half[1] if g]
            wrong = sum(any(v[r] > c for r, c in trial) for v in good)
            if sum(math.comb(len(good), k) * quality.RISK**k * (1 - quality.RISK) ** (len(good) - k) for k in range(wrong + 1)) > (1 - quality.CONFIDENCE) / len(strata):
                break
            kept = trial
        found[lang] = kept
    return found


def test_cutoffs_and_verdicts_against_brute_force(spark):
    rng = random.Random(12)
    rows, labels = [], {}
    for k in range(4600):
        lang = "xx" if k > 4400 else ("en", "fr")[k % 2]
        good = rng.random() < 0.8
        noise = rng.choice((0.0, 0.0, 0.0, 0.02)) if good else rng.choice((0.0, 0.3, 0.6))
        words = [rng.choice(("###", "WOW!!", "%")) if rng.random() < noise else f"w{rng.randrange(5000)}" for _ in range(rng.randrange(22, 40))]
        rows.append((k, " ".join(words), lang))
        if k % 11:
            labels[k] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, g, 0) for k, g in labels.items()], "doc_id long, quality int, toxic int")
    halves = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()}
    measured = quality.with_measures(docs)
    cutoffs = quality.choose_cutoffs(measured, marks)
    assert cutoffs == brute_cutoffs(rows, labels, halves) and set(cutoffs) == {"en", "fr"} and all(cutoffs.values())
    judged = {r["doc_id"]: (r["__kept"], r["__reason"]) for r in quality.verdict(measured, cutoffs).collect()}
    for lang in ("en", "fr"):
        good = [k for k, _, m in rows if m == lang and labels.get(k)]
        assert sum(not judged[k][0] and judged[k][1] != "base" for k in good) <= 1.5 * quality.RISK * len(good)
    assert all(reason in (None, "base") for k, (_, reason) in judged.items() if rows[k][2] == "xx")
    assert any(reason == "symbols" for _, reason in judged.values())


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        parts = [" ".join(f"w{rng.randrange(60)}" for _ in range(8)) + "." for _ in range(5)]
        if k % 4 == 0:
            parts[rng.randrange(5)] = "you VILE w1 thing."
        rows.append((k, " ".join(parts), int(k % 4 == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1, c) for a, _, c in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["__toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(1200))
    assert got[5000] == got[5001] == 0
    located = toxicity.offending_sentences(docs, model).collect()
    assert len(located) == 300 and {r["sentence"] for r in located} == {"you VILE w1 thing."}
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_mixing(docs, none):
    rates = {r["source_key"]: r["rate"] for r in mixing.source_rates(docs, {"a": 3.0, "b": 1.0}).collect()}
    assert rates[mixing.NO_SOURCE] == 0 and rates["a"] > 0
    one = [(r["doc_id"], r["__copy"]) for r in mixing.replicate(docs).collect()]
    assert sorted(map(str, one)) == sorted(map(str, [(r["doc_id"], r["__copy"]) for r in mixing.replicate(docs.repartition(5)).collect()]))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(none).count() == 0


def test_shuffled_rows_are_whole(docs, rows):
    got = mixing.shuffled(docs).collect()
    assert [r["__order"] for r in got] == sorted(r["__order"] for r in got) and len(got) > 5
    assert {tuple(r)[:-2] for r in got} <= set(rows) and any(r["text"] for r in got)


def test_poisson_means(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 15000, "big").otherwise("small").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.replicate(many).groupBy("source").count().collect()}
    assert abs(counts["big"] - 10000) < 400 and abs(counts["small"] - 10000) < 400


def grams(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [(r[0], grams(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(sets[k][0])
    smallest = {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}
    return sorted(((sets[k][0], len(sets[k][1]), smallest[find(k)]) for k in range(len(sets))), key=repr)


def test_near_duplicates(spark, docs, none, rows):
    got = near_duplicates.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)
    assert near_duplicates.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in near_duplicates.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 2 not in kept and 0 in kept


def test_large_groups_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join([*base[:100], *(f"y{rng.randrange(10**6)}" for _ in range(10 + k))])) for k in range(40)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)


def test_links_are_counted_whole(spark, monkeypatch):
    rng = random.Random(9)
    base, odd = ([f"{c}{rng.randrange(3000)}" for _ in range(120)] for c in "wz")
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([*odd, f"y{k}"])) for k in range(5)]
    sets = {r[0]: frozenset(grams(r[1])) for r in rows}
    classes = set(sets.values())
    right = {i: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in classes) for i, x in sets.items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (near_duplicates.BLOCK, 7):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        assert {r["doc_id"]: r["n_links"] for r in near_duplicates.near_duplicates(frame).collect()} == right


def test_sets_that_share_a_digest_and_many_ids(spark, rows, docs, monkeypatch):
    whole = near_duplicates.distinct_sets
    for many, bits in ((2, 64), (10**6, 5)):  # by a join of ids; by first digests of few bits, which different sets share
        def coarse(raw, offsets, bits=bits):
            grams, sizes, digests = whole(raw, offsets)
            return grams, sizes, np.stack([digests[0] >> np.int64(64 - bits) if bits < 64 else digests[0], digests[1]])

        monkeypatch.setattr(near_duplicates, "FILTER_IDS", many)
        found = coarse(*textkit.utf8(pa.array([r[1] for r in rows], pa.large_string())))[2]
        shared = np.array([d for d in set(found[0].tolist()) if len(set(found[1][found[0] == d].tolist())) > 1], np.int64)
        classes = near_duplicates.classes(found, shared)
        assert len(set(classes.tolist())) == len(set(found[1].tolist())) and (bits == 64) == (len(shared) == 0)
        if bits == 64:
            got = near_duplicates.near_duplicates(docs).collect()
            assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)


PAGE = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>\n text.<p>Second one with some words in it.</article><footer>&copy; us</footer><script>x("</p>")</script></body></html>'


def test_leaf_blocks():
    assert [b.text for b in html_text.leaf_blocks(PAGE)] == ["T", "Home", "Buy now", "Head & more", "First bold text.", "Second one with some words in it.", "© us"]
    assert html_text.leaf_blocks("<p>a<!-- b") == [html_text.Block(("p",), "a")]
    assert [b.text for b in html_text.leaf_blocks('<p>a <svg width="1" /> b</p><template-x>c</template-x><select-box>d</select-box><svg><text>no</text></svg><object data="x/"/>e')] == ["a b", "cde"]


def test_training_pages_know_their_main_text():
    first, *made = html_text.training_pages(PAGE, 3)
    blocks, label = html_text.labelled(first)
    assert [b.text for b, y in zip(blocks, label, strict=True) if y] == ["Head & more", "First bold text.", "Second one with some words in it."]
    assert len(made) == html_text.VARIANTS
    for page in made:
        blocks, label = html_text.labelled(page)
        assert {"Head & more"} <= {b.text for b, y in zip(blocks, label, strict=True) if y} and not all(label)
        assert not any(html_text.MARK in b.text for b in blocks)
    assert html_text.training_pages("<p>no article</p>", 1) == html_text.training_pages("<article>a</article><article>b</article>", 1) == []


def test_styles_that_training_never_makes():
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    network = html_text.fit(table[:160])
    found = held_pages.evaluate(network, table[160:])
    assert min(found.values()) > 0.7 and sum(found.values()) / len(found) > 0.9, found
    comments = {kind: held_pages.evaluate_comments(network, table[160:], kind) for kind in held_pages.COMMENT_NAMES}
    assert min(comments.values()) > 0.9 and comments["telling"] > 0.99, comments


def test_readers_comments_in_an_article_are_not_its_text():
    page = PAGE.replace("</article>", '<section id="comments"><p>so true</p></section><div class="commentary">by us</div></article>')
    for k in range(5):
        for made in html_text.training_pages(page, k):
            label = {b.text: y for b, y in zip(*html_text.labelled(made), strict=True)}
            assert not label.get("so true", 0) and label["by us"] and label["Head & more"]


def test_html_of_repeated_pages_and_other_columns(spark):
    network = html_text.Network(html_text._new(np.random.default_rng(0)))
    frame = spark.createDataFrame([(1, "u", PAGE, "x", 9), (1, "u", PAGE, "x", 9), (None, None, "<p>a", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(html_text.extract(frame, network).collect(), key=str)
    assert len(got) == 3 and got[0] == got[1] and html_text.extract(frame, network).columns == ["page_id", "url", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_html(spark):
    rng = random.Random(1)
    pages = [(k, f"http://x/{k}", PAGE.replace("Second one", " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(3, 40))))) for k in range(40)]
    frame = spark.createDataFrame([*pages, (100, None, None), (101, "u", ""), (102, "u", "plain text")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame, html_text.train(frame)).collect()}
    right = sum(got[k].startswith("Head & more\nFirst bold text.\n") and "©" not in got[k] and "Buy" not in got[k] for k in range(40))
    assert right >= 39 and got[100] == "" and got[101] == ""
    assert html_text.extract(frame.limit(0), html_text.Network(html_text._new(np.random.default_rng(0)))).count() == 0


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w, g = rng.normal(0, 0.3, (5 + html_text.HIDDEN, 4 * html_text.HIDDEN)), np.zeros(4 * html_text.HIDDEN)
    x, mask = rng.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    target = rng.normal(size=(4, 2, html_text.HIDDEN))
    out, tape = html_text._pass(w, g, x, mask)
    dw, _, _ = html_text._back(w, tape, target, 5)
    for i, j in ((0, 3), (7, 20), (2, 50)):
        moved = w.copy()
        moved[i, j] += 1e-6
        assert np.isclose(((html_text._pass(moved, g, x, mask)[0] - out) * target).sum() / 1e-6, dw[i, j], rtol=1e-3, atol=1e-5)


def test_edited_texts(spark, tmp_path, rows):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path))
    got = fingerprints.op4_bloom_sketch(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []

    def cells(text):
        out = set()
        for line in text.split("\n"):
            own = []
            for word in WORD.findall(line):
                own.append(word)
                cut = len(word) > 1 and (all(ord(c) < 0x100 and ord(c) % 4 == r for c, r in zip(word[-2:], fingerprints.CUT, strict=True)) or (ord(word[-2]) >= 0x100 and word[-1] in fingerprints.CLAUSE))
                if cut or len(own) == fingerprints.CELL_WORDS:
                    out.add(tuple(own))
                    own = []
            out |= {tuple(own)} if own else set()
        return out

    def alike(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        expected.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(cells(text), cells(edited)), 9), round(alike(cells(text), cells(after)), 9)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=repr) == sorted(expected, key=repr)
    prints = defaultdict(set)
    for r in got:
        prints[next(x[1] for x in rows if x[0] == r["doc_id"]) or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
