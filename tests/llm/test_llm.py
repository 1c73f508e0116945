"""The training-data operators: against brute force, libraries and exact round trips, and on awkward tables."""

from __future__ import annotations

import math
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.oracle import connect, difference
from tracelake.llm import ann_curves, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, queries, sentencepiece_codec, token_counts
from tracelake.llm.common import components

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "doc_id long, text string, lang string, source string, n_chars long, tokens string, words string, row string, label string"
LONG = "word " * 3000 + "end of it\n" + "x" * 5000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names used inside."""
    line = "The same line of plain words stands here again and again, to be found by all of the operators of the library."
    rows = [(1, None, None, None), (2, "", "en", "src0"), (3, " \t\n", "en", "src1"), (4, LONG, "en", "src0"), (4, LONG, "en", "src0"), (5, "Ünï cödé 日本 <|endoftext|> ▁ \r\n\x0b x", None, "src2"), (None, line, "en", None), (6, line, "en", "src0"), (7, line, "de", "src0"), (8, "two words", "en", "src0")]
    return spark.createDataFrame([(*r, None, None, "w", "r", None) for r in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def test_token_counts(spark, docs, texts, odd, empty):
    t = Tokenizer.from_file(BPE)
    want = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, BPE).collect()} == want
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(odd, BPE).collect()]
    assert Counter(got) == Counter((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_token_counts_of_long_words():
    """Unbroken words of a hundred thousand signs: as the library counts them, without growing with their square."""
    t, r = Tokenizer.from_file(BPE), np.random.default_rng(2)
    for signs in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "éÖ日"):
        for n in (700, 100_000):
            text = "".join(r.choice(list(signs), n))
            began = time.time()
            assert token_counts.vocabulary(BPE).counts([text]) == [len(t.encode(text, add_special_tokens=False).ids)]
            assert time.time() - began < 20


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaa", "a<|endoftext|>b", "  x   y\n\n z", "it's 'tis we'll 123,456.78!!", "日本語 ñandú 😀😀", "\u0000  x"])
def test_token_counts_of(text):
    t = Tokenizer.from_file(BPE)
    assert token_counts.vocabulary(BPE).counts([text]) == [len(t.encode(text, add_special_tokens=False).ids)]


def test_sentencepiece(spark, docs, texts, odd, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).collect()
    assert all(r["ids"] == lib.encode(r["text"]) and r["decoded"] == r["text"] for r in both) and len(both) == len(texts)
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES).collect():
        assert r["ids"] == (None if r["text"] is None else lib.encode(r["text"]))
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace("▁", " "))
    assert sentencepiece_codec.encode(empty, PIECES).count() == 0
    key = lambda r: (r["doc_id"] or 0, str(r["ids"]))
    one = sorted(sentencepiece_codec.round_trip(odd, PIECES).collect(), key=key)
    two = sorted(sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES).collect(), key=key)
    assert [(r["doc_id"], r["ids"], r["round_trip"]) for r in one] == [(r["doc_id"], r["ids"], None if r["text"] is None else r["text"] == r["decoded"]) for r in two]


def shingles(text, n=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(sets, percent):
    """Component of each id by brute force; sets: id to list of sets."""
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in groups(sets, percent).items()}


def test_ngram_join_chain_and_odd(spark, odd, empty):
    base = [f"w{k}" for k in range(200)]
    rows = [(10 * k + 1, " ".join([f"v{j}" for j in range(3 * k)] + base[3 * k :])) for k in range(12)]  # each links to the next only
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups({i: shingles(t) for i, t in rows}, 90)
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(odd).collect()}
    assert (None, len(shingles(odd.where("doc_id = 6").first()["text"])), None) in rows and {(1, 0, 1), (2, 0, 2), (3, 0, 3), (8, 1, 8)} <= rows
    assert {c for i, _, c in rows if i in (6, 7)} == {6}
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_repeated_ids(spark):
    """Rows of one doc_id are one document: what any of its texts links with is in its group."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, "other words stand here"), (5, a), (-4, b), (11, None), (11, "other words stand here"), (12, " ".join(f"c{k}" for k in range(9)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(table).collect()}
    assert got == {(3, -4), (5, -4), (7, -4), (-4, -4), (9, 9), (11, 9), (11, 11), (12, 12)}
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(table).collect() if r["text"])
    assert kept == [(-4, b), (9, "other words stand here"), (12, rows[-1][1])]
    again = spark.createDataFrame([(1, a), (1, a), (1, b)], "doc_id long, text string")
    assert ngram_join.keep_one(again).count() == 1


def test_ngram_join_hot_gram(spark):
    """Many texts that share n-grams and differ otherwise, and many near copies of one."""
    r = np.random.default_rng(3)
    common = [f"x{k}" for k in range(4)]
    rows = [(k, " ".join([*common, *(f"w{j}" for j in r.integers(0, 400, 36))])) for k in range(150)]
    base = [f"y{k}" for k in range(80)]
    rows += [(1000 + k, " ".join([*base[:k], f"z{k}", *base[k + 1 :]])) for k in range(80)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups({i: shingles(t) for i, t in rows}, 90)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def plain(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, texts, odd, empty):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_rules.quality_rules(docs, labels.where("quality = 1").select("doc_id")).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}
    assert got == {i: plain(t) for i, t in texts.items()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and (not r["kept"] or not r["base_failed"]) for r in rows)
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert not any(r["kept"] for r in rows if r["doc_id"] in bad) and all(r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"])
    found = quality_rules.quality_rules(odd, labels.select("doc_id").where("false")).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in found) == Counter((r["doc_id"], plain(r["text"])[0]) for r in odd.collect())
    assert quality_rules.quality_rules(empty, labels.select("doc_id")).count() == 0


def test_quality_rules_score(spark):
    """The log ratio against the same computed by hand, from Spark's own hash."""
    rows = spark.createDataFrame([(1, "a b a b"), (2, "a c !!")], "doc_id long, text string")
    weights = {r["bucket"]: r["weight"] for r in quality_rules.log_ratios(rows, rows.where("doc_id = 1").select("doc_id")).collect()}
    bucket = lambda *w: rows.limit(1).select(F.xxhash64(*map(F.lit, w)).bitwiseAND(F.lit(quality_rules.BUCKETS - 1))).first()[0]
    assert weights[bucket("a")] == pytest.approx(math.log(3 / (7 + quality_rules.BUCKETS)) - math.log(4 / (12 + quality_rules.BUCKETS)))
    assert weights[bucket("c", "!!")] == pytest.approx(math.log(1 / (7 + quality_rules.BUCKETS)) - math.log(2 / (12 + quality_rules.BUCKETS)))


def test_line_dedup(spark, docs, texts, odd, empty):
    lines = [(i, n, x) for i, t in sorted(texts.items()) for n, x in enumerate(t.split("\n")) if x.encode().split()]
    first: dict = {}
    for i, n, x in lines:
        first.setdefault(x, (i, n))
    sets = {p: {x[k : k + 8] for k in range(len(x) - 7)} if len(x) >= 8 else {x} for x, p in first.items()}
    near = groups(sets, 80)
    want = Counter(i for i, n, x in lines if near[first[x]] != (i, n))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_report(docs).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: sum(1 for x in t.split("\n") if x.encode().split()) for i, t in texts.items()}
    missed = sum(want.values()) - sum(g[1] for g in got.values())
    assert 0 <= missed <= 0.02 * sum(want.values())  # banding finds nearly all
    kept = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()}
    assert (6, odd.where("doc_id = 6").first()["text"]) in kept and not any(i == 7 for i, _ in kept) and {(1, None), (2, ""), (3, " \t\n")} <= kept
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


def near_pairs():
    """(kind, line, near copy): no two of a pair equal, all of Jaccard 0.8 or more over 8-character shingles."""
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), n))
    text = lambda n: " ".join(word(int(k)) for k in r.integers(2, 9, n))[:n].strip().ljust(n, "x")
    change = lambda x, k: x[:k] + ("#" if x[k] != "#" else "-") + x[k + 1 :]
    for make, kind in ((text, "words"), (word, "unbroken")):
        for n in (*range(11, 40), 60, 100, 200, 600):
            for _ in range(4):
                x = make(n)
                yield f"{kind}, one sign more", x, x + "#"
                yield f"{kind}, last sign", x, change(x, n - 1)
                for k in r.integers(0, n, max(1, n // 80)):
                    x, y = make(n), change(x, int(k))
                    yield f"{kind}, one sign within", change(y, int(k)), y
                y = make(n)
                for k in r.permutation(n)[: max(1, n // 90)]:
                    y, x = change(y, int(k)), y
                yield f"{kind}, several signs", x, y


def test_line_dedup_recall(spark):
    """Of pairs that are no exact copies, short and unbroken lines included, nearly all are found, and none that is not near."""
    of = lambda x: {x[k : k + 8] for k in range(len(x) - 7)}
    found = {}
    for kind, x, y in near_pairs():
        if x != y and 5 * len(of(x) & of(y)) >= 4 * len(of(x) | of(y)):
            found[len(found)] = (kind, x, y)
    assert len(found) > 300 and {len(x) for _, x, _ in found.values()} >= {11, 16, 19, 25, 33, 100, 600}
    rows = [(2 * k + j, v[1 + j]) for k, v in found.items() for j in (0, 1)]
    got = {r["doc_id"] for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 1").collect()}
    missed = [found[k] for k in found if 2 * k + 1 not in got]
    assert len(missed) <= 0.005 * len(found), missed
    assert not [x for _, x, _ in missed if len(x) < 25]


def test_mixing_oracle(spark):
    assert difference(spark, connect(FOLDER), "op1_mixing", queries.op1_mixing, queries.ORACLE_SQL["op1_mixing"], FOLDER) == ""


def test_mixing_redistributes(spark, odd, empty):
    """A short leaf's rest goes to its sibling, and beyond the parent only what the parent cannot take."""
    rows = [(k, "w " * 10, "en", s) for s, n in (("a", 2), ("b", 50), ("c", 50)) for k in range({"a": 0, "b": 100, "c": 200}[s], {"a": 0, "b": 100, "c": 200}[s] + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = F.when(F.col("source") == "c", "d2").otherwise("d1")
    one = {k: F.lit(1) for k in mixing.LEVELS}
    plan = {r["source"]: r["budget"] for r in mixing.plan(mixing.with_leaf(docs, domain), one, 0.5, 1, 1).collect()}
    assert plan == pytest.approx({"a": 20, "b": 235, "c": 255})
    everything = mixing.mix(docs, domain, one, 5.0, 2, 1)
    assert everything.count() == 2 * len(rows)
    assert mixing.mix(odd, F.lit("d"), one, 1.0, 1, 1).count() <= odd.count() and mixing.mix(empty, F.lit("d"), one, 0.5).count() == 0


def test_hilbert():
    """Consecutive places of the curve are neighbouring cells, and no place is taken twice."""
    grid = np.array(np.meshgrid(*[np.arange(4)] * 3, indexing="ij")).reshape(3, -1).T
    key = ann_curves.hilbert_keys(grid, 2)
    assert sorted(key) == list(range(64))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = ann_curves.nearest(table, F.col("vec_id") % 50 == 0).collect()
    rows = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in table.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        hits += len({r["vec_id"] for r in got if r["query_id"] == ids[q]} & set(ids[np.lexsort((ids, -s))[:5]]))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_nearest_without_structure(spark, monkeypatch):
    """Vectors without any clusters: the fitted window grows until nine in ten true neighbours and more are found."""
    monkeypatch.setattr(ann_curves, "WINDOW", 16)  # so that the table is large beside it
    x = np.random.default_rng(8).standard_normal((6000, 64)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in ann_curves.nearest(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = y @ y[q]
        assert all(v == pytest.approx(s[i], abs=1e-12) for i, v in found[q].items())
        s[q] = -9
        hits += len(found[q].keys() & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 120


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<float>, rep string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann_curves.nearest(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0)]
    assert ann_curves.nearest(table.limit(0), F.lit(True)).count() == 0


def test_license_scan(spark, odd, empty):
    words = "thandre ofor the inan reon was at"
    rows = [(k, f"{words} {k}\n{words}\n{t}") for k, t in enumerate(["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "all rights reserved", "plain words only, under the sun"])]
    got = {(r["doc_id"], r["line"], r["family"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 2, "MIT"), (1, 2, "Apache-2.0"), (2, 2, "All-rights-reserved")}
    assert license_scan.license_scan(odd).count() == 0 and license_scan.license_scan(empty).count() == 0


def test_license_scan_wrapped(spark):
    """A notice wrapped at any width, with comment marks, is one paragraph of its family; other licences are unknown."""
    around = "thandre ofor the inan reon was at"
    texts, want = [], {}
    for width in (40, 72):
        for family, text in license_scan.TEMPLATES:
            wrapped = textwrap.wrap(text, width)
            if len(wrapped) > 1:
                want[len(texts)] = family
                texts.append("\n".join([around, "/*", *(f" * {x}" for x in wrapped), " */", around]))
    for text in ("Licensed under the ISC License.", license_scan.OTHERS[2], "The driver showed a license and left.", *license_scan.CUES):
        want[len(texts)] = "unknown" if "Licensed" in text or "Eclipse" in text else None
        texts.append(f"{around}\n{text}\n{around}")
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {k: {r["family"] for r in rows if r["doc_id"] == k and (r["is_confirmed"] or want[k] in (None, "unknown"))} for k in want}
    assert {k: (got[k], texts[k]) for k, f in want.items() if got[k] != ({f} if f else set())} == {}


def test_quality_classifier(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op9_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    got = quality_classifier.quality_scores(odd, labels, F.col("doc_id") == 1).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_scores(empty, labels.limit(0), F.lit(False)).count() == 0


def test_lm_base(spark, docs, texts):
    count: Counter = Counter()
    tokens = {i: [*t.encode().lower().split(), b" "] for i, t in texts.items()}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    rows = queries.op10_lm_scoring(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(count[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_learns_from_all(spark, docs):
    """The rounds together train on every token of every training document, once."""
    learn = docs.where(queries._remainder(7) != 2).select("doc_id", "text")
    lexicon = lm_scoring.lexicon_of(lm_scoring.stored(lm_scoring._token_counts(learn)), lm_scoring.FREQUENT)
    assert lm_scoring.fit(learn, lexicon, lm_scoring.ROUNDS)[1] == lexicon.total


def test_lm_sums_to_one():
    """All classes, core words and counted tail words together have at most probability 1 in any state."""
    words, counts = [b" ", b"aa", b"bb", b"cc"], np.array([10, 8, 4, 2])
    lex = lm_scoring.Lexicon(words, counts, np.zeros((lm_scoring.TAILS, 2)), 24, 4)
    p = lex.initial()
    docs = [lex.encode(t)[:2] for t in ("aa", "bb", "cc")]
    total = sum(10**s for s in lm_scoring.score_docs(lex, p, [(at[:1], c[:1]) for at, c in docs]))
    assert 0 < total < 1


def small_model(seed=0):
    """A lexicon of a few words, weights away from their start in double precision, and documents."""
    r = np.random.default_rng(seed)
    counts = np.array([30, 20, 17, 11, 9, 8, 5, 3, 2])
    words = [b" ", *(f"w{k}".encode() for k in range(8))]
    tails = np.full((lm_scoring.TAILS, 2), 3.0)
    lex = lm_scoring.Lexicon(words, counts, tails, 400, 120)
    # Few classes, so that they hold several words each.
    lex.klass[: lex.core] = np.minimum(np.arange(lex.core) // 3, 2)
    lex.bounds = np.searchsorted(lex.klass[: lex.core], np.arange(lm_scoring.CLASSES + 1)).tolist()
    p = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.3 for k, v in lex.initial().items()}
    docs = [lex.encode(" ".join(r.choice([f"w{k}" for k in range(8)] + ["odd", "new"], n)))[:2] for n in (7, 4, 1, 5, 0)]
    return lex, p, docs


def plain_score(lex, p, at, klass):
    """Natural log probability of classes and core words, one token after the other, from the model's definition."""
    d, h, total = lm_scoring.HIDDEN, np.zeros(lm_scoring.HIDDEN), 0.0
    x = lex.core + lm_scoring.TAILS
    sig = lambda v: 1 / (1 + np.exp(-v))
    for a, c in zip(at, klass, strict=True):
        g, u = p["x"][x] + p["b"], h @ p["u"]
        z, r = sig(g[:d] + u[:d]), sig(g[d : 2 * d] + u[d : 2 * d])
        h = z * h + (1 - z) * np.tanh(g[2 * d :] + r * u[2 * d :])
        y = np.exp(h @ p["o"] + p["ob"])
        total += np.log(y[c] / y.sum())
        if c < lm_scoring.CLASSES:
            y = np.exp(p["i"][lex.bounds[c] : lex.bounds[c + 1]] @ h + p["ib"][lex.bounds[c] : lex.bounds[c + 1]])
            total += np.log(y[a - lex.bounds[c]] / y.sum())
        x = a if c < lm_scoring.CLASSES else lex.core + c - lm_scoring.CLASSES
    return total


def test_lm_forward(monkeypatch):
    """Lanes, windows and the carried state change nothing: each document's score is that of the plain recurrence."""
    lex, p, docs = small_model()
    want = [plain_score(lex, p, at, c) / math.log(10) for at, c in docs]
    for lanes, window in ((1, 3), (2, 2), (512, 96)):
        monkeypatch.setattr(lm_scoring, "SCORE_LANES", lanes)
        monkeypatch.setattr(lm_scoring, "SCORE_WINDOW", window)
        assert lm_scoring.score_docs(lex, p, docs) == pytest.approx(want, rel=1e-5)


def test_lm_gradients():
    """Backpropagation against differences of the loss, for every kind of weight."""
    lex, p, docs = small_model(1)
    grid = lm_scoring._grid(lex, docs, 2)
    start = np.random.default_rng(4).standard_normal((grid[0].shape[1], lm_scoring.HIDDEN))
    run = lambda q: lm_scoring.gradients(lex, q, *grid, start.copy())
    loss, grad, rows, n = run(p)
    assert n == sum(len(at) for at, _ in docs)
    r = np.random.default_rng(6)
    for k, v in p.items():
        full = grad[k]
        if k == "x":
            full = np.zeros_like(v)
            full[rows] = grad[k]
        for _ in range(12):
            at = tuple(int(r.integers(0, m)) for m in v.shape)
            if k == "x":
                at = (int(r.choice(rows)), at[1])
            up, down = ({**p, k: v.copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert full[at] == pytest.approx((run(up)[0] - run(down)[0]) / 2e-5, abs=1e-7, rel=1e-4), k


def test_lm_odd(spark, odd, empty):
    got = lm_scoring.lm_scores(odd, F.col("doc_id") > 3).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_scoring.lm_scores(empty, F.lit(True)).count() == 0


def test_pipeline(spark):
    """Each stage keeps the columns of documents, and its result is what its operator says of its input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER))
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k == 2:
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in docs.collect()}
            assert all(c == i for i, c in groups(sets, 80).items())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert docs.where("not round_trip").count() == 0
