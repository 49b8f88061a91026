import math
import re

import pytest
import xxhash

from docquarry.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = rules.judge(spark, docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.ratio >= rules.LEAST_RATIO)


def hashed(text):
    """Buckets of words and of pairs of neighbours: XXH64 with seed 42, a pair's second word seeded by the hash of the first."""
    words = [w.encode() for w in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(w, h) for h, w in zip(one, words[1:], strict=False)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(h) % rules.BUCKETS for h in one + two]


def test_ratio_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    features = {r.doc_id: hashed(r.text) for r in docs.collect()}
    raw, target = [0] * rules.BUCKETS, [0] * rules.BUCKETS
    for d, f in features.items():
        for b in f:
            raw[b] += 1
            target[b] += d % 2 == 0
    b, a = rules.BUCKETS, rules.SMOOTHING
    w = [math.log((t + a) / (sum(target) + a * b)) - math.log((r + a) / (sum(raw) + a * b)) for t, r in zip(target, raw, strict=True)]
    for r in rules.judge(spark, docs, docs.where("doc_id % 2 = 0")).collect():
        f = features[r.doc_id]
        assert r.ratio == pytest.approx(sum(w[x] for x in f) / max(1, len(f)), abs=1e-9)


def test_odd_rows(spark):
    many = " ".join(f"{i} {i}" for i in range(400)) + "\n"
    texts = [None, "", " \n\x0b ", "a a a a", "a b c a b c", "x\ny\nx\n\ny \ny", "\x1c \x85  b", "# * $ %", many * 2, "p q r s " * 300, "ñ é 日本"]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(3, "a a a a", 0, 0)], "doc_id long, text string, n_words int, g int")
    rows = rules.judge(spark, docs, docs.where("false")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), r.doc_id
        assert r.ratio == 0
    assert rules.judge(spark, docs.where("false"), docs).count() == 0


def test_target_counts_every_trusted_document(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('w', id % 3) as text")
    trusted = docs.where("doc_id < 25000 and doc_id % 3 < 2")
    a, b = rules.SMOOTHING, rules.BUCKETS
    target = [8334, 8333, 0]
    want = [math.log((t + a) / (16_667 + a * b)) - math.log((10_000 + a) / (30_000 + a * b)) for t in target]
    for r in rules.judge(spark, docs, trusted).where("doc_id < 3").collect():
        assert r.ratio == pytest.approx(want[r.doc_id], abs=1e-9)
    assert {r.ratio for r in rules.judge(spark, docs, docs).select("ratio").distinct().collect()} == {0.0}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "r", 2, 3, 4, 5)], "doc_id long, text string, _r string, _ratios int, _made int, w int, ratio int")
    row = rules.judge(spark, docs, docs.where("false")).first()
    assert (row._r, row._ratios, row._made, row.w, row.ratio, row.n_words) == ("r", 2, 3, 4, 0.0, 2)
