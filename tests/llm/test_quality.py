import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from docquarry.llm import quality


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(spark, spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").select("held_out", "score", "predicted", "quality").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 60
    assert (held.predicted == held.quality).mean() > 0.93
    assert held[held.quality == 1].predicted.mean() > 0.95
    # Calibrated: the mean score is near the share of label 1.
    assert abs(held.score.mean() - held.quality.mean()) < 0.07


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(spark, docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(spark, docs.withColumn("source", quality.F.lit("x")), other).collect()}
    assert a == b


def test_context_sums_do_not_depend_on_the_split():
    texts = ["a b c a", "B!! c", None, "", "a a a a a"]
    assert (quality.contexts(texts) == sum(quality.contexts([t]) for t in texts)).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.fit(x, y).scores(x)
    assert abs(p.mean() - y.mean()) < 0.03
    assert abs(y[p > 0.8].mean() - p[p > 0.8].mean()) < 0.06


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "w " * 50_000, "b"), (3, "w " * 50_000, "b")], "doc_id long, text string, score string").drop("score")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.classify(spark, docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.classify(spark, docs.where("false"), labels).count() == 0
    assert quality.classify(spark, docs, labels.where("false")).count() == 5


def shape(word):
    """Runs of upper-case letters, lower-case letters, digits and equal signs, one character each, 12 at most."""
    out = ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        out += kind if not out.endswith(kind) else ""
    return out[:12]


def buckets(text):
    half = quality.BUCKETS // 2
    number = lambda t: xxhash.xxh64_intdigest(t.encode()) % half
    words = (text or "").split()
    return [number(w) for w in words], [half + number(shape(w)) for w in words]


def test_scores_against_plain_loops(spark):
    """Vectors, pooling and the network's forward pass once more, word by word."""
    rng = np.random.default_rng(4)
    good, bad = ["The cat sat on the mat .", "a dog ran home at night"], ["BUY now $$$ !!!", "x9 x9 click HERE 0"]
    texts = [" ".join(rng.choice((good if i % 2 else bad)[i % 4 // 2].split(), int(rng.integers(1, 12)))) for i in range(60)] + ["", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: (r.held_out, r.score) for r in quality.classify(spark, docs, labels).collect()}
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIMS))
    for b in range(quality.BUCKETS):
        for p, s in zip(places[b], signs[b], strict=True):
            index[b, p] += s
    raw, seen = np.zeros_like(index), Counter()
    for t in texts:
        words, shapes = buckets(t)
        for i in range(len(words)):
            seen[words[i], shapes[i]] += 1
            seen[shapes[i], words[i]] += 1
            for kind in (words, shapes):
                for j in (i - 1, i + 1):
                    if 0 <= j < len(words):
                        seen[kind[i], kind[j]] += 1
    for (at, near), n in seen.items():
        raw[at] += n * index[near]
    vectors = raw / (np.sqrt((raw**2).sum(1, keepdims=True)) + 10) + index / np.sqrt(quality.NONZERO)
    assert vectors == pytest.approx(quality.word_vectors(spark, docs), abs=1e-5)

    def pooled(t):
        words, shapes = buckets(t)
        if not words:
            return np.zeros(4 * quality.DIMS + 1)
        mean = sum(vectors[w] for w in words) / len(words)
        pairs = sum((vectors[a] * vectors[b] for a, b in zip(words, words[1:], strict=False)), np.zeros(quality.DIMS)) / max(1, len(words) - 1)
        return np.concatenate([mean, sum(vectors[s] for s in shapes) / len(words), pairs, mean**2, [1]])

    train = sorted((i for i in range(60) if not got[i][0]))
    net = quality.fit(np.stack([pooled(texts[i]) for i in train]).astype(np.float32), np.array([i % 2 for i in train], float))
    mean, scale, w1, b1, w2, b2 = net.layers
    for i, t in enumerate(texts):
        x = (pooled(t) - mean) / scale
        hidden = [max(0.0, sum(x * w1[:, k]) + b1[k]) for k in range(len(b1))]
        z = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2
        assert got[i][1] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z / net.temperature)))), abs=2e-3), i


def test_clashing_names(spark):
    docs = spark.createDataFrame([("a", "x y", 5, "s", 7)], "doc_id string, text string, score int, _score string, held_out int")
    labels = spark.createDataFrame([("a", 1)], "doc_id string, quality int")
    row = quality.classify(spark, docs, labels).first()
    assert 0 <= row.score <= 1 and row._score == "s" and isinstance(row.held_out, bool) and len(row) == 6
