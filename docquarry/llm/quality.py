"""A quality classifier: random-indexing word vectors, pooled, and a small neural network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.memos import only, register
from docquarry.llm.shared import prepare, spare, spread
from docquarry.llm.shingles import chunks

#: Hashed vocabulary, dimensions, non-zero entries of an index vector.
BUCKETS, DIMS, NONZERO = 8192, 48, 4
#: Most labelled rows that the network is fitted on (the lowest by hash), a documented bound.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
MEMO = 300_000
UPPER, LOWER, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True


def shape_of(word: str) -> str:
    """A word's classes of characters with runs cut to one, as Aa. or A! or #: a coarse second word."""
    body = word.rstrip(".,!?#*$%&|")
    if body.isalpha():
        start = "a" if body.islower() else "A" if body.isupper() else "Aa" if body[0].isupper() and body[1:].islower() else ""
        if start:
            return start + "".join(c for c, before in zip(word[len(body) :], word[len(body) - 1 :], strict=False) if c != before)[: 12 - len(start)]
    shape, last = [], ""
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if kind != last:
            shape.append(kind)
        last = kind
    return "".join(shape[:12])


class Buckets(dict):
    """word (UTF-8) -> (bucket of the word, bucket of its shape) as one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        own = xxhash.xxh64_intdigest(word) % (BUCKETS // 2)
        shape = shape_of(word.decode("utf-8", "replace")).encode("utf-8", "replace")
        value = own * BUCKETS + BUCKETS // 2 + xxhash.xxh64_intdigest(shape) % (BUCKETS // 2)
        self[word] = value
        return value


SEEN = Buckets()
register("quality", SEEN.clear)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's fixed random index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of shapes, concatenated, and the number of words of each text."""
    only("quality")
    split = [t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    both = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for w in split:
        both[at : at + len(w)] = np.fromiter(map(SEEN.__getitem__, w), np.int64, len(w))
        at += len(w)
    return both // BUCKETS, both % BUCKETS, sizes


def contexts(texts: list[str | None]) -> np.ndarray:
    """(BUCKETS, DIMS) whole numbers: for each bucket, the sum of the index vectors of its words' neighbours.

    A word's context is the word before and after it, and its shape; a shape's context is the shapes before and after
    and the word.
    """
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    for start, end in chunks(texts):
        word, shape, sizes = word_buckets(texts[start:end])
        if not len(word):
            continue
        owner = np.repeat(np.arange(len(sizes)), sizes)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = [(word[joined], word[joined + 1]), (word[joined + 1], word[joined]), (shape[joined], shape[joined + 1]), (shape[joined + 1], shape[joined]), (word, shape), (shape, word)]
        for at, near in pairs:
            # Equal pairs are counted once with their number: texts repeat their common words.
            key, n = np.unique(at * BUCKETS + near, return_counts=True)
            at, near = key // BUCKETS, key % BUCKETS
            for k in range(NONZERO):
                total += np.bincount(at * DIMS + places[near, k], n * signs[near, k], BUCKETS * DIMS)
    return np.rint(total).astype(np.int64).reshape(BUCKETS, DIMS)


def word_vectors(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets over every text of docs; whole-number sums, so the order doesn't matter.

    Each task sums its own texts; the partial sums (BUCKETS rows at most a task) meet in a hash aggregation by bucket. What
    comes to the driver is BUCKETS x DIMS numbers, whatever the input.
    """
    names = [f"c{i}" for i in range(DIMS)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, DIMS), np.int64)
        for batch in batches:
            total += contexts(batch["text"].tolist())
        some = np.flatnonzero(total.any(1))
        out = pd.DataFrame(total[some], columns=names)
        out.insert(0, "bucket", some.astype(np.int32))
        yield out

    sums = docs.select("text").mapInPandas(partial, "bucket int, " + ", ".join(f"{n} long" for n in names))
    rows = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    raw = np.zeros((BUCKETS, DIMS))
    raw[rows["bucket"].to_numpy(int)] = rows[names].to_numpy(float)
    # A context count grows with the corpus; its direction is what tells, dampened for rare buckets, beside the own index.
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(BUCKETS), places[:, k]), signs[:, k])
    norm = np.sqrt((raw**2).sum(1, keepdims=True))
    return (raw / (norm + 10.0) + own / np.sqrt(NONZERO)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: means over its words of the word's vector, its shape's, and the product of neighbours' vectors,
    and the mean squares of the first; zeros for a text without words. The last column tells whether there is a word."""
    out = np.zeros((len(texts), 4 * DIMS + 1), np.float32)
    for start, end in chunks(texts):
        word, shape, sizes = word_buckets(texts[start:end])
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        edge = np.r_[0, np.cumsum(sizes[some])]
        for i, d in enumerate(some):
            lo, hi = edge[i], edge[i + 1]
            n, row = hi - lo, out[start + d]
            w = vectors[word[lo:hi]]
            row[:DIMS] = w.mean(0)
            row[DIMS : 2 * DIMS] = vectors[shape[lo:hi]].mean(0)
            row[2 * DIMS : 3 * DIMS] = np.einsum("ij,ij->j", w[:-1], w[1:]) / max(1, n - 1)
            row[3 * DIMS : 4 * DIMS] = row[:DIMS] ** 2
            row[-1] = 1
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a temperature; `prior` alone where there was nothing to fit."""

    prior: float
    layers: tuple[np.ndarray, ...] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; a text without words (last column 0) is of the same network at zero inputs."""
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, passes: int = 40, seed: int = 5) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the temperature is the one that fits the last fifth best."""
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) < 20 or y.min() == y.max():
        return Network(float(prior))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean = x[train].mean(0, dtype=np.float64)
    scale = x[train].std(0, dtype=np.float64) + 1e-3
    z = ((x - mean.astype(np.float32)) / scale.astype(np.float32)).astype(np.float32)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.array(np.log(prior / (1 - prior)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(passes, min(400, 200_000 // len(train)))):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), 128):
            b = mixed[at : at + 128]
            zb = z[b].astype(np.float64)
            h = zb @ p[0] + p[1]
            a = np.maximum(h, 0)
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
            da = np.outer(d, p[2]) * (h > 0)
            grads = [zb.T @ da + 1e-4 * p[0], da.sum(0), a.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(float(prior), (mean, scale, *p))
    logits = net.logits(x[held].astype(np.float64))
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / t))
    net.temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from fitting: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Column:
    """Column over `text`: the probability that labels.quality would be 1. Word vectors come from every text of docs; the
    network is fitted on the texts of up to train_rows labelled documents that are not held out, lowest by hash.

    Labels of null quality or id are ignored; of an id labelled more than once the lowest label counts, of an id with several
    texts the least text. With fewer than 20 labelled texts, or one class alone, every score is the smoothed share of label 1.
    """
    prepare(spark)
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    kind = "long" if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    usable = usable.withColumn("doc_id", F.col("doc_id").cast(kind)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).toPandas()
    vectors = word_vectors(spark, docs)
    x, y = np.zeros((0, 4 * DIMS + 1), np.float32), np.zeros(0)
    if len(chosen):
        send = spark.sparkContext.broadcast(vectors)

        @F.pandas_udf("array<float>")
        def pool(text: pd.Series) -> pd.Series:
            return pd.Series(list(pooled(text.tolist(), send.value)))

        picked = F.broadcast(spark.createDataFrame(chosen[["doc_id"]]))  # train_rows ids at most
        rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").join(picked, "doc_id", "left_semi")
        got = rows.select("doc_id", pool("text").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
        if len(got):
            # As one array from the columns: Python objects for each row would be most of the driver's memory.
            x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)
            of = chosen.set_index("doc_id")["quality"]
            y = (of.loc[got["doc_id"].to_pandas()].to_numpy() == 1).astype(float)
        del got
    model = spark.sparkContext.broadcast((vectors, fit(x, y)) if len(y) else (vectors, Network(0.5)))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        vectors, net = model.value
        return pd.Series(net.scores(pooled(text.tolist(), vectors)))

    return score(F.col("text"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with held_out, score (0 to 1; texts without words included) and predicted (1: score >= threshold).

    Extra columns stay, but for those of these three names; null texts score as empty ones. An empty table gives no rows.
    """
    docs = spread(docs)
    score = quality_score(spark, docs, labels, train_rows)
    (made,) = spare(docs, "score")
    scored = docs.withColumn(made, score)
    new = {"held_out": held_out(F.col("doc_id")), "score": F.col(made), "predicted": (F.col(made) >= threshold).cast("int")}
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])
