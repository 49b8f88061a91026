"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.components import components, spanning_roots
from docquarry.llm.shared import cut, prepare, spare, spread
from docquarry.llm.shingles import PRIME, chunks, mix, multisets, spans

#: Five-word shingles; a weighted Jaccard similarity of 0.8 or more links two texts.
WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares none of 24 bands of 5 values with probability 7e-5, at 0.85 with 2e-6.
BANDS, ROWS = 24, 5
#: Members of one side of a tile of a bucket; shingles that one matrix product takes at once.
TILE, COLUMNS = 256, 4096
SIGNATURE = "struct<k1:long,k2:long,weight:long,bands:array<long>>"


def step(n: int) -> np.uint64:
    return np.uint64(int(PRIME) * n % 2**64)


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, m: int) -> np.ndarray:
    """(docs, m) register times of BagMinHash; inf in every register of a document without shingles.

    Weights are discretised at 0, 1, 2, 4, 8, ...: on each shingle's weight axis, the interval between two neighbouring
    levels has a Poisson process of its own, seeded by shingle and interval, whose points have a time, a register and
    a place in the interval. A document takes the points placed below its weight, and each register the earliest time.
    Two documents agree in a register with the probability of their weighted Jaccard similarity. Processes run only up
    to a horizon by which all registers have probably been hit; documents with a register left run on with twice it.
    """
    registers = np.full(docs * m, np.inf)
    weight = np.bincount(doc, count, docs)
    horizon = np.where(weight > 0, (np.log(m) + 4) / np.maximum(weight, 1), 0)
    todo = np.arange(len(doc))
    while len(todo):
        level, low = 0, 0
        while len(at := todo[count[todo] > low]):
            width = max(low, 1)
            d, top = doc[at], count[at]
            seed = mix(shingle[at] * np.uint64(64) + np.uint64(level))
            time, limit, draw = np.zeros(len(at)), horizon[d], 0
            while len(d):
                bits = mix(seed + step(2 * draw + 1))
                time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
                if not (live := time <= limit).all():
                    d, top, seed, time, limit = d[live], top[live], seed[live], time[live], limit[live]
                bits = mix(seed + step(2 * draw + 2))
                register = ((bits >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                place = low + width * ((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
                under = place < top
                np.minimum.at(registers, d[under] * m + register[under], time[under])
                draw += 1
            level, low = level + 1, max(1, 2 * low)
        open_docs = np.isinf(registers.reshape(docs, m)).any(1) & (weight > 0)
        horizon[open_docs] *= 2
        todo = np.flatnonzero(open_docs[doc])
    return registers.reshape(docs, m)


def signatures(texts: list[str | None], bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> pd.DataFrame:
    """k1, k2 (a 128-bit key of the shingle multiset), weight (its size) and one key per band of each text."""
    parts = []
    for start, end in chunks(texts):
        doc, shingle, count = multisets(texts[start:end], words)
        n = end - start
        times = bag_minhash(doc, shingle, count, n, bands * rows)
        value = times.view(np.uint64).reshape(n, bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
        for r in range(rows):
            key = mix(key * PRIME + value[:, :, r])
        edge = np.searchsorted(doc, np.arange(n + 1))
        pair = np.stack([shingle, count.astype(np.uint64)], 1)
        whole = [xxhash.xxh3_128_digest(pair[edge[i] : edge[i + 1]].tobytes()) for i in range(n)]
        both = np.frombuffer(b"".join(whole), np.int64).reshape(n, 2)
        weight = np.bincount(doc, count, n).astype(np.int64)
        parts.append(pd.DataFrame({"k1": both[:, 0], "k2": both[:, 1], "weight": weight, "bands": list(key.view(np.int64))}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"k1": [], "k2": [], "weight": [], "bands": []})


def overlaps(left: list[str | None], right: list[str | None], words: int = WORDS) -> np.ndarray:
    """The exact weighted Jaccard similarity of each pair of texts; 0 where both are empty."""
    out = np.zeros(len(left))
    for start, end in spans(len(a or "") + len(b or "") for a, b in zip(left, right, strict=True)):
        both = [x for pair in zip(left[start:end], right[start:end], strict=True) for x in pair]
        doc, shingle, count = multisets(both, words)
        pair = doc >> 1
        total = np.bincount(pair, count, end - start)
        key = (pair.astype(np.uint64) << np.uint64(48)) | shingle
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        shared = np.bincount((key[same] >> np.uint64(48)).astype(np.int64), np.minimum(count[same], count[same + 1]), end - start)
        out[start:end] = np.divide(shared, total - shared, out=np.zeros(end - start), where=total > shared)
    return out


def tile_edges(bucket: int, reps: np.ndarray, component: np.ndarray, bands: np.ndarray, texts: list[str | None], second: np.ndarray, same: bool, similarity: float, words: int) -> np.ndarray:
    """(edges, 2) places in a tile of a bucket that connect what is similar there, in different components.

    A pair is looked at in the first of its common buckets only. Edges span what is connected; pairs stay in here.
    """
    n = len(reps)
    doc, shingle, count = multisets(texts, words)
    weight = np.bincount(doc, count, n)
    place = int(np.argmax(bands[0] == bucket))
    wanted = np.triu(np.ones((n, n), bool), 1) if same else np.outer(~second, second)
    wanted &= component[:, None] != component[None, :]
    wanted &= np.minimum.outer(weight, weight) >= similarity * np.maximum.outer(weight, weight) - 1e-9
    for k in range(place):
        wanted &= bands[:, k][:, None] != bands[:, k][None, :]
    i, j = np.nonzero(wanted)
    if not len(i):
        return np.empty((0, 2), int)
    # A shingle that comes k times is k columns, so that a product of 0-1 matrices adds up the lesser counts.
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner, column = np.repeat(doc, count), mix(np.repeat(shingle, count) * PRIME + level.astype(np.uint64))
    live = np.zeros(n, bool)
    live[i] = live[j] = True
    owner, column = owner[live[owner]], column[live[owner]]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        at, to = np.searchsorted(column, (low, low + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[at:to], column[at:to] - low] = 1
        shared += block @ block.T
    common = shared[i, j].astype(np.float64)
    linked = common / (weight[i] + weight[j] - common) >= similarity - 1e-12
    i, j = i[linked], j[linked]
    root = spanning_roots(n, i, j)
    some = np.flatnonzero(root != np.arange(n))
    return np.stack([some, root[some]], 1)


def signature_udf(bands: int, rows: int, words: int):
    @F.pandas_udf(SIGNATURE)
    def signed(text: pd.Series) -> pd.DataFrame:
        return signatures([x if isinstance(x, str) else None for x in text], bands, rows, words)

    return signed


def overlap_udf(words: int):
    @F.pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(overlaps(a.tolist(), b.tolist(), words))

    return overlap


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, hashes: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, copies, kept) for each row of docs (doc_id, text; other columns are ignored).

    Texts with equal shingle multisets are one class, whose smallest doc_id stands for it; classes of a weighted Jaccard
    similarity of at least `similarity` link, and class_id is the smallest doc_id reachable by links (itself included).
    kept: doc_id is class_id, and of several texts of that id there, the row's has the least hash. copies: rows with the same
    multiset. Texts without words, null texts and rows without a doc_id link with nothing: their class is their own doc_id, and
    they are kept. Rows that share a doc_id and a text are all kept or all not; texts of one id are documents of their own, which
    have the same class_id without a link where it is the least id of both. With hashes, text_hash tells them apart. An empty
    table gives no rows.

    Candidates come from equal bands. In each bucket the members are held against two members in turn (the smallest
    doc_id, then one drawn by hash); buckets that still span several classes are then dealt out in tiles of bounded size (the
    largest class against the others, and the others among themselves), in which those pairs are verified whose members are in
    different classes and whose sizes allow the similarity, and only the edges that connect them come out. So no pair that could change a class goes unverified, large groups of copies
    cost a few pairs a member, and no bucket is collected anywhere.
    """
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = spread(base).select("doc_id", F.xxhash64("text").alias("text_hash"), signature_udf(bands, rows, words)("text").alias("s")).select("doc_id", "text_hash", "s.*")
    signed = cut(signed, "signatures")
    keys = ["k1", "k2", "weight"]
    able = signed.where("weight > 0 and doc_id is not null")
    classes = cut(able.groupBy(*keys, "bands").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    # A class goes by its smallest doc_id, unless several classes have the same: those go by a hash of their keys.
    shared = cut(classes.groupBy(F.col("least.doc_id").alias("shared_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shared_id"), "shared")
    by_hash = not shared.isEmpty()
    if by_hash:
        classes = classes.join(shared, F.col("least.doc_id") == F.col("shared_id"), "left")
        classes = cut(classes.withColumn("rep", F.when(F.col("shared_id").isNull(), F.col("least.doc_id")).otherwise(F.xxhash64(*keys))).drop("shared_id"), "named")
    else:
        classes = classes.withColumn("rep", F.col("least.doc_id"))
    banded = classes.select("rep", "weight", F.explode("bands").alias("bucket"))
    centre = F.min(F.struct("rep", "weight")).alias("c1")
    other = F.min(F.struct(F.xxhash64("bucket", "rep").alias("h"), "rep", "weight")).alias("c2")
    several = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), centre, other).where("n > 1"), "buckets")
    members = cut(banded.join(several, "bucket"), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "least.*"), "rep")
    texts = base.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"])
    texts = cut(texts.groupBy("doc_id", "text_hash").agg(F.min("rep").alias("rep"), F.min("text").alias("text")).select("rep", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, wa, b, wb), those that are similar; sizes are compared first."""
        able = pairs.where((F.col("a") != F.col("b")) & (F.least("wa", "wb") >= similarity * F.greatest("wa", "wb") - 1e-9))
        able = able.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
        scored = able.join(left, "a").join(right, "b").select("a", "b", overlap_udf(words)("ta", "tb").alias("j"))
        return cut(scored.where(F.col("j") >= similarity - 1e-12).select("a", "b"), "links")

    def across(found: DataFrame) -> DataFrame:
        """The members of buckets that span several classes, with their class. Of two members, the pair is known by then."""
        placed = members.where("n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        placed = cut(placed.withColumn("component", F.coalesce("component", "rep")), "placed")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return placed.join(cut(mixed.where("lo <> hi").select("bucket"), "mixed"), "bucket")

    star = lambda df, c: df.select(F.col("rep").alias("a"), F.col("weight").alias("wa"), F.col(f"{c}.rep").alias("b"), F.col(f"{c}.weight").alias("wb"))
    links = verified(star(members, "c1"))
    links = links.union(verified(star(across(components(links)), "c2")))
    # The two that all members have been held against are done, and so are buckets with one more member.
    pivots = F.when(F.col("c1.rep") == F.col("c2.rep"), 1).otherwise(2)
    left = across(components(links)).where((F.col("n") - pivots > 1) & (F.col("rep") != F.col("c1.rep")) & (F.col("rep") != F.col("c2.rep")))
    left = left.select("bucket", "rep", "component")
    # Of a bucket's classes the largest is one side, all others the other: members of the largest need not meet one another.
    sizes = left.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    shapes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"))
    shapes = cut(shapes.where("total > m.n").select("bucket", F.col("m.component").alias("main"), F.ceil(F.col("m.n") / TILE).cast("int").alias("mains"), F.ceil((F.col("total") - F.col("m.n")) / TILE).cast("int").alias("others")), "shapes")
    payload = texts.join(classes.select("rep", "bands"), "rep")
    main = F.col("component") == F.col("main")
    dealt = left.join(shapes, "bucket").withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    places = """if(component = main, transform(sequence(0, others - 1), k -> struct(true as across, own as x, k as y, false as second)),
      concat(transform(sequence(0, mains - 1), k -> struct(true as across, k as x, own as y, true as second)), transform(sequence(0, others - 1), k -> struct(false as across, least(own, k) as x, greatest(own, k) as y, own > k as second))))"""
    tiled = dealt.select("bucket", "rep", "component", F.explode(F.expr(places)).alias("t")).select("bucket", "rep", "component", "t.*")

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        reps = group["rep"].to_numpy(np.int64)
        at = tile_edges(int(key[0]), reps, group["component"].to_numpy(np.int64), np.stack(group["bands"].to_numpy()), group["text"].tolist(), group["second"].to_numpy(bool), not key[1] and key[2] == key[3], similarity, words)
        return pd.DataFrame({"a": reps[at[:, 0]], "b": reps[at[:, 1]]})

    rest = tiled.join(payload, "rep").groupBy("bucket", "across", "x", "y").applyInPandas(joined, "a long, b long")
    found = components(links.union(cut(rest, "rest")))

    placed = classes.select(*keys, "rep", "least", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if by_hash:
        placed = cut(placed, "components")
        placed = placed.join(placed.groupBy("component").agg(F.min("least").alias("first")), "component")
    else:
        # Only the class that the component goes by has a row of that doc_id.
        placed = placed.withColumn("first", F.struct(F.col("component").alias("doc_id"), F.col("least.text_hash").alias("text_hash")))
    placed = cut(placed.select(*keys, "copies", "first"), "classes")
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    out = able.join(placed, keys).select("doc_id", "text_hash", "weight", F.col("first.doc_id").alias("class_id"), "copies", first.alias("kept"))
    alone = signed.where("not (weight > 0 and doc_id is not null)").select("doc_id", "text_hash", "weight", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    out = out.unionByName(alone)
    return out.select("doc_id", *["text_hash"] * hashes, F.col("weight").alias("n_shingles"), "class_id", "copies", "kept")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; rows that repeat a doc_id and text stay once."""
    hashed, ident, of, stays, times = spare(docs, "hash", "id", "of", "stays", "times")
    found = near_duplicates(spark, docs.select("doc_id", "text"), hashes=True).where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.min("kept").alias(stays), F.count(F.lit(1)).alias(times))
    found = cut(found.where(~F.col(stays) | (F.col(times) > 1)).select(F.col("doc_id").alias(ident), F.col("text_hash").alias(of), stays), "gone")
    same = (F.col("doc_id") == F.col(ident)) & (F.col(hashed) == F.col(of))
    out = docs.withColumn(hashed, F.xxhash64("text")).join(found.where(~F.col(stays)), same, "left_anti")
    again = found.where(stays)
    if not again.isEmpty():
        once = out.join(again, same, "left_semi").dropDuplicates(["doc_id", hashed])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.select(*[f"`{c}`" for c in docs.columns])


#: DuckDB: what op10 returns, by comparing all pairs of texts that share a shingle.
MINHASH_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
counts AS (SELECT doc_id, s, count(*) AS n FROM shingles GROUP BY 1, 2),
sizes AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS size, md5(string_agg(s || ' ' || n, chr(10) ORDER BY s)) AS content FROM counts GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS c FROM counts a JOIN counts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.size + y.size - c) - 1e-9),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(s.size, 0) AS n_shingles, class_id, CASE WHEN s.size IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY s.content) END AS copies, c.doc_id = class_id AS kept
FROM classes c LEFT JOIN sizes s ON c.doc_id = s.doc_id
"""
