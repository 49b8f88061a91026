"""Mixing sources to target weights by fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import WORD, cut, prepare, spare, word_count
from docquarry.llm.shingles import PRIME, mix
from docquarry.operators.structures import running_before

#: Words of a block, weights of the sources in order (repeating), most passes over a source.
BLOCK_WORDS, WEIGHTS, MOST = 64, (5, 2, 1), 3
#: Output shards, rows of a packing bucket, slots dealt out by one row and by one task, sources that one task draws for.
SHARDS, BUCKET_ROWS, SLOT_STEP, TASK_SLOTS, DRAW_SOURCES = 256, 20_000, 16_384, 65_536, 4096


def planned(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """sources (source, source_size) with number (place in code-point order, null last), target, blocks, slots and tail.

    Targets share the sum of sizes by weight; none is above most times its size, and the excess is reshared by weight until none
    is. That is min(most * size, level * weight) at one level for all: in the order of most * size / weight, the sources are full
    up to the first that the level of the rest leaves room in. Running sums in that order find it, whatever the number of sources.
    slots are whole blocks, tail the words of one more.
    """
    order = [F.col("source").isNull(), F.col("source")]
    numbered = running_before(sources.withColumn("one", F.lit(1).cast("long")), order, "one").withColumnRenamed("before", "number").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = cut(numbered.withColumn("weight", weight), "numbered")
    total, all_weight = (rows.agg(F.sum(c)).scalar() for c in ("source_size", "weight"))
    ratio = F.col("source_size") * most / F.col("weight")
    full = running_before(rows, [ratio, F.col("number")], "source_size").withColumnRenamed("before", "full_size")
    full = running_before(full, [ratio, F.col("number")], "weight").withColumnRenamed("before", "full_weight")
    left, open_weight = total - most * F.col("full_size"), all_weight - F.col("full_weight")
    room = full.where(ratio * open_weight >= left).agg(F.min(F.struct(ratio, "number", left.alias("left"), open_weight.alias("open_weight"))).alias("m"))
    at = room.select("m.left", "m.open_weight")
    shared = F.col("weight") * at.select("left").scalar() / at.select("open_weight").scalar()
    target = F.least((F.col("source_size") * most).cast("double"), F.coalesce(shared, F.lit(0.0)))
    words = F.rint("target").cast("long")
    out = rows.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("words", words)
    passes = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    out = out.withColumn("passes", passes).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    out = out.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"rest div {block}")).withColumn("tail", F.col("rest") % block)
    return cut(out.select("number", "source", "source_size", "target", "blocks", "slots", "tail"), "plan")


def draw(owed: np.ndarray, needs: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) slots: for each shard a multinomial draw of its need by what each source still owes, none more."""
    owed = owed.copy()
    out = np.zeros((len(needs), len(owed)), np.int64)
    for k, need in enumerate(needs):
        while need:
            got = np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
            out[k] += got
            owed -= got
            need -= int(got.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) at index, drawn by seed: a four-round Feistel network, walked in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    size = size.astype(np.uint64)
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix(right * PRIME + seed[todo] + np.uint64(turn)) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


def slot_blocks(spark: SparkSession, plan: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """((number, block, shard, slot, take), slots): which block each slot of the output holds and how many of its words (null: all).

    Multinomial counts are drawn twice: on the driver for groups of DRAW_SOURCES sources, then for each group's sources in a task of
    its own. Slots are counted out by as many tasks as they fill.
    """
    grouped = plan.withColumn("group", F.expr(f"number div {DRAW_SOURCES}"))
    groups = grouped.groupBy("group").agg(F.sum("slots").alias("slots"), F.sum((F.col("tail") > 0).cast("long")).alias("tails")).orderBy("group").collect()
    owed = np.array([g.slots for g in groups], np.int64)
    total = int(owed.sum())
    if not total and not any(g.tails for g in groups):
        return plan.where("false").select("number", F.lit(0).cast("long").alias("block"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("take")), 0
    shards = max(1, min(shards, total // 16))
    needs = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    counts = draw(owed, needs, np.random.default_rng(seed))
    given = spark.createDataFrame([(g.group, counts[:, i].tolist()) for i, g in enumerate(groups)], "group long, needs array<long>")

    def drawn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        got = draw(rows["slots"].to_numpy(np.int64), list(rows["needs"].iloc[0]), np.random.default_rng([seed, int(key[0])]))
        first = np.concatenate([np.zeros((1, got.shape[1]), np.int64), np.cumsum(got, 0)])
        shard, at = np.nonzero(got)
        out = pd.DataFrame({"number": rows["number"].to_numpy()[at], "blocks": rows["blocks"].to_numpy()[at], "shard": shard, "lo": first[shard, at], "hi": first[shard + 1, at]})
        some = rows[rows["tail"] > 0]
        tails = pd.DataFrame({"number": some["number"], "blocks": some["blocks"], "shard": shards - 1, "lo": some["slots"], "hi": some["slots"] + 1, "take": some["tail"]})
        return pd.concat([out.assign(take=-1), tails])

    schema = "number long, blocks long, shard int, lo long, hi long, take int"
    dealt = grouped.join(given.hint("merge"), "group").groupBy("group").applyInPandas(drawn, schema).withColumn("take", F.nullif("take", F.lit(-1)))
    dealt = dealt.withColumn("at", F.explode(F.expr(f"sequence(lo, hi - 1, {SLOT_STEP})")))
    # A number of partitions that is asked for is not merged, however small the rows look.
    dealt = dealt.repartition(-(-total // TASK_SLOTS) + 1, "number", "at").withColumn("slot", F.explode(F.expr(f"sequence(at, least(at + {SLOT_STEP}, hi) - 1)")))

    @F.pandas_udf("long")
    def block(number: pd.Series, blocks: pd.Series, slot: pd.Series) -> pd.Series:
        size = blocks.to_numpy(np.int64)
        turn = slot.to_numpy(np.int64) // size
        key = mix(number.to_numpy(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64) + np.uint64(seed))
        return pd.Series(permuted(slot.to_numpy(np.int64) % size, size, key))

    return dealt.select("number", block("number", "blocks", "slot").alias("block"), "shard", "slot", "take"), total


def packed(docs: DataFrame, size: Column, keep: Sequence[Column] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_hash and keep of each row of docs, with start: the place of its first word in its source.

    A source's documents stand in a fixed order of hashed buckets, by doc_id and text hash within them; a prefix sum over
    the buckets places them, so no task holds a source.
    """
    sized = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), *keep), "sizes")
    most = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(64, most // bucket_rows)
    live = sized.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    totals = live.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.select(F.col("source").alias("own"), F.col("bucket").alias("at"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")), "bases")
    placed = live.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("at")))
    placed = placed.select(*sized.columns, (F.col("base") + F.col("inner")).alias("start"))
    idle = sized.where("size = 0").select("*", F.lit(None).cast("long").alias("start"))
    return cut(placed.unionByName(idle), "packed")


def mixed(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 1, keep: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source; of other columns only those of keep come along), as (documents, pieces).

    documents: doc_id, size, source, number (the source's place), source_size, target, taken (words that the mix takes of it, repeats
    counted), text_hash and start, a row for each row of docs. pieces: start, number, first and last (words of the document that
    stand in a block), uses (whole uses of the block), part (words that one more use takes of these, else 0).

    Each source's words are packed into blocks of `block`; each shard draws multinomial counts of the sources; the
    slots of a source run through a new pseudorandom permutation of its blocks on every pass; blocks and slots meet by
    an equi-join on the block's index. A source gives its target to within a block, its documents at most `most`
    (a whole number) times their size. Null and empty texts have size 0 and taken 0; a null source is a source; an empty
    table gives no rows; rows repeated in full are separate documents. The same rows and seed give the same mix.
    """
    prepare(spark)
    place = packed(docs, word_count(F.col("text")), keep)
    plan = planned(place.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block)
    facts = plan.select(F.col("source").alias("own"), "number", "source_size", "target")
    place = place.join(facts, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    slots, _ = slot_blocks(spark, plan, shards, seed)
    used = slots.groupBy("number", "block").agg(F.count(F.when(F.col("take").isNull(), 1)).alias("uses"), F.coalesce(F.max("take"), F.lit(0)).alias("take"))
    spans = place.where("size > 0").select("number", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    # Sizes of what is exploded are underestimated; without the hint all blocks could be broadcast.
    met = spans.join(used.hint("merge"), ["number", "block"])
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    met = met.select("number", "start", (low - F.col("start")).alias("first"), (high - F.col("start")).alias("last"), "uses", F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.col("take")) - low).cast("long").alias("part"))
    pieces = cut(met, "pieces")
    got = pieces.groupBy("number", "start").agg(F.sum((F.col("last") - F.col("first")) * F.col("uses") + F.col("part")).alias("taken"))
    out = place.join(got, ["number", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out, pieces


def mix_report(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs; see mixed()."""
    return mixed(spark, docs, **options)[0].select("doc_id", "size", "source_size", "target", "taken")


def mix_texts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs as the mix repeats them: for each pass, a row of the words that the mix takes of a document in that pass.

    A document that a pass takes whole keeps its text as it stands; of another, the words taken (each with the white space
    after it) follow one another. n_chars, if there, is the new text's length. Documents of which nothing is taken go.
    Columns are those of docs, each row's own whatever other row has its id and text; an empty table, or one without words, gives
    no rows. Rows and texts meet by a 128-bit hash of id and text.
    """
    key, again, own, rank = spare(docs, "k1", "k2", "own", "rank")
    keys = [F.xxhash64("doc_id", "text").alias(key), F.xxhash64(F.lit(1), "doc_id", "text").alias(again)]
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(own)
    out, pieces = mixed(spark, docs, keep=[*keys, others], **options)
    runs = pieces.select("number", "start", F.explode(F.expr("transform(sequence(1, uses + 1), p -> struct(int(p) as pass, first, if(p <= uses, last, first + part) as last))")).alias("r"))
    runs = runs.select("number", "start", "r.*").where("last > first")
    runs = runs.groupBy("number", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum(F.col("last") - F.col("first")).alias("words"))
    runs = cut(runs.join(out.select("number", "start", "size", key, again, own), ["number", "start"]).select(key, again, own, "runs", "words", "size"), "runs")
    # Rows that repeat an id and a text give one text; the limit is taken before the shuffle too.
    texts = docs.select("text", *keys).withColumn(rank, F.row_number().over(Window.partitionBy(key, again).orderBy(key))).where(F.col(rank) == 1)
    parts = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # Bound to a variable, so that a text is split once, not for each of its runs.
    piece = lambda w: lambda r: F.slice(w, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int"))
    picked = F.get(F.transform(F.array(parts), lambda w: F.array_join(F.flatten(F.transform("runs", piece(w))), "")), 0)
    taken = F.when(F.col("words") < F.col("size"), picked).otherwise(F.col("text"))
    whole = texts.join(runs, [key, again]).select(taken.alias("text"), own)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return whole.select(*[new[c].alias(c) if c in new else F.col(own).getField(c).alias(c) for c in docs.columns])
