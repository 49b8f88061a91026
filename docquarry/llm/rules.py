"""Quality rules: counts of a text's words and lines, and a length-normalised n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.shared import WORD, bind, cut, spare, spread

#: Hash buckets of words and word pairs, smoothing count, least mean log-likelihood ratio of a kept document. On two given tables the
#: ratio of trusted documents (3,243 and 16,906) is 0.015 on average and -0.020 and -0.036 at least, and that of documents labelled 0 is
#: -0.04 at most, three quarters below -0.07: the limit stands about twice as far down as any trusted document.
BUCKETS, SMOOTHING, LEAST_RATIO = 10_000, 1.0, -0.07
MIN_WORDS, MOST_REPEATED = 50, 50
FEW = 32
SYMBOLS = "[#*$%&|<>]"

WORDS_SQL = f"regexp_extract_all(coalesce(text, ''), r'{WORD}', 0)"
#: Features of a text w of words: hash buckets of its words and of its pairs of neighbouring words.
FEATURES_SQL = f"""concat(transform(w, x -> int(pmod(xxhash64(x), {BUCKETS}))),
  transform(slice(sequence(0, size(w)), 1, greatest(size(w) - 1, 0)), i -> int(pmod(xxhash64(get(w, i), get(w, i + 1)), {BUCKETS}))))"""


#: Words in three-word windows (as hashes g by place) that the text has twice or more. Without a repeated window: none. With FEW
#: different ones, a look for each place; with more, one sort by hash and place, so that long texts take n log n.
MARKED_FEW = "filter(slice(sequence(0, size(g)), 1, size(g)), i -> array_contains(d, get(g, i)))"
MARKED_MANY = bind(
    "p",
    "sort_array(transform(g, (x, i) -> struct(x as h, i as i)))",
    "sort_array(transform(filter(transform(p, (x, k) -> struct(x.i as i, x.h = get(p, k - 1).h or x.h = get(p, k + 1).h as twice)), y -> y.twice), y -> y.i))",
)
COVERED = "aggregate({marked}, struct(-3 as last, 0L as words), (a, i) -> struct(i as last, a.words + least(3, i - a.last) as words), a -> a.words)"
REPEATS_SQL = bind(
    "g",
    "transform(slice(sequence(0, size(w)), 1, greatest(size(w) - 2, 0)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))",
    "if(size(array_distinct(g)) = size(g), 0L, "
    + bind("s", "sort_array(g)", bind("d", "array_distinct(filter(s, (x, i) -> i > 0 and x = get(s, i - 1)))", f"if(size(d) <= {FEW}, {COVERED.format(marked=MARKED_FEW)}, {COVERED.format(marked=MARKED_MANY)})"))
    + ")",
)
LINES_SQL = bind("l", f"filter(split(coalesce(text, ''), '\\n', -1), x -> x rlike r'{WORD}')", "bigint(size(l) - size(array_distinct(l)))")


def features(text: str = "text") -> F.Column:
    return F.expr(bind("w", WORDS_SQL, FEATURES_SQL).replace("coalesce(text,", f"coalesce({text},"))


def ratio_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, w: the log-likelihood ratio of each bucket between the multinomial of the documents whose doc_id is in trusted
    and that of all documents, both over every text, with SMOOTHING added to each count. Without a trusted text: zeros.
    Ids and texts always meet by a shuffle, whatever their number: a broadcast of ids would grow with the table."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_t", F.lit(1))
    flagged = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left")
    seen = flagged.select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(features()).alias("bucket"))
    counts = cut(seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")), "counts")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    share = lambda c: f"ln(({c} + {SMOOTHING}) / (total_{c} + {SMOOTHING * BUCKETS}))"
    rows = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("total_raw"), F.sum("target").alias("total_target"))
    body = share("target").replace("(target +", "(x.target +") + " - " + share("raw").replace("(raw +", "(x.raw +")
    return cut(rows.select(F.expr(f"if(total_target = 0, transform(c, x -> 0D), transform(c, x -> {body}))").alias("w")), "ratios")


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed and kept.

    Words are runs of anything but six ASCII white-space characters. base_failed: fewer than MIN_WORDS words, or over MOST_REPEATED
    percent of them in repeated three-word windows. ratio: the mean log-likelihood ratio of the text's words and word pairs,
    trusted documents (the rows of trusted, by doc_id) against all of docs; 0 for a text without words and where no document is trusted.
    kept: not base_failed, and ratio >= least. The same table gives the same verdicts. A null text has no words: it fails.
    Extra columns stay, but for those of the same names; repeated rows count as often as they stand; an empty table gives no rows.
    """
    docs = spread(docs)
    table = ratio_table(docs, trusted)
    ratios, made = spare(docs, "ratios", "made")
    counted = bind("w", WORDS_SQL, f"struct(bigint(size(w)) as n_words, bigint(length(array_join(w, ''))) as word_chars, {REPEATS_SQL} as n_repeat_words, {bind('f', FEATURES_SQL, f'aggregate(f, 0D, (a, b) -> a + get({ratios}, b)) / greatest(1, size(f))')} as ratio)")
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept")
    out = docs.withColumn(ratios, table.scalar()).withColumn(made, F.expr(counted))
    out = out.select(
        *[f"`{c}`" for c in docs.columns if c not in own],
        F.col(made).getField("n_words").alias("n_words"),
        F.col(made).getField("word_chars").alias("word_chars"),
        F.expr(f"bigint(regexp_count(coalesce(text, ''), r'{SYMBOLS}'))").alias("n_symbols"),
        F.expr(LINES_SQL).alias("n_dup_lines"),
        F.col(made).getField("n_repeat_words").alias("n_repeat_words"),
        F.col(made).getField("ratio").alias("ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= least))
