"""Line deduplication by the number of distinct sites that a line stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import cut, spare

#: Sites from which a line is boilerplate; log2 of the sketches' registers; relative error that counts as near the threshold.
MIN_SITES, LOG_K, NEAR = 10, 12, 0.1


def bare(line: Column) -> Column:
    """A line without the white space around it."""
    return F.btrim(line, F.lit(" \t\n\r\x0b\x0c"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with n_lines, n_removed (long) and clean: the text without cross-site boilerplate.

    A line is what stands between line feeds, compared without the white space around it; blank lines are never removed. A line
    on at least min_sites distinct sources (null is no source) is boilerplate: it stays in the document of the least doc_id
    that has it (every occurrence there) and goes from all others. Null texts stay null with no lines; rows that repeat a doc_id
    with another text are told apart by text. Extra columns stay, but for those named n_lines, n_removed or clean; an empty table gives no rows.

    HyperLogLog sketches of each line's sources are merged by hash aggregation; lines whose estimate is within NEAR of the
    threshold get an exact distinct count, so the verdicts are exact up to a sketch error far beyond its bounds. Texts are
    split once, into a table of hashes and places that is shuffled by line; the text moves once, to the places that it loses.
    Lines are told apart by 128 bits of hash, the texts of one doc_id by 64.
    """
    hashed, ident, of, lost_at = spare(docs, "hash", "id", "of", "lost")
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    lines = keyed.select("doc_id", F.col(hashed).alias("hash"), "source", F.posexplode(F.transform(F.split("text", "\n", -1), bare)).alias("at", "line")).where("line <> ''")
    lines = cut(lines.select("doc_id", "hash", "source", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")), "lines")
    key = ["k1", "k2"]
    spread = lines.groupBy(*key).agg(F.hll_sketch_agg("source", F.lit(LOG_K)).alias("sketch"), F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select(*key, "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select(*key)
    exact = lines.join(near, key, "left_semi").select(*key, "source").distinct().groupBy(*key).agg(F.count("source").alias("exact"))
    marked = spread.join(exact, key, "left").where(F.coalesce("exact", "sites") >= min_sites).select(*key, "keeper")
    marked = cut(marked, "boilerplate")
    hits = lines.join(marked, key).where(F.coalesce(F.col("doc_id") != F.col("keeper"), F.col("keeper").isNotNull()))
    lost = cut(hits.groupBy("doc_id", "hash").agg(F.collect_set("at").alias("lost")), "lost")
    lost = lost.select(F.col("doc_id").alias(ident), F.col("hash").alias(of), F.col("lost").alias(lost_at))
    out = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(hashed) == F.col(of)), "left")
    split = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(lost_at, i)), "\n")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    made = {
        "n_lines": n(F.size(F.when(F.col("text").isNotNull(), split)) * F.col("text").isNotNull().cast("int")),
        "n_removed": n(F.when(F.col(lost_at).isNotNull(), F.size(lost_at))),
        "clean": F.when(F.col(lost_at).isNull(), F.col("text")).otherwise(rest),
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[v.alias(c) for c, v in made.items()])


def clean_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with their texts cleaned (n_chars follows, if there); documents go that lose every line with a word."""
    (own,) = spare(docs, "own")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(own)
    out = dedup_lines(docs.select("doc_id", "source", "text", others), min_sites)
    stays = (F.col("n_removed") == 0) | (bare(F.col("clean")) != "")
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.where(stays).select(*[new[c].alias(c) if c in new else F.col(own).getField(c).alias(c) for c in docs.columns])


#: DuckDB: what op7 returns, with exact distinct counts throughout.
LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT doc_id, source, place, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM lines),
spread AS (SELECT line, min(doc_id) AS keeper FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT t.doc_id, t.place, t.raw, s.keeper IS NOT NULL AND t.doc_id <> s.keeper AS gone FROM trimmed t LEFT JOIN spread s ON t.line = s.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS clean_md5
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
"""
