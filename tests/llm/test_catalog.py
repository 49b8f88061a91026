"""The registered queries against DuckDB, and the pipeline against brute force, stage by stage."""

import hashlib
import os
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm import catalog, mixing, quality
from docquarry.llm.shared import cut, table

sys.path.insert(0, os.path.dirname(__file__))

import test_lines  # noqa: E402
import test_minhash  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str)
    result = c.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(x) for x in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)


def test_ten_queries_are_registered():
    assert sorted(catalog.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(catalog.queries())
    assert len(catalog.queries()) == 10


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near duplicates", "mixing sources", "bpe tokens"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut(stage(spark, docs, sf))
        rows[name] = docs.collect()
        assert k == 4 or docs.columns == columns
        if k == 0:
            scored = quality.classify(spark, before, table(spark, sf, "labels")).where("predicted = 1")
            assert sorted(r.doc_id for r in rows[name]) == sorted(r.doc_id for r in scored.collect())
        elif k == 1:
            source = [(r.doc_id, r.text, r.source, r.n_chars) for r in before.collect()]
            clean = {i: t for i, _, n, t in test_lines.brute(source) if n == 0 or any(x.strip(" \t\r\x0b\x0c") for x in t.split("\n"))}
            assert {r.doc_id: r.text for r in rows[name]} == clean
        elif k == 2:
            classes = test_minhash.brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in rows[name]) == sorted(set(classes.values()))
        elif k == 3:
            taken = {r.doc_id: r.taken for r in mixing.mix_report(spark, before).collect() if r.taken}
            words = {}
            for r in rows[name]:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(mixing_words(r.text))
            assert words == taken
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = []
            for r in before.collect():
                ids = library.encode(r.text, add_special_tokens=False).ids
                want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
            assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows[name])
    # Reruns agree.
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, rows["bpe tokens"]))


def mixing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_pipeline_of_empty_and_odd_tables(spark, sf, tmp_path):
    import corpus_pipeline

    schema = table(spark, sf, "documents").schema
    table(spark, sf, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c", "en", None, 5), (3, "x " * 90_000, "en", "a", 180_000), (3, "x " * 90_000, "en", "a", 180_000)]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len(out) <= 3 * len(rows)


def test_mix_seed_changes_the_draw(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = (mixing.mix_report(spark, docs, seed=s).collect() for s in (1, 2))
    assert sorted(map(tuple, a)) != sorted(map(tuple, b))
