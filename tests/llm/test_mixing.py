import re

import numpy as np
import pytest

from docquarry.llm import mixing
from docquarry.llm.mixing import mix_report, mix_texts, mixed, permuted, planned

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights, most):
    """Targets by resharing the excess again and again, as the rule is told."""
    targets = [0.0] * len(sizes)
    live = list(range(len(sizes)))
    left = float(sum(sizes))
    while live and left > 1e-9:
        total = sum(weights[i] for i in live)
        gives = {i: left * weights[i] / total for i in live}
        left = 0.0
        for i in list(live):
            targets[i] += gives[i]
            if targets[i] >= most * sizes[i]:
                left += targets[i] - most * sizes[i]
                targets[i] = float(most * sizes[i])
                live.remove(i)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100], [10, 1000, 1000], [0, 0], [5, 0, 7], [1, 1, 1, 5000, 2, 900, 3, 40], list(range(1, 200, 3)), []])
def test_targets_of_a_plan(spark, sizes):
    names = [None if i == len(sizes) - 1 else f"s{i:03d}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(3)
    rows = sorted(planned(df).collect(), key=lambda r: r.number)
    want = shared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [r.source for r in rows] == names and [r.target for r in rows] == pytest.approx(want)
    for r, t in zip(rows, want, strict=True):
        whole, rest = divmod(round(r.target), r.source_size) if r.source_size else (0, 0)
        assert (r.blocks, r.slots, r.tail) == (-(-r.source_size // 64), whole * -(-r.source_size // 64) + rest // 64, rest % 64), t


def test_many_sources_in_groups(spark, monkeypatch):
    """Sources drawn for in several tasks still give their targets."""
    monkeypatch.setattr(mixing, "DRAW_SOURCES", 4)
    rows = [(i, "w " * (60 + 37 * i), "en", f"s{i % 23:02d}", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed(spark, docs)[0].groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max", "size": "sum"}).collect()
    assert len(out) == 23 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 64 and r["max(source_size)"] == r["sum(size)"] for r in out)


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        got = permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_targets_are_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_report(spark, docs).collect()
    text = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == len(text)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = text[r.doc_id].source
        assert r["size"] == len(WORD.findall(text[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = (r.target, r.source_size)
    names = sorted(sizes)
    want = shared([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, t in zip(names, want, strict=True):
        assert target[s] == (pytest.approx(t), sizes[s])
        assert abs(taken[s] - t) <= 64
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_report(spark, docs.repartition(3)).collect()))


def test_texts_have_the_words_that_the_report_tells(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    report = {r.doc_id: r for r in mix_report(spark, docs).collect()}
    got, whole = {}, {r.doc_id: r.text for r in docs.collect()}
    rows = mix_texts(spark, docs).collect()
    assert rows[0].__fields__ == docs.columns
    for r in rows:
        n = len(WORD.findall(r.text))
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        assert r.n_chars == len(r.text)
        if n == report[r.doc_id]["size"]:
            assert r.text == whole[r.doc_id]
    assert got == {k: r.taken for k, r in report.items() if r.taken}


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "x y z", "en", None, 5), (3, "one two", None, "b", 7), (3, "one two", None, "b", 7), (4, "w " * 500, "en", "a", 1000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as start", "8 as number", "9 as size")
    out = mix_report(spark, docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in out) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("4", 500), ("None", 3)]
    assert sum(r.taken for r in mix_report(spark, docs).collect()) == sum(len((r.text or "").split()) for r in mix_texts(spark, docs).collect())
    none = spark.createDataFrame([], SCHEMA)
    assert mix_report(spark, none).count() == 0 and mix_texts(spark, none).count() == 0
    assert [r.taken for r in mix_report(spark, docs.where("doc_id = 1")).collect()] == [0]


def test_one_text_under_two_sources(spark):
    text = "one two three " * 40
    rows = [(1, text, "en", "a", 1), (1, text, "fr", "b", 2), (1, text, "de", None, 3), (2, "w " * 900, "en", "a", 4), (3, "v " * 900, "en", "b", 5)]
    for more in ([], [(4, "u " * 90, "en", "a", 6)] * 2):
        docs = spark.createDataFrame(rows + more, SCHEMA)
        want, got = {}, {}
        report = mixed(spark, docs)[0].select("doc_id", "source", "taken").collect()
        for r in report:
            want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
        for r in mix_texts(spark, docs).collect():
            assert r.doc_id != 1 or r.lang == {"a": "en", "b": "fr", None: "de"}[r.source]
            got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
        assert got == {k: n for k, n in want.items() if n}


def test_rows_of_one_id_and_text_keep_their_own_columns(spark):
    text = "one two three four " * 50
    rows = [(1, text, "en", "a", 1), (1, text, "fr", "a", 2), (1, text, "fr", "a", 2), (2, "w " * 300, "de", "b", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    report = mixed(spark, docs)[0].select("doc_id", "taken").collect()
    got = mix_texts(spark, docs).collect()
    assert {r.lang for r in got if r.doc_id == 1} <= {"en", "fr"}
    for i in (1, 2):
        assert sum(len(r.text.split()) for r in got if r.doc_id == i) == sum(r.taken for r in report if r.doc_id == i)
