from collections import Counter

import numpy as np
import pytest

from docquarry.llm import components as graph
from docquarry.llm.components import components
from docquarry.llm.minhash import bag_minhash, keep_one, near_duplicates, overlaps, signatures
from docquarry.llm.shingles import multisets, spans

SCHEMA = "doc_id long, text string, source string"


def shingles(text, n=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute(rows, similarity=0.8):
    """Class of each doc_id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if a and b and jaccard(a, b) >= similarity]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            if least[i] != m or least[j] != m:
                least[i] = least[j] = m
                changed = True
    return least


def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(spark, docs).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(kept == (k == c) for k, (c, kept) in got.items())


def test_agreement_is_unbiased():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words + words[:200]), " ".join(words[:300] + words[:250])
    j = jaccard(shingles(a), shingles(b))
    doc, s, c = multisets([a, b], 5)
    times = bag_minhash(doc, s, c, 2, 4000)
    assert abs((times[0] == times[1]).mean() - j) < 0.03
    assert overlaps([a], [b])[0] == pytest.approx(j)


def test_heavy_weights_agree_too():
    a, b = " ".join(["x"] * 600), " ".join(["x"] * 500)
    doc, s, c = multisets([a, b], 5)
    times = bag_minhash(doc, s, c, 2, 2000)
    assert abs((times[0] == times[1]).mean() - 496 / 596) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    texts = [" ".join(f"a{i * j % 97}" for i in range(n)) for j, n in enumerate([3, 50, 500, 7])]
    whole = signatures(texts)
    for k, t in enumerate(texts):
        one = signatures([t])
        assert list(one["bands"][0]) == list(whole["bands"][k])
        assert one["k1"][0] == whole["k1"][k]


def test_odd_rows(spark):
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "same five words stand here", "a"), (4, "same five words stand here", None), (4, "same five words stand here", None), (None, "same five words stand here", "a"), (5, long, "a"), (6, long + " tail", "b"), (7, "short", "a"), (8, "short", "a"), (9, "  ", "a")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as bucket", "3 as class_id")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_duplicates(spark, docs).collect()), key=str)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (4, 3, False), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id for r in keep_one(spark, docs).where("doc_id is not null").collect()) == [1, 2, 3, 5, 7, 9]


def test_empty_table(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in rng.integers(0, 10_000, 300)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words), "s"))
        at = int(rng.integers(0, 295))
        words = [*words[:at], "new", f"n{k}", *words[at + 2 :]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark, docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("finish", [0, 70, 1000])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200}
    assert components(df.where("false")).count() == 0


def test_large_buckets_in_small_tiles(spark, monkeypatch):
    from docquarry.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 8)
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 10_000, 150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 8))):
            words[at] = f"x{k}_{at}"
        rows.append((1000 - k, " ".join(words), "s"))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_a_large_class_and_others_in_one_bucket(spark, monkeypatch):
    """Many near copies of one text in a bucket with texts that are too far from the two that all are held against."""
    from docquarry.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 6)
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(90):
        words = list(base)
        # Changes pile up from text to text, so that classes are chains, and ends of chains are unlike.
        for at in range(k // 3):
            words[(7 * at) % 200] = f"x{k // 3}_{at}" if k % 5 else f"x{at}"
        words[int(rng.integers(0, 200))] = f"y{k}"
        rows.append((int(rng.integers(0, 10**6)), " ".join(words), "s"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark, df, bands=60, rows=2).collect()}
    assert got == brute([(r[0], r[1]) for r in rows]) and 1 < len(set(got.values())) < 90


def test_ids_with_several_texts(spark):
    rng = np.random.default_rng(5)
    text = lambda first: " ".join([first, *(f"t{i}" for i in rng.integers(0, 10_000, 120))])
    low, high, copied, third, fourth = text("a"), text("z"), text("m"), text("q"), text("p")
    near = lambda t: t + " tail"
    rows = [
        *[(3, copied), (5, low), (5, high), (5, copied)],  # a copy of another id's text
        *[(13, third), (15, near(low) + " x y"), (15, near(third))],  # near copies, of 5 and of 13
        *[(25, fourth), (25, near(fourth)), (26, fourth + " more")],  # near copies under one id
        *[(31, "said twice over"), (31, "said twice over"), (32, ""), (32, "")],
        *[(41, "same words"), (41, "same  words"), (None, "no id"), (None, "no id")],
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    stay = Counter((r.doc_id, r.text) for r in keep_one(spark, docs).collect())
    fourths = [(25, fourth), (25, near(fourth))]
    sames = [(41, "same words"), (41, "same  words")]
    assert sum(stay[x] for x in fourths) == 1 and sum(stay[x] for x in sames) == 1
    want = {(3, copied): 1, (5, low): 1, (5, high): 1, (13, third): 1, (31, "said twice over"): 1, (32, ""): 1, (None, "no id"): 2}
    assert {k: n for k, n in stay.items() if k not in fourths + sames} == want


def test_an_id_whose_other_text_is_a_copy(spark):
    for a, b in (("a", "m"), ("z", "m")):
        alone, copied = " ".join(f"{a}{i}" for i in range(60)), " ".join(f"{b}{i}" for i in range(60))
        for second in (copied, copied + " tail"):
            docs = spark.createDataFrame([(3, copied, "s"), (5, alone, "s"), (5, second, "s")], SCHEMA)
            assert sorted((r.doc_id, r.text) for r in keep_one(spark, docs).collect()) == [(3, copied), (5, alone)]


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", "h", 5, "x"), (2, "a b c d e f", "h", 6, "y"), (3, "other words", "h", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string, _id long, text_hash string")
    assert sorted(map(tuple, keep_one(spark, docs).collect())) == [rows[0], rows[2]]


def test_ranges_of_texts():
    assert list(spans([])) == [] and list(spans([5])) == [(0, 1)]
    assert list(spans([600_000, 600_000, 1, 5_000_000, 2])) == [(0, 1), (1, 3), (3, 4), (4, 5)]
