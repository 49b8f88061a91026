import numpy as np
import pytest

from docquarry.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, cosine=0.95):
    x = x.astype(np.float64)
    norm = (x * x).sum(1)
    linked = (x @ x.T) / np.sqrt(np.outer(norm, norm)) >= cosine
    np.fill_diagonal(linked, False)
    least = np.array(ids)
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], 1 << 60).min(1))
        if (new == least).all():
            return {(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(1), least, strict=True)}
        least = new


def found(df):
    return {tuple(r) for r in df.collect()}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    assert found(vectors.near_vectors(spark, df)) == brute([r.vec_id for r in rows], np.array([r.embedding for r in rows]))


@pytest.mark.parametrize(("most", "cell_rows"), [(16, 4), (16, 1000), (60, 8)])
def test_clusters_copies_and_small_tiles(spark, monkeypatch, most, cell_rows):
    """Many cells of a few rows, one cell in many pieces, and some of both."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 16))
    x = np.concatenate([c + rng.normal(size=(80, 16)) * s for c, s in zip(centre, (0.05, 0.15, 0.2, 0.3, 1), strict=True)] + [np.repeat(centre[:1], 30, 0), 3 * centre[1:2]])
    x = x.astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    monkeypatch.setattr(vectors, "TILE_LEAST", 16)
    monkeypatch.setattr(vectors, "TILE_MOST", most)
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    for blocks in (1, 4, 7):
        assert found(vectors.near_vectors(spark, df, blocks=blocks)) == brute(ids, x)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0), (7, [1.0, 1.0], 0), (8, [2.0, 2.0], 0), (9, [1.0, 1.0], 0), (10, [1.0], 0), (11, [5.0], 0), (None, [1.0, 1.0], 0), (12, [-1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as block", "3 as copies")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark, df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 12)] + [(7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False), (10, 1, 10, True), (11, 1, 10, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(spark, df.where("false")).count() == 0
    assert vectors.near_vectors(spark, df.where("vec_id < 6")).count() == 5


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2.1e200]), (3, [1e-200, 1e-200]), (4, [-1e200, 1e200]), (5, [-0.0, 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(vectors.near_vectors(spark, df)) == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)}


def test_cells_hold_every_pair_within_reach():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    cells = vectors.Cells(x[:300], 600, 20, 0.3)
    home = cells.home(x)
    met = np.zeros((600, len(cells)), bool)
    met[np.arange(600), home] = True
    row, cell = cells.visits(x, home)
    met[row, cell] = True
    near = np.argwhere(np.triu(((x[:, None] - x[None]) ** 2).sum(2) <= 0.09, 1))
    assert len(cells) > 10 and all(met[i, min(home[i], home[j])] and met[j, min(home[i], home[j])] for i, j in near)
