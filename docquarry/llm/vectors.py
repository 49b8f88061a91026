"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.components import components, spanning_roots
from docquarry.llm.shared import cut, prepare

COSINE = 0.95
#: Blocks of the rotated space; vectors that fit the rotation and the cells (about); sampled vectors that a cell needs.
BLOCKS, FIT_ROWS, CELL_ROWS = 4, 16_384, 16
#: Least and most vectors of one side of a tile (in between, a third of all); rows and columns of one matrix product, which stay in
#: the processor's cache; pairs verified at once.
TILE_LEAST, TILE_MOST, STEP, COLUMNS, PAIRS = 1024, 16_384, 256, 4096, 16_384
SLACK = 1e-4
TILE = ["block", "cell", "kind", "i", "j"]
#: Tiles of two pieces of a cell, and of a piece of a cell with a piece of its visitors (the first also of the piece with itself).
WITHIN, VISITED = 0, 1


def rotate(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """x @ rotation in single precision, summed in a fixed order: a vector's result never depends on its neighbours in a batch."""
    out = np.zeros((len(x), rotation.shape[1]), np.float32)
    for j in range(rotation.shape[0]):
        out += x[:, j : j + 1] * rotation[j]
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 1/2 or more: exact, and no square of it overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def fitted_rotation(sample: np.ndarray, dims: int, blocks: int) -> np.ndarray:
    """An orthonormal basis of the sample's principal directions, dealt so that each block begins with a strong one."""
    if len(sample) > 1:
        _, basis = np.linalg.eigh(np.cov(sample.T.astype(np.float64)).reshape(dims, dims))
        basis = basis[:, ::-1]
    else:
        basis = np.eye(dims)
    order = np.concatenate([np.arange(b, dims, blocks) for b in range(blocks)])
    return np.ascontiguousarray(basis[:, order], dtype=np.float32)


def block_edges(dims: int, blocks: int) -> np.ndarray:
    return np.cumsum([0] + [len(range(b, dims, blocks)) for b in range(blocks)])


class Cells:
    """A partition of a block into boxes: halved at the median of the widest coordinate until a box has few enough rows."""

    def __init__(self, sample: np.ndarray, rows: int, most: int, radius: float):
        self.radius2, dims = radius * radius + SLACK, sample.shape[1]
        self.axis, self.at, self.below, self.above = [], [], [], []
        self.low, self.high = [], []
        share = rows / max(1, len(sample))

        def grow(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            """Add the node of a box; returns its number, or -1 - cell for a leaf."""
            axis = int(np.argmax(points.std(0))) if len(points) else 0
            at = float(np.median(points[:, axis])) if len(points) else 0.0
            upper = points[:, axis] > at if len(points) else np.zeros(0, bool)
            few = len(points) * share <= most or min(upper.sum(), (~upper).sum()) < CELL_ROWS
            # A cut that nearly all of the upper half reach across prunes nothing: such a box is dealt out in pieces instead.
            if few or np.mean(points[upper, axis] <= at + radius) > 0.98:
                self.low.append(low)
                self.high.append(high)
                return -len(self.low)
            node = len(self.axis)
            for column, value in ((self.axis, axis), (self.at, at), (self.below, 0), (self.above, 0)):
                column.append(value)
            edge_high, edge_low = high.copy(), low.copy()
            edge_high[axis] = edge_low[axis] = at
            self.below[node] = grow(points[~upper], low, edge_high)
            self.above[node] = grow(points[upper], edge_low, high)
            return node

        self.root = grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.axis, self.at, self.below, self.above = np.array(self.axis, int), np.array(self.at), np.array(self.below, int), np.array(self.above, int)

    def __len__(self) -> int:
        return len(self.low)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.full(len(x), self.root)
        while len(open_ := np.flatnonzero(node >= 0)):
            n = node[open_]
            node[open_] = np.where(x[open_, self.axis[n]] > self.at[n], self.above[n], self.below[n])
        return -1 - node

    def visits(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells of smaller number than a row's own whose box is within the radius of it."""
        far = np.zeros((len(x), len(self)), np.float32)
        for d in np.unique(self.axis):
            gap = np.maximum(self.low[:, d] - x[:, d, None], 0) + np.maximum(x[:, d, None] - self.high[:, d], 0)
            far += gap * gap
        return np.nonzero((far <= self.radius2) & (np.arange(len(self)) < home[:, None]))


def passes(delta: np.ndarray, edges: np.ndarray, total: float) -> np.ndarray:
    """(pairs, blocks): whether the squared distance within a block is in its share (by dimensions) of the total budget."""
    square = delta.astype(np.float64) ** 2
    dims = edges[-1]
    return np.stack([square[:, lo:hi].sum(1) <= total * (hi - lo) / dims for lo, hi in zip(edges[:-1], edges[1:], strict=True)], 1)


def tile_links(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, block: int, edges: np.ndarray, total: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a tile that are linked and whose first passing block is this one, a bounded number at a time.
    a, b: vectors; ra, rb: rotated."""
    lo, hi = edges[block], edges[block + 1]
    budget = total * (hi - lo) / edges[-1] + SLACK
    pa, pb = ra[:, lo:hi], rb[:, lo:hi]
    # One product gives p.q - |p|^2 / 2 - |q|^2 / 2, which is -1/2 of the squared distance.
    left = np.concatenate([pa, -(pa**2).sum(1, keepdims=True) / 2, np.ones((len(pa), 1), np.float32)], 1)
    right = np.ascontiguousarray(np.concatenate([pb, np.ones((len(pb), 1), np.float32), -(pb**2).sum(1, keepdims=True) / 2], 1).T)
    spots = ((start, low) for start in range(0, len(left), STEP) for low in range(start if same else 0, right.shape[1], COLUMNS))
    for start, low in spots:
        near = left[start : start + STEP] @ right[:, low : low + COLUMNS] >= -budget / 2
        some = np.flatnonzero(near.any(1))
        if not len(some):
            continue
        i, j = np.nonzero(near[some])
        i, j = some[i] + start, j + low
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            ok = passes(ra[x] - rb[y], edges, total)
            own = ok[:, block] & ~ok[:, :block].any(1)
            x, y = x[own], y[own]
            u, v = a[x], b[y]
            linked = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= cosine
            yield x[linked], y[linked]


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding; other columns are ignored).

    Two rows link if their cosine in double precision is at least `cosine`; n_links counts the other rows linked directly,
    component_id is the least vec_id reachable by links, kept tells whether it is the row's own. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing; vectors of different lengths never link.
    Rows that repeat a vector are linked rows; rows without a vec_id link with nothing, and have no component.

    Equal vectors (by a 128-bit hash) are one representative, its copies counted. Unit vectors are rotated by an orthonormal basis
    (fitted on about FIT_ROWS of them; any basis gives the same result) and split into blocks. Linked vectors are within the squared
    distance 2 - 2 * cosine, so in one block at least within that block's share of it: each block is range-joined over adaptive
    cells. A vector lives in one cell, and visits those of smaller number whose box is within reach, so that a pair meets in one cell
    a block; large cells are dealt out by hash in pieces, so that a tile is bounded. A pair counts in the first block that it passes,
    exactly verified there, so tiles return counts and spanning edges instead of pairs.
    """
    prepare(spark)
    clean = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    clean &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    values = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"), F.coalesce(clean, F.lit(False)).alias("clean"))
    keyed = base.where("clean").select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    reps = keyed.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    reps = cut(reps.withColumn("dims", F.size("embedding")), "vectors")
    found, single = None, dict(rows.dtypes)["embedding"] == "array<float>"
    for dims, n in sorted((r.dims, r["count"]) for r in reps.groupBy("dims").count().collect()):
        some = dimension_links(spark, reps.where(F.col("dims") == dims), dims, n, cosine, min(blocks, dims), single)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found, "tile-links")
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    members = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    facts = reps.select("k1", "k2", "rep", "copies").join(counts.withColumnRenamed("vec", "rep"), "rep", "left").join(members.withColumnRenamed("node", "rep"), "rep", "left")
    facts = cut(facts.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "facts")
    out = keyed.select("vec_id", "k1", "k2").join(facts, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = base.where("not clean").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def dimension_links(spark: SparkSession, reps: DataFrame, dims: int, n: int, cosine: float, blocks: int, single: bool) -> DataFrame:
    """(vec, links, root) rows of the tiles of vectors of one length: links to add up, and edges that connect."""
    share = max(1, round(min(1.0, FIT_ROWS / n) * 2**30))
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(2**30)) < share).select("rep", "embedding").toArrow().sort_by("rep")
    sample = unit(sample["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dims)) if len(sample) else np.zeros((0, dims), np.float32)
    rotation = fitted_rotation(sample, dims, blocks)
    edges, total = block_edges(dims, blocks), 2 - 2 * cosine + 1e-5
    tile = max(TILE_LEAST, min(TILE_MOST, n // 3))
    # Single-precision input stays so on its way: the sums are in double precision either way.
    kind = np.float32 if single else np.float64
    turned = rotate(sample, rotation)
    cells = [Cells(turned[:, edges[b] : edges[b + 1]], n, tile, float(np.sqrt(total * (edges[b + 1] - edges[b]) / dims))) for b in range(blocks)]

    def places(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: its number, the cell of each row, and (row, cell) of the visits."""
        turned = rotate(unit(x), rotation)
        for b in range(blocks):
            own = turned[:, edges[b] : edges[b + 1]]
            home = cells[b].home(own)
            yield b, home, *cells[b].visits(own, home)

    def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, home, _, visited in places(np.stack(batch["embedding"].to_numpy())):
                m = len(cells[b])
                yield pd.DataFrame({"block": b, "cell": np.arange(m), "homes": np.bincount(home, minlength=m), "visits": np.bincount(visited, minlength=m)})

    # A row for each cell: FIT_ROWS / CELL_ROWS a block at most.
    sums = reps.select("embedding").mapInPandas(count_cells, "block int, cell long, homes long, visits long").groupBy("block", "cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).collect()
    homes, guests = [np.ones(len(c), int) for c in cells], [np.ones(len(c), int) for c in cells]
    for r in sums:
        homes[r.block][r.cell], guests[r.block][r.cell] = max(1, -(-r.homes // tile)), max(1, -(-r.visits // tile))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["embedding"].to_numpy())
            ids, copies = batch["rep"].to_numpy(np.int64), batch["copies"].to_numpy(np.int64)
            whole = np.array([v.tobytes() for v in x.astype(kind)], object)
            mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

            def rows(at: np.ndarray, b: int, cell: np.ndarray, tile_kind: int, i, j, second) -> pd.DataFrame:  # noqa: B023
                return pd.DataFrame({"block": b, "cell": cell, "kind": tile_kind, "i": i, "j": j, "second": second, "rep": ids[at], "copies": copies[at], "vector": whole[at]})  # noqa: B023

            for b, home, row, visited in places(x):
                piece = mixed % homes[b][home]
                for k in range(int(guests[b][home].max())):
                    at = np.flatnonzero(guests[b][home] > k)
                    yield rows(at, b, home[at], VISITED, piece[at], k, False)
                for k in range(int(homes[b][home].max())):
                    at = np.flatnonzero((homes[b][home] > k) & (piece != k))
                    yield rows(at, b, home[at], WITHIN, np.minimum(piece[at], k), np.maximum(piece[at], k), piece[at] > k)
                for k in range(int(homes[b][visited].max(initial=0))):
                    some = np.flatnonzero(homes[b][visited] > k)
                    at, cell = row[some], visited[some]
                    yield rows(at, b, cell, VISITED, k, mixed[at] % guests[b][cell], True)

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        x = scaled(np.frombuffer(b"".join(group["vector"]), kind).reshape(-1, dims))
        turned = rotate(unit(x), rotation)
        ids, copies = group["rep"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)
        second = group["second"].to_numpy(bool)
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        links, root = np.zeros(len(x)), np.arange(len(x))
        sides = [(one, two, False)] + ([(one, one, True)] if key[2] == VISITED and key[4] == 0 else [])
        for left, right, same in sides:
            for i, j in tile_links(x[left], turned[left], x[right], turned[right], int(key[0]), edges, total, cosine, same):
                i, j = left[i], right[j]
                links += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
                apart = root[i] != root[j]
                if apart.any():
                    root = spanning_roots(len(x), np.r_[i[apart], np.arange(len(x))], np.r_[j[apart], root])
        some = np.flatnonzero(links)
        return pd.DataFrame({"vec": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})

    schema = "block int, cell long, kind int, i long, j long, second boolean, rep long, copies long, vector binary"
    tiles = reps.select("rep", "copies", "embedding").mapInPandas(dealt, schema)
    return tiles.groupBy(*TILE).applyInPandas(joined, "vec long, links long, root long")
