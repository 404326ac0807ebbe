"""Operator 2: nearest neighbours by stable projections and a kd-tree.

Vectors are projected to ``dims`` Gaussian (2-stable) coordinates, made orthogonal,
which keep squared distances up to a chi-square factor with ``dims`` degrees of freedom
(orthogonal ones stray less, so the test errs on the safe side). Largest inner product
is turned into nearest distance by the usual extra coordinate ``sqrt(M^2 - |x|^2)``, M
being the largest norm.

One kd-tree over the projections, fitted on at most ``SAMPLE`` rows (those with the least
hash of vec_id, a bound that does not grow), has cells of about ``shard_rows`` rows.
Every row is routed to its cell; a cell that is too large (many copies of one vector,
more rows than a sample can tell apart) is split by hash into blocks. Queries are routed
twice. They first search one block of their own cell, which bounds the distance
of their k-th neighbour. Then they go to those cells only that the chi-square test does
not exclude: a cell, a leaf or a row is left out once a vector nearer than the present
k-th would, with probability ``confidence``, have had a smaller projected distance.
In a block a kd-tree of its own hands out leaves in order of their projected distance,
rows that pass the test are verified on the original coordinates in double precision,
and the bound tightens as they are.

A task holds the rows of one block, and queries stream past them; blocks that more than
``query_rows`` queries visit are shared by several tasks.

Equal vectors of a block are one row of the search, with all their ids; where more
rows than are kept lie at the k-th score, up to rounding, they are cut by exact
score and least vec_id.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither do rows without a vec_id or whose length is
not the most frequent one (of equally frequent ones the shorter). Ties go to the
smaller vec_id. A query never returns rows of its own vec_id. Of rows with one vec_id
the one with the least vector counts. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, ship, stored, table

DIMS = 24
CONFIDENCE = 0.84
LEAF = 128
SHARD_ROWS = 16384
QUERY_ROWS = 65536
#: Rows that the cells are fitted on, and how many of them a cell needs.
SAMPLE, CELL_SAMPLE = 40_000, 8
SLACK = 12


def chi2_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    half = np.minimum(x / 2.0, 700.0)
    term = np.ones_like(half)
    total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1.0 - np.exp(-half) * total


def chi2_quantile(share: float, dims: int) -> float:
    """Where the distribution function reaches ``share``."""
    if share >= 1:
        return math.inf
    low, high = 0.0, 1400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(np.array([mid]), dims)[0] < share else (low, mid)
    return high


class Cells:
    """A kd-tree of few cells: a number for each point, and the bounds of each cell."""

    def __init__(self, points: np.ndarray, count: int):
        width = points.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []
        low, high = [], []

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, cells: int) -> int:
            """The place of a node, or below zero, of a cell."""
            part = points[rows]
            if cells > 1 and len(rows) > 1:
                axis = int(np.argmax(part.max(0) - part.min(0)))
                left = cells // 2
                at = float(np.partition(part[:, axis], k := len(rows) * left // cells)[k])
                below = part[:, axis] < at
                if below.any() and not below.all():
                    node = len(self.nodes)
                    self.nodes.append((axis, at, 0, 0))
                    hi_left, lo_right = hi.copy(), lo.copy()
                    hi_left[axis] = lo_right[axis] = at
                    self.nodes[node] = (axis, at, grow(rows[below], lo, hi_left, left), grow(rows[~below], lo_right, hi, cells - left))
                    return node
            low.append(lo)
            high.append(hi)
            return -len(low)

        self.root = grow(np.arange(len(points)), np.full(width, -np.inf), np.full(width, np.inf), count)
        self.low, self.high = np.array(low), np.array(high)

    def route(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        axis, value, left, right = (np.array(x) for x in zip(*self.nodes)) if self.nodes else [np.zeros(0)] * 4
        while len(rows := np.flatnonzero(at >= 0)):
            n = at[rows]
            at[rows] = np.where(points[rows, axis[n]] < value[n], left[n], right[n])
        return -at - 1

    def distances(self, queries: np.ndarray) -> np.ndarray:
        return _box_distances(self.low, self.high, queries)


def _box_distances(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d : d + 1]
        gap = np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0.0)
        out += gap * gap
    return out


class KdTree:
    """Leaves of a balanced kd-tree: row order, leaf bounds and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        bounds: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= leaf:
                bounds.append((lo, hi))
                continue
            part = points[order[lo:hi]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.order = order
        self.bounds = sorted(bounds)
        self.low = np.array([points[order[a:b]].min(0) for a, b in self.bounds])
        self.high = np.array([points[order[a:b]].max(0) for a, b in self.bounds])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        return _box_distances(self.low, self.high, queries)


class Projection:
    """``dims`` coordinates of lifted vectors; squared distances are chi-square times the true ones."""

    def __init__(self, width: int, top: float, dims: int = DIMS):
        self.top, self.dims = top, max(2, min(dims, (width + 1) // 2 * 2))
        drawn = np.random.default_rng(20240117).standard_normal((width + 1, self.dims))
        self.basis = np.linalg.qr(drawn)[0] * math.sqrt(width + 1)

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        return vectors @ self.basis[:-1] + rest[:, None] * self.basis[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.basis[:-1]


class Block:
    """The rows of one block, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection):
        vectors, self.ids, starts, copies = _grouped(ids, vectors)
        points = projection.rows(vectors)
        self.projection, self.tree = projection, KdTree(points)
        order = self.tree.order
        self.points, self.vectors, self.starts, self.copies = points[order], vectors[order], starts[order], copies[order]
        self.least = self.ids[self.starts]
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.verified = 0

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE, floor: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` rows for each query, none below its ``floor``: arrays of query position, vec_id and score."""
        tree, vectors, copies, least, dims = self.tree, self.vectors, self.copies, self.least, self.projection.dims
        width, top = vectors.shape[1], self.projection.top
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        projected = self.projection.queries(queries)
        p_norm = np.einsum("ij,ij->i", projected, projected)
        boxes = tree.distances(projected)
        ranking = np.argsort(boxes, axis=1, kind="stable")
        q_norm = np.einsum("ij,ij->i", queries, queries)
        keep = k + SLACK
        limit = chi2_quantile(confidence, dims)
        # no product of a query with a row is further than half of this from its exact score
        rounding = 4 * width * np.finfo(np.float64).eps * np.sqrt(q_norm * top)
        best = np.full((len(queries), keep), -np.inf)
        rows = np.full((len(queries), keep), -1, dtype=np.int64)
        leaves = len(tree.bounds)
        stride = max(2, leaves // 12)
        widest = max(b - a for a, b in tree.bounds)

        def radius(who: np.ndarray) -> np.ndarray:
            """Projected squared distance beyond which the test excludes."""
            kth = np.maximum(-np.partition(-best[who], k - 1, axis=1)[:, k - 1], floor[who])
            far = np.where(np.isfinite(kth), np.maximum(q_norm[who] + top - 2.0 * kth, 0.0) * (1 + 1e-9) + 1e-12, np.inf)
            return far * limit

        active = np.arange(len(queries))
        done = 0
        while done < leaves:
            near = radius(active)
            inside = boxes[active, ranking[active, done]] <= near
            active, near = active[inside], near[inside]
            if not len(active):
                break
            now = ranking[active, done : done + stride]
            steps = now.shape[1]
            scores = np.full((len(active), keep + steps * widest), -np.inf)
            places = np.full(scores.shape, -1, dtype=np.int64)
            scores[:, :keep], places[:, :keep] = best[active], rows[active]
            flat = np.argsort(now, axis=None, kind="stable")
            leaf_of = now.ravel()[flat]
            for group in np.split(flat, np.flatnonzero(np.diff(leaf_of)) + 1):
                who, slot = group // steps, group % steps
                leaf = now[who[0], slot[0]]
                passing = boxes[active[who], leaf] <= near[who]
                who, slot = who[passing], slot[passing]
                if not len(who):
                    continue
                a, b = tree.bounds[leaf]
                q = active[who]
                gap = self.norms[a:b] + p_norm[q][:, None] - 2.0 * (projected[q] @ self.points[a:b].T)
                mine = (copies[a:b] == 1) & (least[a:b] == query_ids[q][:, None])
                i, j = np.nonzero((gap <= near[who][:, None]) & ~mine)
                self.verified += len(i)
                cols = keep + slot[i] * widest + j
                scores[who[i], cols] = _products(queries, q[i], vectors, a + j)
                places[who[i], cols] = a + j
            pick = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            cut = -np.partition(-np.take_along_axis(scores, pick, 1), k - 1, axis=1)[:, k - 1] - rounding[active]
            for i in np.flatnonzero(np.isfinite(cut) & ((scores >= cut[:, None]).sum(axis=1) > keep)):
                tied = np.flatnonzero(scores[i] >= cut[i])
                at = places[i, tied]
                pick[i] = tied[np.lexsort((least[at], -_exact(queries[active[i]], vectors[at])))[:keep]]
            best[active] = np.take_along_axis(scores, pick, 1)
            rows[active] = np.take_along_axis(places, pick, 1)
            done += steps
        who, col = np.nonzero(np.isfinite(best))
        at = rows[who, col]
        score = _exact(queries[who], vectors[at])
        # of each group the k least ids but the query's own can be among the best
        sizes = np.minimum(copies[at], k + 1)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        who, score, found = np.repeat(who, sizes), np.repeat(score, sizes), self.ids[np.repeat(self.starts[at], sizes) + offset]
        other = (found != query_ids[who]) & (score >= floor[who])
        who, score, found = who[other], score[other], found[other]
        order = np.lexsort((found, -score, who))
        who, score, found = who[order], score[order], found[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        return who[nth < k], found[nth < k], score[nth < k]


def _products(queries: np.ndarray, i: np.ndarray, vectors: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The products of the pairs, a bounded number of rows at a time."""
    out = np.empty(len(i))
    for lo in range(0, len(i), step):
        part = slice(lo, lo + step)
        out[part] = np.einsum("ij,ij->i", queries[i[part]], vectors[j[part]])
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (queries * vectors).sum(axis=1)


def _grouped(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different vectors, all ids by vector and then size, and of each vector where its ids start and how many they are."""
    # adding zero makes -0.0 and 0.0 equal
    whole = np.ascontiguousarray(vectors + 0.0)
    _, first, group, copies = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    return whole[first], ids[np.lexsort((ids, group))], np.cumsum(copies) - copies, copies


def _usable(df: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part; components keep their type."""
    narrow = dict(df.dtypes).get("embedding") == "array<float>"
    v = F.col("embedding").cast("array<float>" if narrow else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _blocks(keys: list[str], width: int, k: int, projection: Projection, confidence: float, verified=None):
    """Searches sorted rows: those of a block, then the queries that visit it, which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        held_key, ids, parts, block = None, [], [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "asks"]], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1).tolist(), n]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(marks[lo, :-1].tolist())
                if key != held_key:
                    held_key, ids, parts, block = key, [], [], None
                part = batch.slice(lo, hi - lo)
                mine, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)
                if not marks[lo, -1]:
                    ids.append(mine)
                    parts.append(v)
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(parts), projection)
                floor = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                for at in range(0, len(mine), 1024):
                    s = slice(at, at + 1024)
                    who, found, score = block.search(mine[s], v[s], k, confidence, floor[s])
                    yield pa.RecordBatch.from_arrays([pa.array(mine[s][who]), pa.array(found), pa.array(score)], names)
                if verified is not None:
                    verified.add(block.verified)
                    block.verified = 0

    return run


_FOUND = "query_id long, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    confidence: float = CONFIDENCE,
    dims: int = DIMS,
    sample: int = SAMPLE,
    verified=None,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every usable row whose vec_id is divisible by ``query_every``.

    ``verified`` is an accumulator for the number of products taken on original vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = _usable(vectors)
    # one small aggregate: the width that holds, and its largest norm
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    widths = usable.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"))
    found = widths.orderBy(F.desc("n"), "w").limit(1).collect()
    width, n, top = found[0] if found else (1, 0, 1.0)
    usable = usable.filter(F.size("v") == width)
    if not usable.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        usable = usable.groupBy("vec_id").agg(F.min("v").alias("v"))
    projection = Projection(width, top, dims)
    drawn = bounded_sample(usable, ["vec_id"], sample).select("v").toArrow().column("v").combine_chunks()
    count = max(1, min(math.ceil(n / shard_rows), len(drawn) // CELL_SAMPLE))
    cells = Cells(projection.rows(_matrix(drawn, width)) if len(drawn) else np.zeros((0, projection.dims)), count)
    kind = dict(usable.dtypes)["v"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            own = cells.route(projection.rows(v)).astype(np.int32)
            asks = batch.column("vec_id").to_numpy() % query_every == 0
            home = np.where(asks, cells.route(projection.queries(v)), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(home)], ["vec_id", "v", "cell", "home"])

    routed = stored(usable.select("vec_id", "v").mapInArrow(route, f"vec_id long, v {kind}, cell int, home int"), "routed")
    # at most SAMPLE / CELL_SAMPLE rows each
    sizes = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {c: math.ceil(m / shard_rows) for c, m in sizes.items()}
    block_of = lambda c, of: F.pmod(F.xxhash64("vec_id", F.lit(of)), c)

    def searched(visits: DataFrame) -> DataFrame:
        """Results of ``visits`` (``cell, block, vec_id, v, floor``), each with the rows of its block."""
        each = visits.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"))
        loads = {r["cell"]: r["n"] for r in each.groupBy("cell").agg(F.max("n").alias("n")).collect()}
        plan = spark.createDataFrame([(c, blocks[c], math.ceil(m / query_rows)) for c, m in loads.items() if c in blocks], "cell int, blocks int, shares int")
        rows = routed.select("vec_id", "v", "cell").join(F.broadcast(plan), "cell").select(
            "cell", block_of(F.col("blocks"), 1).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("floor")
        )
        asked = visits.join(F.broadcast(plan), "cell").select("cell", "block", block_of(F.col("shares"), 2).cast("int").alias("share"), F.lit(1).alias("asks"), "vec_id", "v", "floor")
        keys = ["cell", "block", "share"]
        together = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks")
        return together.mapInArrow(_blocks(keys, width, k, projection, confidence, verified), _FOUND)

    def with_block(df: DataFrame) -> DataFrame:
        known = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
        return df.join(F.broadcast(known), "cell")

    # a query whose cell holds no row starts with nothing and visits all
    asked = routed.filter("home >= 0").select("vec_id", "v", F.col("home").alias("cell"))
    own = with_block(asked).select("cell", block_of(F.col("blocks"), 3).cast("int").alias("block"), "vec_id", "v", F.lit(float("-inf")).alias("floor"))
    first = stored(searched(own), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    limit = chi2_quantile(confidence, projection.dims)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, floor = _matrix(batch.column("v"), width), batch.column("floor").to_numpy()
            far = np.where(np.isfinite(floor), np.maximum(np.einsum("ij,ij->i", v, v) + top - 2.0 * floor, 0.0) * (1 + 1e-9) + 1e-12, np.inf)
            for lo in range(0, len(v), 256):
                who, cell = np.nonzero(cells.distances(projection.queries(v[lo : lo + 256])) <= (far * limit)[lo : lo + 256, None])
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(who + lo)) for i in range(4)] + [pa.array(cell.astype(np.int32))], ["vec_id", "v", "home", "floor", "cell"])

    bounded = asked.select("vec_id", "v", F.col("cell").alias("home")).join(kth, F.col("vec_id") == F.col("query_id"), "left")
    bounded = bounded.select("vec_id", "v", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    visits = with_block(bounded.mapInArrow(visit, f"vec_id long, v {kind}, home int, floor double, cell int"))
    visits = visits.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v", "floor", "home", block_of(F.col("blocks"), 3).cast("int").alias("seen"))
    visits = stored(visits.filter("cell != home or block != seen").select("cell", "block", "vec_id", "v", "floor"), "visits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(searched(visits))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def brute(vec_ids: np.ndarray, vectors: np.ndarray, k: int = 20, query_every: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Every query's true neighbours, for recall."""
    out = {}
    for i in np.flatnonzero(vec_ids % query_every == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        ranked = heapq.nsmallest(k, ((-s, int(v)) for s, v in zip(scores, vec_ids) if v != vec_ids[i]))
        out[int(vec_ids[i])] = [(v, -s) for s, v in ranked]
    return out


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_ann": op2_ann}
ORACLES: dict[str, str] = {}
