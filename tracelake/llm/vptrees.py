"""Operator 10: nearest neighbours by largest inner product, with vantage-point trees.

All vectors of one length are lifted onto a sphere of the largest norm M by one
more component sqrt(M^2 - |x|^2), and queries are scaled to M; the nearest point
by Euclidean distance is then the one with the largest inner product, and the
triangle inequality holds.

1. Up to ``PIVOTS`` pivots, one for each shard's worth of vectors, are fitted on a sample
   of ``SAMPLE`` vectors of each length (some rounds of k-means in one task); every vector is
   then put into the cell of its nearest pivot, and a cell keeps the distances to its pivot
   between which it lies.
2. A cell is dealt by a hash of the id into shards, of a 16th of the vectors of a length but
   256 to ``SHARD``, and each shard builds one tree: a node splits its points at the median
   distance to a vantage point, down to leaves of ``LEAF``.
3. A query first searches the cell of its own nearest pivot.  The k-th distance found
   there is its bound: it then goes only to cells, and in them only to subtrees, where

       factor * gap <= bound

   with gap the least distance that the triangle inequality allows.  Factor one skips
   nothing that could matter and is an exact search; a larger factor skips more.

Queries meet shards in a shuffle, so many to a task at most; a shard's answers, at most
k a query, are merged by rank, cut before the shuffle too.  Scores are inner products of
the vectors as given, summed in double precision.

Vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null vec_id take no part.  A query meets candidates of its own length.
Rows that share a vec_id count once, by their smallest vector.  Ties go to the
smaller vec_id: a shard keeps every point that ties with the last place within
rounding, and cuts by exact score and id.  Equal vectors of a shard are one point of its
tree.  Empty tables give empty results.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import settle, share

#: Vectors of a shard at most (see shard_size), points of a leaf.
SHARD, LEAF = 8192, 32
#: Cells of a length of vectors at most, and the vectors that their pivots are fitted on.
PIVOTS, SAMPLE, ROUNDS = 512, 8192, 8
#: Queries that meet a shard in one task, about.
QUERIES = 4096
FACTOR = 1.3


def rounding(dim: int, scale: float) -> float:
    """How much two squared distances may differ by rounding alone."""
    return 8 * (dim + 8) * np.finfo(np.float64).eps * scale


class Tree:
    """A vantage-point tree over rows of points; nodes are ranges of the permuted rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # begin, end, vantage point, children, their nearest and farthest distances
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][3][side] = me
            if b - a <= leaf:
                self.nodes.append((a, b, -1, None, None))
                continue
            rows = self.order[a:b]
            picks = rng.choice(rows, min(8, len(rows)), replace=False)
            probe = rng.choice(rows, min(64, len(rows)), replace=False)
            spread = [np.var(np.linalg.norm(points[probe] - points[p], axis=1)) for p in picks]
            vantage = int(picks[int(np.argmax(spread))])
            d = np.linalg.norm(points[rows] - points[vantage], axis=1)
            by = np.argsort(d, kind="stable")
            self.order[a:b], d = rows[by], d[by]
            m = (b - a) // 2
            self.nodes.append((a, b, vantage, [0, 0], ((d[0], d[m - 1]), (d[m], d[-1]))))
            todo += [(a, a + m, me, 0), (a + m, b, me, 1)]

    def within(self, points: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance), by query and distance, of the k nearest points found and of all that tie with the k-th.

        Points tie when their squared distances differ by no more than rounding may.
        bound holds for each query a squared distance beyond which nothing is wanted.
        """
        dist, kept = np.full((len(queries), k), np.inf), []
        if bound is not None:
            dist[:] = bound[:, None]
        norms, own = (points * points).sum(1), (queries * queries).sum(1)
        scale = max(norms.max(initial=0.0), own.max(initial=0.0))
        slack = rounding(points.shape[1], scale)

        def visit(i: int, active: np.ndarray) -> None:
            a, b, vantage, children, reach = self.nodes[i]
            if children is None:
                rows = self.order[a:b]
                d = np.maximum(own[active, None] + norms[rows] - 2 * queries[active] @ points[rows].T, 0)
                some = np.flatnonzero((d <= dist[active, -1:] + slack).any(axis=1))
                if len(some):
                    at, d = active[some], d[some]
                    dist[at] = np.partition(np.concatenate([dist[at], d], axis=1), k - 1, axis=1)[:, :k]
                    q, r = np.nonzero(d <= dist[at, -1:] + slack)
                    kept.append((at[q], rows[r], d[q, r]))
                return
            d = np.linalg.norm(queries[active] - points[vantage], axis=1)
            first = (d > 0.5 * (reach[0][1] + reach[1][0])).astype(int)  # the likelier child
            for turn in (0, 1):
                for side in (0, 1):
                    use = (first == side) == (turn == 0)
                    lo, hi = reach[side]
                    gap = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                    use &= factor * gap <= np.sqrt(dist[active, -1] + slack) + slack / max(np.sqrt(scale), 1e-300)
                    if use.any():
                        visit(children[side], active[use])

        if len(points) and len(queries):
            visit(0, np.arange(len(queries)))
        if not kept:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        q, rows, d = (np.concatenate(x) for x in zip(*kept))
        near = np.flatnonzero(d <= dist[q, -1] + slack)
        near = near[np.lexsort((d[near], q[near]))]
        return q[near], rows[near], d[near]

    def search(self, points: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distance, row) of the k nearest points found for each query; row -1 where there are fewer."""
        dist, found = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        q, rows, d = self.within(points, queries, k, factor)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        use = place < k
        dist[q[use], place[use]], found[q[use], place[use]] = np.sqrt(d[use]), rows[use]
        return dist, found


def _matrix(column, n: int) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _by_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a group, by id."""
    table = table.sort_by("vec_id")
    return table["vec_id"].to_numpy(), _matrix(table["embedding"], table.num_rows)


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors on the sphere of radius top."""
    return np.concatenate([vectors, np.sqrt(np.maximum(top**2 - (vectors**2).sum(1), 0))[:, None]], axis=1)


def scaled(queries: np.ndarray, top: float) -> np.ndarray:
    """Queries on the sphere of radius top."""
    return np.concatenate([queries * (top / np.linalg.norm(queries, axis=1, keepdims=True)), np.zeros((len(queries), 1))], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each point (a row) to each pivot."""
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T, 0))


def fit_pivots(points: np.ndarray, count: int, seed: int = 4) -> np.ndarray:
    """At most count pivots: means of some rounds of k-means."""
    points = points[np.lexsort(points.T[::-1])]
    made = np.unique(points[np.random.default_rng(seed).choice(len(points), min(count, len(points)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        near = np.concatenate([distances(points[i : i + 1024], made).argmin(axis=1) for i in range(0, len(points), 1024)])
        sizes = np.bincount(near, minlength=len(made))
        sums = np.zeros_like(made)
        np.add.at(sums, near, points)
        made = sums[sizes > 0] / sizes[sizes > 0, None]
    return made


class Shard:
    """The distinct vectors of a shard with the k + 1 smallest ids of each, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, k: int):
        self.vectors, same = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(same, kind="stable")  # ids ascend, so the first of each are its smallest
        ends = np.cumsum(np.bincount(same))
        # a query wants at most k of equal vectors, and its own id may be among them
        self.ids = [ids[by[a:b]][: k + 1] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
        self.top = top
        self.tree = Tree(self.points())

    def points(self) -> np.ndarray:
        return lifted(self.vectors, self.top)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None):
        """(query_id, vec_id, score) of the k best of each query, without itself."""
        asked, found, _ = self.tree.within(self.points(), scaled(queries, self.top), min(k + 1, len(self.vectors)), factor, bound)
        begin = np.searchsorted(asked, np.arange(len(queries) + 1))
        for q, own, a, b in zip(queries, ids.tolist(), begin, begin[1:]):
            if a == b:
                continue
            rows = found[a:b]
            scores = (self.vectors[rows] * q).sum(axis=1).repeat([len(self.ids[r]) for r in rows])
            names = np.concatenate([self.ids[r] for r in rows])
            scores, names = scores[names != own], names[names != own]
            best = np.lexsort((names, -scores))[:k]
            for s, i in zip(scores[best].tolist(), names[best].tolist()):
                yield own, i, s


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def shard_size(n: Column) -> Column:
    """How many of n vectors of a length make a shard."""
    return F.least(F.lit(SHARD), F.greatest(F.lit(256), F.ceil(n / 16))).cast("long")


def _pivots(sound: DataFrame, sizes: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """By length of vectors: the largest norm and the pivots, fitted on a bounded sample in a task a length.

    A length has a pivot for each shard, so there are no more than lengths and shards together.
    """
    # a share of the hashes, by the length's count, that leaves about twice the sample; the smallest of them are taken
    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 31))
    some = sound.join(sizes, "dim").where(draw * F.col("n") <= 2.0 * SAMPLE * (1 << 31))
    first = F.row_number().over(Window.partitionBy("dim").orderBy(draw, "vec_id"))
    picked = some.withColumn("_n", first).where(F.col("_n") <= SAMPLE).drop("_n")

    def fit(key, table):
        top, n = table["top"][0].as_py(), table["n"][0].as_py()
        made = fit_pivots(lifted(_matrix(table["embedding"], table.num_rows), top), min(PIVOTS, -(-n // table["shard"][0].as_py())))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "top": [top], "pivots": pa.array([pickle.dumps(made)], pa.binary())})

    rows = picked.select("dim", "top", "n", "shard", "embedding").groupBy("dim").applyInArrow(fit, "dim int, top double, pivots binary").collect()
    return {r.dim: (r.top, pickle.loads(r.pivots)) for r in rows}


def _in_cells(rows: DataFrame, shared, asking: bool) -> DataFrame:
    """Rows (dim, vec_id, embedding) with the cell of their nearest pivot and the distance to it, as candidates or as queries."""
    place = scaled if asking else lifted

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            cell, away = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                top, pivots = shared.value[int(dim)]
                at = np.flatnonzero(dims == dim)
                d = distances(place(_matrix(b.column(2).take(pa.array(at)), len(at)), top), pivots)
                cell[at] = d.argmin(axis=1)
                away[at] = d[np.arange(len(at)), cell[at]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], ["dim", "vec_id", "embedding", "cell", "away"])

    return rows.mapInArrow(run, "dim int, vec_id long, embedding array<double>, cell int, away double")


def _routed(asked: DataFrame, shared, reach, k: int, factor: float) -> DataFrame:
    """(dim, vec_id, embedding, bound, to): the cells, but for its own, that may hold what a query (with kth, its k-th score) still lacks."""

    def run(batches):
        for b in batches:
            dims, kth = b.column(0).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            own, bound, to = b.column(3).to_numpy(), np.full(len(dims), np.inf), [None] * len(dims)
            for dim in np.unique(dims):
                top, pivots = shared.value[int(dim)]
                cells, inner, outer = reach[int(dim)]
                at = np.flatnonzero(dims == dim)
                q = _matrix(b.column(2).take(pa.array(at)), len(at))
                have = ~np.isnan(kth[at])
                bound[at[have]] = np.maximum(2 * top**2 - 2 * kth[at[have]] * top / np.linalg.norm(q[have], axis=1), 0)
                bound[at] += rounding(q.shape[1], top**2)
                d = distances(scaled(q, top), pivots[cells])
                gap = np.maximum(np.maximum(d - outer, inner - d), 0.0)
                go = factor * gap <= np.sqrt(bound[at])[:, None] + np.sqrt(rounding(q.shape[1], top**2))
                go &= cells != own[at][:, None]
                for i, row in zip(at.tolist(), go):
                    to[i] = cells[row]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(bound), pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "vec_id", "embedding", "bound", "to"])

    return asked.mapInArrow(run, "dim int, vec_id long, embedding array<double>, bound double, to array<int>")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, shard: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row for which queries holds; shard sets the size of shards."""
    spark = vectors.sparkSession
    sound = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sound = sound.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks"))
    sound = sound.withColumn("dim", F.size("embedding"))
    again = settle(sound.groupBy("dim", "vec_id").agg(F.count("*").alias("n")).where("n > 1").select("dim", "vec_id"), "nn-again")
    if not again.isEmpty():  # ids of several rows: the smallest vector of each stays
        once = sound.join(again, ["dim", "vec_id"], "left_semi").groupBy("dim", "vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("asks").alias("asks"))
        sound = sound.join(again, ["dim", "vec_id"], "left_anti").unionByName(once)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sizes = sound.groupBy("dim").agg(F.max(norm).alias("top"), F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    sizes = sizes.withColumn("shard", shard_size(F.col("n")) if shard is None else F.lit(shard).cast("long"))
    sizes = settle(sizes.where("asked > 0"), "nn-sizes")  # a row for each length of vectors
    shared = share(spark, _pivots(sound, sizes))
    used = sound.join(sizes.select("dim"), "dim", "left_semi")
    placed = settle(_in_cells(used.select("dim", "vec_id", "embedding"), shared, False), "nn-placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer"))
    cells = cells.join(sizes.select("dim", "shard"), "dim").withColumn("subs", F.ceil(F.col("n") / F.col("shard")))
    cells = settle(cells, "nn-cells")  # PIVOTS rows a length at most
    reach = {}
    for r in cells.orderBy("dim", "cell").collect():
        reach.setdefault(r.dim, []).append((r.cell, r.inner, r.outer))
    reach = {d: tuple(map(np.array, zip(*x))) for d, x in reach.items()}
    reach = {d: (c.astype(np.int32), i, o) for d, (c, i, o) in reach.items()}

    def build(key, table):
        made = Shard(*_by_id(table), table["top"][0].as_py(), k)
        names = [("dim", pa.int32()), ("cell", pa.int32()), ("sub", pa.int64()), ("parts", pa.int64()), ("tree", pa.binary())]
        return pa.table({"dim": [key[0].as_py()], "cell": [key[1].as_py()], "sub": [key[2].as_py()], "parts": [table["parts"][0].as_py()], "tree": [pickle.dumps(made)]}, schema=pa.schema(names))

    parts = F.ceil(F.col("asked") / QUERIES)
    sub = F.pmod(F.xxhash64("vec_id", F.lit(1)), "subs").alias("sub")
    trees = placed.join(cells.select("dim", "cell", "subs"), ["dim", "cell"]).join(sizes.select("dim", "top", parts.alias("parts")), "dim")
    trees = trees.select("dim", "cell", sub, "top", "parts", "vec_id", "embedding")
    trees = settle(trees.groupBy("dim", "cell", "sub").applyInArrow(build, "dim int, cell int, sub long, parts long, tree binary"), "nn-trees")
    asked = settle(_in_cells(used.where("asks").select("dim", "vec_id", "embedding"), shared, True).drop("away"), "nn-asked")

    def search(key, left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            made = pickle.loads(left["tree"][0].as_py())
            ids, rows = _by_id(right)
            for row in made.nearest(ids, rows, k, factor, right.sort_by("vec_id")["bound"].to_numpy()):
                for column, x in zip(out, row):
                    column.append(x)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def searched(rows):
        """Answers to rows (dim, vec_id, embedding, bound, cell): each meets the shards of its cell."""
        rows = rows.join(cells.select("dim", "cell", "subs"), ["dim", "cell"]).join(sizes.select("dim", parts.alias("parts")), "dim")
        sent = rows.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("vec_id", F.lit(2)), "parts").alias("part"), "vec_id", "embedding", "bound")
        copies = trees.select("dim", "cell", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "tree")
        keys = ["dim", "cell", "sub", "part"]
        return settle(copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double"), "nn-hits")

    def ranked(hits):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    own = searched(asked.withColumn("bound", F.lit(float("inf"))))
    kth = ranked(own).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    asked = asked.join(kth, "vec_id", "left").select("dim", "vec_id", "embedding", "cell", F.coalesce("kth", F.lit(float("nan"))).alias("kth"))
    more = _routed(asked, shared, reach, k, factor).withColumn("cell", F.explode("to")).drop("to")
    return ranked(own.unionByName(searched(more))).select("query_id", "rank", "vec_id", "score")
