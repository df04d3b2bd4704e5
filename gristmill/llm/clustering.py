"""Centroid clustering: exact Lloyd rounds over cover trees of vectors and of centroids, pruned in pairs of nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of a vector, centroids, rounds, and what a component is multiplied with.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Integer components are held within this, so that any squared distance fits a long.
HELD = 1 << 27
#: Components up to this make squared distances that doubles hold exactly.
EXACT = 1 << 22
#: Vectors of a tree, and vectors that make a node of their own at least.
BLOCK, BUCKET = 2_048, 16
#: What rounding of a distance may be off by, relatively; only pruning depends on it.
SLACK = 1e-9
#: Components whose signs tell which vectors come into one tree.
CELL_BITS = 16


@dataclass
class CoverTree:
    """A cover tree in preorder. Points are in tree order, `order` has their rows; node i holds points lo to hi, the first of
    them, up to own, as a leaf's, the others in the nodes after it, `size` in all with itself. Its centre is a point of it and
    no point of it is farther from the centre than radius; the centres of its children lie more than half of that apart."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    own: np.ndarray
    hi: np.ndarray
    size: np.ndarray

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < node + self.size[node]:
            out.append(at)
            at += int(self.size[at])
        return out


def cover_tree(x: np.ndarray, bucket: int) -> CoverTree:
    """The cover tree of the rows of x. Groups of fewer than bucket points stay with their parent as leaf points."""
    f = x.astype(np.float64)
    order: list[np.ndarray] = []
    nodes: list[list] = []

    def build(centre: int, rows: np.ndarray, far: np.ndarray, lo: int) -> None:
        node, radius = [centre, float(far.max()), lo, lo, lo + len(rows), 1], float(far.max())
        nodes.append(node)
        at, groups, leaf = len(nodes), [], []
        if len(rows) <= bucket or not radius:
            leaf.append(rows)
        else:
            c, left, d = centre, rows, far
            while len(left):
                near = d <= radius / 2
                (groups if near.sum() >= max(bucket, 1) else leaf).append((c, left[near], d[near]) if near.sum() >= max(bucket, 1) else left[near])
                left = left[~near]
                if len(left):
                    c = int(left[0])
                    d = np.sqrt(((f[left] - f[c]) ** 2).sum(1))
        order.extend(leaf)
        node[3] = lo = lo + sum(map(len, leaf))
        for c, part, d in groups:
            build(c, part, d, lo)
            lo += len(part)
        node[5] = len(nodes) - at + 1

    if len(x):
        build(0, np.arange(len(x)), np.sqrt(((f - f[0]) ** 2).sum(1)), 0)
    at = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
    back = np.empty(len(x), np.int64)
    back[at] = np.arange(len(x))
    table = np.array(nodes, np.float64).reshape(-1, 6)
    return CoverTree(x[at], at, back[table[:, 0].astype(np.int64)], table[:, 1], *(table[:, k].astype(np.int64) for k in range(2, 6)))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x, whole numbers, to those of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1) if len(y) else np.zeros((len(x), 0), np.int64)


def nearest(vectors: CoverTree, centroids: CoverTree, numbers: np.ndarray) -> np.ndarray:
    """For each point of vectors, in tree order, the number of its nearest centroid, of equally near ones the smallest.
    numbers: those of the points of centroids, which are distinct.

    A node of vectors goes down with the centroid nodes that may hold the nearest one to some point of it: those whose least
    distance is not above the least of the greatest ones. Centroid nodes wider than it are opened first. A node with one
    centroid left is done as a whole; leaf points are compared exactly with all centroids that are left."""
    out = np.zeros(len(vectors.points), np.int64)
    if not len(out):
        return out
    at, mid = vectors.points[vectors.centre].astype(np.float64), centroids.points[centroids.centre].astype(np.float64)
    first = np.array([0])
    todo = [(0, first)]
    while todo:
        node, held = todo.pop()
        while True:
            d = np.sqrt(((mid[held] - at[node]) ** 2).sum(1))
            most = (d + vectors.radius[node]).min() * (1 + SLACK)
            held = held[(d - vectors.radius[node] - centroids.radius[held]) * (1 - SLACK) <= most]
            wide = (centroids.size[held] > 1) & (centroids.radius[held] > vectors.radius[node])
            if not wide.any():
                break
            held = np.concatenate([held[~wide], *[np.array(centroids.children(int(h))) for h in held[wide]]]).astype(np.int64)
        places = np.concatenate([np.arange(centroids.lo[h], centroids.hi[h]) for h in held])
        if len(places) == 1:
            out[vectors.lo[node] : vectors.hi[node]] = numbers[places[0]]
            continue
        leaf = slice(int(vectors.lo[node]), int(vectors.own[node]))
        if leaf.stop > leaf.start:
            places = places[np.argsort(numbers[places])]
            out[leaf] = numbers[places[squared(vectors.points[leaf], centroids.points[places]).argmin(1)]]
        todo += [(child, held) for child in vectors.children(node)]
    return out


def whole_vectors(vectors: DataFrame, vec_id: str, column: str, dimensions: int) -> DataFrame:
    """vec_id, point of the rows whose vector has just so many components, none null or non-finite: floor(SCALE * x) of each."""
    x = F.col(f"`{column}`").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) == dimensions)
    held = lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(HELD))), F.lit(float(-HELD)))).cast("int")
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, held).alias("point"))


def place(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


TREES = "vec_ids array<long>, points binary, nodes binary"


def trees_of(points: DataFrame, dimensions: int) -> DataFrame:
    """One row for each cover tree of about BLOCK vectors; vectors are put in order by the signs of their first components,
    so that those of one tree lie near each other, and then by hash, so that no vector, however common, fills a task."""
    cell = sum((F.when(F.col("point")[i] >= 0, 1 << i).otherwise(0) for i in range(min(CELL_BITS, dimensions))), F.lit(0))
    dealt = points.withColumn("cell", cell).withColumn("dealt", F.xxhash64("vec_id", F.lit(7))).repartitionByRange("cell", "dealt").sortWithinPartitions("cell", "dealt")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            for low in range(0, b.num_rows, BLOCK):
                t = cover_tree(flat[low : low + BLOCK], BUCKET)
                ids = b.column(0).slice(low, BLOCK).take(pa.array(t.order))
                nodes = np.stack([t.centre, t.radius, t.lo, t.own, t.hi, t.size], 1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([t.points.astype("<i4").tobytes()]), pa.array([nodes.tobytes()])], ["vec_ids", "points", "nodes"])

    return dealt.select("vec_id", "point").mapInArrow(grow, TREES)


def read_tree(points: bytes, nodes: bytes, dimensions: int) -> CoverTree:
    p, n = np.frombuffer(points, "<i4").astype(np.int64).reshape(-1, dimensions), np.frombuffer(nodes, np.float64).reshape(-1, 6)
    whole = [n[:, k].astype(np.int64) for k in (0, 2, 3, 4, 5)]
    return CoverTree(p, np.arange(len(p)), whole[0], n[:, 1], *whole[1:])


def centroid_tree(centroids: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """The cover tree of the distinct centroids, a node for each, and their numbers: of equal ones the smallest."""
    _, first = np.unique(centroids, axis=0, return_index=True)
    first = np.sort(first)
    t = cover_tree(centroids[first], 0)
    return t, first[t.order]


def sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors their number and their sum; a task yields a row for each of its centroids."""
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = centroid_tree(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for b in batches:
            for points, nodes in zip(b.column(1), b.column(2), strict=True):
                t = read_tree(points.as_py(), nodes.as_py(), dimensions)
                to = nearest(t, tree, numbers)
                by = np.argsort(to, kind="stable")
                here, start = np.unique(to[by], return_index=True)
                total[here] += np.add.reduceat(t.points[by], start)
                n += np.bincount(to, minlength=k)
        full = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * dimensions + 1, dimensions, dtype=np.int32)), pa.array(total[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), lists], ["cluster", "n", "total"])

    part = trees.select("vec_ids", "points", "nodes").mapInArrow(add, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(dimensions)]
    found = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*each).alias("total"))
    return {r.cluster: (r.n, [int(v) for v in r.total]) for r in found.collect()}


def lloyd(points: DataFrame, centroids: int, rounds: int, seed: int, dimensions: int) -> tuple[DataFrame, np.ndarray]:
    """The trees of the points, settled, and the centroids after the rounds. What the driver gets is a row for each centroid."""
    start = points.orderBy(place(seed), "point").limit(centroids).collect()
    at = np.array([r.point for r in start], np.int64).reshape(-1, dimensions)
    trees = common.settled(trees_of(points, dimensions))
    for _ in range(rounds if len(at) else 0):
        at = at.copy()
        for c, (n, total) in sums(trees, at).items():
            at[c] = [v // n for v in total]
    return trees, at


def clustered(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with the right number of
    components, none null or non-finite; others are left out.

    Components are whole numbers, floor(256 * x), held within 2**27 on either side. The centroids start as the vectors with
    the smallest hashes of seed and id (a null id counts as the empty text; of equal hashes the smaller vector); there are fewer if
    there are fewer vectors. Vectors that repeat each count. An inertia beyond a long is null. An empty table gives no rows;
    other columns play no part."""
    spark = vectors.sparkSession
    trees, at = lloyd(whole_vectors(vectors, vec_id, column, dimensions), centroids, rounds, seed, dimensions)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = centroid_tree(at)
        for b in batches:
            for ids, points, nodes in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = read_tree(points.as_py(), nodes.as_py(), dimensions)
                to = nearest(t, tree, numbers)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(to.astype(np.int32)), pa.array(((t.points - at[to]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    rows = common.settled(trees.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    spent = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    sha = lambda c: hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()
    figures = spark.createDataFrame([(c, fits(d), fits(sum(spent.values())), sha(c)) for c, d in spent.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
