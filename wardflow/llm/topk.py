"""Exact top-k search by inner product with cover trees on both sides.

Vectors are first put in blocks of near ones, and neighbouring blocks in parts that a task can hold.
Every query meets the part of its own block, which gives a score its k-th result can't fall below; then
it meets each other part that has a block whose centre and radius leave room for more.  In a part the
data and the queries that came are each indexed in cover trees, and pairs of nodes are walked together:
with centres a and b and covering radii r and s no product between the two exceeds
ab + |a|s + |b|r + rs, and a pair is passed over if that is below the worst k-th score of the query
node's group.

A task holds one part and some thousand queries at a time, however many there are: rows are sorted so
that the part comes first, and each query keeps its k best places and nothing else.

Equal vectors are one point with its k + 1 smallest ids: more can't enter any result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.llm.words import releasing
from wardflow.sources.scratch import discarded, new_folder, written

#: Points of a block aimed at.
BLOCK_POINTS = 1024
#: Centres of blocks: drawn by hash from the distinct vectors, at most so many.
MOST_CENTRES = 1024
#: Bytes of a part's points as 16-bit integers.
PART_BYTES = 32 << 20
#: Queries that a task holds at a time.
QUERY_ROWS = 4096
#: Queries and points that are multiplied at a time.
TILE = (1024, 256)
#: Scores that may wait before they meet the best ones so far.
WAITING = 8192
#: Rows that are placed or measured at a time.
SLICE = 1024
LEAF = 64
#: A node that needs more children to halve its radius stays whole: bounds can't tell its points apart.
MOST_CHILDREN = 32
#: Pairs of a query and a point that are multiplied without looking for bounds between them.
FEW_PAIRS = 1 << 17
#: Products and all their partial sums below this are exact in 32-bit floats.
EXACT = float(1 << 24)


@dataclass
class Node:
    """Rows ``rows`` of the points lie within ``radius`` of ``centre``."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def _distances(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    found, centre = np.empty(len(rows)), centre.astype(np.float64)
    for at in range(0, len(rows), SLICE):
        apart = points[rows[at : at + SLICE]] - centre
        found[at : at + SLICE] = np.einsum("ij,ij->i", apart, apart)
    return np.sqrt(found)


def lengths(points: np.ndarray) -> np.ndarray:
    return _distances(points, np.arange(len(points)), np.zeros(points.shape[1]))


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, centre: np.ndarray | None = None) -> Node:
    """A tree whose children cover their parent's points with half its radius.

    Children are picked farthest first: each lies farther than half the radius from those before
    it, and picking stops when every point lies within that of one.
    """
    rows = np.arange(len(points)) if rows is None else rows
    centre = points[rows[0]] if centre is None else centre
    nearest = _distances(points, rows, centre)
    radius = float(nearest.max()) * (1 + 1e-12)
    node = Node(centre, radius, rows)
    if len(rows) <= LEAF or radius == 0:
        return node
    group, centres = np.zeros(len(rows), np.int64), [centre]
    while nearest.max() > radius / 2:
        if len(centres) == MOST_CHILDREN:
            return node
        new = points[rows[int(nearest.argmax())]]
        to_new = _distances(points, rows, new)
        closer = to_new < nearest
        group[closer] = len(centres)
        nearest = np.where(closer, to_new, nearest)
        centres.append(new)
    for i, c in enumerate(centres):
        inside = rows[group == i]
        if len(inside):
            node.children.append(cover_tree(points, inside, c))
    return node


def widened(bound):
    """What a bound is at most, with the error of floating-point numbers; also below zero."""
    return bound + np.abs(bound) * 1e-9 + 1e-6


class Index:
    """Points in cover trees, one for each run of rows in ``runs``; of equal scores that of the smaller ``first`` is better."""

    def __init__(self, points: np.ndarray, first: np.ndarray | None = None, runs: list[tuple[int, int]] | None = None):
        self.points = points
        self.first = np.arange(len(points)) if first is None else first
        self.trees = [cover_tree(points, np.arange(*run)) for run in runs or [(0, len(points))]]
        self.longest = float(lengths(points).max())


class Search:
    """The k best points of each query, among all points shown to ``walk``."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray):
        self.queries, self.k, self.floor = queries, k, floor
        self.tree = cover_tree(queries)
        self.size = lengths(queries)
        self.wide = queries.astype(np.float64, copy=False)
        # the best first; of equal scores the one with the smaller id
        self.best = np.full((len(queries), k), -np.inf)
        self.first = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.at = np.full((len(queries), k), -1)
        self.least = np.array(floor, np.float64)
        self.met: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def walk(self, points: np.ndarray, index: Index | None = None) -> None:
        if not len(points):
            return
        self.index = index or Index(points)
        exact = self.index.longest * float(self.size.max()) < EXACT
        narrow = points.dtype in (np.int16, np.float32) and self.queries.dtype == np.float32
        self.kind = np.float32 if exact and narrow else np.float64
        for tree in sorted(self.index.trees, key=lambda x: -self._bound(self.tree, x)):
            self._pair(self.tree, tree)
        self._merge()

    def _bound(self, q: Node, x: Node) -> float:
        a, b = q.centre.astype(np.float64), x.centre.astype(np.float64)
        nq, nx = np.sqrt(a @ a), np.sqrt(b @ b)
        return widened(float(a @ b) + nq * x.radius + nx * q.radius + q.radius * x.radius)

    def _pair(self, q: Node, x: Node) -> None:
        if self._bound(q, x) < self.least[q.rows].min():
            return
        if (not q.children and not x.children) or len(q.rows) * len(x.rows) <= FEW_PAIRS:
            self._base(q.rows, x)
        elif x.children and (not q.children or x.radius >= q.radius):
            for child in sorted(x.children, key=lambda c: -self._bound(q, c)):
                self._pair(q, child)
        else:
            for child in q.children:
                self._pair(child, x)

    def _base(self, rows: np.ndarray, x: Node) -> None:
        reach = self.wide[rows] @ x.centre.astype(np.float64) + self.size[rows] * x.radius
        rows = rows[widened(reach) >= self.least[rows]]
        queries, least = self.queries[rows].astype(self.kind, copy=False), self.least[rows]
        for begin in range(0, len(x.rows), TILE[1]):
            of = x.rows[begin : begin + TILE[1]]
            points = self.index.points[of].astype(self.kind, copy=False).T
            for upto in range(0, len(rows), TILE[0]):
                some = slice(upto, upto + TILE[0])
                scores = queries[some] @ points
                hit = np.flatnonzero(scores.max(1) >= least[some])
                if len(hit):
                    self._enter(rows[some][hit], of, scores[hit])
                    if not self.waiting:
                        least = self.least[rows]

    def _enter(self, asked: np.ndarray, of: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries ``asked`` and the points ``of`` will meet the best ones so far."""
        least = self.least[asked]
        if len(of) > self.k and least.min() == -np.inf:
            least = np.maximum(least, np.partition(scores, len(of) - self.k, 1)[:, len(of) - self.k])
        flat = np.flatnonzero(scores >= least[:, None])
        q, x = np.divmod(flat, len(of))
        score, q, x = scores.ravel()[flat].astype(np.float64), asked[q], of[x]
        first = self.index.first[x]
        better = (score > self.best[q, -1]) | (first < self.first[q, -1])
        self.met.append((q[better], x[better], score[better], first[better]))
        self.waiting += len(self.met[-1][0])
        if self.waiting >= WAITING:
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        q, x, score, first = (np.concatenate(c) for c in zip(*self.met, strict=True))
        self.met, self.waiting = [], 0
        met = np.unique(q)
        q, x = np.concatenate((np.repeat(met, self.k), q)), np.concatenate((self.at[met].ravel(), x))
        score, first = np.concatenate((self.best[met].ravel(), score)), np.concatenate((self.first[met].ravel(), first))
        order = np.lexsort((first, -score, q))
        kept = order[_places(q[order]) < self.k]
        self.best[met], self.first[met], self.at[met] = (c[kept].reshape(-1, self.k) for c in (score, first, x))
        self.least[met] = np.maximum(self.best[met, -1], self.floor[met])

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, point row and score of each query's k best."""
        q, place = np.nonzero((self.at >= 0) & (self.best >= self.floor[:, None]))
        return q, self.at[q, place], self.best[q, place]


def _places(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each run of equal values."""
    begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def _binary(flat: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * (flat.shape[1] * flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id, asks, dim, v``: floor(256 x) of each component in the narrowest integers that hold the row, as bytes.

    Rows whose vector is empty or has a component that is null or not finite are left out.
    """
    for batch in batches:
        vectors, size = batch.column("embedding"), pc.list_value_length(batch.column("embedding"))
        for dim in pc.unique(size.drop_null()).to_pylist():
            some = batch.filter(pc.equal(size, dim)) if dim else batch.slice(0, 0)
            vectors = pc.fill_null(some.column("embedding").flatten(), np.nan).to_numpy(zero_copy_only=False)
            values = np.floor(vectors.astype(np.float64).reshape(-1, dim or 1) * 256)
            most = np.abs(values).max(1, initial=0)
            for kind, above, upto in (("<i2", -1, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, np.inf)):
                rows = np.flatnonzero((most >= above) & (most < upto))
                if len(rows):
                    exact = np.clip(values[rows], -(2.0**63), 2.0**63 - 1024).astype(kind)
                    few = some.select(["vec_id", "asks"]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*few.columns, pa.array(np.full(len(rows), dim, np.int32)), _binary(exact)], ["vec_id", "asks", "dim", "v"]
                    )


def integers_of(packed: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``quantised`` in the narrowest integers that hold all of them."""
    packed = packed.cast(pa.binary())
    width = pc.divide(pc.binary_length(packed), dim).to_numpy(zero_copy_only=False)
    narrow = np.empty((len(packed), dim), f"<i{width.max(initial=2)}")
    for size in np.unique(width):
        rows = np.flatnonzero(width == size)
        some = packed.take(pa.array(rows)) if len(rows) < len(packed) else packed
        begin = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2], np.uint8)[begin[0] : begin[-1]]
        narrow[rows] = np.frombuffer(data, f"<i{size}").reshape(-1, dim)
    return narrow


def vectors_of(packed: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``quantised`` as floats, 32-bit ones if they hold all of them exactly."""
    integers = integers_of(packed, dim)
    return integers.astype(np.float32 if integers.dtype == np.int16 else np.float64)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            some = batch.slice(begin, SLICE)
            yield some, vectors_of(some.column("v"), dim)


def _placing(centres: np.ndarray) -> Callable:
    """``centre`` and ``distance``, those of a near centre, as further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(1) / 2
        by_kind = {np.dtype(kind): centres.T.astype(kind) for kind in (np.float32, np.float64)}
        for batch, v in _slices(batches, centres.shape[1]):
            near = (v @ by_kind[v.dtype] - half).argmax(1)
            apart = v - centres[near]
            distance = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(distance)], [*batch.schema.names, "centre", "distance"]
            )

    return releasing(run)


@dataclass
class Parts:
    """Which parts there are: blocks in groups of near ones; a group is a part, a large block is several.

    ``first`` and ``of``: of each centre, its group's first part and how many the group has.
    """

    centres: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    of: np.ndarray
    count: int


def in_parts(centres: np.ndarray, points: dict[int, int], radius: dict[int, float], size: int) -> Parts:
    """Parts of about ``size`` points; ``points`` and ``radius`` of each centre's block."""

    def in_order(node: Node) -> Iterator[int]:
        for child in node.children:
            yield from in_order(child)
        if not node.children:
            yield from node.rows.tolist()

    first, of, parts, held = np.zeros(len(centres), np.int32), np.ones(len(centres), np.int32), 0, 0
    for c in (c for c in in_order(cover_tree(centres)) if c in points):
        if held and held + points[c] > size:
            parts, held = parts + 1, 0
        first[c], held = parts, held + points[c]
        if held > size:  # then it is alone
            of[c] = -(-held // size)
            parts, held = parts + int(of[c]), 0
    reach = np.array([radius.get(c, -np.inf) for c in range(len(centres))])
    return Parts(centres, reach, first, of, parts + bool(held))


def _meeting(parts: Parts) -> Callable:
    """``parts``: all parts but ``home`` that may hold a score of ``floor`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(parts.radius > -np.inf)
        used = used[np.argsort(parts.first[used], kind="stable")]
        begins = np.flatnonzero(_places(parts.first[used]) == 0)
        group_of = np.repeat(np.arange(len(begins)), parts.of[used[begins]])
        centres, reach = parts.centres[used].T, parts.radius[used]
        for batch, v in _slices(batches, parts.centres.shape[1]):
            bound = widened(v @ centres + lengths(v)[:, None] * reach)
            floor = pc.fill_null(batch.column("floor"), -np.inf).to_numpy(zero_copy_only=False)
            may = np.logical_or.reduceat(bound >= floor[:, None], begins, 1)[:, group_of]
            may[np.arange(len(v)), batch.column("home").to_numpy(zero_copy_only=False)] = False
            offsets = np.concatenate(([0], may.sum(1).cumsum())).astype(np.int32)
            met = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(may)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["vec_id", "v", "centre", "floor"]).columns, met], ["vec_id", "v", "centre", "floor", "parts"]
            )

    return releasing(run)


class _Part:
    """The points of one part, and the queries that wait for a search."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k
        self.data: list[pa.RecordBatch] = []
        self.queries: list[pa.RecordBatch] = []
        self.waiting = 0
        self.index: Index | None = None

    def _indexed(self) -> Index:
        data = pa.Table.from_batches(self.data).combine_chunks().to_batches()[0]
        self.data = []
        ids, centre = data.column("ids"), data.column("centre").to_numpy(zero_copy_only=False)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.begins = np.concatenate(([0], pc.list_value_length(ids).to_numpy(zero_copy_only=False).cumsum()))
        begins = np.flatnonzero(_places(centre) == 0).tolist()
        runs = list(zip(begins, [*begins[1:], len(centre)], strict=True))
        return Index(integers_of(data.column("v"), self.dim), self.ids[self.begins[:-1]], runs)

    def searched(self) -> Iterator[pa.RecordBatch]:
        """The k best of the part's points for each query that waits."""
        if self.queries and (self.data or self.index):
            self.index = self.index or self._indexed()
            asked = pa.Table.from_batches(self.queries).combine_chunks().to_batches()[0]
            floor = pc.fill_null(asked.column("floor"), -np.inf).to_numpy(zero_copy_only=False)
            # a point that holds the query itself has a place more than the others
            search = Search(vectors_of(asked.column("v"), self.dim), self.k + 1, floor)
            search.walk(self.index.points, self.index)
            q, x, score = search.results()
            counts = self.begins[x + 1] - self.begins[x]
            q, score = np.repeat(asked.column("vec_id").to_numpy()[q], counts), np.repeat(score, counts).astype(np.int64)
            found = self.ids[np.arange(len(q)) + np.repeat(self.begins[x] - (counts.cumsum() - counts), counts)]
            order = np.lexsort((found, -score, q))
            q, found, score = (c[order[q[order] != found[order]]] for c in (q, found, score))
            if len(q):
                new = np.concatenate(([True], (q[1:] != q[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])))
                q, found, score = q[new], found[new], score[new]
                few = _places(q) < self.k
                yield pa.RecordBatch.from_arrays([pa.array(c[few]) for c in (q, found, score)], ["query_id", "vec_id", "score"])
        self.queries, self.waiting = [], 0


def searching(dim: int, k: int) -> Callable:
    """Searches of rows sorted by ``part``, in a part first the points and then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, _Part(dim, k)
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *changes], [*changes, len(parts)], strict=True):
                if begin == end:
                    continue
                if parts[begin] != part:
                    yield from held.searched()
                    part, held = parts[begin], _Part(dim, k)
                if not asks[begin]:
                    held.data.append(batch.slice(begin, end - begin))
                    continue
                for at in range(begin, end, QUERY_ROWS):
                    held.queries.append(batch.slice(at, min(QUERY_ROWS, end - at)))
                    held.waiting += held.queries[-1].num_rows
                    if held.waiting >= QUERY_ROWS:
                        yield from held.searched()
        yield from held.searched()

    return releasing(run)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products with other rows.

    ``vectors``: ``vec_id, embedding``; scores are of the quantised vectors, ties go to the smaller
    vec_id.  Vectors that are null or hold a null or non-finite component, rows without vec_id, and
    vectors of another length than most take no part.  Rows that repeat a vec_id count once per
    distinct vector.  Scores are exact while sums of squares stay below 2**53.  Other columns are ignored,
    whatever their names, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    embedding = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] != "array<float>":
        embedding = embedding.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"), is_query.alias("asks"))
    rows = rows.where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    first_folder, second_folder = new_folder(spark, "packed"), new_folder(spark, "points")
    rows = written(rows.mapInArrow(releasing(quantised), "vec_id long, asks boolean, dim int, v binary"), "packed", first_folder)
    dims = rows.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = dims[0]["dim"]
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v", "asks")
    # equal vectors once, with the ids that may enter a result; a rank limit bounds each group first
    by_id = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("vec_id", "v").withColumn("n", by_id).where(F.col("n") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = written(points.withColumn("h", F.xxhash64("v")), "points", second_folder)
    count = points.count()
    wanted = int(min(MOST_CENTRES, max(1, count // block_points)))
    drawn = points.orderBy("h", "v").limit(wanted).select("v").collect()  # at most MOST_CENTRES vectors
    centres = vectors_of(pa.array([bytes(r["v"]) for r in drawn], pa.binary()), dim).astype(np.float64)

    place = _placing(centres)
    placed = written(points.mapInArrow(place, "v binary, ids array<long>, h long, centre int, distance double"), "placed")
    asked = rows.where("asks").select("vec_id", "v").distinct()
    asked = written(asked.mapInArrow(place, "vec_id long, v binary, centre int, distance double").drop("distance"), "asked")
    discarded(spark, first_folder)
    discarded(spark, second_folder)
    blocks = placed.groupBy("centre").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    # no more points than a task may hold, and work for all cores
    size = min(max(1, PART_BYTES // (2 * dim)), -(-count // max(1, min(count // block_points, 2 * spark.sparkContext.defaultParallelism))))
    parts = in_parts(centres, {r["centre"]: r["n"] for r in blocks}, {r["centre"]: r["radius"] for r in blocks}, size)

    def part_of(h: Column) -> Column:
        first, of = (F.array(*map(F.lit, column.tolist()))[F.col("centre")] for column in (parts.first, parts.of))
        return (first + F.pmod(h, of)).cast("int")

    data = placed.select(
        part_of(F.col("h")).alias("part"), F.lit(False).alias("asks"), "centre", F.lit(None).cast("long").alias("vec_id"), "v", "ids", F.lit(None).cast("double").alias("floor")
    )

    def searched(queries: DataFrame) -> DataFrame:
        met = queries.select("part", F.lit(True).alias("asks"), "centre", "vec_id", "v", F.lit(None).cast("array<long>").alias("ids"), "floor")
        together = data.unionByName(met).repartitionById(parts.count, F.col("part")).sortWithinPartitions("part", "asks", "centre")
        return together.mapInArrow(searching(dim, k), "query_id long, vec_id long, score long")

    asked = asked.withColumn("home", part_of(F.xxhash64("vec_id")))
    at_home = searched(asked.withColumn("part", F.col("home")).withColumn("floor", F.lit(None).cast("double")))
    at_home = written(_ranked(at_home, k).drop("rank"), "home")
    floors = at_home.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least").cast("double")).alias("floor"))
    others = asked.join(floors, "vec_id", "left").mapInArrow(
        _meeting(parts), "vec_id long, v binary, centre int, floor double, parts array<int>"
    )
    abroad = searched(others.withColumn("part", F.explode("parts")))
    return _ranked(at_home.unionByName(abroad), k).select("query_id", "rank", "vec_id", "score")
