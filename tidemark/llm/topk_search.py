"""Exact top-k search by inner product: dual-tree search over cover trees.

Vectors become integers floor(scale * x). Every row is dealt by its nearest of some pivots (a bounded sample, chained by nearness) into slices of about
`slice_rows` neighbouring rows; each slice becomes one cover tree of base 1.3: a node's children have centres that lie further apart
than their level's radius and cover its points within that radius, and the node's own centre is one of them. Where more than `fan`
centres would be needed, the points are too far apart for any bound, and the node stays a leaf. Queries become
trees of at most `query_rows` queries. For two nodes with centres p, q and radii r, s no inner product exceeds
p.q + |p| s + |q| r + r s; the pair is dropped if that is below the worst kth score of the node's queries, and once a query node
is a leaf, each of its queries is dropped by its own bound (r = 0) and kth score.

1. The roots alone meet first, in blocks: 8 bytes a dimension, no trees. Each query tree goes to the `first` slices of highest bound,
   best first, which gives every query a kth score to start with.
2. With these scores the roots meet again. Only pairs of a query tree and a slice whose bound reaches the worst kth score go
   on; a query tree is sent with its kth scores to the partition of the slice, best bounds first, and a slice that many
   query trees want is sent to several.
3. What a slice finds (k a query at most, none below the known kth score) is merged by query in one ranked window.

Exactness: sums are taken in float64 only while they stay below 2^53, else as whole numbers of any size; a pair whose bound equals
the kth score is searched, since a tie goes to the smaller id.

Defined results: vectors that are null, empty of meaning (a null or non-finite component, or one whose multiple is not finite)
or without an id take no part; vectors of different lengths do not meet; rows with the query's own id are not its candidates;
equal query rows count once; scores beyond a long are cut to its range before they are ranked; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, parts, table, written

_EXACT = 2.0**53
_BASE = 1.3
_TREE = "part int, slice long, n int, radius double, centre array<double>, tree binary"


class Tree:
    """A cover tree; the points stand in tree order, so a node is a range of them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int, fan: int = 64):
        flat = points.astype(np.float64)
        order: list[np.ndarray] = []
        self.start, self.end, self.radius, self.centre, self.children = [], [], [], [], []
        # what is still to do: rows, their centre, and the node that they are a child of; children are taken in turn
        todo: list[tuple[np.ndarray, int, int]] = []
        if len(ids):
            middle = flat.mean(axis=0)
            todo.append((np.arange(len(ids)), int(((flat - middle) ** 2).sum(axis=1).argmin()), -1))
        at = 0
        while todo:
            rows, centre, above = todo.pop()
            me = len(self.start)
            if above >= 0:
                self.children[above].append(me)
            far = np.sqrt(((flat[rows] - flat[centre]) ** 2).sum(axis=1))
            radius = float(far.max())
            self.start.append(at)
            self.end.append(at + len(rows))
            self.radius.append(radius)
            self.centre.append(flat[centre])
            self.children.append([])
            picked = [centre]
            if len(rows) > leaf and radius > 0:
                near, side = far, np.zeros(len(rows), dtype=np.int64)
                while near.max() > radius / _BASE and len(picked) <= fan:
                    picked.append(int(rows[near.argmax()]))
                    away = np.sqrt(((flat[rows] - flat[picked[-1]]) ** 2).sum(axis=1))
                    side[away < near] = len(picked) - 1
                    near = np.minimum(near, away)
            if len(picked) == 1 or len(picked) > fan:
                order.append(rows)
                at += len(rows)
            else:
                todo += [(rows[side == n], c, me) for n, c in reversed(list(enumerate(picked))) if (side == n).any()]
        if len(ids):
            place = np.concatenate(order)
            self.ids, self.points = ids[place], shortest(points[place])
            self.centre = np.array(self.centre)
            self.norm = np.sqrt((self.centre**2).sum(axis=1))
        else:
            self.ids, self.points = ids, points


def shortest(points: np.ndarray) -> np.ndarray:
    """points in the shortest kind of integer that holds them; Python integers stay."""
    if points.dtype == object or not points.size:
        return points
    low, high = points.min(), points.max()
    return points.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where that holds it, else as Python integers."""
    grown = np.floor(flat * float(scale))
    if not grown.size or np.abs(grown).max() < 2**62:
        return grown.astype(np.int64)
    return np.array([math.floor(v) for v in grown.ravel()], dtype=object).reshape(grown.shape)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


class Search:
    """The k best of data trees for each query of a tree, one data tree after the other."""

    def __init__(self, queries: Tree, k: int, floor: np.ndarray | None = None):
        self.queries, self.k, self.n = queries, k, len(queries.ids)
        self.none = np.iinfo(np.int64).min
        self.scores, self.ids = np.full((self.n, k), self.none, dtype=np.int64), np.full((self.n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.found = np.zeros(self.n, dtype=np.int64)
        #: kth scores that are known already; what is below them is of no use
        self.floor = np.full(self.n, self.none, dtype=np.int64) if floor is None else floor
        self.computed = 0

    def least(self, rows) -> np.ndarray:
        """The score that a candidate must reach, by query."""
        return np.maximum(self.floor[rows], np.where(self.found[rows] >= self.k, self.scores[rows, self.k - 1], self.none))

    def meet(self, data: Tree) -> None:
        queries, k = self.queries, self.k
        if not self.n or not len(data.ids) or queries.points.shape[1] != data.points.shape[1]:
            return
        top = max(float(np.abs(queries.points.astype(np.float64)).max(initial=0)), 1.0) * max(float(np.abs(data.points.astype(np.float64)).max(initial=0)), 1.0) * max(1, queries.points.shape[1])
        exact = top < _EXACT
        kind = np.float64 if exact else object
        left, right = queries.points.astype(kind), data.points.astype(kind)
        slack = top * 1e-12 + 1e-6

        def bounds(q: int, nodes: list[int]) -> np.ndarray:
            r, s = queries.radius[q], np.array([data.radius[d] for d in nodes])
            return data.centre[nodes] @ queries.centre[q] + queries.norm[q] * s + data.norm[nodes] * r + r * s + slack

        if exact:
            length = np.sqrt((left**2).sum(axis=1))

        def base(rows: np.ndarray, d: int) -> None:
            """All products of the queries `rows` with the points of node d that may be good enough."""
            if exact:
                rows = rows[left[rows] @ data.centre[d] + length[rows] * data.radius[d] + slack >= self.least(rows)]
            if not len(rows):
                return
            first, last = data.start[d], data.end[d]
            met = products(left[rows], right[first:last], exact)
            self.computed += met.size
            good = (met >= self.least(rows)[:, None]) & (queries.ids[rows][:, None] != data.ids[first:last][None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                row, own = rows[i], np.flatnonzero(good[i])
                held = int(self.found[row])
                s = np.concatenate((self.scores[row, :held], met[i, own]))
                v = np.concatenate((self.ids[row, :held], data.ids[first:last][own]))
                best = np.lexsort((v, np.invert(s)))[:k]
                self.found[row] = len(best)
                self.scores[row, : len(best)], self.ids[row, : len(best)] = s[best], v[best]

        # node pairs that are still to meet, the best last; two leaves meet at once
        todo = [(0, 0, math.inf)]
        while todo:
            q, d, bound = todo.pop()
            rows = np.arange(queries.start[q], queries.end[q])
            if bound < self.least(rows).min():
                continue
            below_q, below_d = queries.children[q], data.children[d]
            if below_q and (not below_d or queries.radius[q] >= data.radius[d]):
                todo += [(c, d, float(bounds(c, [d])[0])) for c in below_q]
            elif below_d:
                most = bounds(q, below_d)
                todo += [(q, below_d[i], float(most[i])) for i in np.argsort(most).tolist()]
            else:
                base(rows, d)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query in tree order, id, score)."""
        row, column = np.nonzero(np.arange(self.k)[None] < self.found[:, None])
        return row, self.ids[row, column], self.scores[row, column]


def _leaves(kind: str, rows: int):
    """Rows of a partition as trees of at most `rows` points of one length, with what their roots say."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def tree(own: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids = np.array([o[0] for o in own], dtype=np.int64)
            points = np.stack([pickle.loads(o[1]) for o in own])
            grown = Tree(ids, points, 64 if kind == "data" else 16)
            part = TaskContext.get().partitionId()
            columns = [pa.array([part], pa.int32()), pa.array([(part << 32) + made], pa.int64()), pa.array([points.shape[1]], pa.int32()), pa.array([grown.radius[0]], pa.float64()), pa.array([grown.centre[0].tolist()], pa.list_(pa.float64())), pa.array([pickle.dumps(grown, protocol=5)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "slice", "n", "radius", "centre", "tree"])

        for batch in batches:
            for i, x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(n, []).append((i, x))
                if len(held[n]) == rows:
                    yield tree(held.pop(n))
        for own in held.values():
            yield tree(own)

    return build


def _root_pairs(asks: DataFrame, data: DataFrame, best: int | None, block: int = 512) -> DataFrame:
    """(q, d, bound) of roots: of each query root and block of data roots the `best` highest, or all that reach the query root's `worst`.

    Roots meet in blocks of `block` or so on either side; what is sent are roots, not trees.
    """
    n_asks, n_data = (max(1, -(-df.count() // block)) for df in (asks, data))
    cut = lambda df, n, *more: df.groupBy(F.pmod(F.xxhash64("slice"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("slice", "n", "radius", "centre", *more)).alias("roots"))
    left = cut(asks, n_asks, F.col("worst") if best is None else F.lit(-math.inf).alias("worst"))
    left = left.select(F.col("roots").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))).alias("block"))
    both = left.join(cut(data, n_data), "block").select("asked", "roots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, roots in zip(batch.column(0), batch.column(1), strict=True):
                found: list[tuple[int, int, float]] = []
                asked, roots = asked.as_py(), roots.as_py()
                for n in {r["n"] for r in asked} & {r["n"] for r in roots}:
                    a, d = [r for r in asked if r["n"] == n], [r for r in roots if r["n"] == n]
                    p, q = (np.array([r["centre"] for r in side], dtype=np.float64).reshape(len(side), n) for side in (a, d))
                    r, s = (np.array([x["radius"] for x in side]) for side in (a, d))
                    length = [np.sqrt((x**2).sum(axis=1)) for x in (p, q)]
                    most = p @ q.T + length[0][:, None] * s[None] + r[:, None] * (length[1] + s)[None]
                    most += np.abs(most) * 1e-9 + (length[0][:, None] + r[:, None]) * (length[1] + s)[None] * 1e-9 + 1e-6
                    for i, row in enumerate(most):
                        good = np.argsort(-row, kind="stable")[:best] if best is not None else np.flatnonzero(~(row < a[i]["worst"]))
                        found += [(a[i]["slice"], d[j]["slice"], float(row[j])) for j in good.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "d", "bound"])

    return both.mapInArrow(run, "q long, d long, bound double")


def chained(points: list[np.ndarray]) -> list[np.ndarray]:
    """points in an order in which neighbours are near: each is followed by the nearest one left of its length."""
    out: list[np.ndarray] = []
    for n in sorted({len(p) for p in points}):
        left = np.array([p for p in points if len(p) == n], dtype=np.float64).reshape(-1, n)
        at = 0
        while len(left):
            last, left = left[at], np.delete(left, at, axis=0)
            out.append(last)
            if len(left):
                with np.errstate(over="ignore", invalid="ignore"):
                    at = int(np.nan_to_num(((left - last) ** 2).sum(axis=1), nan=np.inf).argmin())
    return out


_FOUND = ["query_id", "print", "vec_id", "score"]


def _result(search: Search) -> list[pa.Array]:
    rows, ids, scores = search.results()
    prints = np.array([hash_row(p) for p in search.queries.points], dtype=np.int64)
    return [pa.array(x, pa.int64()) for x in (search.queries.ids[rows], prints[rows], ids, scores)]


def _first(k: int):
    """Query trees with their first slices, the best first: what they find, and one row (q, floor, worst) for each query tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, search = None, None

        def done() -> pa.RecordBatch:
            found = _result(search)
            floor = np.where(search.found >= k, search.scores[:, k - 1], search.none)
            worst = float(floor.min()) if (search.found >= k).all() else -math.inf
            n = len(found[0])
            more = [pa.concat_arrays([pa.nulls(n, x.type), x]) for x in (pa.array([name], pa.int64()), pa.array([floor.tobytes()], pa.binary()), pa.array([worst], pa.float64()))]
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays([x, pa.nulls(1, pa.int64())]) for x in found), *more], names=[*_FOUND, "q", "floor", "worst"])

        for batch in batches:
            for n, q in enumerate(batch.column("q").to_pylist()):
                if q != name:
                    if search:
                        yield done()
                    name, search = q, Search(pickle.loads(batch.column("asked")[n].as_py()), k)
                search.meet(pickle.loads(batch.column("tree")[n].as_py()))
        if search:
            yield done()

    return run


def _rest(k: int):
    """A slice, and after it the query trees that still want it, with their known kth scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for n, asked in enumerate(batch.column("asked")):
                if not asked.is_valid:
                    tree = pickle.loads(batch.column("tree")[n].as_py())
                    continue
                search = Search(pickle.loads(asked.as_py()), k, np.frombuffer(batch.column("floor")[n].as_py(), dtype=np.int64))
                search.meet(tree)
                yield pa.RecordBatch.from_arrays(_result(search), names=_FOUND)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding", scale: int = 1024, pivots: int = 1024, slice_rows: int = 4096, query_rows: int = 512, first: int = 2) -> DataFrame:
    """The k best rows of vectors for each row of queries: query_id, rank, vec_id, score.

    pivots: at most so many rows, and no more than one for every quarter of a slice, are collected to deal the rows by.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
        finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1.7e308 / scale))
        return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)

    rows = valid(vectors)
    place = F.xxhash64("id", F.lit(3))
    n_rows = rows.count()
    pivots = min(pivots, max(32, 4 * n_rows // slice_rows))
    sample = chained([np.array(r["x"]) for r in rows.withColumn("h", place).orderBy("h", "id").limit(pivots).select("x").collect()])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            packed, cells, starts = [], np.zeros(len(sizes), dtype=np.int32), np.concatenate(([0], np.cumsum(sizes)))
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                near = np.array([p for p in sample if len(p) == n])
                if len(near) and n:
                    x = flat[(starts[own][:, None] + np.arange(n)).ravel()].reshape(len(own), n)
                    with np.errstate(over="ignore", invalid="ignore"):
                        cells[own] = np.nan_to_num((near**2).sum(axis=1)[None] - 2 * (x @ near.T), nan=0.0).argmin(axis=1)
            for i in range(len(sizes)):
                packed.append(pickle.dumps(whole(flat[starts[i] : starts[i + 1]], scale), protocol=5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32()), pa.array(cells, pa.int32())], names=["id", "x", "n", "cell"])

    schema = "id long, x binary, n int, cell int"
    dealt = rows.mapInArrow(deal, schema)
    asked = valid(queries).distinct().mapInArrow(deal, schema)
    spread = dealt.repartitionByRange(max(1, -(-n_rows // slice_rows)), "n", "cell", place, "id")
    with Tables() as tables:
        data = tables.written(spread.mapInArrow(_leaves("data", slice_rows), _TREE), "data-trees")
        n_asked = asked.count()
        some = asked.repartitionByRange(max(1, -(-n_asked // query_rows)), "n", "cell", place, "id")
        asks = tables.written(some.mapInArrow(_leaves("queries", query_rows), _TREE), "query-trees")
        roots = lambda trees: trees.select("slice", "n", "radius", "centre")
        trees = lambda of, name, tree: of.select(F.col("slice").alias(name), F.col("tree").alias(tree))
        near = _root_pairs(roots(asks), roots(data), first)
        near = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "d"))).where(F.col("nth") <= first)
        near = tables.written(near, "first-pairs")
        met = near.join(trees(data, "d", "tree"), "d").join(trees(asks, "q", "asked"), "q")
        met = met.repartition(parts(spark), "q").sortWithinPartitions("q", "nth").select("q", "asked", "tree")
        begun = tables.written(met.mapInArrow(_first(k), "query_id long, print long, vec_id long, score long, q long, floor binary, worst double"), "first-found")
        known = begun.where(F.col("q").isNotNull()).select("q", "floor", "worst")
        pairs = _root_pairs(roots(asks).join(known.select(F.col("q").alias("slice"), "worst"), "slice"), roots(data), None)
        pairs = tables.written(pairs.join(near.select("q", "d"), ["q", "d"], "left_anti"), "pairs")
        # a slice that many query trees want goes to one partition for every 32 of them
        wanted = pairs.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / 32).cast("int").alias("n_parts"))
        asking = pairs.join(wanted, "d").select("d", F.pmod(F.xxhash64("q"), F.col("n_parts")).cast("int").alias("part"), "bound", "q").join(trees(asks, "q", "asked"), "q").join(known.drop("worst"), "q")
        slices = trees(data, "d", "tree").join(wanted, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.lit(math.inf).alias("bound"), F.lit(None).cast("binary").alias("asked"), F.lit(None).cast("binary").alias("floor"), "tree")
        both = asking.select("d", "part", "bound", "asked", "floor", F.lit(None).cast("binary").alias("tree")).unionByName(slices)
        both = both.repartition(parts(spark), "d", "part").sortWithinPartitions("d", "part", F.col("asked").isNotNull(), F.col("bound").desc())
        found = both.select("asked", "floor", "tree").mapInArrow(_rest(k), "query_id long, print long, vec_id long, score long")
        found = written(found.unionByName(begun.where(F.col("q").isNull()).select(*_FOUND)), "found")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def hash_row(point: np.ndarray) -> int:
    """Tells apart different query vectors under one id."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(point.tolist())) - (1 << 63)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
