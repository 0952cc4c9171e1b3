"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is indexed under its leaf. A search goes through the tree with a
priority queue of nodes by distance to their centres and visits leaves in that order. How many it visits is widened,
for a bounded set of calibration queries whose true neighbours are found by brute force over all rows, until their
recall reaches the target.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, one_each, stored
from .vectors import asked, blocks, dealt, each_row, merged, own_row, usable

#: Rows at most that the tree is fitted on, its arity, calibration queries, the recall they must reach (over the 0.9 asked for).
SAMPLE, ARITY, CALIBRATION, TARGET = 65_536, 8, 96, 0.96
#: Rows that a leaf should hold; rows of the sample that a leaf needs at least. The tree is as deep as they allow.
LEAF, FITTED = 64, 12
#: Rows of a leaf, and queries, that one group takes: each row is shipped once for so many queries, and each visit once for so many rows.
CHUNK, QUERIES = 16_384, 32_768
#: Rows of neighbouring leaves that one group takes together, so that a query is shipped to it once and brings back k rows from all of them.
BUNDLE = 1_024


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, for ordering only."""
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


class Tree:
    """Nodes in one list: centres of the children, and where these are (a leaf is a negative number)."""

    def __init__(self, sample: np.ndarray, levels: int, arity: int = ARITY, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._grow(sample, arity, levels, np.random.default_rng(seed))

    def _grow(self, rows: np.ndarray, arity: int, levels: int, rng) -> int:
        if levels == 0 or len(rows) < 2 * arity and self.centres:
            self.leaves += 1
            return -self.leaves
        at = len(self.centres)
        self.centres.append(np.zeros((0, rows.shape[1])))
        self.children.append([])
        centres = rows[rng.choice(len(rows), min(arity, len(rows)), replace=False)]
        for _ in range(8):
            near = distances(rows, centres).argmin(1)
            centres = np.array([rows[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        near = distances(rows, centres).argmin(1)
        used = [i for i in range(len(centres)) if (near == i).any()]
        self.centres[at] = centres[used]
        self.children[at] = [self._grow(rows[near == i], arity, levels - 1, rng) for i in used]
        return at

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, which = waiting.pop()
            near = distances(rows[which], self.centres[node]).argmin(1)
            for i, child in enumerate(self.children[node]):
                if len(part := which[near == i]):
                    if child < 0:
                        out[part] = -child - 1
                    else:
                        waiting.append((child, part))
        return out

    def visits(self, row: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                continue
            gap = ((self.centres[node] - row) ** 2).sum(1)
            for child, d in zip(self.children[node], gap.tolist(), strict=True):
                heapq.heappush(queue, (d, child))
        return found


def nearest(cands: tuple[np.ndarray, np.ndarray], asks: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, leaves: np.ndarray | None = None, visited: list | None = None) -> dict[str, list]:
    """Each query's ``k`` nearest of a bounded block, by Euclidean distance in double precision on the vectors themselves: of all rows, or of those whose leaf
    (``leaves``) the query visits (``visited``)."""
    ids, rows = cands
    by = np.argsort(ids, kind="stable")
    ids, rows = ids[by], rows[by]
    leaves = None if leaves is None else leaves[by]
    out: dict[str, list] = {"ask": [], "query_id": [], "vec_id": [], "score": []}
    for i, (ask, own, row) in enumerate(zip(*asks, strict=True)):
        at = np.arange(len(ids)) if leaves is None else np.flatnonzero(np.isin(leaves, visited[i]))
        gap = np.sqrt(((rows[at] - row) ** 2).sum(1))
        if (mine := own_row(ids[at], rows[at], own, row)) is not None:
            gap[mine] = np.inf
        if len(gap) > k:
            edge = np.partition(gap, k - 1)[k - 1]
            near = np.flatnonzero(gap <= edge)
            near = near[np.argsort(gap[near], kind="stable")][:k]
        else:
            near = np.argsort(gap, kind="stable")
        near = near[np.isfinite(gap[near])]
        out["ask"] += [int(ask)] * len(near)
        out["query_id"] += [int(own)] * len(near)
        out["vec_id"] += ids[at[near]].tolist()
        out["score"] += gap[near].tolist()
    return out


def bundled(sizes: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """leaf, bundle, chunks: leaves that follow each other (so that they are near each other) are bundled up to ``rows`` rows; a larger leaf is alone, in
    chunks of CHUNK rows."""
    out, bundle, held = [], 0, 0
    for leaf in sorted(sizes):
        if held and held + sizes[leaf] > rows:
            bundle, held = bundle + 1, 0
        held += sizes[leaf]
        out.append((leaf, bundle, blocks(sizes[leaf], CHUNK) if sizes[leaf] > rows else 1))
    return out


SCHEMA = "ask long, query_id long, vec_id long, score double"
FIELDS = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def brute_force(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries among all rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(nearest((b.column(0).to_numpy(), matrix(b.column(1))), (ids, ids, queries), k), schema=FIELDS)

    return merged(rows.select("vec_id", "embedding").mapInArrow(run, SCHEMA), k, F.asc("score"))


def depth(rows: int, sample: int) -> int:
    """Levels of the tree: leaves of about LEAF rows, as far as the sample holds FITTED rows for each."""
    leaves = max(1.0, min(rows / LEAF, min(rows, sample) / FITTED))
    return max(1, round(math.log(leaves, ARITY)))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Tree:
    """The tree, from at most ``sample`` rows chosen by hash, one for each vec_id."""
    few = rows.join(F.broadcast(bounded_ids(rows, "vec_id", sample)), "vec_id")  # at most `sample` integers
    few = one_each(few, "vec_id", "embedding").orderBy("vec_id").select("embedding").toArrow()
    return Tree(matrix(few.column(0)), depth(rows.count(), sample))


def calibrate(placed: DataFrame, tree: Tree, queries: DataFrame, k: int, target: float = TARGET) -> int:
    """How many leaves a search visits: the least number at which the mean recall of the calibration queries (at most CALIBRATION, chosen by
    hash, one for each vec_id) reaches ``target``, against brute force over all rows of ``placed``."""
    asks = queries.join(F.broadcast(bounded_ids(queries, "vec_id", CALIBRATION)), "vec_id")
    asks = one_each(asks, "vec_id", "embedding").toArrow()
    ids, points = asks.column("vec_id").to_numpy(), matrix(asks.column("embedding"))
    true = brute_force(placed, ids, points, k).select("query_id", "vec_id")
    true = placed.select("vec_id", "leaf").join(F.broadcast(true), "vec_id").groupBy("query_id", "vec_id").agg(F.min("leaf").alias("leaf")).toPandas()  # CALIBRATION * k rows
    order = {int(i): {leaf: at for at, leaf in enumerate(tree.visits(p, tree.leaves))} for i, p in zip(ids, points, strict=True)}
    at = np.sort([order[q][leaf] for q, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1 if len(at) else 1


def tree_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` (vec_id, embedding) with the leaf each falls in."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(matrix(b.column(1))))], names=["vec_id", "embedding", "leaf"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, leaf int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query (vec_id, embedding), nearest first, ties to the smaller
    vec_id, itself no candidate. Null, zero, non-finite vectors and rows without vec_id take no part. Vectors of different length have no
    distance: each length that queries have is searched on its own. Rows that share a vec_id are candidates, and queries, each on its own: a query's own row
    is one with its id and vector, any other with its id is a candidate. An empty table gives no rows; other columns are left aside, whatever their names."""
    rows, asks = usable(vectors, zero=False), usable(queries, zero=False)
    found = None
    for n in sorted(r["n"] for r in asks.select(F.size("embedding").alias("n")).distinct().collect()):
        made = _search(rows.filter(F.size("embedding") == n), asks.filter(F.size("embedding") == n), k, sample, target)
        found = made if found is None else found.unionByName(made)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _search(rows: DataFrame, asks: DataFrame, k: int, sample: int, target: float) -> DataFrame:
    """``search`` among vectors of one length; there is a query. Every row is indexed; leaves are dealt into chunks, so that a hot leaf is many
    groups."""
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(rows, sample)
    placed = stored(tree_leaves(rows, tree))
    visits = calibrate(placed, tree, asks, k, target)
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf: at most sample / FITTED * ARITY
    asks = asked(asks, "vec_id", "embedding")
    nq = blocks(asks.count(), QUERIES)
    grouped = bundled(sizes, BUNDLE)
    of_leaf = {leaf: bundle for leaf, bundle, _ in grouped}
    chunks = F.broadcast(placed.sparkSession.createDataFrame(grouped, "leaf int, bundle int, chunks int"))
    each = each_row(placed, k, "vec_id", "embedding", "leaf")
    left = each.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("chunks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).drop("chunks")

    def visit(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                which, bundles, leaves = [], [], []
                for i, x in enumerate(matrix(part.column(1))):
                    met: dict[int, list[int]] = {}
                    for leaf in tree.visits(x, visits):
                        if leaf in of_leaf:  # else no row fell into it
                            met.setdefault(of_leaf[leaf], []).append(leaf)
                    which += [i] * len(met)
                    bundles += met
                    leaves += met.values()
                if which:
                    made = [pa.array(bundles, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(which)) for c in part.columns), *made], names=["vec_id", "embedding", "ask", "bundle", "leaves"])

    of_bundle = F.broadcast(placed.sparkSession.createDataFrame(sorted({(bundle, n) for _, bundle, n in grouped}), "bundle int, chunks int"))
    right = asks.mapInArrow(visit, "vec_id long, embedding array<double>, ask long, bundle int, leaves array<int>").join(of_bundle, "bundle")
    right = right.withColumn("q", dealt("ask", nq)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def score(key, cands: pa.Table, table: pa.Table) -> pa.Table:
        if not cands.num_rows or not table.num_rows:
            return FIELDS.empty_table()
        rows = cands.column("vec_id").to_numpy(), matrix(cands.column("embedding"))
        asked_ = *(table.column(c).to_numpy() for c in ("ask", "vec_id")), matrix(table.column("embedding"))
        return pa.table(nearest(rows, asked_, k, cands.column("leaf").to_numpy(), table.column("leaves").to_pylist()), schema=FIELDS)

    keys = ("bundle", "chunk", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, SCHEMA)
    return merged(found, k, F.asc("score"), "ask").select("query_id", "rank", "vec_id", "score")
