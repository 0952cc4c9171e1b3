"""Exact top-k inner products over an impact-ordered index, score at a time.

Each block of candidates keeps, per dimension, its postings in order of impact (the component), cut into segments of about equal
length. What a segment can add to a query's score at most is its quantised impact. Segments of all dimensions are processed in
descending order of it: each candidate gathers the impacts of its postings and how many of its dimensions were met. A candidate's
score is at most what it gathered, plus the impact of the next segment for each dimension that was begun but not yet met, plus the
best of each dimension not begun. The k-th best exact score among the leaders is proved to be reached. Candidates under it can't be
members. Processing stops when hardly more than k may still be members, or all is processed; these are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import asked, blocks, dealt, each_row, merged, own_row, usable

#: Segments of a dimension; candidates and queries of a block. Shipping grows with rows times queries times (1 / CANDIDATES + 1 / QUERIES).
SEGMENTS, CANDIDATES, QUERIES = 64, 16_384, 8_192
#: Shares of the postings after which proof is sought; possible members, in multiples of k, that are hardly more (or one in two hundred).
STOPS, HARDLY = (0.25, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0), 4


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, values: floor(scale * component) of the rows that take part. A component whose value leaves the long is an error."""

    def value(x):
        fits = F.abs(x * scale) < float(1 << 63)
        return F.when(fits, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is no long")).cast("long"))

    return usable(vectors).select("vec_id", F.transform("embedding", value).alias("values"))


def dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exactly: in whole numbers of any size where 64 bits might not hold them."""
    if not len(rows) or float(np.abs(rows.astype(float)).max()) * float(np.abs(query.astype(float)).max()) * len(query) < 2.0**62:
        return rows @ query
    return rows.astype(object) @ query.astype(object)


class Index:
    """Postings of one block of candidates of equal length, in order of impact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, segments: int = SEGMENTS):
        by = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by], values[by]
        n, dims = self.values.shape
        self.postings = np.ascontiguousarray(np.argsort(self.values, axis=0, kind="stable").T)  # per dimension, ascending impact
        self.shift = int(dims).bit_length()
        self.pack = 1 << self.shift
        self.edges = np.unique(np.linspace(0, n, min(n, segments) + 1).astype(np.int64))
        ranked = np.take_along_axis(self.values.T, self.postings, axis=1)
        self.low, self.high = ranked[:, self.edges[:-1]], ranked[:, self.edges[1:] - 1]
        self.sizes = np.diff(self.edges)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best, best first, ties to the smaller id; the query's ``own`` row (its id and values) is no candidate.
        ``done`` then holds the shares of postings processed and of candidates rescored. Impacts are quantised upwards to a unit (1, while
        values are small) in which sums stay exact, so that a bound is one at any magnitude."""
        n, dims = self.values.shape
        at_most = float(np.abs(self.low.astype(float)).max(initial=0.0)), float(np.abs(self.high.astype(float)).max(initial=0.0)), float(np.abs(query.astype(float)).max(initial=0.0))
        reach = max(at_most[:2]) * at_most[2]
        unit = max(0, int(np.ceil(np.log2(reach + 1))) + 1 - (52 - 2 * self.shift))  # bits dropped: dims * (impact * pack + 1) stays under 2 ** 53
        if reach < 2.0**62:
            most = np.maximum(query[:, None] * self.low, query[:, None] * self.high)
        else:
            most = np.maximum(query[:, None].astype(object) * self.low, query[:, None].astype(object) * self.high)
        most = (-(-most >> unit)).astype(np.int64)
        order = np.argsort(-most, axis=None, kind="stable")
        impacts, of_dim = most.ravel()[order], order // len(self.sizes)
        reached = np.cumsum(self.sizes[order % len(self.sizes)])
        best_of, begun = most.max(axis=1), np.zeros(dims, np.int64)  # segments of each dimension that were processed
        rising = query >= 0  # then the segment of most impact is a dimension's last, else its first
        whole = np.repeat(most, self.sizes, axis=1) * self.pack + 1  # what a posting adds: its segment's impact, and one dimension met
        gathered, members, at = np.zeros(n), np.arange(n), 0
        out = None if own is None else own_row(self.ids, self.values, own, query)
        for share in STOPS:
            upto = len(order) if share == 1.0 else int(np.searchsorted(reached, share * n * dims)) + 1
            more = np.bincount(of_dim[at:upto], minlength=dims)
            lists, weights = [], []
            for d in np.flatnonzero(more).tolist():
                first, last = begun[d], begun[d] + more[d]
                part = slice(self.edges[-1 - last], self.edges[-1 - first]) if rising[d] else slice(self.edges[first], self.edges[last])
                lists.append(self.postings[d, part])
                weights.append(whole[d, part])
            if lists:
                gathered += np.bincount(np.concatenate(lists), np.concatenate(weights), n)
            begun, at = begun + more, upto
            packed = gathered.astype(np.int64)
            met, ahead = packed & (self.pack - 1), impacts[at] if at < len(order) else 0
            bound = (packed >> self.shift) + ((begun > 0).sum() - met) * ahead + best_of[begun == 0].sum()
            lead = np.argpartition(-bound, HARDLY * k)[: HARDLY * k + 1] if n > HARDLY * k + 1 else np.arange(n)
            exact = sorted(dot(self.values[lead[lead != out] if out is not None else lead], query).tolist(), reverse=True)
            members = np.flatnonzero(bound >= -(-exact[k - 1] >> unit)) if len(exact) >= k else np.arange(n)
            if len(members) <= max(HARDLY * k, n // 200):
                break
        self.done = (reached[at - 1] if at else 0) / max(1, n * dims), len(members) / max(1, n)
        members = members[members != out] if out is not None else members
        scores, ids = dot(self.values[members], query), self.ids[members]
        best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[best], scores[best]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best by integer inner product (all candidates, if fewer), ties to the
    smaller vec_id, itself no candidate. Both tables: vec_id, values (array<long>). Only vectors of equal length meet.
    Candidates and queries are dealt into blocks; each pair of blocks is one group of bounded size, and each gives k
    rows a query. Rows that share a vec_id are candidates, and queries, each on its own: a query's own row is one with its id and values, any other
    with its id is a candidate. Equal rows are counted, and stand for themselves at most k + 1 times. A score that leaves the long is an error. Null, empty, and odd vectors are left out by ``scaled``; empty tables give no
    rows; other columns are left aside, whatever their names."""
    sizes = candidates.agg(F.count("*")).head()[0], queries.agg(F.count("*")).head()[0]
    nc, nq = blocks(sizes[0], CANDIDATES), blocks(sizes[1], QUERIES)
    asks, rows_ = asked(queries, "vec_id", "values"), each_row(candidates, k, "vec_id", "values")
    block = F.pmod(F.xxhash64("vec_id", "values"), F.lit(nc)).cast("int").alias("c")  # equal rows in one
    left = rows_.select("vec_id", "values", F.size("values").alias("dims"), block, F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"))
    right = asks.select("ask", "vec_id", "values", F.size("values").alias("dims"), dealt("ask", nq).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"))

    def rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        flat = table.column("values").combine_chunks().flatten().to_numpy()
        return ids, flat.reshape(len(ids), -1)

    def search(key, cands: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"ask": [], "query_id": [], "vec_id": [], "score": []}
        if cands.num_rows and asks.num_rows:
            index = Index(*rows(cands))
            for ask, own, query in zip(asks.column("ask").to_pylist(), *rows(asks), strict=True):
                ids, scores = index.search(query, k, int(own))
                out["ask"] += [ask] * len(ids)
                out["query_id"] += [int(own)] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    keys = ("q", "c", "dims")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "ask long, query_id long, vec_id long, score long")
    return merged(found, k, F.desc("score"), "ask").select("query_id", "rank", "vec_id", "score")
