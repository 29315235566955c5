"""Approximate nearest neighbours by collision counting: sorted single projections, query-centred windows, virtual rehashing."""

from __future__ import annotations

from functools import cache
from math import comb, erf, inf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import cut

#: Projections, share of them in which a candidate must fall into the query's window, first half-width of a window and its
#: growth, in standard deviations of the block's projections; chance with which a vector as near as the k-th found reaches the threshold.
PROJECTIONS, COLLISIONS, FIRST, GROWTH, CONFIDENCE, SEED = 64, 0.6, 0.4, 1.07, 0.9, 11
#: Vectors of a block, queries of a query block, query blocks that one task takes for a block.
BLOCK, QUERIES, TURNS = 8192, 512, 4
K, EVERY = 20, 20


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows as one row: ids and vectors as bytes."""
    ids, vectors = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [vectors.shape[1]], "b": [pdf["b"].iloc[0]], "ids": [ids.tobytes()], "vs": [vectors.tobytes()]})


@cache
def reach_of(confidence: float) -> float:
    """The half-width, in distances of a vector from the query, at which the vector reaches the threshold with this chance.

    Differences of projections are normal with the distance as deviation, so collisions of one vector are binomial.
    """
    if confidence >= 1:
        return inf
    need = int(np.ceil(COLLISIONS * PROJECTIONS))
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        p = erf(middle / sqrt(2))
        chance = sum(comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(need, PROJECTIONS + 1))
        low, high = (middle, high) if chance < confidence else (low, middle)
    return high


class Index:
    """A block's vectors with one sorted array for each projection. Lengths are levelled by one more component, so that the
    nearest by distance is the one of largest inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = SEED):
        self.ids, self.vectors = ids, vectors
        scaled = vectors * 2.0 ** -np.frexp(np.abs(vectors).max())[1]  # so that squares of huge components stay finite
        squares = (scaled * scaled).sum(1)
        tail = np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]
        self.scaled = scaled
        self.directions = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        self.length = float(np.sqrt(squares.max()))
        values = np.round(np.concatenate([scaled, tail], axis=1) @ self.directions, 9).T
        order = np.argsort(values, axis=1, kind="stable")
        self.place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)  # of each vector in each sorted array
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        # The sorted arrays one after the other, each moved to a range of its own, so that one search finds all windows' edges.
        self.unit, self.shift = float(np.abs(values).max()) or 1.0, 4.0 * np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(values, order, axis=1) / self.unit + self.shift[:, None]).ravel()
        self.n_ids = len(np.unique(ids))
        self.step = float(values.std()) or 1.0
        self.level, self.verified = 15, 0

    def collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """For each vector, in how many sorted arrays it lies in the query's window."""
        edge = lambda x: np.clip(x / self.unit, -1.5, 1.5) + self.shift
        before = len(self.ids) * np.arange(PROJECTIONS)
        low, high = self.sorted.searchsorted(edge(centre - half), "left") - before, self.sorted.searchsorted(edge(centre + half), "right") - before
        inside = self.place - low.astype(self.place.dtype)[:, None] < (high - low).astype(self.place.dtype)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    def kth(self, found: np.ndarray, likeness: np.ndarray, k: int) -> float | None:
        """The k-th best likeness of the vectors at these positions, an id counted once; None if there are fewer ids."""
        own = likeness[found]
        if self.n_ids < len(self.ids):
            order = np.argsort(-own, kind="stable")
            own = own[order[np.unique(self.ids[found][order], return_index=True)[1]]]
        return None if len(own) < k else float(np.partition(own, len(own) - k)[len(own) - k])

    def search(self, qid: int, query: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the verified vectors that can be among the query's k best; those of its own id are left out.

        Level by level the windows widen by GROWTH, and with them the collisions grow; vectors that reach the threshold are
        verified. The windows are wide enough once a vector at the distance of the k-th best so far would reach the threshold with
        the chance `confidence`: nearer ones reach it more surely still. Wider windows only find more and nearer ones, so the
        first such level is found by doubling steps, then bisection. How many are verified (`verified`) follows from the distances.
        """
        others = self.ids != qid
        need, n_others = int(np.ceil(COLLISIONS * PROJECTIONS)), int(others.sum())
        query_ = query * 2.0 ** -np.frexp(np.abs(query).max())[1]
        query_ = query_ / np.linalg.norm(query_)
        centre = np.concatenate([query_ * self.length, [0.0]]) @ self.directions
        reach, fulls, likeness = {}, {}, np.full(len(self.ids), np.nan)

        def full(level: int) -> bool:
            half = FIRST * self.step * GROWTH**level
            found = reach[level] = np.flatnonzero((self.collisions(centre, half) >= need) & others)
            new = found[np.isnan(likeness[found])]
            likeness[new] = self.scaled[new] @ query_
            best = self.kth(found, likeness, k)
            near = best is not None and half >= reach_of(confidence) * sqrt(max(0.0, 2 * self.length * (self.length - best)))
            fulls[level] = near or len(found) == n_others
            return fulls[level]

        # Queries of a block need much the same level, so the search for the first full one starts from the last query's.
        low, high, step = -1, self.level, 1
        while not full(high):
            low, high, step = high, high + step, 2 * step
        while low < 0 < high and (below := max(0, high - step)) < high and full(below):
            high, step = below, 2 * step
        low = max([low, *(x for x in reach if not fulls[x] and x < high)])
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if full(middle) else (middle, high)
        self.level = high
        found = np.flatnonzero(~np.isnan(likeness))
        self.verified, best = len(found), self.kth(found, likeness, k)
        if best is not None:
            found = found[likeness[found] >= best - 1e-9 * self.length]  # far more than rounding: no equal score is lost
        with np.errstate(over="ignore", invalid="ignore"):
            return found, np.einsum("ij,j->i", self.vectors[found], query)


def _best(ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool):
    """The k best ids, each with its best score if some are repeated, and ties to smaller ids."""
    if repeated:
        order = np.lexsort((-scores, ids))
        first = order[np.unique(ids[order], return_index=True)[1]]
        ids, scores = ids[first], scores[first]
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(k: int, confidence: float):
    def run(frames):
        known, index = None, None
        for pdf in frames:
            for row in pdf.itertuples():
                if known != (row.dim, row.b):
                    known, index = (row.dim, row.b), Index(np.frombuffer(row.ids, np.int64), np.frombuffer(row.vs, np.float64).reshape(-1, row.dim))
                out = []
                for qid, query in zip(np.frombuffer(row.qids, np.int64), np.frombuffer(row.qvs, np.float64).reshape(-1, row.dim), strict=True):
                    at, scores = index.search(qid, query, k, confidence)
                    ids, scores = _best(index.ids[at], scores, k, index.n_ids < len(index.ids))
                    out.append((np.full(len(ids), qid), ids, scores))
                q, i, s = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """id, v, dim of the vectors that take part: an id, at least one component, all of them finite, not all zero."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(good).withColumn("dim", F.size("v"))


def dealt(vectors: DataFrame, parts: int) -> DataFrame:
    """Distinct id, v, dim as `parts` packed blocks for each dim. The vector salts the hash, so that rows of one id spread."""
    block = F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    return vectors.withColumn("b", block).groupBy("dim", "b").applyInPandas(_pack, "dim int, b long, ids binary, vs binary")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k of largest inner product found among all others.

    Rows alike in id and vector count once, as queries and as candidates. Where an id has several vectors, each of them is a
    query and a candidate: a pair of ids comes once, with the best score of their vectors, so the k are k different vec_ids.
    Null ids, and vectors that are null, empty, zero or not finite throughout, take no part; an empty table gives no rows.
    Further columns of embeddings, whatever their names, are not read.

    Vectors are dealt to blocks by a hash of id and components; each block sorts all its vectors by PROJECTIONS random projections,
    and each query's windows in it grow (the virtual rehashing); vectors that fall into COLLISIONS of them are verified, exactly, and
    the windows stop once one as near as the block's k-th best would have fallen into as many with the chance `confidence` (1: all are
    verified). Vectors in clusters are pruned hard; where all are nearly as far as the k-th best, most are verified. A query block meets each block once; a block returns k rows a query. All vectors within a
    window's edge take part, so equal vectors are found together and ties go to the smaller id. Only vectors of the query's
    dimension are its candidates. Rows that share a query's id are not candidates of each other.
    """
    base = cut(usable(embeddings).distinct())
    n, n_queries = base.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, query_blocks = n // BLOCK + 1, n_queries // QUERIES + 1
    queries = dealt(base.filter(F.col("id") % every == 0), query_blocks).withColumnsRenamed({"b": "q", "ids": "qids", "vs": "qvs"})
    packs = dealt(base, blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    pairs = packs.join(queries.hint("shuffle_hash"), ["dim", "q"]).repartition(blocks * (query_blocks // TURNS + 1), "dim", "b", F.expr(f"q div {TURNS}")).sortWithinPartitions("dim", "b")
    found = pairs.select("dim", "b", "ids", "vs", "qids", "qvs").mapInPandas(_search(k, confidence), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings)
