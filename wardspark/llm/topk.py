"""Exact top-k inner products from an impact-ordered index, processed score-at-a-time.

The vectors lie in blocks. A block's index has, for every dimension, the vector ids in order of their component, cut
into segments of one quantised impact each. A query visits the segments of all dimensions by descending impact (its own
component times the segment's, above the least that dimension can give) and adds lower and upper bounds to per-vector
accumulators. After each round the vectors ahead are scored exactly, for a floor of the k-th best score. The query
stops only on proof: once the impact of the next segment, times the dimensions a vector has yet to meet, cannot lift
more than a few vectors to that floor. Those possible members are rescored exactly.

Blocks of queries meet blocks of vectors by key, so neither side is collected or broadcast whole. Each pair of blocks
returns at most k rows a query; a last ranking of those gives the answer.

Components are integers floor(scale * x). Defined cases: a vector that is null, empty or has a null or non-finite
component takes no part, nor does a null id. Of repeated ids the smallest vector counts. Vectors are compared with
those of the same length only. Ties go to the smaller id. A query with fewer than k others gets all of them. An empty
table gives no rows. Large components: accumulators hold bounds in units of a power of two that keeps them exact, and
members are rescored in 64-bit integers; where a sum of products might not fit those, in integers of any size. A
component or one of the k best scores beyond 64 bits is an error, as the result has no place for it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a block's postings after which the proof is tried.
ROUNDS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


class ImpactIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray, levels: int = 48):
        self.vectors = vectors
        n, dims = vectors.shape
        low, high = vectors.min(0), vectors.max(0)
        level = (vectors - low) * levels // (high - low + 1)
        order = np.argsort(level, axis=0, kind="stable").T
        self.postings = np.ascontiguousarray(order, np.intp).ravel()
        column = vectors.T[np.arange(dims)[:, None], order]
        at = np.sort(level, axis=0).T
        self.dim, self.start, self.stop, self.least, self.most = [], [], [], [], []
        for d in range(dims):
            first = np.flatnonzero(np.diff(at[d], prepend=-1))
            self.dim.append(np.full(len(first), d))
            self.start.append(first)
            self.stop.append(np.append(first[1:], n))
            self.least.append(np.minimum.reduceat(column[d], first))
            self.most.append(np.maximum.reduceat(column[d], first))
        self.dim, self.start, self.stop, self.least, self.most = (
            np.concatenate(x) for x in (self.dim, self.start, self.stop, self.least, self.most))
        self.floor_low, self.floor_high = low, high

    def search(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all possible members of the k best; ``own`` takes no part."""
        n, dims = self.vectors.shape
        size = np.maximum(np.abs(self.floor_low.astype(float)), np.abs(self.floor_high.astype(float)))
        most_sum = float((np.abs(query.astype(float)) * size).sum())
        if most_sum >= 2.0 ** 60:  # products and their sums might not fit 64 bits
            return self._search_any_size(query, k, own)
        q = query[self.dim]
        ends = np.stack([q * self.least, q * self.most])
        worst = np.minimum(query * self.floor_low, query * self.floor_high)[self.dim]
        lower, upper = ends.min(0) - worst, ends.max(0) - worst
        # bounds in units of 2 ** unit, rounded outwards: with the counter below they stay within 52 bits
        unit = max(0, int(2 * most_sum).bit_length() + dims.bit_length() + 2 - 52)
        lower, upper = lower >> unit, -(-upper >> unit)
        # no vector gains more by quantisation than the widest segment of each dimension
        slack = np.maximum.reduceat(upper - lower, np.flatnonzero(np.diff(self.dim, prepend=-1))).sum()
        by_impact = np.argsort(-upper, kind="stable")
        size = self.stop - self.start
        place = self.dim * n + self.start
        done = np.cumsum(size[by_impact])
        # one accumulator holds both the lower bound and, in its last digit, the number of dimensions met
        digit = dims.bit_length()
        gain = ((lower << digit) + 1).astype(np.float64)
        held = np.zeros(n)
        begin, few, probes = 0, max(4 * k, n // 16), 8 * k + 1
        least_score = np.minimum(query * self.floor_low, query * self.floor_high).sum()
        for share in ROUNDS:
            end = int(np.searchsorted(done, share * n * dims - 0.5)) + 1
            segments = np.sort(by_impact[begin:end])
            if len(segments):
                # neighbouring segments lie side by side in the postings
                first = np.flatnonzero(np.diff(segments, prepend=-2) != 1)
                last = np.append(first[1:], len(segments)) - 1
                ids = np.concatenate([self.postings[a:b] for a, b in zip(
                    place[segments[first]].tolist(), (place + size)[segments[last]].tolist(), strict=True)])
                held += np.bincount(ids, np.repeat(gain[segments], size[segments]), n)
            begin = max(begin, end)
            left = upper[by_impact[begin]] if begin < len(by_impact) else 0
            exact = held.astype(np.int64)
            bound, met = exact >> digit, exact & ((1 << digit) - 1)
            most = bound + slack + left * (dims - met)
            if own >= 0:
                bound[own] = -1
            if n - (own >= 0) > probes:
                # the vectors ahead so far are scored exactly: the k-th best of them is below the true k-th best
                ahead = np.argpartition(bound, n - probes)[n - probes:]
                ahead = ahead[ahead != own]
                kth = (np.partition(self.vectors[ahead] @ query, -k)[-k] - least_score) >> unit
                possible = most >= kth
            else:
                possible = np.ones(n, bool)
            if own >= 0:
                possible[own] = False
            if begin >= len(by_impact) or np.count_nonzero(possible) <= few:
                break
        members = np.flatnonzero(possible)
        return members, self.vectors[members] @ query

    def _search_any_size(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, by integers of any size, for components whose products might overflow."""
        q = [int(x) for x in query]
        score = [(sum(a * b for a, b in zip(row.tolist(), q, strict=True)), -i) for i, row in enumerate(self.vectors) if i != own]
        best = heapq.nlargest(k, score)
        if any(abs(s) >= 1 << 63 for s, _ in best):
            raise OverflowError("a score of the best does not fit 64 bits")
        return np.array([-i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def integers(col: Column, scale: float) -> Column:
    """floor(scale * x) of every component as long, null for a vector that takes no part."""
    wide = F.transform(col, lambda x: x.cast("double"))
    limit = float("inf")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (x == F.lit(limit)) | (x == F.lit(-limit)))
    good = col.isNotNull() & (F.size(col) > 0) & ~bad
    def whole(x):
        y = F.lit(scale) * x
        return F.when(F.abs(y) < F.lit(2.0 ** 63), F.floor(y)).otherwise(
            F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    return F.when(good, F.transform(wide, whole))


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, block: int = 16384, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds.

    A block of vectors is sent, and its index built, once for each ``query_block`` queries; larger blocks of queries
    move less and make fewer and longer tasks.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n, n_q = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // query_block))
    h = F.xxhash64("id")
    vectors = rows.select(F.pmod(h, F.lit(blocks)).alias("vb"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
                          F.size("v").alias("dims"), F.lit(False).alias("q"), "id", "v")
    queries = rows.where("q").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("vb"),
                                     F.pmod(h, F.lit(q_blocks)).alias("qb"),
                                     F.size("v").alias("dims"), F.lit(True).alias("q"), "id", "v")

    def block_pair(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q = t["q"].to_numpy().astype(bool)
        ids = t["id"].to_numpy()
        dims = t["dims"][0].as_py()
        values = t["v"].combine_chunks()
        m = values.flatten().to_numpy().reshape(-1, dims)
        vid, v = ids[~q], m[~q]
        out_q, out_v, out_s = [], [], []
        if len(vid) and q.any():
            order = np.argsort(vid)
            vid, v = vid[order], v[order]
            index = ImpactIndex(v)
            for query_id, query in zip(ids[q], m[q], strict=True):
                at = int(np.searchsorted(vid, query_id))
                own = at if at < len(vid) and vid[at] == query_id else -1
                members, score = index.search(query, k, own)
                best = np.lexsort((vid[members], -score))[:k]
                out_q.append(np.full(len(best), query_id))
                out_v.append(vid[members[best]])
                out_s.append(score[best])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s)})

    found = (vectors.unionByName(queries).groupBy("qb", "vb", "dims")
             .applyInArrow(block_pair, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
