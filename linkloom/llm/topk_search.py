"""Exact top-k inner-product search over an impact-ordered index.

Vectors become integer vectors. Rows are cut into blocks, queries as well, and
every pair of blocks is one unit of work of bounded size; a query's best rows
of all blocks are merged by one window. Within a block the index is a list of
posting segments by descending quantised impact: segment b has the components
whose absolute value is in [2^b, 2^(b+1)), rounded to multiples of STEP. Score
at a time, segments are added for all open queries at once. What a row can
still gain or lose is bounded by the length of the query times the length of
the row's unread rest, so a query is closed only when its possible members are
proven to be few (or no segment is left), and these are scored exactly.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
#: Quantisation step of an impact.
STEP = 8
#: The largest score that a long can hold.
MOST = (1 << 63) - 1
#: A query is closed when at most this many times k rows can be members.
SLACK = 4


class ImpactIndex:
    """The posting segments of one block of integer vectors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        quantised = np.rint(rows / STEP) * STEP
        size = np.abs(quantised)
        band = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))), -1).astype(np.int64)
        self.segments, rest = [], rows.astype(np.float64)
        for level in sorted({int(x) for x in np.unique(band) if x >= 0}, reverse=True):
            part = np.where(band == level, quantised, 0.0)
            rest = rest - part
            # the slack covers rounding of square roots and sums
            self.segments.append((part, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-6))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the places of all rows that can be among its k best.

        ``own`` is true where a row is the query itself, which takes no part.
        """
        n, m = len(queries), len(self.rows)
        found: list[np.ndarray] = [np.flatnonzero(~own[i]) for i in range(n)]
        scores, still = np.zeros((n, m)), np.arange(n)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        for part, rest in self.segments:
            if not len(still) or m <= SLACK * k:
                break
            scores[still] += queries[still] @ part.T
            margin = length[still, None] * rest[None, :]
            low = np.where(own[still], -np.inf, scores[still] - margin)
            floor = np.partition(low, m - k, axis=1)[:, m - k]
            possible = (scores[still] + margin >= floor[:, None]) & ~own[still]
            for place, i in enumerate(still):
                found[i] = np.flatnonzero(possible[place])
            still = still[possible.sum(axis=1) > SLACK * k]
        return found


def search_block(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, row id, score) of each query's k best rows of a block, exactly."""
    out: tuple[list, list, list] = ([], [], [])
    own = query_ids[:, None] == row_ids[None, :]
    if len(rows) and float(np.abs(rows.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * rows.shape[1] >= 2.0**53:
        # too large for exact sums of doubles: Python's integers score every row
        listed = rows.tolist()
        for i, query in enumerate(queries.tolist()):
            scored = sorted((-sum(map(operator.mul, query, row)), int(own_id)) for own_id, row, mine in zip(row_ids, listed, own[i], strict=True) if not mine)
            for score, row_id in [x for x in scored if -MOST <= -x[0] <= MOST][:k]:
                out[0].append(int(query_ids[i]))
                out[1].append(row_id)
                out[2].append(-score)
        return out
    for i, places in enumerate(ImpactIndex(rows).search(queries.astype(np.float64), own, k)):
        exact = rows[places] @ queries[i]
        best = np.lexsort((row_ids[places], -exact))[:k]
        out[0].extend([int(query_ids[i])] * len(best))
        out[1].extend(row_ids[places][best].tolist())
        out[2].extend(exact[best].tolist())
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x), x as double; the score is the integer
    inner product. Queries are the rows for which ``is_query`` holds, over its
    id column; candidates all rows but those with the query's own id. Ties go
    to the smaller id; fewer candidates than ``k`` give fewer rows. Vectors
    that are null or empty, hold a null or non-finite component or have no id take
    no part; a query meets only vectors of its own length. Components beyond a
    long count as its end, and a score beyond it, which no long can tell, is
    left out. A repeated row is
    a candidate as often as it comes. An empty table gives an empty table.
    """
    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    numbers = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), numbers.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    row_blocks, query_blocks = -(-n_rows // BLOCK_ROWS) or 1, -(-n_queries // BLOCK_QUERIES) or 1
    # salted by content as well, so that rows that repeat an id spread
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", block(row_blocks).alias("row_block")).withColumn("query_block", every(query_blocks))
    queries = rows.filter("asks").select("id", "v", block(query_blocks).alias("query_block")).withColumn("row_block", every(row_blocks))

    def unit(ours: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for size in {len(x) for x in asked.column("v")} & {len(x) for x in ours.column("v")}:
            sides = []
            for side in (asked, ours):
                picked = [(i.as_py(), v.as_py()) for i, v in zip(side.column("id"), side.column("v"), strict=True) if len(v) == size]
                sides += [np.array([i for i, _ in picked], np.int64), np.array([v for _, v in picked], np.int64)]
            for column, more in zip(out, search_block(*sides, k), strict=True):
                column.extend(more)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    keys = ["row_block", "query_block"]
    best = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(unit, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
