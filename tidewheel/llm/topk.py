"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers floor(scale * x). A block of rows keeps its components by power-of-two band of |value|, so
that a posting segment is a dimension and a band. Of a block of queries, a segment's quantised impact is the query
component's band plus the segment's; segments are added to the accumulators from the highest impact down, all queries of
the block and all segments of an impact at once (as products of matrices that hold one band each). What is left of a row
adds less than the query's impacts that are left, so after each impact level every score is known to within a bound. Rows
that the bound proves to be outside the best k leave; a query ends only on that proof, when few enough possible members
are left (or no segment is), and these are rescored exactly.

Components of 2^26 or more would not fit the integers used here: such vectors meet all others in unlimited integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 8_192, 512
#: Bytes of query blocks up to which they are broadcast; beyond, blocks of rows and of queries meet on a grid.
BROADCAST_BYTES = 16 << 20
BANDS = 27
#: A query's possible members are rescored once they are so small a share of the block, or no more than k.
RESCORED = 1 / 64
LONG = (-(1 << 63), (1 << 63) - 1)


def _bands(v: np.ndarray) -> np.ndarray:
    """floor(log2 |v|), -1 for 0."""
    return np.frexp(np.abs(v).astype(np.float64))[1] - 1


class Block:
    """Index of one block of integer vectors (as float64). `rescored` counts the possible members of all searches."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.rescored = ids, rows, 0
        self.most = np.abs(rows).max(0, initial=0)
        if self.most.max(initial=0) >= 1 << 26:
            self.parts = None
            return
        band = _bands(rows)
        self.parts = {}
        for b in np.unique(band[band >= 0]):
            columns = np.flatnonzero((band == b).any(0))
            self.parts[int(b)] = columns, np.where(band[:, columns] == b, rows[:, columns], 0).astype(np.float32)
        self.norm = math.sqrt((rows**2).sum(1).max(initial=0))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the best k rows of each query, other than its own id; ties go to the smaller id."""
        if self.parts is None or np.abs(queries).max(initial=0) >= 1 << 26 or queries.shape[1] > 1 << 10:
            self.rescored += len(queries) * len(self.ids)
            return [self._exact(q, np.flatnonzero(self.ids != i), k) for q, i in zip(queries, own, strict=True)]
        band = _bands(queries)
        at = np.arange(len(queries))  # queries that go on
        score = np.zeros((len(at), len(self.ids)), np.float32)
        score[own[:, None] == self.ids[None, :]] = -np.inf
        slip = queries.shape[1] * 2.0**-22 * np.sqrt((queries**2).sum(1)) * self.norm  # of single precision
        few, out = max(k, int(len(self.ids) * RESCORED)), [np.empty(0, np.int64)] * len(at)
        by_band = {int(b): np.where(band == b, queries, 0).astype(np.float32) for b in np.unique(band[band >= 0])}
        levels = sorted({a + b for a in by_band for b in self.parts}, reverse=True)
        for level in levels:
            for b, (columns, part) in self.parts.items():
                q = by_band.get(level - b)
                if q is not None:
                    used = q[at][:, columns]
                    seen = used.any(0)
                    if seen.any():
                        score += (used[:, seen] @ part[:, seen].T) if not seen.all() else used @ part.T
            # a component left has a band below level - (the query component's), and is no larger than its column's largest
            left = np.minimum(np.exp2(np.clip(level - band[at], 0, 60)), self.most) * np.abs(queries[at])
            bound = left.sum(1) * (level > levels[-1]) + slip[at]
            if len(self.ids) > k:
                spread = score.max(1) - np.median(score[:, ::16], 1)
                ready = np.flatnonzero((2 * bound < spread) | (level == levels[-1]))  # others can hardly end
            else:
                ready = np.arange(len(at))
            if not len(ready):
                continue
            s = score[ready]
            kth = np.partition(s, -k, axis=1)[:, -k] if len(self.ids) > k else np.full(len(ready), -np.inf)
            # in double precision, where what is known and the bound round no further
            may = (s.astype(np.float64) + 2 * bound[ready, None] >= kth[:, None]) & (s > -np.inf)
            done = (may.sum(1) <= few) | (level == levels[-1]) | (len(self.ids) <= k)
            for j in np.flatnonzero(done):
                out[at[ready[j]]] = np.flatnonzero(may[j])
            going = np.ones(len(at), bool)
            going[ready[done]] = False
            at, score = at[going], score[going]
            if not len(at):
                break
        if not levels:  # all zero
            out = [np.flatnonzero(self.ids != i) for i in own]
        self.rescored += sum(map(len, out))
        return [self._exact(q, found, k) for q, found in zip(queries, out, strict=True)]

    def _exact(self, q: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows[found]
        most = int(np.abs(q).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, len(q))
        if most < 1 << 53:
            exact = (rows @ q).astype(np.int64)
        elif most < 1 << 63:
            exact = rows.astype(np.int64) @ q.astype(np.int64)
        else:
            whole = [int(x) for x in q]
            exact = np.array([min(max(sum(int(a) * b for a, b in zip(r, whole, strict=True)), LONG[0]), LONG[1]) for r in rows], np.int64)
        best = np.lexsort((self.ids[found], ~exact))[:k]
        return self.ids[found[best]], exact[best]


def _packed(rows_a_block: int, scale: int):
    """Rows (width, large, ids, values) of blocks; a partition's vectors of one width and kind of size share blocks."""

    def run(batches: Iterator[pd.DataFrame]):
        held: dict[tuple[int, bool], list] = {}

        def made(key) -> pd.DataFrame:
            ids, vectors = zip(*held.pop(key), strict=True)
            return pd.DataFrame({"width": [key[0]], "large": [key[1]], "ids": [np.array(ids, np.int64).tobytes()], "values_": [np.stack(vectors).tobytes()]})

        for b in batches:
            for vec_id, v in zip(b["id"], b["x"], strict=True):
                v = np.floor(np.asarray(v, np.float64) * scale)
                key = len(v), bool(np.abs(v).max(initial=0) >= 1 << 26)
                held.setdefault(key, []).append((vec_id, v))
                if len(held[key]) >= rows_a_block:
                    yield made(key)
        for key in list(held):
            yield made(key)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among all other ids.

    Ties go to the smaller id; rows that repeat an id each count, and queries that repeat id and vector are one. Vectors
    that are null or hold null or non-finite components take no part, nor rows without an id; vectors only meet those of
    their own width. A score beyond 64 bits is the nearest 64-bit number. An empty table gives no rows; other columns are
    ignored."""
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"), is_query.alias("q"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    queries = v.where("q").select("id", "x").distinct()
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * (F.size("x") + 1)), F.lit(0)).alias("bytes")).first()
    schema = "width int, large boolean, ids binary, values_ binary"
    asked = queries.repartition(max(1, math.ceil(size.n / QUERY_ROWS)), "id").mapInPandas(_packed(QUERY_ROWS, scale), schema).drop("large").toDF("width", "q_ids", "q_values")
    blocks = v.select("id", "x").mapInPandas(_packed(BLOCK_ROWS, scale), schema).drop("large")
    if size.bytes <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), "width")
    else:  # every block meets every query block once, in one of g x h groups
        h = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        g = math.ceil(size.bytes / BROADCAST_BYTES)
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        pairs = blocks.withColumn("h", deal("ids", h)).withColumn("g", every(g)).join(asked.withColumn("g", deal("q_ids", g)).withColumn("h", every(h)), ["width", "g", "h"])

    def search(batches: Iterator[pa.RecordBatch]):
        last, block = None, None
        for b in batches:
            for r in b.to_pylist():
                if last != (r["ids"], r["values_"]):
                    last = r["ids"], r["values_"]
                    ids = np.frombuffer(r["ids"], np.int64)
                    block = Block(ids, np.frombuffer(r["values_"], np.float64).reshape(len(ids), r["width"]))
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                found = block.search(np.frombuffer(r["q_values"], np.float64).reshape(len(q_ids), r["width"]), k, q_ids)
                out = [(np.full(len(ids), q_id), ids, score) for q_id, (ids, score) in zip(q_ids, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
