"""Exact top-k by integer inner product, with a precomputed table of distances to pivots.

Each component becomes floor(256 x). For a query q and a row x, |d(q, p) - d(x, p)| <= d(q, x) holds for every pivot
p, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2; the largest of these lower bounds over all pivots is an upper bound of
the score. Rows are evaluated in the order of that bound, and a query stops when the next bound is below its k-th
score. Rows with a bound equal to the k-th score are still evaluated, so that ties fall to the smaller id.

1. *Pivots* are rows of the data, far from each other: of the ``SAMPLE`` rows of each length whose ids have the least
   hashes, one after the other the row farthest from those chosen. Any pivots give exact results.
2. *Table.* Each row's id, integers, square and distances to the pivots are written once; no block of queries computes
   them anew.
3. *Blocks.* The queries are written once, by blocks of at most ``BLOCK``, and the driver reads one block at a time and
   broadcasts it. A task is a block and a part of the table: it keeps k rows a query, which one window by query ranks.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; rows of another
length than the query's are not its candidates; repeated ids are candidates one by one but for the query's own id, and
of several vectors of one query id the least by components is the query; fewer than k candidates give fewer rows; empty
tables give an empty result; other columns are not read. Scores are exact whatever the size of the components: in
float64 where no sum can reach 2**53, else in 64-bit integers, else in integers of any size; a score beyond 64 bits is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK = 4096
PIVOTS = 24
SAMPLE = 2000
CHUNK = 4096
STEP = 64
SIDE = 32
OUT = "query_id long, vec_id long, score long"


TABLE = "vec_id long, d int, vector binary, square double, distances binary"


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in the batch: the length, ids, and the integer rows as float64."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(ids) else np.empty(0)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), ids[at], np.floor(flat[offsets[at][:, None] + np.arange(d)].astype(np.float64) * 256)


def pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x``, each the farthest from those before."""
    chosen = [0]
    gap = _to_pivots(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _to_pivots(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _to_pivots(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: in float64 where no sum can reach 2**53, in int64 below 2**62, else in Python's integers."""
    most = len(q) * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    if not np.isfinite(most):
        raise ValueError("a score may lie beyond 64 bits")
    own = [int(v) for v in q]
    scores = [sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in x]
    if any(not -(1 << 63) <= v < 1 << 63 for v in scores):
        raise ValueError("a score lies beyond 64 bits")
    return np.array(scores, np.int64)


def best_of(q_id: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """``top``, the k best scores and ids so far, with the rows evaluated in the order of their bounds until the next
    bound is below the k-th score; and how many rows were evaluated."""
    scores, names = top
    left = np.flatnonzero(bound >= scores[-1]) if len(scores) == k else np.arange(len(ids))
    seen, step = 0, STEP
    while len(left):
        if step < len(left):
            by = np.argpartition(-bound[left], step)
            rows, left = left[by[:step]], left[by[step:]]
        else:
            rows, left = left, left[:0]
        seen += len(rows)
        own = _dots(q, x[rows])
        good = ids[rows] != q_id
        if len(scores) == k:
            good &= own >= scores[-1]
        if good.any():
            scores, names = np.r_[scores, own[good]], np.r_[names, ids[rows][good]]
            first = np.lexsort((names, -scores))[:k]
            scores, names = scores[first], names[first]
        if len(scores) == k:
            left = left[bound[left] >= scores[-1]]
        step *= 16
    return (scores, names), seen


def _tabled(shared):
    """Rows (vec_id, embedding) to rows of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, x in _vectors(batch):
                p = shared.value.get(d)
                to = _to_pivots(x, p) if p is not None else np.empty((len(x), 0))
                columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(1)), pa.array([r.tobytes() for r in to], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "d", "vector", "square", "distances"])

    return run


def _rows(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, squares and distances of the table's rows of length ``d``."""
    own = batch.filter(pc.equal(batch.column(1), d))
    ids, square = own.column(0).to_numpy(), own.column(3).to_numpy()
    x, to = (_matrix(own.column(c).to_pylist()) for c in (2, 4))
    return ids, x, square, to


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), len(rows[0]) // 8 if rows else 0)


def _search(shared, k: int, tell: bool = False):
    """Rows of the table to each query's best rows; with ``tell``, to one row of numbers of evaluated and of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        none = np.empty(0, np.int64)
        tops = {d: [(none, none)] * len(t[0]) for d, t in tables.items()}
        evaluated = pairs = 0
        for batch in batches:
            for d, (q_ids, qs, q_square, q_to) in tables.items():
                best = tops[d]
                for s in range(0, len(batch), CHUNK):
                    ids, x, x_square, x_to = _rows(batch.slice(s, CHUNK), d)
                    if not len(ids):
                        continue
                    x_to = np.ascontiguousarray(x_to.T)
                    for a in range(0, len(q_ids), SIDE):
                        lower = np.zeros((len(q_ids[a : a + SIDE]), len(ids)))
                        for to, own in zip(q_to[a : a + SIDE].T, x_to, strict=True):
                            gap = own[None] - to[:, None]
                            np.maximum(lower, np.abs(gap, out=gap), out=lower)
                        # The slack covers the rounding of the distances; a bound that is too high costs work only.
                        size = q_square[a : a + SIDE, None] + x_square
                        lower = np.maximum(lower - 1e-6 * (1 + np.sqrt(size)), 0)
                        bound = (size - lower * lower) / 2 + 1e-6 * (1 + size)
                        for j in range(a, a + len(bound)):
                            best[j], n = best_of(int(q_ids[j]), qs[j], ids, x, bound[j - a], k, best[j])
                            evaluated, pairs = evaluated + n, pairs + len(ids)
        if tell:
            yield pa.RecordBatch.from_arrays([pa.array([evaluated]), pa.array([pairs]), pa.array([0])], ["query_id", "vec_id", "score"])
            return
        for d, best in tops.items():
            counts = [len(t[0]) for t in best]
            if sum(counts):
                columns = [np.repeat(tables[d][0], counts), np.concatenate([t[1] for t in best]), np.concatenate([t[0] for t in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _sound(df: DataFrame) -> DataFrame:
    whole = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return whole.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)


def _chosen_pivots(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, from a bounded sample of each of the ``PIVOTS`` most frequent lengths; rows of other
    lengths have none, and are all evaluated."""
    lengths = [r.d for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(PIVOTS).collect()]
    out = {}
    for d in lengths:
        sample = rows.where(F.size("embedding") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE)
        out[d] = pivots(np.floor(np.array([r.embedding for r in sample.select("embedding").collect()], np.float64) * 256), count)
    return out


def _parts(vectors: DataFrame, queries: DataFrame, k: int, block: int, count: int, tell: bool = False) -> DataFrame:
    spark = vectors.sparkSession
    rows, asked = _sound(vectors), _sound(queries)
    shared = spark.sparkContext.broadcast(_chosen_pivots(rows, count))
    table = scratch.table(rows.mapInArrow(_tabled(shared), TABLE), "pivot-table")
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.table(asked.mapInArrow(_tabled(shared), TABLE), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = scratch.table(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "query-blocks", "block")
    found = None
    for b in range(blocks):
        by: dict[int, list[list]] = {}
        for r in asked.where(F.col("block") == b).collect():  # about ``block`` rows, from a folder of their own
            for kept, value in zip(by.setdefault(r.d, [[], [], [], []]), (r.vec_id, r.vector, r.square, r.distances), strict=True):
                kept.append(value)
        flat = {d: (np.array(t[0], np.int64), _matrix(t[1]), np.array(t[2]), _matrix(t[3])) for d, t in by.items()}
        part = table.mapInArrow(_search(spark.sparkContext.broadcast(flat), k, tell), OUT)
        found = part if found is None else found.unionAll(part)
        if b % 8 == 7 and b + 1 < blocks:
            found = scratch.table(found, "topk")
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, count: int = PIVOTS) -> DataFrame:
    """Both frames hold vec_id and embedding. Each query's k highest scores: query_id, rank, vec_id, score."""
    found = _parts(vectors, queries, k, block, count)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, count: int = PIVOTS) -> float:
    """Of all pairs of a query and a row, the share whose score was computed."""
    r = _parts(vectors, queries, k, block, count, True).agg(F.sum("query_id").alias("n"), F.sum("vec_id").alias("all")).first()
    return r.n / r["all"] if r["all"] else 0.0


ORACLE = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
