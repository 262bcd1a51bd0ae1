"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's components become floor(SCALE * x). At a resolution of s segments, each segment of a vector has a mean and a
deviation. By the Cauchy-Schwarz inequality the inner product of two segments of length w is at most
w * (mean * mean' + deviation * deviation'), so their sum bounds the score from above (and the distance from below). The
bound gets tighter with every resolution.

Each pair of a query and a candidate is decided on its own. A query's first k-th best score comes from the exact scores of
those candidates of its first block that have the best bounds at the finest resolution. From then on, coarse to fine, pairs whose bound
lies below the query's k-th best score so far drop out, and the exact integer score is computed for the pairs left only.
Best.pairs and Best.exact count both.

Queries are dealt over groups of bounded size, candidates too, and every group of queries meets every group of candidates in one
task, which holds the queries and lets the candidates pass. So the table is copied once for each group of queries, and the
queries once for each group of candidates; tasks grow in number, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Vectors in a group, at most, and their bytes; the least number of vectors for which a further group of candidates is made,
#: up to LANES; bytes in a packed row.
GROUP, GROUP_BYTES, LANE, LANES, PACK_BYTES = 16384, 64 << 20, 1024, 32, 1 << 16
#: Queries and candidates whose bounds are one matrix.
QUERIES, CANDIDATES = 512, 2048
#: Of a matrix, the share of pairs above which a resolution's bounds are one matrix product, for speed alone.
DENSE = 0.02
_MOST = 2**63 - 1


def levels(d: int) -> list[int]:
    """Numbers of segments of vectors with d components, coarse to fine; at the finest, half of the components are alone."""
    return sorted({s for s in (1, 4, 16, d // 2, 3 * d // 4) if 0 < s <= d})


def _features(x: np.ndarray, ours: bool = True) -> dict[int, np.ndarray]:
    """By resolution, rows whose inner products (ours with others) are upper bounds of those of x's rows.

    The last column adds more than rounding may take away.
    """
    out = {}
    with np.errstate(over="ignore", invalid="ignore"):
        slack = np.sqrt((x * x).sum(axis=1))[:, None] * (1e-9 if ours else 1)
        for s in levels(x.shape[1]):
            parts = np.array_split(x, s, axis=1)
            mean = [p.mean(axis=1, keepdims=True) * np.sqrt(p.shape[1]) for p in parts]
            dev = [p.std(axis=1, keepdims=True) * np.sqrt(p.shape[1]) for p in parts if p.shape[1] > 1]
            out[s] = np.concatenate([*mean, *dev, slack], axis=1)
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of q's rows with x's rows, row by row, held to the range of a long."""
    out = np.zeros(len(q), np.int64)
    with np.errstate(over="ignore"):
        safe = np.abs(q).max(axis=1, initial=0) * np.abs(x).max(axis=1, initial=0) * max(1, q.shape[1]) < 2**53
    out[safe] = np.einsum("ij,ij->i", q[safe], x[safe]).astype(np.int64)
    for k in np.flatnonzero(~safe):
        out[k] = max(-_MOST, min(_MOST, sum(int(a) * int(b) for a, b in zip(q[k].tolist(), x[k].tolist(), strict=True))))
    return out


class Best:
    """The k best (score, vec_id) of each of some queries so far, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.k = ids, rows, k
        self.of, self.scores, self.found = (np.zeros(0, np.int64) for _ in range(3))  # query's row, score, vec_id
        self.least = np.full(len(ids), -np.inf)
        self.pairs = self.exact = 0
        self._features: dict[int, dict] = {}

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Lets all queries meet some candidates. Vectors of different lengths meet in the components that both have."""
        d = min(self.rows.shape[1], rows.shape[1])
        if d not in self._features:
            self._features[d] = _features(self.rows[:, :d])
        rows = np.ascontiguousarray(rows[:, :d])
        theirs = _features(rows, ours=False)
        for a in range(0, len(self.ids), QUERIES):
            some = np.arange(a, min(a + QUERIES, len(self.ids)))
            alive = self.ids[some][:, None] != ids[None]
            self.pairs += int(alive.sum())
            mine = {s: f[some] for s, f in self._features[d].items()}
            fresh = np.flatnonzero(np.isinf(self.least[some]))
            if len(fresh) and theirs:
                self._seed(some, fresh, mine, theirs, alive, ids, rows)
            for s in theirs:
                if not np.isfinite(self.least[some]).any():
                    break
                if alive.mean() > DENSE:
                    alive &= self._above(mine[s] @ theirs[s].T, self.least[some][:, None])
                else:
                    q, c = np.nonzero(alive)
                    for b in range(0, len(q), 1 << 17):
                        x, y = q[b : b + (1 << 17)], c[b : b + (1 << 17)]
                        alive[x, y] = self._above(np.einsum("ij,ij->i", mine[s][x], theirs[s][y]), self.least[some][x])
            self._take(some, *np.nonzero(alive), ids, rows)

    @staticmethod
    def _above(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        return ~(bound + 1e-3 < least)  # a bound that is no number decides nothing

    def _seed(self, some: np.ndarray, fresh: np.ndarray, mine: dict, theirs: dict, alive: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s = max(theirs)
        bound = np.nan_to_num(mine[s][fresh] @ theirs[s].T, nan=np.inf)
        bound[~alive[fresh]] = -np.inf
        n = min(self.k, bound.shape[1])
        best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        q, c = np.repeat(fresh, n), best.ravel()
        good = alive[q, c]
        self._take(some, q[good], c[good], ids, rows)
        alive[q[good], c[good]] = False

    def _take(self, some: np.ndarray, q: np.ndarray, c: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Computes the exact scores of pairs and keeps the best."""
        self.exact += len(q)
        d = rows.shape[1]
        for a in range(0, len(q), 1 << 17):
            x, y = some[q[a : a + (1 << 17)]], c[a : a + (1 << 17)]
            scores = _exact(self.rows[x, :d], rows[y])
            good = scores >= self.least[x]
            self._add(x[good], scores[good], ids[y[good]])

    def _add(self, of: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        of, scores, found = (np.concatenate(p) for p in ((self.of, of), (self.scores, scores), (self.found, found)))
        order = np.lexsort((-scores, found, of))  # rows that repeat a vec_id count once, by the best of them
        of, scores, found = of[order], scores[order], found[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
        of, scores, found = of[first], scores[first], found[first]
        order = np.lexsort((found, -scores, of))
        of, scores, found = of[order], scores[order], found[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[of[last]] = np.nextafter(scores[last].astype(np.float64), -np.inf)
        self.of, self.scores, self.found = of[keep], scores[keep], found[keep]

    def frame(self) -> Iterator[pa.RecordBatch]:
        if len(self.of):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.of]), pa.array(self.found), pa.array(self.scores)], ["query_id", "vec_id", "score"])


def _packed(vectors: DataFrame, key: str) -> DataFrame:
    """Rows of key, dim, ids and rows (packed, PACK_BYTES about). vectors has key, vec_id and embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def packed(k: tuple) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(k), strict=True)
            values = ([k[0]], [k[1]], [np.concatenate(ids).tobytes()], [np.concatenate(rows).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [key, "dim", "ids", "rows"])

        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id").to_numpy()
            at, of = column.offsets.to_numpy(), batch.column(key).to_numpy()
            with np.errstate(over="ignore"):
                flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
            flat = np.clip(flat, -np.finfo(np.float64).max, np.finfo(np.float64).max)
            size = np.diff(at)
            pairs = np.stack([of, size], axis=1)
            for k in map(tuple, np.unique(pairs, axis=0).tolist()) if len(ids) else []:
                own = np.flatnonzero((pairs == k).all(axis=1))
                n = max(1, PACK_BYTES // (8 * max(1, k[1])))
                for a in range(0, len(own), n):
                    part = own[a : a + n]
                    rows = flat[at[part][:, None] + np.arange(k[1])] if k[1] else np.zeros((len(part), 0))
                    held.setdefault(k, []).append((ids[part], rows))
                    if sum(len(p[0]) for p in held[k]) >= n:
                        yield packed(k)
        for k in list(held):
            yield packed(k)

    return vectors.select(key, "vec_id", "embedding").mapInArrow(run, f"{key} long, dim int, ids binary, rows binary")


def _met(batches: Iterator[pa.RecordBatch], k: int, counted: tuple[Accumulator, Accumulator] | None) -> Iterator[pa.RecordBatch]:
    """The best of each cell (qb, cb), whose queries come first."""
    cell, best, waiting, asked = None, {}, {}, {}

    def unpack(dim: int, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, np.int64)
        return own, np.frombuffer(rows, np.float64).reshape(len(own), dim)

    def flush(dim: int) -> None:
        for d, parts in asked.items():  # all queries of the cell are known now
            best[d] = Best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
        asked.clear()
        ids, rows = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
        for b in best.values():
            for a in range(0, len(ids), CANDIDATES):
                b.meet(ids[a : a + CANDIDATES], rows[a : a + CANDIDATES])

    def end() -> Iterator[pa.RecordBatch]:
        for dim in list(waiting):
            flush(dim)
        for b in best.values():
            if counted:
                counted[0].add(b.pairs)
                counted[1].add(b.exact)
            yield from b.frame()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("qb", "cb", "kind", "dim", "ids", "rows")), strict=True):
            if row[:2] != cell:
                yield from end()
                cell, best, waiting, asked = row[:2], {}, {}, {}
            dim = row[3]
            if row[2] == 0:
                asked.setdefault(dim, []).append(unpack(*row[3:]))
            else:
                waiting.setdefault(dim, []).append(unpack(*row[3:]))
                if sum(len(p[0]) for p in waiting[dim]) >= CANDIDATES:
                    flush(dim)
    yield from end()


def search(vectors: DataFrame, is_query, k: int = 10, counted: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row of vectors (vec_id, embedding) with is_query.

    Vectors that are null, have a null vec_id, or hold null or non-finite components take no part. Vectors of different lengths
    meet in the components that both have; empty ones score 0. Scores beyond the range of a long are held to its ends. Of rows
    that repeat a vec_id the best score counts; none is a candidate of its own id. Ties go to the smaller vec_id. Fewer
    candidates than k give all; an empty table gives no rows. Other columns don't matter. counted adds up pairs and exact scores.
    """
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).filter(good)
    total, asked, dim = whole.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("embedding"))).first()
    most = max(1, min(GROUP, GROUP_BYTES // (8 * max(1, dim or 0))))
    across = max(1, -(-(asked or 0) // most))
    down = max(1, -(-(total or 0) // most), min(LANES, (total or 0) // LANE))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = _packed(whole.filter("asks").withColumn("qb", dealt(across, 1)), "qb").withColumn("cb", every(down)).withColumn("kind", F.lit(0))
    cands = _packed(whole.withColumn("cb", dealt(down, 2)), "cb").withColumn("qb", every(across)).withColumn("kind", F.lit(1))
    columns = ["qb", "cb", "kind", "dim", "ids", "rows"]
    cells = asks.select(columns).unionByName(cands.select(columns)).repartition(across * down, "qb", "cb").sortWithinPartitions("qb", "cb", "kind")
    found = cells.mapInArrow(lambda batches: _met(batches, k, counted), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
