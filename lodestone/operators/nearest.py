"""Scores of a stated set of query vectors against every row, a block of rows at a time.

Tasks get blocks of rows and, broadcast, the block of queries as one row; scores are matrices there and not rows.  Sums
go over the components in order, so they are those of ``functions.vectors`` to the last bit."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType

SLICE, TILE, PART = 2048, 256, 100_000  # rows and queries of a matrix, rows of a partition
NEAR = 2e-9  # more than a step of the rounding and the error of a matrix product


def fits(queries: DataFrame, rows: DataFrame) -> bool:
    """Are ids whole numbers and vectors arrays of floating numbers?"""
    kinds = [queries.schema["qv"].dataType, rows.schema["vector"].dataType]
    return all(isinstance(k, ArrayType) and isinstance(k.elementType, FloatType | DoubleType) for k in kinds) and isinstance(rows.schema["piece"].dataType, LongType | IntegerType)


def blocks(queries: DataFrame, rows: DataFrame, most: int) -> list[DataFrame]:
    """Tables of (pieces, vectors, asked) for each block of at most about ``most`` queries(query, qv): a block of
    rows(piece, vector) beside the whole block of queries."""
    n = -(-queries.count() // most) or 1
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, b.column(c)) for c in ("piece", "vector")], ["pieces", "vectors"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("piece", "vector")]
    packed = rows.select("piece", "vector").repartition(parts).mapInArrow(pack, f"pieces array<{kinds[0]}>, vectors array<{kinds[1]}>")
    block = [queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b) if n > 1 else queries for b in range(n)]
    return [packed.crossJoin(F.broadcast(q.agg(F.collect_list(F.struct("query", "qv")).alias("asked")))) for q in block]  # one row


def items(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(pieces, their vectors, queries, their vectors) of each row of a table of blocks, at most SLICE pieces at a time."""
    cols = {c: batch.column(c) for c in ("pieces", "vectors", "asked")}
    for k in range(batch.num_rows):
        p, v, q = (cols[c][k].values for c in ("pieces", "vectors", "asked"))
        for at in range(0, len(p), SLICE):
            yield p.slice(at, SLICE), v.slice(at, SLICE), q.field("query"), q.field("qv")


def matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(components as doubles, length) of each vector; -1 is the length of one that is null or holds a null."""
    n = len(v)
    lengths = np.asarray(v.value_lengths().fill_null(-1), dtype=np.int64)
    flat = v.flatten()
    out = np.zeros((n, max(int(lengths.max(initial=0)), 0)))
    row = np.repeat(np.arange(n), np.maximum(lengths, 0))
    start = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out[row, np.arange(len(row)) - start[row]] = np.asarray(flat.fill_null(0), dtype=np.float64)
    if flat.null_count:
        lengths[row[np.asarray(flat.is_null())]] = -1
    return out, lengths


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products along the last axis, from the first component on; a and b may be of any shapes that agree."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for k in range(a.shape[-1]):
        out += a[..., k] * b[..., k]
    return out


def cosines(dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.where(norms == 0, 0.0, dot / np.where(norms == 0, 1.0, norms))


def unscored(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Which cosines are null: of vectors that are null or hold one, or whose lengths differ, neither zero."""
    return (np.minimum(a, b) < 0) | ((a != b) & (norms != 0))


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def places(x: np.ndarray, missing: np.ndarray, digits: int) -> np.ndarray:
    """Keys that order scores as Spark does once they are rounded half up: NaN above all, null below."""
    scaled = np.abs(x) * 10.0**digits
    up = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        up[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    key = np.clip(np.sign(x) * up, -1e300, 1e300)
    return np.where(missing, -np.inf, np.where(np.isnan(x), np.inf, key))


class Kept:
    """The k best pieces of each of n queries, among the rows that a task has seen; none below a query's floor can be one."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits, self.floor = k, digits, np.full(n, -np.inf)
        self.kept, self.new, self.waiting = None, [], 0

    def lift(self, score: np.ndarray, to: np.ndarray | None = None, error: float = 0.0) -> None:
        """Sets the floor of queries without one (or of those among ``to``) from scores of rows by queries, which may be
        off by ``error``."""
        to = np.arange(len(self.floor)) if to is None else to
        fresh = np.isneginf(self.floor[to])
        if fresh.any() and len(score) >= self.k:
            self.floor[to[fresh]] = np.partition(score[:, fresh], len(score) - self.k, axis=0)[len(score) - self.k] - NEAR - error

    def add(self, q: np.ndarray, pieces: pa.Array, rows: np.ndarray, score: np.ndarray, missing: np.ndarray) -> None:
        """Scores of queries and rows of pieces; those that are missing are null."""
        if not len(q):
            return
        near = pieces.take(pa.array(rows))
        self.whole = pa.types.is_integer(pieces.type)
        ids = np.asarray(near.fill_null(0), dtype=np.int64) if self.whole else np.asarray(near.fill_null(""), dtype=object)
        self.new.append([q, ids, np.asarray(near.is_valid()), score, missing, places(score, missing, self.digits)])
        self.waiting += len(q)
        if self.waiting >= len(self.floor) * self.k:  # as many as are kept, so sorting stays in proportion to what is new
            self.settle()

    def settle(self) -> None:
        """Takes what waits among what is kept, and raises the floors."""
        if not self.new:
            return
        every = [np.concatenate(x) for x in zip(*([] if self.kept is None else [self.kept]), *self.new, strict=True)]
        self.new, self.waiting = [], 0
        order = np.lexsort((every[1] if self.whole else np.unique(every[1], return_inverse=True)[1], every[2], -every[5], every[0]))
        every = [x[order] for x in every]
        place = np.arange(len(order)) - np.searchsorted(every[0], every[0])
        self.kept = [x[place < self.k] for x in every]
        last = place == self.k - 1
        at, low = every[0][last], every[5][last]
        finite = np.isfinite(low)
        self.floor[at[finite]] = np.maximum(self.floor[at[finite]], low[finite] * 10.0**-self.digits - NEAR)

    def batches(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """query, piece, score of what is kept; queries has their ids."""
        self.settle()
        q, ids, known, score, missing, _ = self.kept or [np.zeros(0, np.int64)] * 6
        for at in range(0, len(q), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[s])), pa.array(ids[s], kind, mask=~known[s]), pa.array(score[s], pa.float64(), mask=missing[s])], ["query", "piece", "score"])


class Best:
    """The same by the cosine of one block of query vectors, TILE of them at a time.

    A matrix product in single precision tells which pairs may be among the best; only these are scored."""

    def __init__(self, qv: pa.Array, k: int, digits: int):
        self.v, self.length = matrix(qv)
        self.norm = np.sqrt(dots(self.v, self.v))
        self.plain = self._plain(self.norm, self.length)
        self.unit = self._unit(self.v, self.norm, self.plain)
        self.error = (self.v.shape[1] + 4) * 2.0**-23  # twice the bound of a product of unit vectors in single precision
        self.tiles = [Kept(min(TILE, len(qv) - at), k, digits) for at in range(0, len(qv), TILE)]

    def _plain(self, norm: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Vectors whose scores a matrix product tells but for a small error."""
        return (length == self.v.shape[1]) & ((norm == 0) | ((norm > 1e-100) & (norm < 1e100)))

    def _unit(self, v: np.ndarray, norm: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Those of the plain vectors, each of length 1 unless it is 0."""
        return (v[plain] / np.where(norm[plain] > 0, norm[plain], 1.0)[:, None]).astype(np.float32)

    def meet(self, pieces: pa.Array, vectors: pa.Array) -> None:
        v, length = matrix(vectors)
        norm = np.sqrt(dots(v, v))
        plain = self._plain(norm, length)
        rows, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        v, own = widened(v, self.v)
        unit, begun = self._unit(v[:, : self.v.shape[1]], norm, plain), 0
        for at, kept in zip(range(0, len(own), TILE), self.tiles, strict=True):
            of = np.flatnonzero(self.plain[at : at + TILE])
            product = unit @ self.unit[begun : begun + len(of)].T
            begun += len(of)
            kept.lift(product, of, self.error)
            least = np.nextafter((kept.floor[of] - self.error).astype(np.float32), np.float32(-np.inf))
            near = np.flatnonzero(product >= least)
            i, q = rows[near // max(len(of), 1)], of[near % max(len(of), 1)]
            # what is not plain is always compared
            strange = np.flatnonzero(~self.plain[at : at + TILE])
            n = len(kept.floor)
            i = np.concatenate((i, np.repeat(odd, n), np.repeat(rows, len(strange))))
            q = np.concatenate((q, np.tile(np.arange(n), len(odd)), np.tile(strange, len(rows))))
            if len(i):
                score = np.concatenate([cosines(dots(v[i[s]], own[at + q[s]]), norm[i[s]] * self.norm[at + q[s]]) for s in (slice(a, a + 4096) for a in range(0, len(i), 4096))])
                kept.add(q, pieces, i, score, unscored(length[i], self.length[at + q], norm[i] * self.norm[at + q]))

    def batches(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at, kept in zip(range(0, len(queries), TILE), self.tiles, strict=True):
            yield from kept.batches(queries.slice(at, TILE), kind)


def best_cosines(table: DataFrame, query_type: str, k: int, digits: int) -> DataFrame:
    """query, piece, score of a table of blocks: of each partition, at least the k best of every query."""
    piece_type = table.schema["pieces"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = asked = None
        with np.errstate(all="ignore"):
            for batch in batches:
                for pieces, vectors, query, qv in items(batch):
                    if best is None:
                        best, asked, kind = Best(qv, k, digits), query, pieces.type
                    best.meet(pieces, vectors)
        if best is not None:
            yield from best.batches(asked, kind)

    return table.mapInArrow(run, f"query {query_type}, piece {piece_type}, score double")


def all_scores(table: DataFrame, query_type: str) -> DataFrame:
    """query, piece, dot, cosine, l2 of all pairs of a table of blocks, a few queries at a time."""
    piece_type = table.schema["pieces"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        with np.errstate(all="ignore"):
            for batch in batches:
                for pieces, vectors, query, qv in items(batch):
                    if last is None:
                        last = matrix(qv)
                    v, length = matrix(vectors)
                    v, asked = widened(v, last[0])
                    norm, norms = np.sqrt(dots(v, v)), np.sqrt(dots(asked, asked))
                    columns = np.ascontiguousarray(v.T)
                    for at in range(0, len(asked), 32):
                        q, n = asked[at : at + 32], len(asked[at : at + 32])
                        dot, square = np.zeros((n, len(v))), np.zeros((n, len(v)))
                        for d in range(len(columns)):
                            dot += q[:, d, None] * columns[d]
                            gap = columns[d] - q[:, d, None]
                            square += gap * gap
                        lengths, both = last[1][at : at + 32, None], norm * norms[at : at + 32, None]
                        differ = (length != lengths) | (length < 0)
                        found = [pa.array(x.ravel(), pa.float64(), mask=m.ravel()) for x, m in ((dot, differ), (cosines(dot, both), unscored(length, lengths, both)), (-np.sqrt(square), differ))]
                        one, two = np.repeat(np.arange(at, at + n), len(v)), np.tile(np.arange(len(v)), n)
                        yield pa.RecordBatch.from_arrays([query.take(pa.array(one)), pieces.take(pa.array(two)), *found], ["query", "piece", "dot", "cosine", "l2"])

    return table.mapInArrow(run, f"query {query_type}, piece {piece_type}, dot double, cosine double, l2 double")
