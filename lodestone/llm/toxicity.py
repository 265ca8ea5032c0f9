"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Method.  A text's features are the distinct character n-grams (code points, A-Z lower-cased) of the
configured orders, hashed to buckets.  From labelled training texts, each bucket gets the ratio
r = log(p / q) of its smoothed document counts in toxic and in clean texts, moved towards 0 by so many
of its standard errors; a logistic regression with a ridge is fitted on the presence of features
multiplied by r; a score is the regression's probability.  How many standard errors is chosen among
``levels`` by the log loss in inner folds of the training rows, the ratios of each being counted
without its own fold; rows of equal text are in one fold.  A bucket whose ratio is moved to 0 has no
weight, so there is no list of features to cut.

Bounds, all parameters: the classifier is fitted on at most ``max_train_rows`` labelled ids, taken
in order of a hash of the id, and as many rows of these; buckets are 2**bucket_bits.  Counting is
spread over tasks; only the buckets with a ratio, of the sampled rows, meet in the one fitting task.
Scoring reads every whole text, in a map with no shuffle, and sends each task the fixed-size model.

Defined cases.  A text too short for any n-gram, null and empty ones included, tells nothing: its score
is the smoothed share of toxic rows among those trained on, and ``reject_toxic`` keeps it.  Null labels and null ids of labels are not learned from; several labels of one id count as
the largest.  Repeated rows are scored alike, one result row per input row.  Without training rows of
both classes every score is that share.  ``score`` does not read extra columns; ``reject_toxic`` keeps
them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import U64, Hasher, chunks
from lodestone.llm.elias_fano import from_planes, planes
from lodestone.llm.shared import discard, fold_of, stored, table


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bucket_bits: int = 20
    max_train_rows: int = 6_000
    alpha: float = 1.0
    levels: tuple[float, ...] = (2.0, 3.0)
    folds: int = 3
    ridge: float = 0.1
    steps: int = 60


@dataclass(frozen=True)
class Model:
    orders: tuple[int, ...]
    bucket_bits: int
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    base: float  # the log odds of a text without n-grams


def hashed(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each n-gram, its bucket) for each order; n-grams do not cross texts."""
    hasher = Hasher(data)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.append(chars, len(data))
    last = np.repeat(off[1:], np.diff(np.searchsorted(chars, off)))
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(np.searchsorted(chars, off)))
    for n in orders:
        if len(chars) < n:
            continue
        starts, ends = edges[: len(edges) - n], edges[n:]
        ok = ends <= last[: len(starts)]
        h = hasher.of(starts, ends) * U64(0x9E3779B97F4A7C15) + U64(n * 0x632BE59BD9B4E019 % (1 << 64))
        yield row[: len(starts)][ok], (h >> U64(64 - bits)).astype(np.int64)[ok]


def present(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...], bits: int, slots: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs in order; a feature is a bucket, or its slot if slots are given."""
    keys = []
    for row, bucket in hashed(data, off, orders, bits):
        f = bucket if slots is None else slots[bucket]
        if slots is not None:
            row, f = row[hit := f >= 0], f[hit]
        keys.append(row.astype(np.int64) * width + f)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key // width, key % width


def _slots(buckets: np.ndarray, bits: int) -> np.ndarray:
    slots = np.full(1 << bits, -1, dtype=np.int64)
    slots[buckets] = np.arange(len(buckets))
    return slots


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, level: float, alpha: float) -> np.ndarray:
    """Log-count ratios of document counts, moved towards 0 by so many standard errors."""
    ratio = np.log((toxic + alpha) / (n_toxic + 2 * alpha)) - np.log((clean + alpha) / (n_clean + 2 * alpha))
    error = np.sqrt(np.maximum(1 / (toxic + alpha) - 1 / (n_toxic + 2 * alpha) + 1 / (clean + alpha) - 1 / (n_clean + 2 * alpha), 0))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - level * error, 0)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from documents(doc_id, text) and labels(doc_id, toxic); labels that are null are skipped."""
    s, width = settings, 1 << settings.bucket_bits
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train_rows)  # bounded, so it may be broadcast
    fold = F.pmod(F.xxhash64("text"), F.lit(s.folds)).cast("int")
    train = labelled = stored(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")), "labelled")
    # ids that repeat make no more rows than the bound
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(s.max_train_rows).select("text", "toxic", "fold") if _repeats(train) else train.select("text", "toxic", "fold")
    parts, cells = 16, 2 * s.folds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((cells, width), dtype=np.int32), np.zeros(cells, dtype=np.int64)
        for b in batches:
            cell = b.column(1).to_numpy(zero_copy_only=False) * s.folds + b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in chunks(b.column(0), 1 << 18):
                rows += np.bincount(cell[lo:hi], minlength=cells)
                row, bucket = present(data, off, s.orders, s.bucket_bits, None, width)
                own = cell[lo:hi][row]
                for c in np.unique(own).tolist():
                    seen[c] += np.bincount(bucket[own == c], minlength=width).astype(np.int32)
        if rows.sum():
            for p, block in enumerate(np.split(seen, parts, axis=1)):
                yield pa.record_batch({"part": [p], "seen": [planes(block.ravel())], "rows": pa.array([rows.tolist()], pa.list_(pa.int64()))})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                now = [from_planes(r["seen"]).astype(np.int64).reshape(cells, -1), np.array(r["rows"])]
                sums[r["part"]] = [x + y for x, y in zip(sums[r["part"]], now, strict=True)] if r["part"] in sums else now
        for p, (seen, rows) in sums.items():
            held = np.zeros(seen.shape[1], dtype=bool)
            for _, clean, toxic, n_clean, n_toxic in _without(seen, rows, s.folds):
                held |= ratios(clean, toxic, n_clean, n_toxic, min(s.levels), s.alpha) != 0
            own = np.flatnonzero(held)
            yield pa.record_batch({"bucket": pa.array(own + p * (width // parts), pa.int64()), "seen": pa.array(seen[:, own].T.tolist(), pa.list_(pa.int64())), "rows": pa.array([rows.tolist()] * len(own), pa.list_(pa.int64()))})

    counted = train.mapInArrow(count, "part long, seen binary, rows array<long>")
    # at most a row for each bucket
    chosen = counted.repartition(parts, "part").mapInArrow(choose, "bucket long, seen array<long>, rows array<long>").toPandas().sort_values("bucket")
    buckets = chosen["bucket"].to_numpy(np.int64)
    seen = np.array(chosen["seen"].tolist(), dtype=np.int64).T.reshape(cells, len(buckets))
    rows = np.array(chosen["rows"].iloc[0], dtype=np.int64) if len(buckets) else np.zeros(cells, np.int64)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots(buckets, s.bucket_bits)
        for b in batches:
            for lo, hi, data, off in chunks(b.column(0), 1 << 18):
                row, slot = present(data, off, s.orders, s.bucket_bits, slots, max(1, len(buckets)))
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                blobs = [slot[a:z].astype("<i4").tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch({"toxic": b.column(1).slice(lo, hi - lo), "fold": b.column(2).slice(lo, hi - lo), "slots": pa.array(blobs, pa.binary())})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, fold, cols = [], [], []
        for b in batches:
            y += b.column(0).to_pylist()
            fold += b.column(1).to_pylist()
            cols += [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
        weights, intercept = chosen_fit(np.array(y, dtype=np.float64), np.array(fold), cols, seen, rows, s)
        yield pa.record_batch({"weights": [weights.tolist()], "intercept": [intercept]}, schema=pa.schema([("weights", pa.list_(pa.float64())), ("intercept", pa.float64())]))

    got = train.mapInArrow(rows_of, "toxic int, fold int, slots binary").repartition(1).mapInArrow(solve, "weights array<double>, intercept double").first()
    discard(labelled)
    weights, intercept = (np.array(got[0], dtype=np.float64), got[1]) if got else (np.zeros(len(buckets)), 0.0)
    used, clean, toxic = np.flatnonzero(weights), rows[: s.folds].sum(), rows[s.folds :].sum()
    return Model(s.orders, s.bucket_bits, buckets[used], weights[used], intercept, float(np.log((toxic + 1) / (clean + 1))))


def _repeats(train: DataFrame) -> bool:
    return bool(train.groupBy("doc_id").count().where("count > 1").head(1))


def _without(seen: np.ndarray, rows: np.ndarray, folds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(fold, or -1: none, left out; clean and toxic counts by feature; clean and toxic rows)."""
    for k in range(-1, folds):
        clean, toxic = ([c * folds + j for j in range(folds) if j != k] for c in (0, 1))
        yield k, seen[clean].sum(axis=0), seen[toxic].sum(axis=0), int(rows[clean].sum()), int(rows[toxic].sum())


def chosen_fit(y: np.ndarray, fold: np.ndarray, cols: list[np.ndarray], seen: np.ndarray, rows: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) at the level of least log loss in the inner folds."""
    if not 0 < y.sum() < len(y):
        return np.zeros(seen.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    row, col = np.repeat(np.arange(len(y)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64)
    loss = dict.fromkeys(s.levels, 0.0)
    for k, *counts in _without(seen, rows, s.folds):
        out = fold == k
        if k < 0 or not out.any() or not 0 < y[~out].sum() < (~out).sum():
            continue
        for level in s.levels:
            scale = ratios(*counts, level, s.alpha)
            w, b = logistic(row, col, scale, y, ~out, s)
            margin = np.bincount(row, weights=(w * scale)[col], minlength=len(y))[out] + b
            loss[level] += float(np.logaddexp(0, np.where(y[out] > 0, -margin, margin)).sum())
    level = min(s.levels, key=lambda x: (loss[x], -x))
    scale = ratios(*next(_without(seen, rows, s.folds))[1:], level, s.alpha)
    w, b = logistic(row, col, scale, y, np.ones(len(y), dtype=bool), s)
    return w * scale, b


def logistic(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, use: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presence times scale, by Adam on the rows in use."""
    keep = use[row] & (scale[col] != 0)
    row, col, k, n = row[keep], col[keep], len(scale), int(use.sum())
    b = float(np.log((y[use].sum() + 1) / (n - y[use].sum() + 1)))
    w = np.append(np.zeros(k), b)
    m, v, value = np.zeros(k + 1), np.zeros(k + 1), scale[col]
    for t in range(1, s.steps + 1):
        margin = np.bincount(row, weights=w[col] * value, minlength=len(y)) + w[k]
        error = np.where(use, 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y, 0.0)
        g = np.append(np.bincount(col, weights=error[row] * value, minlength=k) + s.ridge * w[:k], error.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:k], float(w[k])


def probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score of each text, whether it has n-grams at all)."""
    slots = _slots(model.buckets, model.bucket_bits)
    margin, known = np.full(len(texts), model.base), np.zeros(len(texts), dtype=bool)
    for lo, hi, data, off in chunks(texts, 1 << 18):
        row, slot = present(data, off, model.orders, model.bucket_bits, slots, max(1, len(model.buckets)))
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        known[lo:hi] = np.diff(np.searchsorted(chars, off)) >= min(model.orders)
        found = np.bincount(row, weights=model.weights[slot], minlength=hi - lo) if len(row) else 0.0
        margin[lo:hi] = np.where(known[lo:hi], found + model.intercept, model.base)
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500))), known


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(probabilities(model, b.column(1))[0])})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents whose score is below the threshold, or that tell nothing, with their columns.

    The model is fitted first; rows are then judged in one map over whole texts, with no join."""
    model = fit(documents, labels.where(fold_of(F.col("doc_id"), 5) != 0), settings)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, known = probabilities(model, b.column(at))
            yield b.filter(pa.array((score < threshold) | ~known))

    return documents.mapInArrow(keep, documents.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    scored = score(documents, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
