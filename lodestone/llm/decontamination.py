"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Method.  Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased.  A first pass counts
in how many documents each word n-gram of the test items occurs.  In a second pass every place of a
document where an n-gram of an item stands opens a window around the item's diagonal, one for all
places of a document, item and range of diagonals; the best local alignment there (match 2, other -1,
gap -1) divided by twice the item's words is the score.  The n-grams in at most ``rare`` of the
documents are aligned at once.  A window of common n-grams alone is aligned if the item's words that
it holds could reach the threshold, which no alignment that reaches it fails.

Every n-gram is a seed: with a word put in after each two a copy scores 0.75 and keeps no three words,
so no subset of an item's n-grams can be shown to be enough, however common the others are.  A window
holds whatever an alignment of the threshold through its seed can span.  A copy that shares no n words
in a row with its item is not looked for.

Both passes are maps over whole texts.  The items' n-grams travel with the tasks, so items are taken
in blocks of at most ``block_bytes`` of text, or one text that is longer, wherever an id's texts are cut:
more items mean more passes, never a larger broadcast.  Only counts by n-gram, combined before, and
matches are shuffled.

Defined cases.  Null and empty texts and items match nothing.  An item of fewer than n words is one
seed of all its words.  A document and an item id, null ids included, have one row, of the best score
and then the last place over all texts of that id and all rows of that document; ``drop_matches``
judges each row by itself.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import ALNUM, U64, Hasher, chunks, mix, words
from lodestone.llm.shared import table


@dataclass(frozen=True)
class Settings:
    n: int = 3
    rare: float = 1e-3
    least_rare: int = 20
    threshold: float = 0.5
    block_bytes: int = 16 << 20


def hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, by = words(data, off, ALNUM)
    return (mix(Hasher(data).of(starts, ends)) if len(starts) else np.zeros(0, U64)), by


def grams(h: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n words from each word on; those that would cross texts are meaningless."""
    out = np.zeros(len(h), dtype=U64)
    for k in range(n):
        out[: len(h) - k] = out[: len(h) - k] * U64(0x9FB21C651E98DF25) + h[k:]
    return mix(out + U64(n))


class Items:
    """The items of a block with their n-grams; size is bounded by the block's text."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in rows]
        data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in rows])))
        h, by = hashes(data, off)
        self.words = [h[a:z] for a, z in zip(by[:-1], by[1:], strict=True)]
        keys, item, place, size = [], [], [], []
        for m in range(1, n + 1):
            g = grams(h, by, m)
            for i, (a, z) in enumerate(zip(by[:-1], by[1:], strict=True)):
                if m == min(n, z - a) and z > a:
                    keys.append(g[a : z - m + 1])
                    item.append(np.full(z - a - m + 1, i))
                    place.append(np.arange(z - a - m + 1))
                    size.append(np.full(z - a - m + 1, m))
        self.pad = np.array([len(w) // 4 + 4 for w in self.words], dtype=np.int64)
        none = np.zeros(0, np.int64)
        self.keys, self.item, self.place, self.size = (np.concatenate([*x, none.astype(t)]) for x, t in ((keys, U64), (item, int), (place, int), (size, int)))
        self.rare = np.ones(len(self.keys), dtype=bool)

    def arranged(self, rare: np.ndarray | None = None) -> None:
        order = np.argsort(self.keys, kind="stable")
        self.rare = self.rare if rare is None else rare[order]
        self.keys, self.item, self.place, self.size = self.keys[order], self.item[order], self.place[order], self.size[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray, by: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, word, first entry of the n-gram among the keys) of each hit."""
        for m in range(1, n + 1):
            if not len(h) or not (self.size == m).any():
                continue
            g = grams(h, by, m)
            near = np.flatnonzero(self.maybe[(g >> U64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, g[near]), len(self.keys) - 1)
            ok = (self.keys[k] == g[near]) & (self.size[k] == m)
            near, k = near[ok], k[ok]
            doc = np.searchsorted(by, near, side="right") - 1
            inside = near + m <= by[doc + 1]
            yield doc[inside], near[inside], k[inside]


def shared_words(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """At most so many of the item's words can match in each row of word hashes."""
    own, times = np.unique(item, return_counts=True)
    k = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    row, column = np.nonzero(own[k] == windows)
    seen = np.bincount(row * len(own) + k[row, column], minlength=len(windows) * len(own)).reshape(len(windows), len(own))
    return np.minimum(seen, times).sum(axis=1)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, its last column) of the item against each row of word hashes (0: outside)."""
    rows, width = windows.shape
    ramp = np.arange(width, dtype=np.int32)
    above = np.zeros((rows, width + 1), dtype=np.int32)
    best, where = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
    for w in item:
        cell = np.maximum(above[:, :-1] + np.where(windows == w, 2, -1).astype(np.int32), above[:, 1:] - 1)
        np.maximum(cell, 0, out=cell)
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        above[:, 1:] = cell
        top = cell.argmax(axis=1)
        value = cell[np.arange(rows), top]
        better = value > best
        best, where = np.where(better, value, best), np.where(better, top, where)
    return best, where


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of at most so many bytes of text at a time."""
    rows, size = [], 0
    for r in items.select("item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        n = len(r[1].encode())
        if rows and size + n > most:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


def matches(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, last_word: one row for each document and item that score the threshold."""
    out = None
    for rows in _blocks(items, settings.block_bytes):
        got = _block(documents, rows, settings)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, last_word long")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "last_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.last_word")


def _rare(documents: DataFrame, rows: list[tuple[int, str]], s: Settings) -> np.ndarray:
    """Which of the block's n-grams are rare, from their counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, s.n)
        items.arranged()
        seen, n = np.zeros(len(items.keys), dtype=np.int64), 0
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                h, by = hashes(data, off)
                for doc, _, k in items.look_up(h, by, s.n):
                    pairs = np.unique(doc * len(seen) + k)
                    seen += np.bincount(pairs % len(seen), minlength=len(seen))
                n += len(off) - 1
        hit = np.flatnonzero(seen)
        yield pa.record_batch({"key": pa.array(np.append(items.keys[hit], U64(0)).view(np.int64)), "df": pa.array(np.append(seen[hit], n))})

    df = {r[0]: r[1] for r in documents.select("text").mapInArrow(count, "key long, df long").groupBy("key").agg(F.sum("df")).collect()}
    total = df.pop(0, 0)
    items = Items(rows, s.n)
    counts = np.array([df.get(k, 0) for k in items.keys.view(np.int64).tolist()])
    return counts <= max(s.least_rare, s.rare * total)


def _block(documents: DataFrame, rows: list[tuple[int, str]], s: Settings) -> DataFrame:
    rare = _rare(documents, rows, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(rows, s.n)
        index.arranged(rare)
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                best = _aligned(index, *hashes(data, off), s)
                if best:
                    ids = b.column(0).slice(lo, hi - lo).to_pylist()
                    yield pa.record_batch({"doc_id": pa.array([ids[d] for d, _ in best], pa.int64()), "item_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([v[0] for v in best.values()], pa.float64()), "last_word": pa.array([v[1] for v in best.values()], pa.int64())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, last_word long")


def drop_matches(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents that match no item, with their columns; each row is judged by its own text."""
    columns = documents.columns
    at = columns.index("text")
    for rows in _blocks(items, settings.block_bytes):
        rare = _rare(documents, rows, settings)

        def keep(batches: Iterator[pa.RecordBatch], rows: list = rows, rare: np.ndarray = rare) -> Iterator[pa.RecordBatch]:
            index = Items(rows, settings.n)
            index.arranged(rare)
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                for lo, _, data, off in chunks(b.column(at)):
                    clean[[lo + d for d, _ in _aligned(index, *hashes(data, off), settings)]] = False
                yield b.filter(pa.array(clean))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents


def _aligned(index: Items, h: np.ndarray, by: np.ndarray, s: Settings) -> dict[tuple[int, int], tuple[float, int]]:
    """(document of the chunk, item id) to (score, last word) for what reaches the threshold."""
    parts = []
    for doc, at, k in index.look_up(h, by, s.n):
        last = np.searchsorted(index.keys, index.keys[k], side="right")
        n = last - k
        entry = np.repeat(k - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = index.item[entry]
        parts.append(np.stack((item, np.repeat(doc, n), (np.repeat(at, n) - index.place[entry]) // index.pad[item], ~index.rare[entry])))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    spots = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    spots = spots[:, np.lexsort(spots[::-1])]
    if not spots.shape[1]:
        return best
    spots = spots[:, np.concatenate(([True], (spots[:3, 1:] != spots[:3, :-1]).any(axis=0)))]
    cuts = np.flatnonzero(np.diff(spots[0])) + 1
    for a, z in zip([0, *cuts], [*cuts, spots.shape[1]], strict=True):
        i = int(spots[0, a])
        item, pad = index.words[i], int(index.pad[i])
        reach = math.ceil(2 * len(item) * (1 - s.threshold))  # more insertions than this cost too much
        width = len(item) + pad + 2 * reach
        step = max(1, min(256, (1 << 20) // width))
        for part in range(a, z, step):
            _, d, q, common = spots[:, part : min(z, part + step)]
            place = (q * pad - reach)[:, None] + np.arange(width)[None, :]
            inside = (place >= by[d][:, None]) & (place < by[d + 1][:, None])
            windows = np.where(inside, h[np.where(inside, place, 0)], U64(0))
            if common.any():
                ok = (common == 0) | (shared_words(item, windows) >= s.threshold * len(item))
                d, place, windows = d[ok], place[ok], windows[ok]
            if not len(d):
                continue
            value, end = align(item, windows)
            share = value / (2 * len(item))
            for k in np.flatnonzero(share >= s.threshold):
                key, now = (int(d[k]), index.ids[i]), (float(share[k]), int(place[k, end[k]] - by[d[k]]))
                best[key] = max(best.get(key, now), now)
    return best


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
