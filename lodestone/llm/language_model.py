"""LM scoring with an Elias-Fano n-gram trie.

Method.  A pass over the training texts for each level builds the trie as files in the shared folder.
Level 1 holds the words, sorted by hash, and their counts; a word's id is its place.  Level m holds
the n-grams of m words by context, a node of level m - 1; a node's id is its place over all shards.
Monotone pointers give a context's range.  Its successors are word ids at level 2; from level 3 on they
are ids relative to the context: the word's place among the successors that the context without its
first word has a level below.  Each range goes on from the last value of the one before, which makes
the successors an Elias-Fano sequence.  Next to it are 8-bit quantised smoothed log10 probabilities
p(w | u v) = (c(u v w) + mu p(w | v)) / (c(u v) + mu), p(w) = (c(w) + 1) / (N + V + 1), with the
quantised p of the level below, and below the last level the nodes' counts.
An n-gram that is not there is scored by the same formula with a count of 0.  A text's first context
is the end token; no context reaches back before it, so first tokens have one word of context.
Scoring maps whole texts; its tasks map the levels into memory, take the range of each of a chunk's
contexts from the pointers and search the successors in it.

Counts are combined in each task, then shuffled as packed ranges of keys; both grow with the corpus
and nothing is pruned.  A context with a large share of the tokens is split by successor over
several ranges.  The driver sees one row of totals a range.

Defined cases.  Null texts are empty: they have the end token only.  A null id counts as the empty
text for the training split.  Without training texts N and V are 0 and every token has p = 1.
Repeated rows are learned from and scored each time.  Words are hashed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import U64, WHITE, Hasher, chunks, mix, words
from lodestone.llm.elias_fano import Sequence, encode, from_planes, map_arrays, planes, write_arrays
from lodestone.llm.shared import fold_of, new_path, table

END = 0x454E44
STEP = 0.05  # log10 a quantum; 255 of them reach 10**-12.75
CHUNK = 2 << 20  # a chunk visits every shard
_open: dict[str, dict] = {}


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and of an end for each text, token offsets by text)."""
    starts, ends, by = words(data, off, WHITE)
    by_token = by + np.arange(len(by))
    out = np.full(by_token[-1], END, dtype=U64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(by) - 1), np.diff(by))] = mix(Hasher(data).of(starts, ends)) if len(starts) else 0
    return out, by_token


class Counter:
    """Counts of 64-bit keys in bounded steps."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > 4_000_000 and len(self.parts) > 16:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts by range; cuts are the ranges' first keys."""
    at = np.append(np.searchsorted(keys, cuts), len(keys))
    for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if z > a:
            yield pa.record_batch({"shard": [k], "keys": pa.array([planes(np.diff(keys[a:z], prepend=U64(0)))], pa.binary()), "counts": pa.array([planes(counts[a:z])], pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    by: dict[int, Counter] = {}
    for b in batches:
        for r in b.to_pylist():
            by.setdefault(r["shard"], Counter()).add(np.cumsum(from_planes(r["keys"]), dtype=U64), from_planes(r["counts"]))
    for k in sorted(by):
        yield k, *by.pop(k).total()


@dataclass(frozen=True)
class Level:
    """cuts: the first key of each shard; a key is context * width + relative id.  base: the first node id of each shard, and their number."""

    cuts: tuple[int, ...]
    base: tuple[int, ...]
    width: int


@dataclass(frozen=True)
class Model:
    """Where the levels are, and their totals.  first_id has a place for each shard of level 1, levels are those from 2 on."""

    path: str
    first_id: tuple[int, ...]
    levels: tuple[Level, ...]
    total: int
    distinct: int
    mu: float

    def level1(self, k: int) -> dict:
        key = f"{self.path}/words-{k}"
        if key not in _open:
            _open[key] = map_arrays(self.path, f"words-{k}")
        return _open[key]

    def shard(self, m: int, k: int) -> dict:
        key = f"{self.path}/nodes{m}-{k}"
        if key not in _open:
            a = map_arrays(self.path, f"nodes{m}-{k}")
            part = lambda name: Sequence({x.partition(".")[2]: v for x, v in a.items() if x.startswith(name)})
            _open[key] = {"pointers": part("pointers."), "successors": part("successors."), "code": a["code"], "count": a.get("count"), "first": int(a["first"][0])}
        return _open[key]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of each word or -1, its count)."""
        want, inverse = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(want), -1, dtype=np.int64), np.zeros(len(want), dtype=np.int64)
        shards = len(self.first_id)
        ends = np.searchsorted(want, _cuts(shards)[1:]) if shards else []
        for k, (a, z) in enumerate(zip([0, *ends], [*ends, len(want)], strict=True) if shards else []):
            if z > a and self.first_id[k] >= 0:
                level = self.level1(k)
                at = np.minimum(np.searchsorted(level["hash"], want[a:z]), len(level["hash"]) - 1)
                same = level["hash"][at] == want[a:z]
                ids[a:z] = np.where(same, at + self.first_id[k], -1)
                counts[a:z] = np.where(same, level["count"][at], 0)
        return ids[inverse], counts[inverse]

    def nodes(self, m: int, context: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, its quantised probability, its count or 0 at the last level) of contexts and relative ids."""
        level = self.levels[m - 2]
        want, inverse = np.unique(context.astype(U64) * U64(level.width) + relative.astype(U64), return_inverse=True)
        out, code, count = np.full(len(want), -1, dtype=np.int64), np.zeros(len(want), dtype=np.uint8), np.zeros(len(want), dtype=np.int64)
        at = np.append(np.searchsorted(want, np.array(level.cuts, dtype=U64)), len(want))
        for k in np.flatnonzero((np.diff(at) > 0) & (np.diff(level.base) > 0)).tolist():
            shard = self.shard(m, k)
            x = want[at[k] : at[k + 1]]
            c, r = (x // U64(level.width)).astype(np.int64) - shard["first"], x % U64(level.width)
            inside = np.flatnonzero((c >= 0) & (c < shard["pointers"].n - 1))
            if not len(inside):
                continue
            c, r = c[inside], r[inside]
            head = np.concatenate(([True], c[1:] != c[:-1]))
            run = np.cumsum(head) - 1
            low, high, before = _range(shard, c[head])
            place = shard["successors"].find(before[run] + r, low[run], high[run])
            hit = np.flatnonzero(place >= 0)
            to = at[k] + inside[hit]
            out[to], code[to] = level.base[k] + place[hit], shard["code"][place[hit]]
            if shard["count"] is not None:
                count[to] = shard["count"][place[hit]]
        return out[inverse], code[inverse], count[inverse]

    def starts(self, m: int, context: np.ndarray) -> np.ndarray:
        """The first node of level m whose context is not below the given one."""
        level = self.levels[m - 2]
        want, inverse = np.unique(context, return_inverse=True)
        out = np.zeros(len(want), dtype=np.int64)
        shard_of = np.searchsorted(np.array(level.cuts, dtype=U64), want.astype(U64) * U64(level.width), side="right") - 1
        for k, a, z in _runs(shard_of):
            out[a:z] = level.base[k]
            if level.base[k + 1] > level.base[k]:
                shard = self.shard(m, k)
                out[a:z] += shard["pointers"].access(np.clip(want[a:z] - shard["first"], 0, shard["pointers"].n - 1)).astype(np.int64)
        return out[inverse]

    def of(self, m: int, node: np.ndarray, name: str) -> np.ndarray:
        """The codes or counts of nodes."""
        level = self.levels[m - 2]
        want, inverse = np.unique(node, return_inverse=True)
        out = np.zeros(len(want), dtype=np.int64)
        for k, a, z in _runs(np.searchsorted(level.base, want, side="right") - 1):
            out[a:z] = self.shard(m, k)[name][want[a:z] - level.base[k]]
        return out[inverse]

    def suffix(self, m: int, node: np.ndarray) -> np.ndarray:
        """The node of level m - 1, or word, that is left without the first word; nodes ascend."""
        level = self.levels[m - 2]
        context, relative = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
        for k, a, z in _runs(np.searchsorted(level.base, node, side="right") - 1):
            shard, place = self.shard(m, k), node[a:z] - level.base[k]
            pointers = shard["pointers"].access(np.arange(shard["pointers"].n)).astype(np.int64)
            c = np.searchsorted(pointers, place, side="right") - 1
            _, _, before = _range(shard, c)
            context[a:z], relative[a:z] = c + shard["first"], (shard["successors"].access(place) - before).astype(np.int64)
        if m == 2:
            return relative
        own, inverse = np.unique(context, return_inverse=True)
        return self.starts(m - 1, self.suffix(m - 1, own))[inverse] + relative


def _range(shard: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, value before) of each context's successors in the shard."""
    low, high = (shard["pointers"].access(context + j).astype(np.int64) for j in (0, 1))
    return low, high, np.where(low > 0, shard["successors"].access(np.maximum(low - 1, 0)), U64(0))


def _runs(k: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run."""
    at = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z > a:
            yield int(k[a]), a, z


def _cuts(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(shards)], dtype=U64)


def train(texts: DataFrame, mu: float = 4.0, hot: int = 16, order: int = 2) -> Model:
    """Learns n-grams of up to ``order`` words from texts(text)."""
    spark = texts.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_path(spark, "trie")
    schema = "shard long, keys binary, counts binary"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for _, _, data, off in chunks(b.column(0), CHUNK):
                counter.add(tokens(data, off)[0])
        yield from _packed(*counter.total(), _cuts(shards))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, counts in _merged(batches):
            write_arrays(path, f"words-{k}", {"hash": keys, "count": counts})
            top = np.argsort(-counts, kind="stable")[:hot]
            yield pa.record_batch({"shard": [k], "n": [len(keys)], "total": [int(counts.sum())], "place": pa.array([top.tolist()], pa.list_(pa.int64())), "count": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    made = texts.select("text").mapInArrow(count_words, schema).repartition(shards, "shard").mapInArrow(write_words, "shard long, n long, total long, place array<long>, count array<long>").collect()
    first, at = [-1] * shards, 0
    for r in sorted(made, key=lambda r: r["shard"]):
        first[r["shard"]] = at
        at += r["n"]
    total, distinct = sum(r["total"] for r in made), at
    model = Model(path, tuple(first), (), total, distinct, mu)
    parents, width = distinct, distinct
    common = [(first[r["shard"]] + p, c) for r in made for p, c in zip(r["place"], r["count"], strict=True)]
    for m in range(2, order + 1):
        if parents:
            model, common, longest = _next_level(texts, model, shards, m == order, parents, width, common, hot)
            parents, width = model.levels[-1].base[-1], longest
    return model


def _next_level(texts: DataFrame, model: Model, shards: int, last: bool, parents: int, width: int, common: list[tuple[int, int]], hot: int) -> tuple[Model, list[tuple[int, int]], int]:
    """(the model with one more level, its commonest nodes with counts, the successors of the context that has most)."""
    m, total, mu = len(model.levels) + 2, model.total, model.mu
    # ranges of contexts of one width, and contexts with more than their share split by successor
    found = {k * parents // shards * width for k in range(shards)} | {0}
    for context, c in common:
        if c * shards * 4 > total:
            pieces = max(2, min(shards, c * shards * 4 // max(1, total)))
            found |= {context * width + j * width // pieces for j in range(pieces)} | {(context + 1) * width}
    cuts = tuple(sorted(found))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for _, _, data, off in chunks(b.column(0), CHUNK):
                hashes, by = tokens(data, off)
                _, context, relative = _walk(model, model.ids(hashes)[0], by, True)
                known = np.flatnonzero((context >= 0) & (relative >= 0))
                counter.add(context[known].astype(U64) * U64(width) + relative[known].astype(U64))
        yield from _packed(*counter.total(), np.array(cuts, dtype=U64))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, counts in _merged(batches):
            context, relative = (keys // U64(width)).astype(np.int64), (keys % U64(width)).astype(np.int64)
            low, high = int(context[0]), int(context[-1])
            own, run = np.unique(context, return_inverse=True)
            if m == 2:
                seen = _counts(model, own)
                below = (_counts(model, relative) + 1) / (total + model.distinct + 1)
            else:
                seen = model.of(m - 1, own, "count")
                below = 10.0 ** (-STEP * model.of(m - 1, model.starts(m - 1, model.suffix(m - 1, own))[run] + relative, "code"))
            p = (counts + mu * below) / (seen[run] + mu)
            starts = np.searchsorted(context, np.arange(low, high + 2))
            ends = np.searchsorted(context, own, side="right")
            values = relative + np.concatenate(([0], np.cumsum(relative[ends - 1])[:-1]))[run]
            arrays = {"first": np.array([low]), "code": np.minimum(np.round(-np.log10(p) / STEP), 255).astype(np.uint8)}
            if not last:
                arrays["count"] = counts.astype(np.min_scalar_type(int(counts.max())))
            arrays |= {f"pointers.{x}": v for x, v in encode(starts, len(keys) + 1).items()}
            arrays |= {f"successors.{x}": v for x, v in encode(values, int(values[-1]) + 1).items()}
            write_arrays(model.path, f"nodes{m}-{k}", arrays)
            top = np.argsort(-counts, kind="stable")[:hot]
            sizes = np.diff(starts)
            yield pa.record_batch({
                "shard": [k], "n": [len(keys)], "place": pa.array([top.tolist()], pa.list_(pa.int64())), "count": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
                "longest": [int(sizes.max())], "low": [low], "n_low": [int(sizes[0])], "high": [high], "n_high": [int(sizes[-1])],
            })

    made = texts.select("text").mapInArrow(count, "shard long, keys binary, counts binary").repartition(max(shards, min(len(cuts), 4 * shards)), "shard")
    made = made.mapInArrow(write, "shard long, n long, place array<long>, count array<long>, longest long, low long, n_low long, high long, n_high long").collect()
    sizes, split = [0] * len(cuts), {}
    for r in made:
        sizes[r["shard"]] = r["n"]
        for context, n in {(r["low"], r["n_low"]), (r["high"], r["n_high"])}:
            split[context] = split.get(context, 0) + n
    base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tolist()
    common = [(base[r["shard"]] + p, c) for r in made for p, c in zip(r["place"], r["count"], strict=True)]
    longest = max([1, *split.values(), *(r["longest"] for r in made)])
    return Model(model.path, model.first_id, (*model.levels, Level(cuts, tuple(base), width)), total, model.distinct, mu), common, longest


def _walk(model: Model, ids: np.ndarray, by: np.ndarray, further: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(node, code and count of each token for each level from 2 on; if further, context and relative id of each token for the next level), -1: none."""
    out, context, relative = [], _contexts(ids, by, model), ids
    for m in range(2, len(model.levels) + 2):
        node, code, count = np.full(len(ids), -1, dtype=np.int64), np.zeros(len(ids), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
        known = np.flatnonzero((context >= 0) & (relative >= 0))
        if len(known):
            node[known], code[known], count[known] = model.nodes(m, context[known], relative[known])
        out.append((node, code, count))
        if further or m < len(model.levels) + 1:
            known = np.flatnonzero(node >= 0)
            relative = np.full(len(ids), -1, dtype=np.int64)
            relative[known] = node[known] - model.starts(m, context[known])
            context = _before(node, by, -1)
    return out, context, relative


def _before(values: np.ndarray, by: np.ndarray, first: int) -> np.ndarray:
    """The value of the token before each token in its text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[by[:-1]] = first
    return out


def _counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts by id."""
    want, inverse = np.unique(ids, return_inverse=True)
    out = np.zeros(len(want))
    held = [k for k, f in enumerate(model.first_id) if f >= 0]
    starts = np.array([model.first_id[k] for k in held])
    at = np.append(np.searchsorted(want, starts), len(want))
    for j, k in enumerate(held):
        a, z = at[j], at[j + 1]
        if z > a:
            out[a:z] = model.level1(k)["count"][want[a:z] - model.first_id[k]]
    return out[inverse]


def _contexts(ids: np.ndarray, by: np.ndarray, model: Model) -> np.ndarray:
    """The id before each token in its text; the end token's before the first."""
    return _before(ids, by, model.ids(np.array([END], dtype=U64))[0][0])


def score(documents: DataFrame, model: Model, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the kept boolean columns, n_tokens, n_known, base_score, score of documents(doc_id, text)."""
    names = [documents.select(c).columns[0] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = model.total + model.distinct + 1
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1), CHUNK):
                hashes, by = tokens(data, off)
                ids, counts = model.ids(hashes)
                p1 = np.log10((counts + 1) / whole)
                seen = _before(counts, by, model.ids(np.array([END], dtype=U64))[1][0])
                p = p1 + np.log10(model.mu / (seen + model.mu))
                for m, (node, code, count) in enumerate(_walk(model, ids, by, False)[0], 2):
                    if m > 2:
                        p += np.log10(model.mu / (seen + model.mu))
                    p = np.where(node >= 0, -STEP * code, p)
                    seen = _before(count, by, 0)
                sums = lambda x: np.add.reduceat(x, by[:-1])
                out = {"doc_id": b.column(0).slice(lo, hi - lo)} | {c: b.column(2 + j).slice(lo, hi - lo) for j, c in enumerate(names)}
                yield pa.record_batch(out | {"n_tokens": pa.array(np.diff(by)), "n_known": pa.array(sums((counts > 0).astype(np.int64))), "base_score": pa.array(sums(p1)), "score": pa.array(sums(p))})

    schema = "doc_id long, " + "".join(f"{c} boolean, " for c in names) + "n_tokens long, n_known long, base_score double, score double"
    return documents.select("doc_id", "text", *keep).mapInArrow(run, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 7) == 2
    model = train(documents.where(~held), order=3)
    got = score(documents, model, (held.alias("held_out"),))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

