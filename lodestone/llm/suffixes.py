"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

Method.  A rolling hash of ``trigger`` bytes cuts every text into phrases: a trigger is the leftmost
smallest hash of some ``length``-byte string, so every string of that length holds exactly one
trigger that it selects, and equal strings select it at the same offset.  Only triggers whose bytes
occur at least twice in the corpus can belong to a repeated string; for these the parse is dealt out
by trigger with the bytes that its strings cover.  There the dictionary's two suffix arrays - of
what follows the trigger and, reversed, of what precedes it - are built with their LCP arrays; a
string with o bytes before its trigger is repeated if another row has the same rank group at LCP o
on the left and at LCP length - o on the right.  So the two arrays together give corpus order of all
strings, compared byte by byte (but for hot triggers, below), while text that occurs once is never sorted.

Bounds.  Equal rows of a chunk are sent once; equal texts are counted apart (each byte of a text of
at least ``length`` bytes that occurs twice is removed) and a task sends a text once.  Triggers with
more than ``hot`` occurrences, at most ``hot_keys`` of them, leave the suffix order: their strings are
dealt out one by one by two independent 64-bit hashes, which stand for the bytes there, so no task
holds a hot trigger.  The test of triggers is a bitmap of fixed
size; where it errs, rows are sent that find no partner.

Defined cases.  A null text is the empty one.  Texts shorter than the length lose nothing.  Equal
texts, ids that repeat and null ids are rows of their own; a text that occurs twice is removed in
both.  Strings may overlap themselves.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import PLAIN, U64, Hasher, chunks, mix
from lodestone.llm.elias_fano import from_planes, planes
from lodestone.llm.shared import stored, table


@dataclass(frozen=True)
class Settings:
    length: int = 200
    trigger: int = 40
    bitmap_bits: int = 26
    hot: int = 20_000
    hot_keys: int = 4096
    rows: int = 32_768


class Parse:
    """The triggers of a chunk: key, place, and the first and last start of the strings that select it."""

    def __init__(self, data: np.ndarray, off: np.ndarray, s: Settings):
        self.hasher = Hasher(data, PLAIN)
        n, k, span = len(data), s.trigger, s.length - s.trigger + 1
        self.key, self.place, self.low, self.high, self.doc = (np.zeros(0, t) for t in (U64, int, int, int, int))
        if n < s.length:
            return
        h = mix(self.hasher.of(np.arange(n - k + 1), np.arange(k, n + 1)))
        best = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        sizes = np.diff(off)
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
        starts = np.flatnonzero(np.arange(len(best)) + s.length <= off[1:][doc])
        if not len(starts):
            return
        at = (best[starts] & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[starts[1:]] != doc[starts[:-1]]))))
        self.place, self.low, self.doc = at[first], starts[first], doc[starts[first]]
        self.high = starts[np.append(first[1:], len(starts)) - 1]
        self.key = h[self.place]


def _name() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("name")


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Fixed-size bitmap of a long column ``key``; the driver sees at most 2**(bits - 6) words."""
    got = keys.selectExpr(f"pmod(key, {1 << bits}) as bit").groupBy(F.expr("shiftright(bit, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out


def _in(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key % (len(bitmap) * 64)
    return (bitmap[bit >> 6] >> (bit & 63)) & 1 == 1


def repeated_triggers(texts: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the triggers that occur twice, the hottest keys) over texts(name, text)."""
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = U64((1 << 64) // parts + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = []
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                keys.append(Parse(data, off, s).key)
        key, n = np.unique(np.concatenate([*keys, np.zeros(0, U64)]), return_counts=True)
        cuts = np.searchsorted(key // width, np.arange(parts + 1).astype(U64))
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                yield pa.record_batch({"part": [k], "key": [planes(np.diff(key[a:z], prepend=U64(0)))], "n": [planes(n[a:z])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                by.setdefault(r["part"], []).append((np.cumsum(from_planes(r["key"]), dtype=U64), from_planes(r["n"])))
        for found in by.values():
            key, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            total = np.add.reduceat(n, first)
            twice = total > 1
            yield pa.record_batch({"key": pa.array(key[first][twice].view(np.int64)), "n": pa.array(total[twice])})

    found = stored(texts.select("text").mapInArrow(run, "part long, key binary, n binary").repartition(parts, "part").mapInArrow(merge, "key long, n long"), "triggers")
    hot = found.where(F.col("n") > s.hot).orderBy(F.desc("n"), "key").limit(s.hot_keys).toPandas()["key"].to_numpy(np.int64)
    return _bitmap(found, s.bitmap_bits), np.sort(hot)


CONTEXT = "key long, name binary, low long, before long, count long, twice boolean, bytes binary, other long"
_SECOND = mix(PLAIN ^ U64(0x5851F42D4C957F2D))


def contexts(texts: DataFrame, bitmap: np.ndarray, hot: np.ndarray, s: Settings) -> DataFrame:
    """Rows of the parse at repeated triggers.  bytes is null in rows that need no comparing: strings
    low .. low + count - 1 are repeated (key 0), or belong to a hot trigger (its key, dealt one by one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi, data, off in chunks(b.column(1)):
                fresh = np.zeros(hi - lo, dtype=bool)
                for i, name in enumerate(names[lo:hi]):
                    if name not in seen:
                        seen.add(name)
                        fresh[i] = True
                p = Parse(data, off, s)
                key = p.key.view(np.int64)
                x = np.flatnonzero(fresh[p.doc] & _in(bitmap, key)) if len(key) else np.zeros(0, np.int64)
                if not len(x):
                    continue
                before, count = p.place[x] - p.low[x], p.high[x] - p.low[x] + 1
                row = mix(mix(p.hasher.of(p.low[x], p.high[x] + s.length)) + (count * 1024 + before).astype(U64))
                _, first, inverse, n = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
                sent = np.zeros(len(x), dtype=bool)
                sent[first] = True
                is_hot = np.isin(key[x], hot)
                plain = sent & ~is_hot
                size = np.where(plain, count - 1 + s.length, 0)
                begin = np.concatenate(([0], np.cumsum(size)))
                whole = data[np.arange(begin[-1]) + np.repeat(p.low[x] - begin[:-1], size)]
                blob = pa.Array.from_buffers(pa.large_binary(), len(x), [pa.py_buffer(np.packbits(plain, bitorder="little").tobytes()), pa.py_buffer(begin.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())]).cast(pa.binary())
                local = p.low[x] - off[p.doc[x]]
                own = pa.array([names[lo + d] for d in p.doc[x].tolist()], pa.binary())
                twice = n[inverse.ravel()] > 1
                out = pa.record_batch({"key": pa.array(key[x]), "name": own, "low": pa.array(local), "before": pa.array(before), "count": pa.array(count), "twice": pa.array(twice), "bytes": blob, "other": pa.nulls(len(x), pa.int64())})
                yield out.filter(pa.array(sent & ~is_hot))
                if (twice & ~is_hot).any():
                    done = out.filter(pa.array(twice & ~is_hot))
                    n_done = done.num_rows
                    yield pa.record_batch({"key": pa.array(np.zeros(n_done, np.int64)), "name": done.column(1), "low": done.column(2), "before": done.column(3), "count": done.column(4), "twice": done.column(5), "bytes": pa.nulls(n_done, pa.binary()), "other": pa.nulls(n_done, pa.int64())})
                if is_hot.any():
                    y = np.flatnonzero(is_hot)
                    reps = count[y]
                    ends = np.cumsum(reps)
                    step = np.arange(ends[-1]) - np.repeat(ends - reps, reps)
                    start = np.repeat(p.low[x][y], reps) + step
                    h = mix(p.hasher.of(start, start + s.length)).view(np.int64)
                    h = np.where(h == 0, 1, h)
                    other = mix(Hasher(data, _SECOND).of(start, start + s.length)).view(np.int64)
                    at = np.repeat(y, reps)
                    zero = np.zeros(len(at), np.int64)
                    yield pa.record_batch({"key": pa.array(h), "name": own.take(pa.array(at)), "low": pa.array(local[at] + step), "before": pa.array(zero - 1), "count": pa.array(zero + 1), "twice": pa.array(np.zeros(len(at), bool)), "bytes": pa.nulls(len(at), pa.binary()), "other": pa.array(other)})

    return texts.select("name", "text").mapInArrow(run, CONTEXT)


def _ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order of the rows' bytes, LCP of each with the one before)."""
    flat = np.ascontiguousarray(rows)
    order = np.argsort(flat.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    got = flat[order]
    differ = got[1:] != got[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate(([-1], lcp))


def repeated_strings(key: np.ndarray, before: np.ndarray, count: np.ndarray, twice: np.ndarray, blobs: list[bytes], s: Settings) -> np.ndarray:
    """For each row and each number o of bytes before the trigger: is that string repeated?"""
    n, most = len(key), s.length - s.trigger
    sizes = np.array([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    head = np.ascontiguousarray(key.astype(">u8")).view(np.uint8).reshape(n, 8)

    def side(start: np.ndarray, step: int, width: int, room: np.ndarray) -> np.ndarray:
        ramp = np.arange(width)
        inside = ramp[None, :] < room[:, None]
        place = np.where(inside, (base + start)[:, None] + step * ramp[None, :], 0)
        out = np.empty((n, 8 + width), dtype=np.uint8)
        out[:, :8] = head
        out[:, 8:] = np.where(inside, data[place], 0)
        return out

    right_order, right_lcp = _ranks(side(before, 1, s.length, sizes - before))
    left_order, left_lcp = _ranks(side(before - 1, -1, most, before))
    found = np.zeros((n, most + 1), dtype=bool)
    lowest = before - count + 1
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(most + 1):
        valid = np.flatnonzero((o <= before) & (o >= lowest))
        if not len(valid):
            continue
        right[right_order] = np.cumsum(right_lcp < s.length - o + 8)
        left[left_order] = np.cumsum(left_lcp < o + 8)
        pair = left[valid] * (n + 1) + right[valid]
        _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
        found[valid, o] = (times[inverse.ravel()] > 1) | twice[valid]
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by the first column, about ``most`` rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield t.slice(0, end)
            held = t.slice(end).to_batches()
            rows = t.num_rows - end
    if rows:
        yield pa.Table.from_batches(held)


def spans(parse: DataFrame, s: Settings) -> DataFrame:
    """name, start, end: covered stretches of texts, not yet joined where they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches, s.rows):
            key = t.column("key").to_numpy()
            again = key[1:] == key[:-1]
            met = np.concatenate(([False], again)) | np.concatenate((again, [False]))
            t = t.filter(pa.array(met | t.column("twice").to_numpy()))
            if not t.num_rows:
                continue
            low, before, count = (t.column(c).to_numpy() for c in ("low", "before", "count"))
            found = repeated_strings(t.column("key").to_numpy(), before, count, t.column("twice").to_numpy(), t.column("bytes").to_pylist(), s)
            # string o starts at low + before - o: runs of repeated o are stretches
            edge = np.zeros((len(found), found.shape[1] + 2), dtype=bool)
            edge[:, 1:-1] = found
            row, first = np.nonzero(edge[:, 1:] & ~edge[:, :-1])
            _, last = np.nonzero(~edge[:, 1:] & edge[:, :-1])
            start, end = low[row] + before[row] - last + 1, low[row] + before[row] - first + s.length
            yield pa.record_batch({"name": t.column("name").combine_chunks().take(pa.array(row)), "start": pa.array(start), "end": pa.array(end)})

    parts = int(parse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = parse.where("bytes is not null").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "name binary, start long, end long")
    told = parse.where("bytes is null and key = 0").select("name", F.col("low").alias("start"), (F.col("low") + F.col("count") - 1 + s.length).alias("end"))
    hot = parse.where("bytes is null and key <> 0").select("key", "other", "name", "low")
    twice = hot.groupBy("key", "other").count().where("count > 1").select("key", "other")
    return compared.unionByName(told).unionByName(hot.join(twice, ["key", "other"]).select("name", F.col("low").alias("start"), (F.col("low") + s.length).alias("end")))


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches: those that touch or overlap are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[first], ends[np.append(np.flatnonzero(first)[1:], len(starts)) - 1]


def dedup(documents: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of documents(doc_id, text); with_text adds the
    kept bytes (they may part a character, so it is a binary column)."""
    s = settings
    text = F.coalesce("text", F.lit(""))
    texts = documents.select(_name(), "text")
    bitmap, hot = repeated_triggers(texts, s)
    parse = stored(contexts(texts, bitmap, hot, s), "parse")
    covered = stored(spans(parse, s).groupBy("name").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    touched = _bitmap(covered.select(F.expr("conv(substr(hex(name), 1, 15), 16, 10)").cast("long").alias("key")), s.bitmap_bits)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            names = b.column(0).to_pylist()
            hit = _in(touched, np.array([int.from_bytes(x[:8], "big") >> 4 for x in names], dtype=np.int64)) if names else keep
            for i in np.flatnonzero(hit):
                if names[i] not in seen:
                    seen.add(names[i])
                    keep[i] = True
            yield b.filter(pa.array(keep))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, sha, kept = [], [], [], []
            for t, spans_ in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                data = (t or "").encode()
                pairs = spans_.values
                starts, ends = _joined(pairs.field(0).to_numpy(), pairs.field(1).to_numpy())
                rest = b"".join(data[a:z] for a, z in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                removed.append(len(data) - len(rest))
                runs.append(len(starts))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.record_batch({"name": b.column(0), "removed": pa.array(removed, pa.int64()), "runs": pa.array(runs, pa.int64()), "sha": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    once = texts.mapInArrow(may, "name binary, text string").join(covered, "name")
    changed = stored(once.select("name", "text", "spans").mapInArrow(cut, "name binary, removed long, runs long, sha string, kept binary").dropDuplicates(["name"]), "changed")
    plain = documents.select("doc_id", _name(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"), *([text.cast("binary").alias("whole")] if with_text else []))
    copies = stored(documents.select(_name()).groupBy("name").count().where("count > 1"), "copies")
    got = plain.join(changed, "name", "left").join(copies, "name", "left")
    gone = (F.col("count") > 1) & (F.col("n_bytes") >= s.length)
    columns = [
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept"))
    return got.select("doc_id", "n_bytes", *columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op2: every 200-byte string, by its MD5."""
    return """with d as (select row_number() over () i, doc_id, hex(encode(coalesce(text, ''))) h from documents),
s as (select i, p, md5(substr(h, 2 * p + 1, 400)) m from (select i, h, unnest(range(0, len(h) // 2 - 199)) p from d)),
twice as (select m from s group by 1 having count(*) > 1),
r as (select i, p, coalesce(p > lag(p) over (partition by i order by p) + 200, true)::int fresh from s where m in (from twice)),
n as (select i, p, sum(fresh) over (partition by i order by p) span from r),
runs as (select i, min(p) a, max(p) + 200 z from n group by i, span),
cut as (select i, a, z, lag(z, 1, 0) over (partition by i order by a) before from runs),
kept as (select i, sum(z - a)::bigint n_removed, count(*) n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) k from cut join d using (i) group by i)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256 from d left join kept using (i)"""
