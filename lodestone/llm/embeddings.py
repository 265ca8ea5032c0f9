"""Embedding near-duplicates with spherical-cap filters.

Method.  Filter directions are a structured random product code: a seeded rotation splits a unit
vector into two halves, and every pair of a codeword for each half is a direction.  A vector's
filters are all directions whose inner product exceeds the cap's threshold, decoded from the halves'
sorted products without visiting the rest; a vector that exceeds fewer than ``least`` takes its best
ones.  Vectors join on (label, filter) and pairs are verified by cosine in double precision.

Equal vectors of a label are one class with a size before the join.  A bucket larger than ``block``
is split into blocks, and each pair of blocks becomes its own key, so no task holds a hot bucket.  A
pair is counted only under the first filter its vectors share.  A bucket returns the number of links
of each class and a spanning forest of its links, never its pairs.

Defined cases.  Vectors that are null, empty, zero, or hold null or non-finite components, rows with
a null label and rows with a null id link with nothing: n_links 0, component_id the own id, kept.
Vectors of different lengths do not link.  Rows that repeat a vec_id are rows of their own, joined
to one node; equal rows link with each other.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import components, stored, table


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    codewords: int = 48
    deviations: float = 2.9
    least: int = 10
    block: int = 1024
    seed: int = 20


def code(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, codewords of the first half, of the second half)."""
    rng = np.random.default_rng([s.seed, dim])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = (dim + 1) // 2
    words = []
    for d in (half, dim - half):
        w = rng.standard_normal((s.codewords, max(1, d)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(2))
    return rotation, words[0], words[1]


def decode(units: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The filters of each unit vector, ascending: all that exceed the cap's threshold, its best ones at least."""
    dim = units.shape[1]
    rotation, a, b = code(dim, s)
    x = units @ rotation
    half = (dim + 1) // 2
    left = x[:, :half] @ a.T
    right = x[:, half:] @ b.T if dim > half else np.zeros((len(x), s.codewords))
    order_l, order_r = np.argsort(-left, axis=1), np.argsort(-right, axis=1)
    limit = s.deviations / np.sqrt(dim)
    out = []
    for k in range(len(x)):
        l, r = left[k, order_l[k]], right[k, order_r[k]]
        # the best `least` sums lie where (i + 1) * (j + 1) <= least; anything above the limit in the staircase below
        grid = np.add.outer(l[: s.least], r[: s.least]).ravel()
        cut = min(limit, np.partition(grid, -s.least)[-s.least]) if len(grid) >= s.least else grid.min()
        rows = int(np.searchsorted(-l, -(cut - r[0]), side="right"))
        ends = np.searchsorted(-r, -(cut - l[:rows]), side="right")
        i = np.repeat(np.arange(rows), ends)
        j = np.arange(len(i)) - np.repeat(np.concatenate(([0], np.cumsum(ends)[:-1])), ends)
        out.append(np.sort(order_l[k, i] * s.codewords + order_r[k, j]).astype(np.int32))
    return out


def classes(vectors: DataFrame) -> DataFrame:
    """Valid rows as (vec_id, label, key, vector as float64 bytes); key names label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, keys, data = [], [], [], []
            for i, v, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if i is None or label is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    blob = x.tobytes()
                    ids.append(i)
                    labels.append(label)
                    keys.append(hashlib.blake2b(blob, digest_size=16, salt=int(label).to_bytes(8, "little", signed=True)).digest())
                    data.append(blob)
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "key": pa.array(keys, pa.binary()), "vector": pa.array(data, pa.binary())})

    return vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).mapInArrow(run, "vec_id long, label long, key binary, vector binary")


def _filtered(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = b.column(b.schema.get_field_index("vector")).to_pylist()
        lists: list = [None] * len(blobs)
        for size in {len(x) for x in blobs}:
            at = [k for k, x in enumerate(blobs) if len(x) == size]
            v = np.frombuffer(b"".join(blobs[k] for k in at)).reshape(len(at), -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            for k, f in zip(at, decode(v / np.linalg.norm(v, axis=1, keepdims=True), s), strict=True):
                lists[k] = f
        yield b.append_column("filters", pa.array(lists, pa.list_(pa.int32())))


class _Bucket:
    """One (label, filter, pair of blocks)."""

    def __init__(self, rows: pa.Table, s: Settings):
        blobs = rows.column("vector").to_pylist()
        self.ids, self.keys = rows.column("least_id").to_numpy(), rows.column("key").to_pylist()
        self.sizes, self.block = rows.column("size").to_numpy(), rows.column("block").to_numpy()
        v = np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        self.units = v / np.linalg.norm(v, axis=1, keepdims=True)
        lists = rows.column("filters").to_pylist()
        self.filters = np.full((len(lists), max(map(len, lists))), -1, dtype=np.int64)
        for k, f in enumerate(lists):
            self.filters[k, : len(f)] = f
        self.own, self.i, self.j, self.cosine = rows.column("filter")[0].as_py(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), s.cosine

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that link and whose first common filter is this one."""
        a, b = np.flatnonzero(self.block == self.i), np.flatnonzero(self.block == self.j)
        got = self.units[a] @ self.units[b].T >= self.cosine
        if self.i == self.j:
            got = np.triu(got, 1)
        x, y = np.nonzero(got)
        x, y = a[x], b[y]
        first = np.ones(len(x), dtype=bool)
        for k in range(self.filters.shape[1]):
            f = self.filters[x, k]
            earlier = first & (f >= 0) & (f < self.own)
            if earlier.any():
                at = np.flatnonzero(earlier)
                first[at[(self.filters[y[at]] == f[at, None]).any(axis=1)]] = False
        return x[first], y[first]

    def forest(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        up = list(range(len(self.ids)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        out = []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            rp, rq = root(p), root(q)
            if rp != rq:
                up[rp] = rq
                out.append((int(self.ids[p]), int(self.ids[q])))
        return out


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors(vec_id, embedding, label)."""
    s = settings
    valid = stored(classes(vectors), "vectors")
    grouped = valid.groupBy("label", "key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"), F.min("vector").alias("vector"))
    schema = "label long, key binary, least_id long, size long, vector binary, filters array<int>"
    filtered = stored(grouped.select("label", "key", "least_id", "size", "vector").mapInArrow(lambda it: _filtered(it, s), schema), "filters")
    spread = filtered.withColumn("filter", F.explode("filters")).withColumn("dim", F.length("vector"))
    counts = filtered.select("label", F.explode("filters").alias("filter"), F.length("vector").alias("dim")).groupBy("label", "filter", "dim").count().where("count > 1")
    met = spread.join(counts, ["label", "filter", "dim"]).withColumn("blocks", F.ceil(F.col("count") / s.block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.select("label", "filter", "dim", "i", "j", "block", "key", "least_id", "size", "vector", "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = ["label", "filter", "dim", "i", "j"]
        held = None

        def done(rows: pa.Table) -> pa.RecordBatch | None:
            bucket = _Bucket(rows, s)
            x, y = bucket.links()
            if not len(x):
                return None
            n = np.bincount(x, weights=bucket.sizes[y], minlength=len(bucket.ids)) + np.bincount(y, weights=bucket.sizes[x], minlength=len(bucket.ids))
            hit, edges = np.flatnonzero(n), bucket.forest(x, y)
            return pa.record_batch(
                {
                    "key": pa.array([bucket.keys[k] for k in hit] + [None] * len(edges), pa.binary()), "links": pa.array(n[hit].astype(np.int64).tolist() + [0] * len(edges), pa.int64()),
                    "a": pa.array([None] * len(hit) + [e[0] for e in edges], pa.int64()), "b": pa.array([None] * len(hit) + [e[1] for e in edges], pa.int64()),
                }
            )

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            codes = np.stack([t.column(c).to_numpy() for c in group])
            cuts = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
                if hi - lo > 1 and (out := done(t.slice(lo, hi - lo))):
                    yield out
            held = t.slice(cuts[-1] if len(cuts) else 0)
        if held is not None and held.num_rows > 1 and (out := done(held)):
            yield out

    keys = ["label", "filter", "dim", "i", "j"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(verify, "key binary, links long, a long, b long"), "links")
    links = found.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    whole = components(found.where("a is not null").select("a", "b"))
    by_class = grouped.select("key", "least_id", "size").join(links, "key", "left").join(whole.withColumnRenamed("node", "least_id"), "least_id", "left")
    by_class = by_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "least_id").alias("component_id"))
    linked = valid.select("vec_id", "key").join(by_class, "key").select("vec_id", "n_links", "component_id")
    # rows that are no valid vector come from the input's own test, so nothing is joined by id
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    alone = vectors.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """DuckDB SQL of op8: every pair of a label."""
    return """with v as (select row_number() over () i, vec_id, label, embedding::double[] e from embeddings),
ok as (select * from v where vec_id is not null and label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.i, b.i j, a.vec_id u, b.vec_id w from ok a join ok b on a.label = b.label and a.i <> b.i and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
edges as (select u, w from links union select w, u from links),
least as (with recursive r(x, y) as (select vec_id, vec_id from ok union select r.x, edges.w from r join edges on edges.u = r.y) select x, min(y) c from r group by 1),
n as (select i, count(*) n from links group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(c, vec_id) component_id, coalesce(vec_id = coalesce(c, vec_id), true) kept from v left join n using (i) left join least on x = vec_id and i in (select i from ok)"""
