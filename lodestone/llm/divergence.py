"""How the sources of a language differ in the words they use: exact divergences of all pairs, and each source's own terms.

Method.  The counts of a language are a matrix of groups (lang, source) by kept terms.  Blocks of 64 groups by a
hashed bucket of terms become K2 quadtrees (k = 2): one bit a quadrant, level by level, children found by rank, the
counts only at nonzero leaves.  Two rows' trees are walked together from the root for all pairs of groups at once.
Where both have no bit, the quadrant's terms have the smoothed share of a count of zero in both groups, so
its whole width is priced at once for every pair of its rows; only leaves with a count in either are looked up.

Scale.  A task counts the terms of its texts by group and emits each once, so the only wide shuffle is of partial counts
by (lang, term); it also yields document frequencies and totals of a language, and a term no document list
or pair of documents is ever formed for.  Kept counts are stored, far smaller.  A bucket has about 4,096 terms and two
blocks of groups, whatever the corpus has; its sums go to (lang, source, source).  All arithmetic is on integers:
shares are divided in steps of 1,000, so counts may reach 9 * 10**15.

Defined cases.  A null text, lang or source is ''.  Repeated rows are documents of their own.  Groups without terms
take part with counts of zero; a language without kept terms has values of 0 and no terms.  Ties are ordered by item.
Further columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import stored, table

SIDE = 64  # groups of a block, and terms of a quadtree
BILLION = 1_000_000_000


def _letters() -> bytes:
    """Each byte of a text as it stands in a term: a letter in lower case, a byte beyond ASCII as it is, else a space."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for upper in range(65, 91):
        out[upper] = out[upper + 32] = upper + 32
    return bytes(out)


LETTERS = _letters()


def counted(documents: DataFrame, most: int = 400_000) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of terms, summed within a task as far as ``most`` entries go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = defaultdict(Counter), defaultdict(Counter)
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                terms = list(c)
                for k in range(0, len(terms), 50_000):
                    part = terms[k : k + 50_000]
                    known = docs[lang, source]
                    yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": pa.array(part, pa.binary()).cast(pa.string()), "n": pa.array([c[t] for t in part], pa.int64()), "docs": pa.array([known[t] for t in part], pa.int64())})

        for b in batches:
            for lang, source, text in zip(*(x.cast(pa.large_binary()) if k == 2 else x.to_pylist() for k, x in enumerate(b.columns)), strict=True):
                terms = (text.as_py() or b"").translate(LETTERS).split()
                group = n[lang, source]
                before = len(group)
                group.update(terms)
                docs[lang, source].update(set(terms))
                held += len(group) - before
                if held >= most:
                    yield from out()
                    n.clear()
                    docs.clear()
                    held = 0
        yield from out()

    read = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(documents: DataFrame, least: int = 10) -> DataFrame:
    """lang, source, term, n, total, nth of terms in at least so many documents of the language: total is the
    language's count, nth numbers the sources that have the term."""
    by_term = counted(documents).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    spread = by_term.withColumns({"df": F.sum("docs").over(w), "total": F.sum("n").over(w), "nth": F.row_number().over(w.orderBy("source"))})
    return spread.where(F.col("df") >= least).select("lang", "source", "term", "n", "total", "nth")


def share(count: Column, of: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / of), exactly."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.call_function("div", wide, of.cast("decimal(20,0)")) + 1


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same for arrays: long division in steps of 1,000, as 10**9 times a count may not fit."""
    x = count + 2
    quotient, rest = x // of, x % of
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // of, rest % of
    return quotient + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Quadtrees:
    """K2 quadtrees (k = 2) of a matrix with SIDE rows, one for each SIDE columns: a bit a quadrant, values at leaves."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, stripes: int):
        key, height = cols // SIDE, SIDE.bit_length() - 1
        for bit in range(height - 1, -1, -1):
            key = key * 4 + (rows >> bit & 1) * 2 + (cols >> bit & 1)
        order = np.argsort(key)
        key, self.values, self.bits = key[order], values[order], []
        for _ in range(height):
            parent, at = np.unique(key >> 2, return_inverse=True)
            bits = np.zeros((len(parent), 4), dtype=bool)
            bits[at, key & 3] = True
            self.bits.insert(0, bits)
            key = parent
        self.roots = np.full(stripes, -1)
        self.roots[key] = np.arange(len(key))
        self.ranks = [np.cumsum(b.ravel()) - 1 for b in self.bits]

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The node's child by rank; -1 where the node, or its bit, is none."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level].ravel()[at], self.ranks[level][at], -1)


def joint(x: Quadtrees, y: Quadtrees, px: tuple[np.ndarray, np.ndarray], py: tuple[np.ndarray, np.ndarray], columns: int, same: bool, at_once: int = 8) -> np.ndarray:
    """Sums of distances over all columns for all pairs of rows of x and y; with ``same``, of rows a < b only.

    px and py: (what a row divides by, its share of a count of zero)."""
    nx, ny, height = len(px[0]), len(py[0]), SIDE.bit_length() - 1
    total = np.zeros((nx, ny), dtype=np.int64)
    void = [np.zeros((1 << k, 1 << k), dtype=np.int64) for k in range(height + 1)]
    for first in range(0, len(x.roots), at_once):
        stripe = np.arange(first, min(first + at_once, len(x.roots)))
        a, b, ra, rb, col = x.roots[stripe], y.roots[stripe], np.zeros_like(stripe), np.zeros_like(stripe), stripe * SIDE
        for level in range(height + 1):
            size = SIDE >> level
            none = (a < 0) & (b < 0)
            np.add.at(void[level], (ra[none] // size, rb[none] // size), np.minimum(columns - col[none], size))
            a, b, ra, rb, col = (v[~none] for v in (a, b, ra, rb, col))
            if level == height:
                break
            size, parts = size // 2, []
            for i in (0, 1):
                for j in (0, 1):
                    for c in (0, 1):
                        r, s, t = ra + i * size, rb + j * size, col + c * size
                        use = (r < nx) & (s < ny) & (t < columns) & ((r <= s) | (not same))
                        parts.append((x.child(level, a[use], 2 * i + c), y.child(level, b[use], 2 * j + c), r[use], s[use], t[use]))
            a, b, ra, rb, col = (np.concatenate(v) for v in zip(*parts, strict=True))
        p, q = (np.where(n >= 0, shares(np.append(t.values, 0)[n], of[r]), zero[r]) for t, n, r, (of, zero) in ((x, a, ra, px), (y, b, rb, py)))
        np.add.at(total, (ra, rb), distance(p, q))
    empty = sum(np.kron(v, np.ones((SIDE >> k, SIDE >> k), dtype=np.int64)) for k, v in enumerate(void))[:nx, :ny]
    return total + empty * distance(px[1][:, None], py[1][None, :])


def _bucket(rows: pa.Table) -> pa.Table:
    """Sums of one bucket of terms for two blocks of groups; rows without a term name a group, its divisor, and the bucket's terms."""
    lang, i, j = (rows.column(c)[0].as_py() for c in ("lang", "i", "j"))
    heads = rows.filter(rows.column("term").is_null()).sort_by("idx")
    cells = rows.filter(rows.column("term").is_valid())
    columns = heads.column("n")[0].as_py()
    coded = cells.column("term").combine_chunks().dictionary_encode()
    term = coded.indices.to_numpy()
    often = np.bincount(term, minlength=len(coded.dictionary))
    place = np.empty(len(often), dtype=np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(often))  # terms of many groups side by side: large empty quadrants
    idx, n, names, number = cells.column("idx").to_numpy(), cells.column("n").to_numpy(), heads.column("source").to_pylist(), heads.column("idx").to_numpy()
    of, stripes = heads.column("of").to_numpy(), max(1, -(-columns // SIDE))
    trees, bounds = [], []
    for block in (i, j):
        own, head = idx // SIDE == block, number // SIDE == block
        trees.append(Quadtrees(idx[own] % SIDE, place[term[own]], n[own], stripes))
        d = np.maximum(of[head], 1)
        bounds.append((d, shares(np.zeros(len(d), np.int64), d), [names[k] for k in np.flatnonzero(head)]))
    (dx, zx, xs), (dy, zy, ys) = bounds
    sums = joint(*trees, (dx, zx), (dy, zy), columns, i == j)
    a, b = np.triu_indices(len(xs), 1) if i == j else (v.ravel() for v in np.indices(sums.shape))
    left, right, value = [xs[k] for k in a], [ys[k] for k in b], sums[a, b]
    return pa.table({"lang": pa.array([lang] * (2 * len(a)), pa.string()), "source": pa.array(left + right, pa.string()), "item": pa.array(right + left, pa.string()), "value": pa.array(np.concatenate((value, value)), pa.int64())})


def audit(documents: DataFrame, least: int = 10, top: int = 10, bucket_terms: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` has every other source of the language, ``term`` the terms that
    the source uses more than its language, at most ``top``."""
    kept = stored(kept_counts(documents, least), "kept-counts")
    groups = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum((F.col("nth") == 1).cast("long")).alias("v"), F.sum(F.when(F.col("nth") == 1, F.col("total"))).alias("all"))
    held = groups.join(own, ["lang", "source"], "left").na.fill(0, ["own", "v", "all"])
    lang = Window.partitionBy("lang")
    held = held.withColumns({"v": F.sum("v").over(lang), "all": F.sum("all").over(lang), "groups": F.count("*").over(lang), "idx": F.row_number().over(lang.orderBy("source")) - 1})
    held = held.select("lang", "source", "idx", "groups", "v", (F.col("own") + 2 * F.col("v")).alias("of"), (F.col("all") + 2 * F.col("v")).alias("all_of"), F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("int").alias("buckets"))
    held = stored(held, "groups")

    cells = kept.join(held, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    p, q = share(F.col("n"), F.col("of")), share(F.col("total"), F.col("all_of"))
    terms = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sizes = cells.where("nth = 1").groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    heads = held.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).join(sizes, ["lang", "bucket"], "left").na.fill(0, ["n"])
    shape = ["lang", "bucket", "source", "term", "n", "idx", "of", "groups"]
    rows = cells.select(*shape).unionByName(heads.withColumn("term", F.lit(None).cast("string")).select(*shape))
    block, blocks = F.floor(F.col("idx") / SIDE), F.floor((F.col("groups") - 1) / SIDE)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks))).withColumns({"i": F.least(block, "other"), "j": F.greatest(block, "other")})
    sums = rows.select("lang", "bucket", "i", "j", "source", "term", "n", F.col("idx").cast("long").alias("idx"), "of").groupBy("lang", "bucket", "i", "j").applyInArrow(_bucket, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    p = lambda n, d: f"(1 + (1000000000 * ({n} + 2)::hugeint) // {d})"
    f = lambda: "((p - q) * (p - q) // (p + q))::bigint"
    return f"""with d as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
t as (select lang, source, id, unnest(w) term from d), kept as (select lang, term, count(*) total from t group by 1, 2 having count(distinct id) >= 10),
c as (select lang, source, term, count(*) n from t semi join kept using (lang, term) group by 1, 2, 3), g as (select distinct lang, source from d),
v as (select lang, count(*) v, sum(total) al from kept group by 1),
o as (select g.*, coalesce(sum(n), 0) own from g left join c using (lang, source) group by 1, 2),
grid as (select o.lang, o.source, term, coalesce(n, 0) n, {p('coalesce(n, 0)', '(own + 2 * v)')} p, {p('total', '(al + 2 * v)')} q from o join v using (lang) join kept using (lang) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, 'pair' part, b.source item, sum({f()})::bigint as value from (select lang, source, term, p from grid) a join (select lang, source, term, p q from grid) b using (lang, term) where a.source <> b.source group by 1, 2, 4),
every as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' part, term item, {f()} as value from grid where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from every union all from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10"""
