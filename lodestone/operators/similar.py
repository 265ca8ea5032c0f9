"""Texts that nearly agree, by the ratio of their longest common blocks: the closest sentence of a missing passage, and
questions that repeat an earlier one.

The ratio 2 * M / (a + b), M the characters of matching blocks, is bounded by the lengths and by the characters both
have, in any order.  Pairs that a bound rules out are never looked at; the exact ratio, the one step outside
the JVM, is taken of the rest, a batch of pairs at a time."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions import text as T
from lodestone.operators.questions import gold_status
from lodestone.operators.sentences import sentences
from lodestone.sources.tables import stored

LETTERS = "abcdefghijklmnopqrstuvwxyz "
END = 2**32 - 1  # stands where a text has ended
ROWS, STEPS = 256, 512  # texts that meet a block at a time; letter counts, in steps of one, up to which a matrix product compares bags


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of each pair, b held while it repeats."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def letter_bag(c: Column) -> Column:
    """How often each letter stands in a text, and how many other signs it has."""
    own = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    return F.array(*own, F.length(F.translate(c, LETTERS, "")))


def by_length(a: Column, b: Column) -> Column:
    """No ratio of texts of these lengths is greater."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2 * F.least(a, b) / (a + b))


def by_letters(a: Column, b: Column) -> Column:
    """Nor of texts with these letter bags."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    n = total(a) + total(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / n)


def closest_sentences(golds: DataFrame, documents: DataFrame, cutoff: float = 0.6, key: str = "query") -> DataFrame:
    """key, doc_id, gold, closest, score of golds(key, doc_id, gold) that their document does not hold: its sentence whose
    normalised text agrees best, from ``cutoff`` up, else null.

    Ties go to the greatest normalised text, then to the first sentence.  A gold meets only the sentences of its own
    document, and of these only those within both bounds; the best is an aggregate, so no document is gathered."""
    d = documents.select("doc_id", "text")
    met = golds.select(key, "doc_id", "gold").join(d, "doc_id", "left")
    lost = met.where(F.col("gold").isNotNull() & (gold_status(F.col("text"), F.col("gold")) == "not_found")).drop("text").distinct()
    lost = stored(lost.withColumn("needle", T.match_normalise(F.col("gold"))), "missing-golds")
    own = sentences(d.join(lost.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("folded", T.match_normalise(F.col("text")))
    g = lost.select(key, "doc_id", "gold", "needle", F.length("needle").alias("n1"), letter_bag(F.col("needle")).alias("b1"))
    s = own.select("doc_id", "ordinal", F.col("text").alias("sentence"), "folded", F.length("folded").alias("n2"), letter_bag(F.col("folded")).alias("b2"))
    near = s.join(g, "doc_id").where(by_length(F.col("n1"), F.col("n2")) >= cutoff).where(by_letters(F.col("b1"), F.col("b2")) >= cutoff)
    scored = near.withColumn("score", block_ratio("folded", "needle")).where(F.col("score") >= cutoff)
    best = scored.groupBy(key, "doc_id", "gold").agg(F.max(F.struct("score", "folded", (-F.col("ordinal")).alias("first"), "sentence")).alias("best"))
    return lost.join(best, [key, "doc_id", "gold"], "left").select(key, "doc_id", "gold", F.col("best.sentence").alias("closest"), F.col("best.score").alias("score"))


class _Texts:
    """A block of texts: lengths, counts of its letters and of other signs, codes of the signs of texts up to 64."""

    def __init__(self, norms: pa.Array):
        self.length = np.asarray(pc.utf8_length(norms), dtype=np.int64)
        code = np.frombuffer("".join(norms.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(len(norms)), self.length)
        letter = np.full(128, len(LETTERS))
        letter[[ord(x) for x in LETTERS]] = np.arange(len(LETTERS))
        kind = np.where(code < 128, letter[np.minimum(code, 127)], len(LETTERS))
        bag = np.bincount(row * (len(LETTERS) + 1) + kind, minlength=len(norms) * (len(LETTERS) + 1)).reshape(len(norms), -1)
        self.bag = np.ascontiguousarray(bag.T.astype(np.uint8 if self.length.max(initial=0) < 256 else np.int32))
        place = np.arange(len(code)) - (np.cumsum(self.length) - self.length)[row]
        brief = (self.length <= 64)[row]
        self.codes = np.full((len(norms), 64), END, np.uint32)
        self.codes[row[brief], place[brief]] = code[brief]


def _steps(bag: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A row for each text: is the count of a letter at least 1, 2, … up to most?  The product of two rows is what the bags share."""
    return np.concatenate([x[:, None] > np.arange(n) for x, n in zip(bag, most, strict=True)], axis=1)


def _bags_allow(a: _Texts, b: _Texts, ratio: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, i, j) for slices of a: its rows, from the first on, and texts of b whose letters allow the ratio; a few
    more may be among them, as sums are in single precision."""
    most = np.minimum(a.bag.max(axis=1, initial=0), b.bag.max(axis=1, initial=0)).astype(np.int64)
    if most.sum() <= STEPS:
        one, two = (np.concatenate((_steps(x.bag, most), np.zeros((len(x.length), 2))), axis=1, dtype=np.float32) for x in (a, b))
        one[:, -2:] = np.stack((-ratio / 2 * a.length, np.ones(len(one))), axis=1)
        two[:, -2:] = np.stack((np.ones(len(two)), -ratio / 2 * b.length), axis=1)
        two = np.ascontiguousarray(two.T)
        for at in range(0, len(one), ROWS):
            i, j = np.divmod(np.flatnonzero(one[at : at + ROWS] @ two > -0.05), two.shape[1])
            yield at, i, j
        return
    for at in range(0, len(a.length), ROWS // 4):
        s = slice(at, at + ROWS // 4)
        size = a.length[s, None] + b.length
        shared = np.zeros(size.shape, np.uint8 if a.bag.dtype == b.bag.dtype == np.uint8 else np.int32)
        for x, y in zip(a.bag, b.bag, strict=True):
            shared += np.minimum(x[s, None], y)
        yield at, *np.nonzero(2 * shared.astype(np.int32) > ratio * size - 1e-6)


def _low(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set."""
    n = np.clip(n, 0, 64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def subsequence_allows(masks: np.ndarray, row: np.ndarray, length: np.ndarray, signs: np.ndarray, other: np.ndarray, at: np.ndarray, ratio: float) -> np.ndarray:
    """Which pairs have a common subsequence that allows the ratio.  masks has for each text, of up to 64 signs, the places of
    each sign of an alphabet as bits, and signs the t-th sign of each other text in row t; a pair is a row of masks, that text's
    length, the other's length and its column in signs.

    Of texts of a and b signs that share m in order, b leaves b - m signs out and a has a - m others between.  So the first
    t signs of b share t - (b - m) with the first t + (a - m) of a; pairs that do not are left as soon as that is seen."""
    need = np.floor((ratio * (length + other) - 1e-6) / 2).astype(np.int64) + 1
    left, flat, base = np.arange(len(row)), masks.ravel(), row * masks.shape[1]
    slack, spare = length - need, other - need
    v = np.full(len(row), ~np.uint64(0))
    wide = int(other.max(initial=0))
    for t in range(wide + 1):
        if t == wide or (t >= 16 and t % 4 == 0):
            near = np.bitwise_count(~v & _low(np.minimum(t + slack, length))) >= np.minimum(t, other) - spare
            v, left, base, slack, spare, length, other, at = (x[near] for x in (v, left, base, slack, spare, length, other, at))
        if t < wide:
            u = v & flat[base + signs[t][at]]
            v = (v + u) | (v - u)
    found = np.zeros(len(row), bool)
    found[left] = np.bitwise_count(~v & _low(length)) >= need[left]
    return found


def _met(batches: Iterator[pa.RecordBatch], keys: list[str], ratio: float) -> Iterator[pa.RecordBatch]:
    """keys, n1, t1, n2, t2 of the pairs of two blocks that the bounds leave."""
    for batch in batches:
        for k in range(batch.num_rows):
            one, two = (batch.column(c)[k].values for c in ("one", "two"))
            a, b = _Texts(one.field("norm")), _Texts(two.field("norm"))
            same = batch.column("same")[k].as_py()
            alphabet, signs = np.unique(np.concatenate([a.codes.ravel(), b.codes.ravel()]), return_inverse=True)
            signs = signs.reshape(-1, 64)
            first, second = signs[: len(a.length)], np.ascontiguousarray(signs[len(a.length) :].T)
            for at, i, j in _bags_allow(a, b, ratio):
                if same:
                    i, j = i[at + i < j], j[at + i < j]
                rows = min(ROWS, len(first) - at)
                masks = np.zeros((rows, len(alphabet)), np.uint64)
                for t in range(64):
                    masks[np.arange(rows), first[at : at + rows, t]] |= np.uint64(1) << np.uint64(t)
                masks[:, alphabet == END] = 0
                left = []
                for c in (slice(x, x + 16_384) for x in range(0, len(i), 16_384)):
                    p, q = i[c], j[c]
                    brief = (a.length[at + p] <= 64) & (b.length[q] <= 64)
                    stays = ~brief
                    p1, q1 = p[brief], q[brief]
                    stays[brief] = subsequence_allows(masks, p1, a.length[at + p1], second, b.length[q1], q1, ratio)
                    left.append((at + p[stays], q[stays]))
                if left:
                    p, q = (pa.array(np.concatenate(x)) for x in zip(*left, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(np.full(len(p), k))) for c in keys] + [h.field(f).take(w) for h, w in ((one, p), (two, q)) for f in ("n", "norm")], [*keys, "n1", "t1", "n2", "t2"])


def near_pairs(texts: DataFrame, ratio: float, scope: tuple[str, ...] = ("set_id",), size: int = 4096) -> DataFrame:
    """scope, late, early, score: ordered pairs of different texts(scope, n, norm) with a ratio above ``ratio``.  The ratio
    depends on which text comes second, so either order of a pair may be there without the other.

    Pairs are met in blocks of about ``size`` texts of a scope, up to four times as many in a large one, as each block is sent
    once for each other; each pair of blocks is met in a task, and pairs of texts become rows only
    once lengths, letter bags and, of texts up to 64 signs, the longest common subsequence allow the ratio.  All pairs
    are compared by nature; memory is that of two blocks, and what is shuffled is the blocks, once for each partner."""
    keys = [*scope]
    t = texts.where("norm is not null").select(*keys, "n", "norm")
    sets = t.groupBy(*keys).agg(F.ceil(F.count("*") / F.greatest(F.lit(size), F.least(F.lit(4 * size), F.count("*") / 16))).alias("blocks"))  # a row for each scope
    dealt = t.join(sets, keys).withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")))
    packed = stored(dealt.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("n", "norm")).alias("held")), "text-blocks")
    pairs = packed.agg(F.sum(F.col("blocks") - F.col("block"))).first()[0] or 0
    one = packed.select(*keys, F.col("block").alias("first"), F.col("held").alias("one"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("block"))
    both = one.join(packed.select(*keys, "block", F.col("held").alias("two")), [*keys, "block"]).withColumn("same", F.col("first") == F.col("block")).drop("first", "block")
    parts = max(4 * t.sparkSession.sparkContext.defaultParallelism, -(-pairs // 16))
    kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema if f.name in keys]
    n = t.schema["n"].dataType.simpleString()
    met = both.repartition(parts).mapInArrow(lambda batches: _met(batches, keys, ratio), ", ".join([*kind, f"n1 {n}, t1 string, n2 {n}, t2 string"]))
    order = F.col("n1") < F.col("n2")
    early = F.when(order, F.struct(F.col("n1").alias("n"), F.col("t1").alias("t"))).otherwise(F.struct(F.col("n2").alias("n"), F.col("t2").alias("t")))
    late = F.when(order, F.struct(F.col("n2").alias("n"), F.col("t2").alias("t"))).otherwise(F.struct(F.col("n1").alias("n"), F.col("t1").alias("t")))
    both = met.select(*keys, early.alias("e"), late.alias("l")).select(*keys, F.col("e.n").alias("early"), F.col("e.t").alias("t1"), F.col("l.n").alias("late"), F.col("l.t").alias("t2"))
    ways = F.array(F.struct("late", "early", "t2", "t1"), F.struct(F.col("early").alias("late"), F.col("late").alias("early"), F.col("t1").alias("t2"), F.col("t2").alias("t1")))
    each = both.select(*keys, F.inline(ways))
    return each.withColumn("score", block_ratio("t2", "t1")).where(F.col("score") > ratio).select(*keys, "late", "early", "score")


def kept_in_order(candidates: DataFrame, ratio: float = 0.85) -> DataFrame:
    """candidates(set_id, n, question, gold, …) with drop: "same gold passage" as an earlier kept question of its set, "near
    duplicate" of an earlier kept one, or null where it is kept.  n numbers a set's candidates; nulls count as empty.

    What is near to a question that itself falls stays.  Rounds decide who has an earlier kept neighbour (falls) and who
    has no earlier undecided one (is kept), each a written table, as many as the longest chain has links.
    Neighbours are pairs of texts, not of questions: of one text the earliest kept or undecided question stands for all."""
    c = candidates.select("set_id", "n", T.normalise(F.coalesce("question", F.lit(""))).alias("norm"), T.normalise(F.coalesce("gold", F.lit(""))).alias("g"))
    texts = c.groupBy("set_id", "norm").agg(F.min("n").alias("t"))
    c = stored(c.join(texts, ["set_id", "norm"]).select("set_id", "n", "t", "g"), "candidates")
    near = near_pairs(texts.select("set_id", F.col("t").alias("n"), "norm"), ratio).select("set_id", F.col("late").alias("t"), F.col("early").alias("o"))
    near = stored(near.unionByName(texts.select("set_id", "t", F.col("t").alias("o"))), "near-texts")

    def beside(rows: DataFrame, others: DataFrame) -> DataFrame:
        """rows(set_id, n, t) that an earlier one of the others has a near text to, or the same."""
        first = others.groupBy("set_id", F.col("t").alias("o")).agg(F.min("n").alias("first"))
        return rows.join(near, ["set_id", "t"]).join(first, ["set_id", "o"]).where("first < n").select("set_id", "n").distinct()

    def same_gold(rows: DataFrame, others: DataFrame) -> DataFrame:
        return rows.join(others.groupBy("set_id", "g").agg(F.min("n").alias("first")), ["set_id", "g"]).where("first < n").select("set_id", "n")

    left, kept = c, c.where("false")
    while left.head(1):
        ready = left.join(beside(left, left), ["set_id", "n"], "left_anti").join(same_gold(left, left), ["set_id", "n"], "left_anti")
        kept = stored(kept.unionByName(ready.select(*kept.columns)), "kept")
        left = left.join(kept.select("set_id", "n"), ["set_id", "n"], "left_anti")
        left = stored(left.join(beside(left, kept), ["set_id", "n"], "left_anti").join(same_gold(left, kept), ["set_id", "n"], "left_anti").select(*kept.columns), "undecided")
    told = c.select("set_id", "n").join(kept.select("set_id", "n", F.lit(True).alias("kept")), ["set_id", "n"], "left").join(same_gold(c, kept).withColumn("same", F.lit(True)), ["set_id", "n"], "left")
    drop = F.when(F.col("kept"), None).when(F.col("same"), "same gold passage").otherwise("near duplicate")
    return candidates.join(told.select("set_id", "n", drop.alias("drop")), ["set_id", "n"])
