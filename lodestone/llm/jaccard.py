"""Exact Jaccard join of word-shingle sets, with list blocks skipped by position and shared answers.

Method.  A document's set is ordered by one total order of shingles (frequent ones last), and its
prefix, long enough that any set it links with shares a member of it, is posted under each member.
A member's list is parted in blocks by set size, and inside them pairs are skipped whose positions
leave too few members for a link.

Answers are derived from those of highly similar sets: equal sets are one class; the sets of a block
that post the list's member earliest, which are those with the fewest members of their own, answer
for the block, so the others are first compared with these alone; sets joined so are one group.
Of the sets within a few meetings of it each set takes the one that most sets met as its reference, if
it shares enough with it.

What is left are pairs of sets in different groups.  If both have one reference H, what they share of
it follows from |H| and the members that each lacks, so the number of differences from H that they must
share is known.  It is at least one, as one of them does not link with H; the differences get prefixes
of their own, members that H lacks first, and only these are posted and skipped by position: copies
that were edited apart share none of them, and their long common lists are not visited.
Pairs with different references meet in the lists of the prefix members, references held against each
other.  The first member such a pair shares has before it only members in which the sets differ; as
frequent members come last, these are most of the members in which they differ at all.  After it,
members that no other set posts before a mark which both prefixes reach are differences too.  Pairs
leave a task only if both bounds allow a link, and only where neither of the last two posted members
before says that they met there already.
What the bounds leave is compared on the whole sets.  A link inside a group can change no component
and is not looked for, so no list or group is ever expanded into all its pairs.

The order needs no exact frequencies to be right, so the shingles to put last are the most frequent
ones of what tasks meet often, at most ``frequent`` of them (a broadcast of that size).  Sets are
made again from the texts where they are needed: each set has the hash of one of its texts, and a bitmap of
fixed size drops the texts that no candidate needs before their words are looked at; the others go to
the pairs compressed, and are hashed there.

Defined cases.  Null, empty and white texts have no shingles, link with nothing and are their own
component.  Texts of one to four words have one shingle, the whole sequence.  Rows with equal sets
link even if their ids repeat; a null id is never a component's smallest id unless alone.  Shingles
and sets are named by 64-bit hashes, lists by 48 bits of these.  ``join`` does not read extra columns;
``keep_first`` keeps them, whatever their names.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bytetext import U64, WHITE, Hasher, chunks, mix, words
from lodestone.llm.elias_fano import from_planes, planes
from lodestone.llm.shared import components, discard, stored, table, unused

_TOP = U64(1 << 63)
# marks in the order of shingles; most prefixes end between the same two
MARKS = (np.arange(16, dtype=U64) * U64(2) + U64(1)) << U64(58)
_PAIRS = 1 << 20
_TEXTS = 256  # pairs whose sets are held at once
LIST_BITS = 48


@dataclass(frozen=True)
class Settings:
    n: int = 5
    percent: int = 75
    frequent: int = 32_768
    bitmap_bits: int = 26
    heads: int = 4
    long_list: int = 32


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles, offsets by text), repeats included."""
    starts, ends, by = words(data, off, WHITE)
    h = mix(Hasher(data).of(starts, ends)) if len(starts) else np.zeros(0, U64)
    sizes = np.diff(by)
    sums = np.zeros(len(h), dtype=U64)
    for k in range(min(n, len(h))):
        sums[: len(h) - k] = sums[: len(h) - k] * U64(0x9FB21C651E98DF25) + h[k:]
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(at[-1]) + np.repeat(by[:-1] - at[:-1], count)
    out = mix(sums[place])
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):
        x = U64(0)
        with np.errstate(over="ignore"):
            for w in h[by[i] : by[i + 1]]:
                x = x * U64(0x9FB21C651E98DF25) + w
            out[at[i]] = mix(np.array([x + U64(int(sizes[i]))]))[0]
    return out, at


class Sets:
    """The sets of a chunk's texts: members in the total order, and the name of the set."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int, frequent: np.ndarray):
        self.members = self.ordered(data, off, n, frequent)
        self.names = self.named(self.members)

    @staticmethod
    def ordered(data: np.ndarray, off: np.ndarray, n: int, frequent: np.ndarray) -> list[np.ndarray]:
        h, at = shingles(data, off, n)
        order = h >> U64(1)
        if len(frequent) and len(h):
            k = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
            order = np.where(frequent[k] == order, order | _TOP, order)
        members = []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            m = np.sort(order[a:z])  # at these sizes faster than np.unique, which hashes first
            m = m[np.concatenate(([True], m[1:] != m[:-1]))] if z > a else m
            members.append(m)
        return members

    @staticmethod
    def name(members: np.ndarray) -> int:
        return int(Sets.named([members])[0])

    @staticmethod
    def named(members: list[np.ndarray]) -> np.ndarray:
        """Names of sets, whatever the order of their members."""
        n = np.array([len(m) for m in members], dtype=np.int64)
        plain = np.concatenate([*members, np.zeros(0, U64)]) & ~_TOP
        sums = np.concatenate(([U64(0)], np.cumsum(mix(plain + U64(0x51ED2701)))))
        ends = np.cumsum(n)
        return mix(sums[ends] - sums[ends - n] + n.astype(U64)).view(np.int64)


def prefix(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first members of a set of n must hold one of any set that it links with."""
    return n - -(-n * percent // 100) + 1


def links(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many members sets of a and b members share at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def _text_hash() -> Column:
    return F.xxhash64("text").alias("hash")


def documents_sets(documents: DataFrame, s: Settings) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, name, hash of the text of every row; the shingles to put last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        members, rows = [], 0
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                sets = Sets(data, off, s.n, np.zeros(0, U64))
                n = np.array([len(m) for m in sets.members], dtype=np.int64)
                for m, name in zip(sets.members, sets.names.tolist(), strict=True):
                    if name not in seen:
                        seen.add(name)
                        members.append(m)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.record_batch({"doc_id": b.column(0).slice(lo, hi - lo), "n": pa.array(n), "name": pa.array(sets.names, mask=n == 0), "hash": b.column(2).slice(lo, hi - lo), "shingle": none, "df": none})
                rows += hi - lo
        if members:
            shingle, df = np.unique(np.concatenate(members), return_counts=True)
            often = df >= max(4, len(seen) // 1000)
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.record_batch({"doc_id": none, "n": none, "name": none, "hash": none, "shingle": pa.array(shingle[often].view(np.int64)), "df": pa.array(df[often])})

    both = stored(documents.select("doc_id", "text", _text_hash()).mapInArrow(run, "doc_id long, n long, name long, hash long, shingle long, df long"), "sets")
    top = both.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "shingle").limit(s.frequent).select("shingle").toPandas()
    return both.where("shingle is null").select("doc_id", "n", "name", "hash"), np.sort(top["shingle"].to_numpy(np.int64).view(U64))


def postings(documents: DataFrame, s: Settings, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(shingle, name, size, place, reach of every prefix member that at least two sets post, besides rows without a
    shingle; pairs a, b of sets and the first sets of their blocks, near; and of sets and the first set of a list,
    which may be too far to link with it)."""
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = (1 << LIST_BITS) // parts + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = np.array([h[0] for h in held], dtype=np.int64)
            sizes = np.array([h[1] for h in held], dtype=np.int64)
            token = np.concatenate([h[2] for h in held])
            reach = np.array([_reach(h[2]) for h in held], dtype=np.int64)
            owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            place = np.concatenate([np.arange(len(h[2])) for h in held])
            # members of one key share a list; that adds pairs to compare, never links
            token = mix(token) >> U64(64 - LIST_BITS)
            part = token // U64(width)
            order = np.lexsort((token, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1).astype(U64))
            for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if z > a:
                    o = order[a:z]
                    used, index = np.unique(owner[o], return_inverse=True)
                    yield pa.record_batch({"part": [k], "token": [planes(np.diff(token[o], prepend=U64(0)))], "set": [planes(index)], "place": [planes(place[o])], "names": [names[used].tobytes()], "sizes": [planes(sizes[used])], "reach": [planes(reach[used])]})

        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                sets = Sets(data, off, s.n, frequent)
                for m, name in zip(sets.members, sets.names.tolist(), strict=True):
                    if len(m) and name not in seen:
                        seen.add(name)
                        held.append([name, len(m), m[: prefix(len(m), s.percent)]])
                        size += len(held[-1][2])
            if size > 3_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                index = from_planes(r["set"]).astype(np.int64)
                by.setdefault(r["part"], []).append((np.cumsum(from_planes(r["token"]), dtype=U64), np.frombuffer(r["names"], np.int64)[index], from_planes(r["sizes"])[index], from_planes(r["place"]), from_planes(r["reach"])[index]))
        for k in sorted(by):
            token, name, size, place, reach = (np.concatenate(x) for x in zip(*by.pop(k), strict=True))
            order = np.lexsort((name, token))
            token, name, size, place, reach = (x[order] for x in (token, name, size, place, reach))
            same = (token[1:] == token[:-1]) & (name[1:] == name[:-1])  # one set met in several tasks
            keep = np.concatenate(([True], ~same))
            token, name, size, place, reach = (x[keep] for x in (token, name, size, place, reach))
            again = token[1:] == token[:-1]
            keep = np.concatenate(([False], again)) | np.concatenate((again, [False]))
            token, name, size, place, reach = (x[keep].astype(t) for x, t in ((token, U64), (name, np.int64), (size, np.int64), (place, np.int64), (reach, np.int64)))
            yield _rows(STAR, *_stars(token, name, size, place, s))
            for a in range(0, len(token), 65_536):
                x = slice(a, a + 65_536)
                yield _rows(POSTED, token[x].view(np.int64), name[x], size[x], place[x], reach[x])

    packed = documents.select("text").mapInArrow(post, "part long, token binary, set binary, place binary, names binary, sizes binary, reach binary").repartition(parts, "part")
    both = stored(packed.mapInArrow(meet, ", ".join(f"{c} long" for c in POSTED + STAR)), "postings")
    stars = both.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.min("least").alias("least"))
    # a list in four is looked at, and where two sets share less than half of what linked sets would, the crossing pass decides
    return both, stars.where("greatest(n, m) * 8 >= least").select("a", "b", F.expr("n * 8 >= least").alias("near"))


POSTED, STAR = ("shingle", "name", "size", "place", "reach"), ("a", "b", "n", "m", "least")


def _reach(members: np.ndarray) -> int:
    """32 * (members of a prefix up to its last mark) + (marks it reaches)."""
    marks = int(np.searchsorted(MARKS, members[-1], side="right"))
    return 32 * int(np.searchsorted(members, MARKS[marks - 1], side="right")) + marks if marks else 0


def _rows(names: tuple[str, ...], *columns: np.ndarray) -> pa.RecordBatch:
    given = {c: pa.array(x) for c, x in zip(names, columns, strict=True)}
    return pa.record_batch({c: given.get(c, pa.nulls(len(columns[0]), pa.int64())) for c in POSTED + STAR})


def _stars(token: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """a, b, n, m, least: in a quarter of the lists, how often sets meet one of the first sets of their block that
    position does not rule out (n), and the first set of the whole list where it does (m)."""
    some = ((mix(token) & U64(3)) == 0) | (place < 4)
    token, name, size, place = token[some], name[some], size[some], place[some]
    block = np.floor(np.log(size) / np.log(100 / s.percent) + 1e-9).astype(np.int64)
    order = np.lexsort((name, place, block, token))
    token, name, size, place, block = (x[order] for x in (token, name, size, place, block))
    rows = np.arange(len(token))
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    new_list = np.concatenate(([True], token[1:] != token[:-1]))
    head = np.maximum.accumulate(np.where(new_list | np.concatenate(([True], block[1:] != block[:-1])), rows, 0))

    def near(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        far = np.abs(place[i] - place[k]) + np.abs((size[i] - place[i]) - (size[k] - place[k]))
        return far * (100 + s.percent) <= (100 - s.percent) * (size[i] + size[k])

    left, right = [], []
    for j in range(s.heads):
        later = np.flatnonzero(rows - head > j)
        ok = near(later, head[later] + j)
        left.append(later[ok])
        right.append(head[later][ok] + j)
    counted = sum(map(len, left))
    least_place = np.lexsort((name, place, token))
    first = least_place[np.flatnonzero(new_list)][np.cumsum(new_list) - 1]
    away = np.flatnonzero((first != rows) & ~near(rows, first))
    i, k = np.concatenate((*left, away)), np.concatenate((*right, first[away]))
    pair, inverse = np.unique(np.stack((np.minimum(name[i], name[k]), np.maximum(name[i], name[k]))), axis=1, return_inverse=True)
    inverse = inverse.ravel()
    n, m = (np.bincount(inverse[part], minlength=pair.shape[1]) for part in (slice(counted), slice(counted, None)))
    # in a long list one meeting with the first is enough, as it would be left to all pairs else
    members = np.diff(np.append(np.flatnonzero(new_list), len(rows)))[np.cumsum(new_list) - 1]
    enough = (members[i] >= s.long_list) & ((k == head[i]) | (k == first[i]))
    least = np.full(pair.shape[1], np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, np.where(enough, 0, np.minimum(prefix(size[i], s.percent), prefix(size[k], s.percent))))
    return pair[0], pair[1], n, m, least


def first_texts(rows: DataFrame) -> DataFrame:
    """(name, hash of one of its texts) of every set of rows that ``documents_sets`` has given."""
    return rows.where("name is not null").groupBy("name").agg(F.min("hash").alias("hash"))


def packed_texts(documents: DataFrame, named: DataFrame, s: Settings, frequent: np.ndarray, texts: DataFrame | None = None) -> DataFrame:
    """name, packed of the sets that named(name) lists, one row each; a few others may be there, too.

    packed is a compressed text with that set, a fraction of the size of the set's hashes, which do not compress.
    texts are the documents' ``first_texts``: only texts with the hash of a listed set are made sets again."""
    texts = first_texts(documents_sets(documents, s)[0]) if texts is None else texts
    # hashes are mixed already, so their low bits serve
    bits = texts.join(named, "name", "left_semi").selectExpr(f"pmod(hash, {1 << s.bitmap_bits}) as bit").groupBy(F.expr("shiftright(bit, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
    # at most 2**(bits - 6) rows, whatever the number of names
    got = bits.toPandas()
    bitmap = np.zeros(1 << (s.bitmap_bits - 6), dtype=np.int64)
    bitmap[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    hashed = documents.select("text", _text_hash())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            bit = b.column(1).to_numpy() % (1 << s.bitmap_bits)
            maybe = (bitmap[bit >> 6] >> (bit & 63)) & 1
            for _, _, data, off in chunks(b.column(0).take(pa.array(np.flatnonzero(maybe)))):
                sets = Sets(data, off, s.n, frequent)
                out = []
                for k, name in enumerate(sets.names.tolist()):
                    if len(sets.members[k]) and name not in seen:
                        seen.add(name)
                        out.append((name, packed_text(data[off[k] : off[k + 1]].tobytes())))
                if out:
                    yield pa.record_batch({"name": pa.array([o[0] for o in out], pa.int64()), "packed": pa.array([o[1] for o in out], pa.binary())})

    return hashed.mapInArrow(run, "name long, packed binary").dropDuplicates(["name"])


def packed_text(text: bytes) -> bytes:
    """A text with the same set, in lower case and with single spaces, compressed: a fifth less than deflate leaves."""
    plain = b" ".join(text.lower().split())  # of ASCII both, as ``words`` parts and folds
    return bz2.compress(plain, 1 if len(plain) < 100_000 else 9)


def unpacked(texts: list[bytes], s: Settings, frequent: np.ndarray) -> dict[bytes, np.ndarray]:
    """The members of each packed text's set; a text that repeats is hashed once."""
    each = list(dict.fromkeys(texts))
    members: list[np.ndarray] = []
    for _, _, data, off in chunks(pa.array([bz2.decompress(x) for x in each], pa.binary())):
        members += Sets.ordered(data, off, s.n, frequent)
    return dict(zip(each, members, strict=True))


def compared(documents: DataFrame, texts: DataFrame, pairs: DataFrame, s: Settings, frequent: np.ndarray) -> DataFrame:
    """(a, b, link) of pairs(a, b, refers), and where refers, with a the reference of b, also: held = |a|, dp and dm =
    how many members b has more and lacks, short = how long a prefix of these differences serves for partners that
    do not link with a, and the prefix that b posts, members more first."""
    # both joins take the texts from the one exchange by name
    packed = packed_texts(documents, pairs.select(F.explode(F.array("a", "b")).alias("name")), s, frequent, texts)
    both = pairs.join(packed.withColumnsRenamed({"name": "b", "packed": "y"}), "b").join(packed.withColumnsRenamed({"name": "a", "packed": "x"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _TEXTS) for b in batches for k in range(0, b.num_rows, _TEXTS)):
            link, rows = [], []
            xs, ys = (batch.column(k).to_pylist() for k in (2, 3))
            members = unpacked(xs + ys, s, frequent)
            for x, y, refers in zip(xs, ys, batch.column(4).to_pylist(), strict=True):
                h, q = members[x], members[y]
                more = h[np.minimum(np.searchsorted(h, q), len(h) - 1)] != q
                shared = len(q) - int(more.sum())
                link.append(bool(links(shared, len(h), len(q), s.percent)))
                if not refers:
                    rows.append((None,) * 5)
                    continue
                less = h[q[np.minimum(np.searchsorted(q, h), len(q) - 1)] != h]
                dp, dm = len(q) - shared, len(less)
                short = dp + dm - (s.percent * dp + 100 * dm) // (100 + s.percent)
                longer = short if link[-1] else max(short, dp + dm - (needed(len(q), len(h), s.percent) - shared) + 1)
                rows.append((len(h), dp, dm, short, np.concatenate((q[more], less))[:longer].tobytes()))
            numbers = {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("held", "dp", "dm", "short"))}
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "link": pa.array(link, pa.bool_()), **numbers, "differences": pa.array([r[4] for r in rows], pa.binary())})

    return both.select("a", "b", "x", "y", "refers").mapInArrow(run, "a long, b long, link boolean, held long, dp long, dm long, short long, differences binary")


def references(stars: DataFrame, hops: int = 3) -> DataFrame:
    """(name, ref) of every set of stars(a, b): of the sets within so many meetings of it, itself included, the one that
    most sets met.  Two favourites of one family become one, as some set met both."""
    both = stars.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(stars.select(F.col("b").alias("name"), F.col("a").alias("other")))
    ref = stored(both.groupBy("name").agg(F.struct(F.count("*").alias("pairs"), F.col("name").alias("ref")).alias("top")), "references")
    for _ in range(hops):
        seen = both.join(ref.withColumnRenamed("name", "other"), "other").select("name", "top").unionByName(ref)
        ref, old = stored(seen.groupBy("name").agg(F.max("top").alias("top")), "references"), ref
        discard(old)
    return ref.select("name", F.col("top.ref").alias("ref"))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole lists of rows sorted by the first column, many at a time."""
    held: list[pa.RecordBatch] = []
    for b in _and_none(batches):
        if b is not None:
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
        if not held:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [t.column(k).to_numpy() for k in range(t.num_columns)]
        end = len(columns[0])
        if b is not None:
            end = int(np.searchsorted(columns[0], columns[0][-1]))
        if end:
            yield [c[:end] for c in columns]
        held = t.slice(end).to_batches() if b is not None else []


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _meetings(starts: np.ndarray, ends: np.ndarray, size: np.ndarray, part: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one list, of different parts and with sizes that may link, in blocks.

    The largest part of a list is not held against itself."""
    left, right, held = [], [], 0
    for lo, hi in zip(starts, ends, strict=True):
        order = lo + np.argsort(size[lo:hi], kind="stable")
        sizes, parts = size[order], part[order]
        values, counts = np.unique(parts, return_counts=True)
        largest = values[np.argmax(counts)]
        others = np.flatnonzero(parts != largest)
        low = np.searchsorted(sizes, -(-sizes[others] * percent // 100))
        n = np.searchsorted(sizes, sizes[others] * 100 // percent, side="right") - low
        ahead = np.concatenate(([0], np.cumsum(n)))
        a = 0
        while a < len(others):
            z = max(a + 1, int(np.searchsorted(ahead, ahead[a] + _PAIRS, side="right")) - 1)
            i = np.repeat(others[a:z], n[a:z])
            j = np.arange(len(i)) + np.repeat(low[a:z] - ahead[a:z] + ahead[a], n[a:z])
            apart = (parts[i] != parts[j]) & ((parts[j] == largest) | (j > i))
            left.append(order[i[apart]])
            right.append(order[j[apart]])
            held += len(left[-1])
            a = z
            if held >= _PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return pa.record_batch({"a": pa.array(pair[0]), "b": pa.array(pair[1])})


def _mixed_lists(key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists begin and end that hold more than one part."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(first[1:], len(key))
    mixed = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
    return first[mixed], ends[mixed]


def cross_pairs(posted: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """a, b of different references and groups that may still link; known(name, ref, part)."""
    upto = F.expr("shiftright(reach, 5)")
    grouped = posted.where("shingle is not null").select(*POSTED).join(known, "name", "left").withColumns({c: F.coalesce(c, "name") for c in ("ref", "part")})
    after = Window.partitionBy("name").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("name").orderBy("place")
    posted_after = F.coalesce(F.sum((F.col("place") < upto).cast("long")).over(after), F.lit(0))
    grouped = grouped.select("shingle", "name", "size", "place", "part", "ref", (F.greatest(upto - F.col("place") - 1, F.lit(0)) - posted_after).alias("own"), F.expr("reach & 31").alias("marks"), F.lag("shingle", 1).over(line).alias("last"), F.lag("shingle", 2).over(line).alias("second"))
    # null where none is before; the shingle itself stands for that, as it cannot be before itself
    grouped = grouped.withColumns({c: F.coalesce(c, "shingle") for c in ("last", "second")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, name, size, place, part, ref, own, marks, last, second in _by_key(batches):
            for i, j in _meetings(*_mixed_lists(shingle, ref), size, ref, s.percent):
                # were this the first shared member, they would share no more than their rests, without what is in one alone
                most = np.minimum(size[i] - place[i] - np.where(marks[i] <= marks[j], own[i], 0), size[j] - place[j] - np.where(marks[j] <= marks[i], own[j], 0))
                near = links(most, size[i], size[j], s.percent) & (part[i] != part[j])
                i, j, here = i[near], j[near], shingle[i[near]]
                met = np.zeros(len(i), bool)
                for before in (last, second):
                    met |= (before[i] != here) & ((before[i] == last[j]) | (before[i] == second[j]))
                yield _pairs(name[i[~met]], name[j[~met]])

    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(parts, "shingle").sortWithinPartitions("shingle").mapInArrow(run, "a long, b long").distinct()


def difference_pairs(differences: DataFrame, s: Settings) -> DataFrame:
    """a, b of one reference and different groups that may still link, from lists of differences alone.

    differences(ref, name, part, link, held, dp, dm, short, differences), link: name links with ref."""
    values = ("key", "name", "part", "place", "held", "dp", "dm", "link", "serves")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, U64) for x in b.column(8).to_pylist()]
            n = np.array([len(x) for x in lists])
            ref, name, part, link, held, dp, dm, short = (np.repeat(b.column(k).cast(pa.int64()).to_numpy(), n) for k in range(8))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = mix(mix(np.concatenate([*lists, np.zeros(0, U64)])) + mix(ref.view(U64)) + (place >= dp).astype(U64)).view(np.int64)
            yield pa.record_batch(dict(zip(values, (pa.array(x) for x in (key, name, part, place, held, dp, dm, link, (place < short).astype(np.int64))), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, name, part, place, held, dp, dm, link, serves in _by_key(batches):
            size = held - dm + dp
            for i, j in _meetings(*_mixed_lists(key, part), size, part, s.percent):
                # what they share of the reference, and so how many differences they must share
                must = needed(size[i], size[j], s.percent) - (held[i] - dm[i] - dm[j])
                rest = np.minimum(dp[i] + dm[i] - place[i], dp[j] + dm[j] - place[j])
                near = (rest >= must) & ((link[i] + link[j] == 1) | (serves[i] + serves[j] == 2)) & (link[i] + link[j] < 2)
                yield _pairs(name[i[near]], name[j[near]])

    parts = int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = differences.select("ref", "name", "part", "link", "held", "dp", "dm", "short", "differences").mapInArrow(post, ", ".join(f"{c} long" for c in values))
    return posted.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def join(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents(doc_id, text)."""
    s = settings
    rows, frequent = documents_sets(documents, s)
    texts = first_texts(rows)
    posted, stars = postings(documents, s, frequent)
    stars = stored(stars, "stars")
    refs = references(stars)
    refers = refs.where("name <> ref").select(F.col("ref").alias("a"), F.col("name").alias("b"), F.lit(True).alias("refers"))
    known_pairs = refers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    asked = stored(stars.where("near").drop("near").join(known_pairs, ["a", "b"], "left_anti").withColumn("refers", F.lit(False)).unionByName(refers), "asked")
    told = stored(compared(documents, texts, asked, s, frequent), "compared")
    first = told.where("link").select("a", "b")
    groups = stored(components(first), "groups")
    # a set that shares little with its reference has none
    near = stored(told.where(3 * (F.col("held") - F.col("dm")) >= F.col("held") + F.col("dp")).withColumnsRenamed({"a": "ref", "b": "name"}), "near")
    own = refs.select("name").join(near.select("name", "ref"), "name", "left").join(groups.withColumnRenamed("node", "name"), "name", "left")
    known = stored(own.select("name", F.coalesce("ref", "name").alias("ref"), F.coalesce("component", "name").alias("part")), "known")
    # a reference that links with all that refer to it leaves nothing to look for among these
    open_refs = near.where("not link").select("ref").distinct()
    differences = near.join(open_refs, "ref", "left_semi").join(known.select("name", "part"), "name")
    more = stored(cross_pairs(posted, known, s).unionByName(difference_pairs(differences, s)), "crossing").withColumn("refers", F.lit(False))
    discard(posted)
    second = stored(compared(documents, texts, more, s, frequent).where("link").select("a", "b"), "links")
    whole = components(first.unionByName(second)) if second.head(1) else groups
    named = rows.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least")).join(whole.withColumnRenamed("node", "name"), "name", "left")
    named = stored(named.select("name", "least", F.coalesce("component", "name").alias("component")), "named")
    discard(stars, asked, told, near, groups, known, second)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_name = named.join(ids, "component").select("name", "component_id")
    return rows.join(of_name, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents that stay: of each component the smallest doc_id, and every row without
    shingles or without an id.  Of rows that repeat an id that stays, one stays."""
    found = stored(join(documents, settings), "components")
    stay = found.where((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull())
    own = unused("stay", documents)
    stay = stay.groupBy(F.col("doc_id").alias(own)).count()
    kept = documents.join(stay.select(own), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    if not stay.where(F.col("count") > 1).where(F.col(own).isNotNull()).head(1):
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op4: all pairs of distinct sets that share a shingle."""
    return r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as shingles from d),
k as (select md5(array_to_string(shingles, chr(10))) k, any_value(shingles) shingles, min(doc_id) least, any_value(len(shingles)) n from s where len(shingles) > 0 group by 1),
p as (select k, n, unnest(shingles) x from k),
links as (select a.k u, b.k w from p a join p b using (x) where a.k <> b.k group by a.k, b.k, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c as (with recursive r(x, y) as (select k, k from k union select r.x, links.w from r join links on links.u = r.y) select r.x k, min(k.least) component_id from r join k on k.k = r.y group by 1)
select doc_id, len(shingles)::bigint n_shingles, coalesce(component_id, doc_id) component_id from s left join c on len(shingles) > 0 and c.k = md5(array_to_string(shingles, chr(10)))"""
