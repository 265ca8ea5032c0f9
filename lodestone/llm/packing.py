"""Packing documents into fixed-length token sequences in bounded space.

Method.  Each partition keeps at most ``windows`` open windows of ``length`` tokens.  A document's
full lengths become sequences of their own; what is left goes to the open window it fits best, or
opens one.  When none fits and all are open, the fullest is topped up with a piece cut from the
document and emitted.  Windows still open at a partition's end are leftovers: those of ``merge``
partitions meet in one task and are laid end to end, cut at the length, so that at most one short
sequence remains for each such group.

Token ids come from the tokenizer file for each distinct word of a chunk once; words that the
tokenizer would normalise or split go through its whole pipeline, plain words through its model.
The only shuffle is of leftovers: at most windows x length tokens a partition.

Defined cases.  A null or empty text has the end token only.  Null ids and repeated rows are packed
like others, each row as a document.  Very long documents are cut.  An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import CHUNK, chunks
from lodestone.llm.shared import stored, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TAIL = r"^(?P<word>[a-z]+)(?P<signs>[!-&(-/:-@\[-`{-~]+)$"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of many texts at once, equal to the tokenizer's own for each."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # one model in memory: its two ways of parting a text are put in turn
        self.full = Tokenizer.from_file(path)
        self._own = self.full.normalizer, self.full.pre_tokenizer
        self._bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain words end to end, how many each has)."""
        each = words.to_pylist()
        joined = [" ".join(each[i : i + 512]) for i in range(0, len(each), 512)]
        self.full.normalizer, self.full.pre_tokenizer = self._bare
        try:  # few encodings are held at a time; they are many times the size of their ids
            flat = np.fromiter(chain.from_iterable(e.ids for i in range(0, len(joined), 8) for e in self.full.encode_batch_fast(joined[i : i + 8], add_special_tokens=False)), np.int32)
        finally:
            self.full.normalizer, self.full.pre_tokenizer = self._own
        return flat, np.diff(np.flatnonzero(self.last[flat]) + 1, prepend=0)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that need the whole tokenizer."""
        each = words.to_pylist()
        ids = [e.ids for i in range(0, len(each), 4096) for e in self.full.encode_batch_fast(each[i : i + 4096], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin and number of the two runs of ids of each word, a row each); a word holds no space or newline
        and no A-Z.  The first run is of a plain word, the second of signs after it or of any other word."""
        alone = pc.match_substring_regex(words, "^[a-z]+$")
        # letters that the tokenizer's normaliser leaves as they are
        wide = pc.and_(pc.and_(pc.utf8_is_alpha(words), pc.match_substring_regex(words, r"^[\x{0}-\x{24f}]+$")), pc.equal(words, pc.utf8_lower(words)))
        plain = pc.or_(alone, wide)
        parted = pc.extract_regex(words, _TAIL)
        tailed = pc.and_(parted.is_valid(), pc.invert(plain))
        missing = pa.scalar(None, words.type)
        first = pc.if_else(plain, words, pc.if_else(tailed, pc.struct_field(parted, "word"), missing)).dictionary_encode()
        second = pc.if_else(plain, missing, pc.if_else(tailed, pc.struct_field(parted, "signs"), words)).dictionary_encode()
        a, n = self._plain(first.dictionary)
        b, m = self._whole(second.dictionary)
        runs = np.zeros((len(words), 4), dtype=np.int64)
        for k, (coded, sizes, base) in enumerate(((first, n, 0), (second, m, len(a)))):
            at = np.flatnonzero(coded.is_valid().to_numpy(zero_copy_only=False))
            index = coded.indices.drop_null().to_numpy()
            runs[at, 2 * k], runs[at, 2 * k + 1] = (np.cumsum(sizes) - sizes + base)[index], sizes[index]
        return np.concatenate((a, b)), runs[:, ::2], runs[:, 1::2]

    def of_texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text), each text's ids followed by the end token."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        # a text that may hold a special token's mark goes through the tokenizer as it is
        odd = pc.match_substring(texts, "<|") if all(m.startswith("<|") for m in self.marks) else pa.array([True] * len(texts))
        whole = {i: np.array(self.full.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.int32) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        parts = pc.split_pattern(pc.replace_substring(pc.ascii_lower(pc.if_else(odd, "", texts)), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        flat, begin, size = self.of_words(coded.dictionary)
        index = coded.indices.to_numpy()
        begin, n = begin[index].ravel(), size[index].ravel()
        before = np.concatenate(([0], np.cumsum(n)))
        got, cuts = flat[np.arange(before[-1]) + np.repeat(begin - before[:-1], n)], before[2 * np.asarray(parts.offsets)]
        out, offsets = [], [0]
        for i in range(len(texts)):
            out += [whole.get(i, got[cuts[i] : cuts[i + 1]]), np.array([end], np.int32)]
            offsets.append(offsets[-1] + len(out[-2]) + 1)
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.array(offsets, dtype=np.int64)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one partition; rows are (doc, start, length, ids, doc_tokens, window, offset)."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.windows, self.next = length, windows, first
        self.gaps: list[tuple[int, int]] = []  # (gap, window), in order
        self.held: dict[int, list[tuple]] = {}

    def _open(self) -> tuple[int, int]:
        self.next += 1
        self.held[self.next] = []
        return self.length, self.next

    def _put(self, gap: int, window: int, doc: int | None, ids: np.ndarray, start: int, n: int) -> list[tuple]:
        """Puts ids[start:start + n] in the window; returns the window's rows if that fills it."""
        self.held[window].append((doc, start, n, ids[start : start + n], len(ids), window, self.length - gap))
        if gap == n:
            return self.held.pop(window)
        bisect.insort(self.gaps, (gap - n, window))
        return []

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        while start < len(ids):
            rest = len(ids) - start
            if rest >= self.length:
                out += self._put(*self._open(), doc, ids, start, self.length)
                start += self.length
                continue
            k = bisect.bisect_left(self.gaps, (rest, -1))
            if k < len(self.gaps):
                gap, window = self.gaps.pop(k)
            elif len(self.gaps) < self.windows:
                gap, window = self._open()
            else:
                gap, window = self.gaps.pop(0)
            n = min(gap, rest)
            out += self._put(gap, window, doc, ids, start, n)
            start += n
        return out

    def leftovers(self) -> list[tuple]:
        return [row for _, w in self.gaps for row in self.held[w]]


def _batch(rows: list[tuple], left: list[tuple], group: int) -> pa.RecordBatch:
    every = rows + left
    col = lambda k: pa.array([r[k] for r in every], pa.int64())
    return pa.record_batch(
        {
            "doc_id": col(0), "start": col(1), "length": col(2), "ids_crc32": pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in every], pa.int64()), "doc_tokens": col(4), "sequence_id": col(5), "offset": col(6),
            "ids": pa.array([None] * len(rows) + [r[3].astype("<i4").tobytes() for r in left], pa.binary()), "part": pa.array([group] * len(every), pa.int64()),
        }
    )


def pack(documents: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, windows: int = 64, merge: int = 32) -> DataFrame:
    """Pieces of documents(doc_id, text): PIECES."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(length, windows, part << 32)
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for lo, hi, _, _ in chunks(b.column(1), CHUNK):
                ids, off = coder.of_texts(b.column(1).slice(lo, hi - lo), end)
                rows: list[tuple] = []
                for i in range(hi - lo):
                    rows += packer.add(ids_of[lo + i], ids[off[i] : off[i + 1]].copy())
                if rows:
                    yield _batch(rows, [], part)
        if left := packer.leftovers():
            yield _batch([], left, part)

    placed = stored(documents.select("doc_id", "text").mapInArrow(fill, PIECES + ", ids binary, part long"), "pieces")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["part"], r["sequence_id"], r["offset"]))
        first = (1 << 62) + (TaskContext.get().partitionId() << 32)
        out, fillings = [], 0
        for r in rows:
            ids, start = np.frombuffer(r["ids"], "<i4"), 0
            while start < len(ids):
                n = min(len(ids) - start, length - fillings % length)
                out.append((r["doc_id"], r["start"] + start, n, ids[start : start + n], r["doc_tokens"], first + fillings // length, fillings % length))
                fillings, start = fillings + n, start + n
        if out:
            yield _batch(out, [], 0).select([c.split()[0] for c in PIECES.split(", ")])

    left = placed.where("ids is not null").withColumn("pool", (F.col("part") / merge).cast("long"))
    merged = left.repartition("pool").drop("pool").mapInArrow(join, PIECES)
    return placed.where("ids is null").drop("ids", "part").unionByName(merged)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
