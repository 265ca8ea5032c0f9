"""Encoding and decoding of whole texts with a byte-level BPE vocabulary.

Method.  A merge can join two neighbouring bytes only if they stand side by side inside some token of the
vocabulary.  A pair of bytes inside no token is therefore a forced boundary: every encoding has a cut there.
White space, which no token holds, cuts a text into words; the tokenizer's classes of signs cut a word into
pretokens; the table of byte pairs cuts these into fragments, all in one pass over the bytes of a chunk's distinct
words.  Each distinct fragment is merged by itself, once a chunk, and the ids are concatenated.  Fragments that
end a pretoken go to the library's merges in large batches; those that end at a forced boundary, which the library
cannot be given, are merged here from a heap (n log n).  Words with signs beyond ASCII and small Latin letters, with
a special token's mark or with an English contraction take the tokenizer's own normaliser and splitter first.

Only maps: no shuffle, and a task holds a chunk of texts, the vocabulary and memos of fixed size.

Defined cases.  A null or empty text, or one of white space, has no ids and decodes to ''; null ids decode to
''.  Repeated rows and null keys are rows like others.  Marks of special tokens in a text become their ids, as
the tokenizer does.  Ids that the vocabulary lacks are left out when decoding.  An empty table stays empty;
further columns stay, and one that has the result's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lodestone.llm.bytetext import buffers, give_back
from lodestone.llm.shared import table

MEMO, LONGEST = 1 << 16, 64  # entries of a memo; longer words and fragments are not kept in one
EASY, CONTRACTED = r"^[!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]*$", "(?i)'[stmdrvl]|<\\|"
_loaded: dict[str, Codec] = {}


def _kinds() -> np.ndarray:
    """1: letter, or byte of a letter beyond ASCII; 2: digit; 0: any other sign."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[65:91] = kind[97:123] = kind[128:] = 1
    kind[48:58] = 2
    return kind


KIND = _kinds()


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: visible Latin-1 as itself, the rest from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


def runs(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first row, end row) of successive runs of rows with about so many bytes; a longer row is a run of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(total):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + size, side="right")))
        yield row, end
        row = end
    give_back()


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin:begin + size] end to end, and where each begins (and the end)."""
    before = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(before[-1]) + np.repeat(begin - before[:-1], size)], before


class Memo(dict):
    """What ``make`` gives for a key, kept for keys that are not long; emptied when full."""

    def __init__(self, make, size: int = MEMO):
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


class Codec:
    """One tokenizer file: forced boundaries, merges, and the strings of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a vocabulary of plain byte-level BPE is needed")
        self.suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed(list(enumerate(merges)))}
        bodies = [t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t for t in vocab]
        self.joined = {t[i : i + 2] for t in bodies for i in range(len(t) - 1)}
        signs = {c for t in bodies for c in t}
        self.inner, self.final = ({c: vocab[c + end] for c in signs if c + end in vocab} for end in ("", self.suffix))
        if len(self.inner) < 256 or len(self.final) < 256:
            raise ValueError("the vocabulary lacks bytes")
        self.normal, self.splitter = full.normalizer, full.pre_tokenizer
        added = full.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added.values()):
            raise ValueError("added tokens must be plain marks")
        self.marks = {t.content: k for k, t in added.items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if added else None
        names = full.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for t, k in names.items():
            self.names[k] = t + " "
        self.inside, self.closing = Memo(lambda f: self.merge([self.inner[c] for c in f])), Memo(lambda f: self.merge([self.inner[c] for c in f[:-1]] + [self.final[f[-1]]]))
        self.words = Memo(self.word)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([t.endswith(self.suffix + " ") for t in self.names])
        self.sign = byte_signs()
        at = {c: i for i, c in enumerate(self.sign)}
        self.together = np.zeros((256, 256), dtype=bool)
        for x, y in self.joined:
            self.together[at[x], at[y]] = True

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges, lowest rank first, leftmost first among equals."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        heap.sort(key=lambda h: (h[0], h[2]))
        heap = [(k, i, new, a, b) for k, new, i, a, b in heap]
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def fragments(self, pretoken: str) -> list[str]:
        """The pretoken, cut at every pair of bytes that no token holds."""
        cuts = [i for i in range(1, len(pretoken)) if pretoken[i - 1 : i + 1] not in self.joined]
        return [pretoken[a:b] for a, b in zip([0, *cuts], [*cuts, len(pretoken)], strict=True)]

    def word(self, word: str) -> bytes:
        """The ids of a run without spaces or newlines, as little-endian unsigned 32-bit numbers."""
        ids: list[int] = []
        for part in self.mark.split(word) if self.mark and "<" in word else (word,):
            if part in self.marks:
                ids.append(self.marks[part])
            elif part:
                for pretoken, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(part) if self.normal else part):
                    *inner, last = self.fragments(pretoken)
                    for f in inner:
                        ids += self.inside[f]
                    ids += self.closing[last]
        return pack(f"<{len(ids)}I", *ids)

    def _easy(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, how many each has), for words whose pretokens their bytes tell."""
        data, off = buffers(pc.ascii_lower(words))
        data, off = data[off[0] : off[-1]], off - off[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        kind, pre = KIND[data], np.zeros(len(data) + 1, dtype=bool)
        pre[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        pre[off] = True
        cut = pre.copy()
        cut[1:-1] |= ~self.together[data[:-1], data[1:]]
        at = np.flatnonzero(cut)
        closes, first = pre[at[1:]], data[at[:-1]]
        every = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        whole = closes & ((first < 128) | (first >= 192))  # text by itself
        coded = every.filter(pa.array(whole)).dictionary_encode()
        each = coded.dictionary.cast(pa.large_string()).to_pylist()
        found = self.plain.encode_batch_fast([" ".join(each[i : i + 512]) for i in range(0, len(each), 512)], add_special_tokens=False)
        flat = np.fromiter((x for e in found for x in e.ids), np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        other = every.filter(pa.array(~whole)).dictionary_encode()
        texts = ["".join(map(self.sign.__getitem__, f)) for f in other.dictionary.to_pylist()]
        inner = [self.inside[f] for f in texts]
        closed = [self.closing[f] for f in texts] if (closes & ~whole).any() else [[]] * len(texts)
        more = np.array([x for ids in (*inner, *closed) for x in ids], dtype=np.uint32)
        n = np.array([len(ids) for ids in (*inner, *closed)], dtype=np.int64)
        begin, size = np.empty(len(closes), np.int64), np.empty(len(closes), np.int64)
        k = coded.indices.to_numpy(zero_copy_only=False)
        begin[whole], size[whole] = (np.cumsum(sizes) - sizes)[k], sizes[k]
        k = other.indices.to_numpy(zero_copy_only=False) + len(texts) * closes[~whole]
        begin[~whole], size[~whole] = (np.cumsum(n) - n)[k] + len(flat), n[k]
        ids, before = gathered(np.concatenate((flat, more)), begin, size)
        return ids, np.diff(before[np.searchsorted(at[:-1], off)])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin and number of each word's); a word holds no space or newline."""
        easy = pc.and_(pc.match_substring_regex(words, EASY), pc.invert(pc.match_substring_regex(words, CONTRACTED)))
        easy = pc.and_(easy, pc.equal(pc.utf8_lower(words), pc.ascii_lower(words))).to_numpy(zero_copy_only=False)
        ids, n = self._easy(words.filter(pa.array(easy)))
        hard = [self.words[w] for w in words.filter(pa.array(~easy)).to_pylist()]
        size = np.empty(len(words), np.int64)
        size[easy], size[~easy] = n, [len(w) // 4 for w in hard]
        begin = np.empty(len(words), np.int64)
        begin[easy], begin[~easy] = np.cumsum(n) - n, np.cumsum(size[~easy]) - size[~easy] + len(ids)
        return np.concatenate((ids, np.frombuffer(b"".join(hard), "<u4"))), begin, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        flat, begin, size = self.of_words(coded.dictionary)
        k = coded.indices.to_numpy()
        ids, before = gathered(flat, begin[k], size[k])
        cuts = before[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        data = memoryview(ids.astype("<u4").tobytes())
        return [bytes(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: bytes | None) -> str:
        """Names of the ids, a space between two, as a tokenizer without decoder has them."""
        known, names = np.frombuffer(ids or b"", "<u4"), self.names
        if len(known) and int(known.max()) >= len(names):
            known = known[known < len(names)]
        return "".join(map(names.__getitem__, known.tolist()))[:-1]


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _mapped(df: DataFrame, source: str, name: str, kind: BinaryType | StringType, of: str, tokenizer: str) -> DataFrame:
    at = df.columns.index(source)
    kept = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]
    fields = [StructField(df.columns[i], df.schema[i].dataType) for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = getattr(codec(tokenizer), of)
        for b in batches:
            for lo, hi in runs(b.column(at)):
                rows = b.slice(lo, hi - lo)
                got = pa.array(make(rows.column(at)) if of == "encode" else [make(x) for x in rows.column(at).to_pylist()], pa.binary() if of == "encode" else pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in kept] + [got], [f.name for f in fields] + [name])

    return df.mapInArrow(run, StructType([*fields, StructField(name, kind)]))


def encode(documents: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """documents with a binary column: the ids of the text as little-endian unsigned 32-bit numbers, as token files hold them."""
    return _mapped(documents, text, ids, BinaryType(), "encode", tokenizer)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a string column: what such ids decode to, special tokens included."""
    return _mapped(encoded, ids, text, StringType(), "decode", tokenizer)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
