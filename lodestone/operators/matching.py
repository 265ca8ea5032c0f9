"""Scores of a set of questions against all pieces by the words they share, a batch of pieces at a time.

Pieces are reduced once to the questions' own terms and their counts; scores are then products of a batch's weights
with the terms of a block of questions, and only each partition's best rows of a question become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.nearest import Kept
from lodestone.operators.prepare import postings
from lodestone.sources.tables import stored

CELLS = 4_000_000  # of the matrices of one step


class Asked:
    """The distinct (query, term) of questions(query, text): a stated set, held as arrays."""

    def __init__(self, questions: DataFrame):
        rows = postings(questions, "query").select("query", "term").toArrow()
        query, term = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
        if isinstance(query, pa.ChunkedArray):
            query, term = query.combine_chunks(), term.combine_chunks()
        self.kind = questions.schema["query"].dataType.simpleString()
        self.ids, self.terms = query.dictionary, term.dictionary
        none = query.indices.null_count > 0  # a null id is a query too
        self.n = len(self.ids) + none
        self.query, self.term = np.asarray(query.indices.fill_null(len(self.ids)), dtype=np.int64), np.asarray(term.indices, dtype=np.int64)
        if none:
            self.ids = pa.concat_arrays([self.ids, pa.nulls(1, self.ids.type)])


def reduced(pieces: DataFrame, terms: pa.Array) -> DataFrame:
    """piece, dl, terms, tfs of pieces(piece, text): the number of words, and how often each of these terms is one; written."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+"), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("words")
            lengths = np.asarray(w.value_lengths().fill_null(0), dtype=np.int64)
            at = pc.index_in(w.flatten(), value_set=terms)
            known = np.asarray(at.is_valid())
            row = np.repeat(np.arange(b.num_rows), lengths)[known]
            key, count = np.unique(row * max(len(terms), 1) + np.asarray(at.drop_null(), dtype=np.int64), return_counts=True)
            row = key // max(len(terms), 1)
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % max(len(terms), 1), count)]
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("dl"), *lists], ["piece", "dl", "terms", "tfs"])

    kind = pieces.schema["piece"].dataType.simpleString()
    tokens = pieces.select("piece", words.alias("words")).select("piece", F.size("words").alias("dl"), "words")
    return stored(tokens.mapInArrow(run, f"piece {kind}, dl int, terms array<int>, tfs array<int>"), "terms")


def frequencies(table: DataFrame, n: int) -> np.ndarray:
    """In how many pieces of a reduced table each of n terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, np.int64)
        for b in batches:
            seen += np.bincount(np.asarray(b.column("terms").flatten()), minlength=n)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])

    out = np.zeros(n)
    for r in table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the questions
        out[r.term] = r.df
    return out


def best(table: DataFrame, asked: Asked, weight: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int, digits: int, most: int = 500) -> Iterator[DataFrame]:
    """For each block of at most ``most`` questions, query, piece, score of a reduced table: of each partition at least each
    question's k best of the pieces that share a term.  The score is the sum of weight(term, tf, dl) over shared terms."""
    piece_type, ids = table.schema["piece"].dataType.simpleString(), asked.ids
    for at in range(0, asked.n, most):
        mine = (asked.query >= at) & (asked.query < at + most)
        here, local = np.unique(asked.term[mine], return_inverse=True)
        query, n = asked.query[mine] - at, min(most, asked.n - at)
        column = np.full(len(asked.terms), -1)
        column[here] = np.arange(len(here))

        def run(batches: Iterator[pa.RecordBatch], at=at, local=local, query=query, n=n, column=column, t=len(here)) -> Iterator[pa.RecordBatch]:
            holds = np.zeros((t, n))
            holds[local, query] = 1
            kept, kind, step = Kept(n, k, digits), None, max(1, CELLS // (t + n))
            for whole in batches:
                kind = whole.column("piece").type
                for a in range(0, whole.num_rows, step):
                    b = whole.slice(a, step)
                    term, tf = (np.asarray(b.column(c).flatten(), dtype=np.int64) for c in ("terms", "tfs"))
                    row = np.repeat(np.arange(b.num_rows), np.asarray(b.column("terms").value_lengths(), dtype=np.int64))
                    dl = np.asarray(b.column("dl").fill_null(0), dtype=np.float64)[row]
                    own = column[term] >= 0
                    weights = np.zeros((b.num_rows, t))
                    weights[row[own], column[term[own]]] = weight(term[own], tf[own], dl[own])
                    score = weights @ holds
                    kept.lift(np.where(score != 0, score, -np.inf))
                    i, q = np.nonzero((score != 0) & (score >= kept.floor))
                    kept.add(q, b.column("piece"), i, score[i, q], np.zeros(len(i), bool))
            yield from kept.batches(ids.slice(at, n), kind)

        yield table.mapInArrow(run, f"query {asked.kind}, piece {piece_type}, score double")
