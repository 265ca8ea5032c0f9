"""License scans with a positional rare-token index.

Method.  A first pass counts in how many documents each word of the templates occurs and so gives its
IDF.  The index maps a word to postings (template, position): those of each template's anchor, the word of
its mandatory key phrase with the highest IDF.  In a second pass a file's words are looked up in it, and
each posting met puts its template at the place less the position, so a file pays for the anchors that
it holds and not for the templates there are.  All candidates of a chunk are then met with their templates'
words by relative position at once: the key phrase has to stand there whole, and the IDF of the words that
agree, as a share of the template's, has to reach its least value (1 for base phrases, so these are exact).

The anchor stands at every place that can count, as the key phrase does.
The index is fixed by the templates and travels with the task; both passes are maps over whole
texts; only counts by template word are shuffled.

Defined cases.  Null texts are empty; a text without words or without licence words has counts 0,
null first and last word, empty labels and score 0.  Overlapping places of one phrase all count.
Rows are judged one by one, so repeated rows and null ids keep their own results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bytetext import ALNUM, Hasher, chunks, mix, word_hash, words
from lodestone.llm.shared import table


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    least: float
    base: bool = False


# Base phrases with their labels, then the method's own templates.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", 1.0, True),
    Template("gpl", "general public license", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", "all rights reserved", 1.0, True),
    Template("mit", "released under the mit license", "mit license", 0.7),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 0.7),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license", 0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source", 0.7),
    Template("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license", 0.7),
    Template("cc", "licensed under a creative commons attribution license", "creative commons", 0.7),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain under the cc0 waiver", "to the extent possible under law", 0.7),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify", 0.7),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable", 0.7),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 0.7),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license", 0.7),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license", 0.7),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license", 0.7),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license", 0.7),
)


class Index:
    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float] | None = None):
        self.templates = templates
        self.words = sorted({w for t in templates for w in t.text.split()})
        hashes = np.array([word_hash(w) for w in self.words], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        code = {w: i for i, w in enumerate(self.words)}
        self.idf = np.array([(idf or {}).get(w, 1.0) for w in self.words])
        self.coded = [np.array([code[w] for w in t.text.split()]) for t in templates]
        self.keys = []
        for t in templates:
            all_words, key = t.text.split(), t.key.split()
            at = next(i for i in range(len(all_words)) if all_words[i : i + len(key)] == key)
            self.keys.append((at, at + len(key)))
        self.low, self.high = np.array(self.keys).T
        self.length, self.least = np.array([len(c) for c in self.coded]), np.array([t.least for t in templates])
        self.base = np.array([t.base for t in templates])
        self.own, self.begin = np.concatenate(self.coded), np.cumsum(self.length) - self.length
        self.whole = np.array([self.idf[c].sum() for c in self.coded])
        # postings by word: (template, position) of the anchors
        anchors = [max(range(low, high), key=lambda p, own=own: self.idf[own[p]]) for own, (low, high) in zip(self.coded, self.keys, strict=True)]
        word = np.array([own[p] for own, p in zip(self.coded, anchors, strict=True)])
        order = np.argsort(word, kind="stable")
        self.post_template, self.post_place = order, np.array(anchors)[order]
        self.post_off = np.searchsorted(word[order], np.arange(len(self.words) + 1))

    def look_up(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word or -1, word offsets by document)."""
        starts, ends, by = words(data, off, ALNUM)
        codes = np.full(len(starts), -1, dtype=np.int64)
        if len(starts):
            h = mix(Hasher(data).of(starts, ends))
            near = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            same = self.hashes[k] == h[near]
            codes[near[same]] = self.order[k[same]]
        return codes, by

    def _agree(self, codes: np.ndarray, start: np.ndarray, template: np.ndarray, low: np.ndarray, high: np.ndarray, inside: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, template word, does it agree) for the template positions low .. high - 1 of each candidate, laid at its start."""
        n = high - low
        which = np.repeat(np.arange(len(start)), n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
        own, x = self.own[self.begin[template[which]] + p], start[which] + p
        ok = (x >= inside[0][which]) & (x < inside[1][which])
        return which, own, ok & (codes[np.where(ok, x, 0)] == own)

    def matches(self, codes: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, document, start in the chunk, score) of each place that counts, templates in order."""
        hits = np.flatnonzero(codes >= 0)
        n = self.post_off[codes[hits] + 1] - self.post_off[codes[hits]]
        at = np.repeat(hits, n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.post_off[codes[at]]
        template, start = self.post_template[post], at - self.post_place[post]
        doc = np.searchsorted(by, at, side="right") - 1
        ok = (start + self.low[template] >= by[doc]) & (start + self.high[template] <= by[doc + 1])
        template, doc, start = template[ok], doc[ok], start[ok]
        if len(start):
            which, _, same = self._agree(codes, start, template, self.low[template], self.high[template], (by[doc], by[doc + 1]))
            ok = np.bincount(which, weights=~same, minlength=len(start)) == 0
            template, doc, start = template[ok], doc[ok], start[ok]
        which, own, same = self._agree(codes, start, template, np.zeros_like(template), self.length[template], (by[doc], by[doc + 1]))
        got = np.bincount(which, weights=np.where(same, self.idf[own], 0.0), minlength=len(start)) / self.whole[template]
        got = np.round(np.minimum(got, 1.0), 9)
        ok = np.flatnonzero(got >= self.least[template] - 1e-9)
        ok = ok[np.lexsort((start[ok], template[ok]))]
        return template[ok], doc[ok], start[ok], got[ok]


def idf(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of the templates' words over all documents; the result's size is fixed by the templates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        seen, n = np.zeros(len(index.words), dtype=np.int64), 0
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                codes, by = index.look_up(data, off)
                hits = np.flatnonzero(codes >= 0)
                doc = np.searchsorted(by, hits, side="right") - 1
                pairs = np.unique(doc * len(index.words) + codes[hits])
                seen += np.bincount(pairs % len(index.words), minlength=len(index.words))
                n += len(off) - 1
        yield pa.record_batch({"word": pa.array([*index.words, ""]), "df": pa.array([*seen.tolist(), n], pa.int64())})

    df = {r[0]: r[1] for r in documents.select("text").mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df")).collect()}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}


def scan(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weights = idf(documents, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, weights)
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                codes, by = index.look_up(data, off)
                n = hi - lo
                n_base, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                every: list[set] = [set() for _ in range(n)]
                t, d, start, got = index.matches(codes, by)
                np.maximum.at(score, d, got)
                own = index.base[t]
                n_base += np.bincount(d[own], minlength=n)
                np.minimum.at(first, d[own], start[own] - by[d[own]])
                np.maximum.at(last, d[own], start[own] - by[d[own]])
                for i, k in set(zip(d.tolist(), t.tolist(), strict=True)):
                    every[i].add(templates[k].label)
                    if templates[k].base:
                        base[i].add(templates[k].label)
                none = n_base == 0
                yield pa.record_batch(
                    {
                        "doc_id": b.column(0).slice(lo, n), "n_words": pa.array(np.diff(by)), "n_base": pa.array(n_base), "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                        "base_labels": pa.array([",".join(sorted(x)) for x in base], pa.string()), "labels": pa.array([",".join(sorted(x)) for x in every], pa.string()), "score": pa.array(score),
                    }
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op9: every place of every template's key phrase."""
    rows, keys = [], []
    for k, (t, (low, high)) in enumerate(zip(TEMPLATES, Index(TEMPLATES).keys, strict=True)):
        rows += [f"({k}, {p}, '{w}', {low <= p < high})" for p, w in enumerate(t.text.split())]
        keys.append(f"({k}, '{t.label}', {low}, {high - low}, {t.least}, {t.base})")
    return rf"""with tw(t, p, w, k) as (values {", ".join(rows)}), te(t, label, low, n_key, least, base) as (values {", ".join(keys)}),
d as (select row_number() over () i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') l from documents),
ws as (select i, unnest(range(0, len(l))) pos, unnest(l) w from d), hit as (select * from ws where w in (select w from tw)),
idf as (select w, ln(((select count(*) from d) + 1) / (coalesce(df, 0) + 1)) + 1 idf from (select distinct w from tw) left join (select w, count(distinct i) df from hit group by 1) using (w)),
tot as (select t, sum(idf) total from tw join idf using (w) group by 1),
cand as (select i, t, start from (select i, t, pos - p as start, count(*) n from hit join tw using (w) where k group by 1, 2, 3) join te using (t) where n = n_key),
sc as (select c.i, c.t, c.start, round(least(sum(case when h.w is not null then idf else 0 end) / any_value(total), 1), 9) s from cand c join tw using (t) join idf on idf.w = tw.w join tot on tot.t = c.t left join hit h on h.i = c.i and h.pos = c.start + tw.p and h.w = tw.w group by 1, 2, 3),
ok as (select i, start, s, label, base from sc join te using (t) where s >= least - 1e-9),
g as (select i, max(s) score, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word, array_to_string(list_sort(list(distinct label) filter (base)), ',') base_labels, array_to_string(list_sort(list(distinct label)), ',') labels from ok group by 1)
select doc_id, len(l)::bigint n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score from d left join g using (i)"""
