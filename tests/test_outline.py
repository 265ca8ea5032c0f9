"""Headings at offsets, paragraphs from line boxes, offsets of normalised texts and texts that nearly agree, against plain versions."""

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import alignment, answers, layout, outline, prepare, retrieve, similar
from lodestone.operators.sentences import sentences


def path_at(elements, offset):
    stack = []
    for e in elements:
        if e["start"] > offset or e["type"] != "heading" or e["end"] <= e["start"]:
            continue
        level = e["level"] or 1
        stack = [s for s in stack if s[0] < level] if any(s[0] >= level for s in stack) else stack
        stack.append((level, e["text"]))
    return [t for _, t in stack]


def made_elements(seed):
    draw, out, at = random.Random(seed), [], 0
    for k in range(60):
        kind = draw.choice(["heading", "paragraph", "footer", "paragraph", "heading"])
        text = f"t{k} " + "x" * draw.randrange(30)
        level = draw.choice([1, 2, 3, None]) if kind == "heading" else None
        body = "" if kind == "footer" else "#" * (level or 1) + " " + text if kind == "heading" else text
        out.append({"doc_id": seed, "order": k, "id": f"e{k}", "type": kind, "level": level, "text": text, "page": draw.choice([k // 10, None]), "start": at, "end": at + len(body)})
        at += len(body) + 2 * bool(body)
    return out


@pytest.mark.parametrize("leading", [False, True])
def test_outline(spark, leading):
    every = {seed: made_elements(seed) for seed in range(4)}
    pieces = [(d, k, a, a + random.Random(d * 100 + k).randrange(90), "clash") for d in every for k, a in enumerate(range(0, every[d][-1]["end"] + 40, 37))]
    e = spark.createDataFrame([tuple(x.values()) for v in every.values() for x in v], "doc_id int, order int, id string, type string, level int, text string, page int, start int, end int").repartition(5)
    p = spark.createDataFrame(pieces, "doc_id int, ordinal int, start int, end int, held string")
    got = {(r.doc_id, r.ordinal): r for r in outline.outlined(p, e, leading).collect()}
    assert len(got) == len(pieces)
    for d, k, a, z, _ in pieces:
        held = [x for x in every[d] if x["end"] > x["start"] and x["start"] < z and x["end"] > a] if z > a else []
        n = next((i for i, x in enumerate(held) if x["type"] != "heading"), len(held))
        at, pages, r = held[n - 1]["start"] if leading and n else a, [x["page"] for x in held if x["page"] is not None], got[d, k]
        assert (r.heading_path, r.n_leading, r.source_element_ids) == (path_at(every[d], at), n, [x["id"] for x in held])
        assert (r.first_page, r.last_page) == ((min(pages), max(pages)) if pages else (None, None))


def test_outline_without_rows(spark):
    e = spark.createDataFrame([], "doc_id int, order int, id string, type string, level int, text string, start int, end int")
    p = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 3, 3)], "doc_id int, ordinal int, start int, end int")
    assert [(r.heading_path, r.source_element_ids, r.first_page) for r in outline.outlined(p, e).collect()] == [([], [], None)] * 2
    assert outline.outlined(p.limit(0), e).count() == 0


def plain_paragraphs(lines):
    if any(x is None for _, *box in lines for x in box):
        return [(t, 1, *box) for t, *box in lines]
    pitch = [a[4] - b[4] for a, b in zip(lines, lines[1:])]
    up = [x for x in pitch if x > 0]
    median, out = statistics.median(up) if up else 0, []
    for k, (text, *box) in enumerate(lines):
        if k == 0 or pitch[k - 1] <= 0 or pitch[k - 1] > 1.5 * median:
            out.append([text, 1, *box])
            continue
        head, n, *old = out[-1]
        broken = head.endswith("-") and head[-2:-1].isalpha() and text[:1].islower()
        out[-1] = [head[:-1] + text if broken else head + " " + text, n + 1, min(old[0], box[0]), min(old[1], box[1]), max(old[2], box[2]), max(old[3], box[3])]
    return [tuple(x) for x in out]


def test_paragraphs(spark):
    draw, rows, want = random.Random(4), [], {}
    for page in range(30):
        y, own = 700.0, []
        for k in range(draw.randrange(1, 25)):
            y = 690.0 if draw.random() < 0.05 else y - draw.choice([12, 12, 12, 13, 30, 0])
            left = draw.choice([10.0, 12.0])
            own.append((draw.choice(["word and", "bro-", "ken", "-", "Up", "é-", "9-", ""]), left, y, left + 50, y + 10))
        if page == 7:
            own[-1] = (own[-1][0], None, 1.0, 2.0, 3.0)
        rows += [(page % 3, page, k, *x, "clash") for k, x in enumerate(own)]
        want[page % 3, page] = plain_paragraphs(own)
    d = spark.createDataFrame(rows, "doc_id int, page int, line int, text string, left double, bottom double, right double, top double, paragraph string").drop("paragraph").repartition(4)
    got = {}
    for r in sorted(layout.paragraphs(d).collect(), key=lambda r: (r.doc_id, r.page, r.paragraph)):
        got.setdefault((r.doc_id, r.page), []).append((r.text, r.n_lines, r.left, r.bottom, r.right, r.top))
    assert got == want
    assert layout.paragraphs(d.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 1, 0, "soft￾hy￾Up", 0.0, 0.0, 1.0, 1.0), (1, 1, 1, None, 0.0, 0.0, 1.0, 0.5)], d.schema)
    assert [r.text for r in layout.paragraphs(one).collect()] == ["softhy- Up "]


def folded(text):
    """(normalised text, offsets) one character at a time."""
    out, places, i, space = [], [], 0, None
    while i < len(text):
        c = text[i]
        j = i + 1
        if c == "-":
            while j < len(text) and text[j] in " \t":
                j += 1
            if j < len(text) and text[j] in "\r\n":
                while j < len(text) and text[j].isspace():
                    j += 1
                i = j
                continue
        if c.isspace():
            space = i if space is None and out else space
        else:
            if space is not None:
                out.append(" ")
                places.append(space)
                space = None
            for x in T.LIGATURES.get(c, T.QUOTES.get(c, c)).casefold():
                out.append(x)
                places.append(i)
        i += 1
    return "".join(out), places


def test_offsets(spark):
    draw = random.Random(8)
    texts = [None, "", "  \n", "-\n", "a-\n b", "well-\t\r\n known - x", "“ﬁne” ﬃ Straße É", " x -\n", "(a–b) ﬀ"]
    texts += ["".join(draw.choice(["-", "\n", " ", "\t", "a", "Bc", "ﬁ", "ß", "’", "é", "9", " "]) for _ in range(draw.randrange(40))) for _ in range(200)]
    d = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id int, text string, piece string").repartition(3)
    got = {r.doc_id: r for r in alignment.normalised_with_offsets(d).withColumn("found", alignment.found_span(F.col("norm"), F.col("offsets"), F.lit("fi"))).collect()}
    for i, t in enumerate(texts):
        norm, places = folded(t) if t is not None else (None, None)
        assert (got[i].norm, got[i].offsets) == (norm, places), repr(t)
        if t and "fi" in norm:
            k = norm.index("fi")
            assert tuple(got[i].found) == (places[k], places[k + 1] + 1)
    same = d.join(alignment.normalised_with_offsets(d), "doc_id").where(~F.col("norm").eqNullSafe(T.match_normalise(F.col("text"))))
    assert same.count() == 0
    assert spark.range(1).select(alignment.composed(F.array(F.lit(2), F.lit(0)), F.array(F.lit(5), F.lit(6), F.lit(9)))).first()[0] == [9, 5]


def test_offsets_shuffle_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = alignment.normalised_with_offsets(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_closest_sentence(spark):
    draw, words = random.Random(5), "alpha beta gamma delta rhythm xylem ﬁnal question answer north".split()
    docs = [(d, " ".join((" ".join(draw.choice(words) for _ in range(draw.randint(3, 9))).capitalize() + ".") for _ in range(25)), "x") for d in range(6)] + [(6, None, "x"), (7, "", "x")]
    golds = []
    for q in range(60):
        d = q % 8
        body = docs[d][1] or "none of it here"
        part = body[(q * 13) % max(1, len(body) - 40) :][:40]
        golds.append((q, d, "".join(c if draw.random() > (q % 5) / 8 else draw.choice("abcz ") for c in part)))
    golds += [(99, 0, None), (98, 100, "no such document here"), (97, 0, "Alpha!" * 60)]
    d, g = spark.createDataFrame(docs, "doc_id int, text string, gold string"), spark.createDataFrame(golds, "query int, doc_id int, gold string")
    got = {(r.query, r.doc_id): (r.closest, r.score) for r in similar.closest_sentences(g, d).collect()}
    fold = lambda s: folded(s)[0]
    texts, own = {i: t for i, t, _ in docs}, {}
    for r in sentences(d).orderBy("doc_id", "ordinal").collect():
        own.setdefault(r.doc_id, []).append(r.text)
    n = 0
    for q, i, gold in golds:
        text = texts.get(i)
        if gold is None or (text and (gold in text or fold(gold) in fold(text))):
            assert (q, i) not in got
            continue
        lines = own.get(i, [])
        close = difflib.get_close_matches(fold(gold), [fold(s) for s in lines], n=1, cutoff=0.6)
        assert got[q, i][0] == (lines[[fold(s) for s in lines].index(close[0])] if close else None)
        n += bool(close)
    assert n > 5 and any(v[0] is None for v in got.values())


def test_kept_in_order(spark):
    """Chains: what is near to a question that falls is kept; copies, golds and sets by themselves."""
    draw, rows = random.Random(6), []
    base = ["what does the long clause say about renewal", "how many days may a tenant wait", "who signs"]
    for s in (1, 2, None):
        for n in range(45):
            q = list(draw.choice(base))
            for _ in range(draw.randrange(8)):
                q[draw.randrange(len(q))] = draw.choice("abcdefgh ")
            rows.append((s, n, draw.choice(["".join(q), "".join(q), "who signs", None]) if n % 6 == 0 else "".join(q), draw.choice([f"Gold {n}", "gold 1", None if n % 7 == 0 else f"gold {n % 20}"])))
    fold = lambda x: " ".join((x or "").split()).casefold()
    want = {}
    for s in (1, 2):
        kept = []
        for _, n, q, g in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if any(fold(g) == fold(k[1]) for k in kept):
                want[s, n] = "same gold passage"
            elif any(fold(q) == fold(k[0]) or difflib.SequenceMatcher(None, fold(q), fold(k[0])).ratio() > 0.85 for k in kept):
                want[s, n] = "near duplicate"
            else:
                want[s, n] = None
                kept.append((q, g))
    d = spark.createDataFrame(rows, "set_id int, n int, question string, gold string").where("set_id is not null")
    got = {(r.set_id, r.n): r["drop"] for r in similar.kept_in_order(d).collect()}
    assert got == want and {"same gold passage", "near duplicate", None} == set(want.values())
    assert similar.kept_in_order(d.limit(0)).count() == 0


def test_rendered_offsets_and_outline_agree(spark):
    e = spark.createDataFrame([(1, 0, "e0", "heading", 1, "A"), (1, 1, "e1", "heading", 2, "B"), (1, 2, "e2", "paragraph", None, "text"), (1, 3, "e3", "heading", 1, "C")], "doc_id int, order int, id string, type string, level int, text string")
    e = prepare.offsets(e.withColumn("body", prepare.rendered(F.col("type"), F.col("text"), F.col("level"))))
    places = spark.createDataFrame([(1, "p", 3), (1, "q", 4), (1, "r", 5), (1, "s", 99), (2, "t", 0), (1, "u", None)], "doc_id int, key string, at int")
    got = {r.key: r.heading_path for r in outline.paths_at(places, e).collect()}
    assert got == {"p": ["A"], "q": ["A"], "r": ["A", "B"], "s": ["C"], "t": [], "u": []}


def test_containment_of_all_golds(spark):
    """Golds with and without an inner word, copies of texts, columns named like those inside, against every pair."""
    texts = [(1, "one two three four", "s", 5), (2, "one two three four", "s", 6), (3, "onetwo three", "t", 7), (4, None, "u", 8), (5, "", "u", 9), (6, "a  one\ttwo b three", "v", 10)]
    golds = [(k, g) for k, g in enumerate(["two three f", "one", "e two", "one two three", "", None, "onetwo", "two b", "t", "  one", "zzz"])]
    d = spark.createDataFrame(texts, "doc_id int, text string, seed string, item_id int")
    g = spark.createDataFrame(golds, "item_id int, gold string")
    want = sorted((k, i, s) for k, gold in golds for i, text, s, _ in texts if gold and text and gold in text)
    for most in (1000, 2):
        got = retrieve.containing(g, d, most=most)
        assert got.columns == ["item_id", "doc_id", "seed"] and sorted(tuple(r) for r in got.collect()) == want
    assert retrieve.containing(g.limit(0), d).count() == 0 and retrieve.containing(g, d.limit(0)).count() == 0
    plan = retrieve.containing(g, d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_broken_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b x c", "a b c", "w", "e", 7)], "query int, text string, gold string, _words string, _ends string, best int")
    assert [tuple(r) for r in answers.broken(rows).collect()] == [(1, "w", "e", 7, 0, 3)]
