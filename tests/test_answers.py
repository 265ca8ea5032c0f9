"""Sentences, answers, filters, questions and hooks on small cases: nulls, empties, ties, repeats and clashing columns."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import collections as L
from lodestone.operators import filters as W
from lodestone.operators import hooks as H
from lodestone.operators import prepare as P
from lodestone.operators import questions as Q
from lodestone.operators import retrieve as R
from lodestone.operators import reviews as V
from lodestone.operators import sentences as N

SAMPLES = [
    None, "", "  \n ", "One. Two! three? Four", "Dr. Who met J. Smith, e.g. today. Then left!  \n\n1. First item\n2. Second item. More", "See fig. 3 in U.S. law. \"Quoted.\" (He left.) 5 men. went on...Then. And?! \"So.\"",
    "# Head\ntext one. Text two.\n- item runs\non here. Still item\n\nafter it. Done\n| a | b |\n| c. D |\nlast", "no stop", "a.\r\nB.\r\n\r\nC. d", "Approx. Five. etc. Then. x.y.z. Q. 12. Go on.", "...", "1. Only. Next",
]


def plain_sentences(text):
    """The rule, word for word: blocks of lines first, then stops inside paragraphs."""
    blocks, begin, item, at = [], None, False, 0
    for line in re.findall(r"[^\n\r]*(?:\r\n|[\n\r]|$)", text):
        body = line.rstrip("\r\n")
        whole = re.match(T.LIST_ITEM, line) or re.match(r"[ \t]*\|", line) or re.match(r"[ \t]*#{1,6}\s", line)
        if not body.strip():
            if begin is not None:
                blocks.append((begin, at, False))
            begin, item = None, False
        elif whole:
            if begin is not None:
                blocks.append((begin, at, False))
            begin, item = None, bool(re.match(T.LIST_ITEM, line))
            blocks.append((at, at + len(body), True))
        elif item:
            blocks[-1] = (blocks[-1][0], at + len(body), True)
        elif begin is None:
            begin = at
        at += len(line)
    if begin is not None:
        blocks.append((begin, len(text), False))
    out = []
    for a, z, whole in blocks:
        cuts = [a]
        for m in [] if whole else re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s)", text[a:z]):
            rest = text[a + m.end() : z].lstrip()
            word = re.search(r"\S*$", text[a : a + m.start()])
            bare = word.group().lstrip("\"'“‘([")
            first = not text[a : a + word.start()].strip()
            kept = bare.lower() in T.ABBREVIATIONS or (len(bare) == 1 and bare.isupper()) or ("." in bare and all(len(p) <= 2 for p in bare.split("."))) or (bare.isdigit() and first)
            if rest and re.match(r"[A-Z0-9\"'“‘(\[]", rest) and not (m.group()[0] == "." and bare and kept):
                cuts.append(a + m.end())
        for s, e in zip(cuts, [*cuts[1:], z], strict=True):
            if text[s:e].strip():
                s += len(text[s:e]) - len(text[s:e].lstrip())
                out.append((s, s + len(text[s:e].strip())))
    return out


def found(spark, texts):
    rows = N.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.text for r in rows)
    return [[(r.start, r.end) for r in sorted((x for x in rows if x.doc_id == i), key=lambda x: x.ordinal)] for i in range(len(texts))]


def test_sentences_against_the_rule(spark):
    assert found(spark, SAMPLES) == [plain_sentences(t or "") for t in SAMPLES]


@given(st.lists(st.lists(st.sampled_from(["A.", "b", "Dr.", "e.g.", "(Yes!)", "\n", "\n\n", "- x", "3.", "| t", "No?", "\"So.\"", "J.", "# h", "U.S.", " "]), max_size=25).map(" ".join), min_size=5, max_size=30))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_sentences_of_any_text(spark, texts):
    assert found(spark, texts) == [plain_sentences(t) for t in texts]


def test_sentence_windows(spark):
    text = "# A\nOne. Two. Three. Four. Five.\n# B"
    d = spark.createDataFrame([(1, text), (2, "# only"), (3, None), (4, "Just one")], "doc_id long, text string")
    got = {(r.doc_id, r.ordinal): (r.start, r.end) for r in N.sentence_windows(d, 2, 1).collect()}
    assert [text[slice(*got[1, k])] for k in range(4)] == ["# A\nOne. Two.", "Two. Three.", "Three. Four.", "Four. Five.\n# B"]
    assert got[2, 0] == (0, 6) and got[4, 0] == (0, 8) and len(got) == 6


def test_numbered_sources(spark):
    d = spark.createDataFrame([(1, 1, "One here. Two\nthere."), (1, 2, None), (1, 3, "Last")], "query long, chunk long, text string")
    assert {(r.sid, r.line) for r in N.numbered(d).collect()} == {("1.1", "[1.1] One here."), ("1.2", "[1.2] Two there."), ("3.1", "[3.1] Last")}
    assert N.prompt_blocks(d, F.lit("f")).first().block == "<f Source 1>\n[1.1] One here.\n[1.2] Two there.\n</f>\n\n<f Source 3>\n[3.1] Last\n</f>"


def test_claims(spark):
    d = spark.createDataFrame([(1, "It is [1.2][01.2] [9.9]. Then. [1.1] more", ["1.1", "1.2"]), (2, None, []), (3, "", []), (4, "plain", None), (5, "end [1.1]", ["1.1"])], "query long, text string, known array<string>")
    got = [(r.query, r.text, r.ids, r.invalid) for r in A.claims(d).orderBy("query", "ordinal").collect()]
    assert got == [(1, "It is", ["1.2"], 1), (1, ". Then. ", ["1.1"], 0), (1, " more", [], 0), (4, "plain", [], 0), (5, "end", ["1.1"], 0)]


def test_broken_answers(spark):
    rows = [(1, "a x b y c", "A b c"), (2, "a b", "a c"), (3, "a q q q q q q q q b", "a b"), (4, "a a b", "a b"), (5, None, "a"), (6, "a", ""), (7, "split wo-\nrd here", "word HERE!")]
    got = {r.id: (r.first, r.last) for r in A.broken(spark.createDataFrame(rows, "id long, text string, gold string")).collect()}
    assert got == {1: (0, 4), 2: (None, None), 3: (None, None), 4: (1, 2), 5: (None, None), 6: (None, None), 7: (1, 2)}


def test_cut_pieces(spark):
    pieces = spark.createDataFrame([(1, 0, "so one two three four"), (1, 1, "five six seven eight on"), (2, 0, "one two three four five six seven eight"), (3, 0, None)], "query long, ordinal long, text string")
    golds = spark.createDataFrame([(q, "one two three four five six seven eight") for q in (1, 2, 3)], "query long, gold string")
    assert [(r.query, r.first, r.last) for r in A.cut_pieces(pieces, golds).collect()] == [(1, 0, 1)]


def test_only_from_and_projection(spark):
    hits = spark.createDataFrame([(1, 1, "p", 2.0, "text", None, None, "d"), (1, 2, "q", 1.0, "other", 3, 0.5, "e"), (2, 1, "r", 1.0, "free", None, None, "e")], "query long, rank int, piece string, score double, text string, prior_rank int, prior_score double, doc_id string")
    masked = A.only_from(hits, spark.createDataFrame([(1, "d")], "query long, doc_id string"))
    assert [r.text for r in masked.orderBy("query", "rank").collect()] == ["text", "", "free"]
    assert [(r.snippet, r.prior_rank) for r in A.projected(hits, 1, 3).orderBy("query").collect()] == [("tex", None), ("fre", None)]


def test_filters_of_unusable_values(spark):
    d = spark.createDataFrame([(1, "a", True, ["x"], None), (None, None, None, None, None)], "n int, s string, b boolean, l array<string>, o array<int>")
    n = lambda f: d.where(W.to_column(f, d.schema)).count()
    assert n(W.Eq("n", 1.0)) == 1 and n(W.Eq("b", 1)) == 0 and n(W.Eq("b", True)) == 1 and n(W.Eq("n", None)) == 0 and n(W.NO_FILTER) == 2
    assert n(W.AnyOf("l", ("x", "y"))) == 1 and n(W.AnyOf("o", ("1",))) == 0 and n(W.AnyOf("l", ())) == 0 and n(W.And((W.Eq("s", "a"), W.Eq("zz", 1)))) == 0
    with pytest.raises(ValueError, match="no sections"):
        W.in_section(F.col("l"), "x", 0)


def test_containing(spark):
    golds = spark.createDataFrame([(1, "wo long-word her"), (2, "ab"), (3, None), (4, ""), (1, "wo long-word her")], "item_id long, gold string")
    texts = spark.createDataFrame([(1, "two long-word here", 5), (2, "xaby", 6), (3, None, 7)], "doc_id long, text string, gold2 int")
    assert sorted((r.item_id, r.doc_id) for r in R.containing(golds, texts).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_dedupe_and_drop_keep_nulls_and_columns(spark):
    rows = [(1, 0, "e0", "paragraph", "A  b", 7), (1, 1, "e1", "paragraph", "a B", 8), (1, 2, "e2", "footer", "a b", 9), (1, 3, "e3", "paragraph", None, 1), (1, 4, "e4", "paragraph", None, 2)]
    e = spark.createDataFrame(rows, "doc_id long, order int, id string, type string, text string, norm int")
    got = P.dedupe_blocks(e)
    assert got.columns == [*e.columns, "duplicate_of"] and {r.id: r.duplicate_of for r in got.collect()} == {"e0": None, "e1": "e0", "e2": None, "e3": None, "e4": None}
    assert P.drop_matching(e, "A B").count() == 3 and P.drop_matching(e, "^A", regex=True, case=True).count() == 4 and P.drop_matching(e, "").count() == 5


def test_running_lines_are_peeled(spark):
    rows = [(1, p, o, t) for p in range(4) for o, t in enumerate(["Report", "Chapter", f"body {p}", f"{p + 1}", None])] + [(2, 0, 0, "alone")]
    got = P.running_kinds(spark.createDataFrame(rows, "doc long, page long, order int, text string").withColumn("type", F.lit("paragraph")))
    kinds = {(r.page, r.order): r.kind for r in got.where("doc = 1").collect()}
    assert all([kinds[p, o] for o in range(5)] == ["header", "header", None, "page_number", None] for p in range(4))
    assert P.stripped(got).count() == 9 and P.stripped(got, retype=True).where("type = 'header'").count() == 8


def test_token_chunks_of_a_long_text(spark):
    text = " ".join(f"w{i}, " for i in range(60_000))
    rows = P.token_chunks(spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")).collect()
    parts = re.findall(r"\w+|[^\w\s]", text)
    long = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.ordinal)
    assert all(text[r.start : r.end] == r.text for r in long) and len(long) == -(-(len(parts) - 64) // 448) and long[-1].end == len(text.rstrip())
    for size, overlap in ((5, 0), (4, 3), (3, 9)):
        stride, some = max(1, size - overlap), "a b, c d. e f g h"
        toks = [m.span() for m in re.finditer(r"\w+|[^\w\s]", some)]
        want = [(toks[i][0], toks[min(i + size, len(toks)) - 1][1]) for i in range(0, len(toks), stride) if i == 0 or i - stride + size < len(toks)]
        assert [(r.start, r.end) for r in P.token_chunks(spark.createDataFrame([(1, some)], "doc_id long, text string"), size, overlap).orderBy("ordinal").collect()] == want


def test_evaluators(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("inf")), ("d", 4.0)], "trace_id string, v double")
    e = V.online_evaluator(V.Evaluator("twice", "1", {"x": F.col("v") * 2, "y": F.lit(1)}, skip=F.col("trace_id") == "d"))
    none = spark.createDataFrame([], "trace_id string, key string")
    got = {(r.trace_id, r.key): (r.value, r.status) for r in V.evaluate_traces(t, none, [V.EVALUATORS["twice"]]).collect()}
    assert got["a", "twice@1.x"] == (2, "scored") and got["b", "twice@1.y"] == (None, "failed") and got["c", "twice@1.x"] == (None, "failed") and got["d", "twice@1.x"][1] == "skipped"
    assert {r.status for r in V.evaluate_traces(t, spark.createDataFrame([("a", e.key(o)) for o in "xy"], "trace_id string, key string"), [e]).where("trace_id = 'a'").collect()} == {"skipped"}
    with pytest.raises(ValueError, match="not a stage"):
        V.between(t, since="nope")


def test_hooks(spark):
    def ask(prompts):
        if "bad" in prompts:
            raise KeyError
        return [{"text": p.upper()} for p in prompts]

    d = spark.createDataFrame([(1, "x"), (2, None), (3, "bad"), (4, "y")], "i long, p string").coalesce(1)
    got = {r.i: (r.reply.text, r.reply.error) for r in H.ai_map(d, "p", ask, batch=1).collect()}
    assert got == {1: ("X", None), 2: (None, None), 3: (None, "KeyError"), 4: ("Y", None)}
    with pytest.raises(ValueError, match="nope"):
        H.run_steps(d, [("nope", {})])


def test_user_source(spark):
    class Countries(H.UserSource):
        documents = staticmethod(lambda index, parts: ((f"d{k}", f"text {k}") for k in range(index, 10, parts)))

    spark.dataSource.register(Countries)
    got = spark.read.format("Countries").option("parts", 3).load()
    assert sorted(r.doc_id for r in got.collect()) == [f"d{k}" for k in range(10)]


def test_unread_entries_refuse_bad_listings(spark):
    d = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    for bad, why in ((d, "twice"), (d.where("false"), "nothing")):
        with pytest.raises(ValueError, match=why):
            L.unread(bad, d)


def test_question_files(spark):
    q = Q.generated(F.lit('{"question": " a\\n b ", "gold_passage": "one two three four five six", "answer": null}'))
    r = spark.range(1).select(q.alias("q")).first().q
    assert (r.question, r.answer, r["drop"]) == ("a  b", "", None)
    texts = ["a.b", "short", "v. long text. That ends. here it goes on", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.summary_cap(F.col("t"), 20).alias("c")).collect()
    assert [r.c for r in got] == ["a.b", "short", "v. long text.", None]


def test_citations_do_not_carry_their_text_along(spark):
    c = spark.createDataFrame([(1, 7, 0, 0, 2, "ab"), (2, 7, 0, 1, 3, "no"), (3, 8, 0, 0, 2, "ab")], "citation int, doc_id int, chunk_start long, c_start long, c_end long, cited_text string")
    e = spark.createDataFrame([(7, "e0", 0, 4)], "doc_id int, id string, start long, end long")
    d = spark.createDataFrame([(7, "abcd")], "doc_id int, text string")
    got = A.located(c, e, d)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2, True, "e0"), (2, 1, 3, False, "e0"), (3, 0, 2, False, None)]
    join = got._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    assert not re.search(r"\btext#", join.children().head().output().toString())


def test_windows_of_sentences_without_their_text(spark):
    d = spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id int, text string")
    rows = lambda w: sorted(map(tuple, w.collect()))
    got = rows(N.windows(N.sentences(d).drop("text"), 2, 1))
    assert got == rows(N.sentence_windows(d, 2, 1)) and len(got) > len(SAMPLES) / 2
