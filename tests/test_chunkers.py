"""Chunkers, element parsers, replies, question sets and streams on small cases."""

import difflib
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import elements as E
from lodestone.operators import judge as J
from lodestone.operators import records as D
from lodestone.operators import rerank as K
from lodestone.sources import files

TEXTS = ["", "   ", "One paragraph. It has two sentences.", "# A\n\n## B\n\ntext one two.\n\n# C\n\nmore text", "Ünïcode – “quotes”. Straße!", "word " * 900 + "x" * 4000, "| a | b |\n| 1 | 2 |\n\nafter. And e.g. this, by Dr. Who. End"]
CUTS = [C.sentences, C.recursive, lambda t: C.windows(C.sentences(t), 5, 1), lambda t: C.sections(t, 20, 6, False), lambda t: C.sections(t, 20, 2, True)]


@pytest.mark.parametrize("cut", CUTS)
@given(st.one_of(st.sampled_from(TEXTS), st.text(alphabet="ab .\n#|-1é", max_size=300)))
@settings(max_examples=150, deadline=None)
def test_chunks_hold_every_word_in_order(cut, text):
    spans = cut(text)
    assert all(0 <= a < z <= len(text) for a, z in spans) and [a for a, _ in spans] == sorted(a for a, _ in spans)
    held = [False] * len(text)
    for a, z in spans:
        held[a:z] = [True] * (z - a)
    assert all(h or c.isspace() for h, c in zip(held, text, strict=True))


def test_recursive_chunks_are_short():
    assert max(z - a for a, z in C.recursive("word " * 900 + "x" * 4000)) <= 400


def test_sentences():
    text = "Dr. Who met J. Smith, e.g. today. Then left! and on  \n\n1. First item\n2. Second item. More"
    assert [text[a:z] for a, z in C.sentences(text)] == ["Dr. Who met J. Smith, e.g. today.", "Then left! and on", "1. First item", "2. Second item.", "More"]


def test_html_blocks():
    html = "<head><title>T</title></head><h2>Head</h2><p>a <b>b</b><br>c</p><ul><li>x<li>y</ul><table><caption>cap</caption><tr><th>k<td>v</tr></table><pre>\n i = 1\n</pre><script>no</script><p> </p>tail"
    assert E.blocks_of_html(html) == [("heading", 2, "Head"), ("paragraph", None, "a b c"), ("list_item", None, "x"), ("list_item", None, "y"), ("caption", None, "cap"), ("table", None, "k | v"), ("code", None, " i = 1"), ("paragraph", None, "tail")]
    assert E.blocks_of_html("") == []
    assert E.blocks_of_html("<html><head><title>x</title><body><p>hello") == [("paragraph", None, "hello")] == E.blocks_of_html("<head><title>x</title><p>hello</p>")


def test_markdown_blocks():
    text = "# Top #\nline one\nline two\n\n- item\n| a |\n| b |\n```py\nx\n\ny\n```\n"
    assert E.blocks_of_markdown(text) == [("heading", 1, "Top"), ("paragraph", None, "line one line two"), ("list_item", None, "item"), ("table", None, "| a |\n| b |"), ("code", None, "x\n\ny")]


def test_heading_paths_end_at_shallower_headings(spark):
    rows = [(1, 0, "heading", 1, "A"), (1, 1, "heading", 3, "B"), (1, 2, "paragraph", None, "p"), (1, 3, "heading", 2, "C"), (1, 4, "paragraph", None, "q"), (1, 5, "heading", 1, "D")]
    got = E.heading_paths(spark.createDataFrame(rows, "doc_id long, order int, type string, level int, text string"))
    assert [r.heading_path for r in got.orderBy("order").collect()] == [["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C"], ["D"]]


def test_parents_move_to_kept_ancestors(spark):
    e = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "x", "y"), (1, "y", "x"), (1, "z", "y")], "doc_id long, id string, parent_id string")
    kept = e.where("id in ('a', 'c', 'z')")
    assert {r.id: r.parent_id for r in E.reparented(e, kept).collect()} == {"a": None, "c": "a", "z": None}


def test_mmr_prefers_what_differs(spark):
    hits = spark.createDataFrame([(1, 10, 1, 0.9, [1.0, 0.0]), (1, 11, 2, 0.8, [1.0, 0.01]), (1, 12, 3, 0.5, [0.0, 1.0])], "query long, piece long, rank int, score double, vector array<double>")
    pick = lambda w: [r.piece for r in K.mmr(hits, w, 3).orderBy("rank").collect()]
    assert pick(0.3) == [10, 12, 11] and pick(1.0) == [10, 11, 12]


@pytest.mark.parametrize(("reply", "want"), [('so {"score": 1, "reason": "r"}', (1.0, "r")), ('{"score": "0.5"}', None), ('{"score": true}', None), ('{"score": 1.5}', None), ("", None), ('{"score": 0}', (0.0, ""))])
def test_judge_replies(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "x string").select(J.judge_reply(F.col("x"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_question_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document": "d", "questions": [{"id": "1", "question": "q?", "gold_answer": "g", "gold_answers": ["g", "h"]}, {"id": "2", "question": " ", "gold_answer": "g"}]}))
    (tmp_path / "b.csv").write_text('id,question,gold_answers,tags\n1,"a ""b""?",x || y||,"s, t"\n2,q,,\n')
    rows = {r.id: r for r in files.questions_json(spark, str(tmp_path / "a.json")).collect()}
    assert rows["1"].golds == ["g", "h"] and rows["1"].document == "d" and rows["1"].error is None and rows["2"].error == "no question"
    rows = {r.id: r for r in files.questions_csv(spark, str(tmp_path / "b.csv")).collect()}
    assert rows["1"].golds == ["x", "y"] and rows["1"].tags == ["s", "t"] and rows["2"].error == "no gold answer"


def test_listing_and_sinks(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.md").write_text("# x")
    (root / ".hidden").write_text("no")
    assert [(r.doc_id, r.size, r.content_type) for r in files.list_files(spark, str(root)).collect()] == [("sub/a.md", 3, "text/markdown")]
    assert [tuple(r) for r in files.read_texts(spark, str(root)).collect()] == [("sub/a.md", "# x")]
    rows = spark.range(5).withColumnRenamed("id", "doc_id")
    files.write_index(rows, str(tmp_path / "index"), 2)
    files.write_report(rows, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == spark.read.json(str(tmp_path / "report")).count() == 5


def test_pairs_of_runs_are_one_to_one(spark):
    a = spark.createDataFrame([(1, "q", True), (2, "q", True), (3, "r", False)], "id long, question string, found boolean")
    b = spark.createDataFrame([(1, "q", False), (8, "q", False), (9, "q", True)], "id long, question string, found boolean")
    assert sorted(tuple(r) for r in J.paired(a, b).collect()) == [(1, 1, True, False, "id"), (2, 8, True, False, "text")]


def test_near_blocks_name_the_first_kept_twin(spark):
    rows = [(1, 0, "p", "a" * 40), (1, 1, "p", "a" * 39 + "b"), (1, 2, "h", "a" * 40), (1, 3, "p", "c" * 40), (2, 0, "p", "a" * 40), (1, 4, "p", "")]
    got = D.near_blocks(spark.createDataFrame(rows, "doc_id long, order int, type string, norm string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0)]


def test_twins_are_those_of_all_pairs_and_few_are_aligned(monkeypatch):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefghij ") for _ in range(draw.choice((1, 40, 41, 60)))) for _ in range(12)]
    blocks = [(3 * k, "".join(draw.choice("xyé") if draw.random() < 0.02 else c for c in draw.choice(base)) or "a") for k in range(150)]
    kept, want, pairs = [], [], 0
    for order, text in blocks:
        pairs += len(kept)
        near = [at for at, other in kept if difflib.SequenceMatcher(None, other, text, autojunk=False).ratio() >= 0.95]
        if near:
            want.append((order, near[0]))
        else:
            kept.append((order, text))
    seen = []
    monkeypatch.setattr(difflib.SequenceMatcher, "quick_ratio", lambda m, whole=difflib.SequenceMatcher.quick_ratio: seen.append(1) or whole(m))
    assert list(D.twins(blocks, 0.95)) == want and len(want) > 20
    assert len(seen) < pairs / 5


def test_hashed_vectors_have_length_one_or_none(spark):
    got = {r.id: r.vector for r in D.hashed_vectors(spark.createDataFrame([(1, "a b"), (2, "B a"), (3, ""), (4, None)], "id long, text string"), 16).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and got[3] == got[4] == [0.0] * 16


def test_sections_scan_a_text_for_tokens_once(monkeypatch):
    class Counting:
        scans = 0

        def finditer(self, *a):
            Counting.scans += 1
            return token.finditer(*a)

    token = C.TOKEN
    monkeypatch.setattr(C, "TOKEN", Counting())
    text = " ".join(f"Sentence {k} has words." for k in range(400))
    got = C.sections(text, 50, 6, False)
    assert Counting.scans == 1
    assert [len(token.findall(text[a:z])) for a, z in got[:-1]] == [50] * (len(got) - 1)


def test_rows_are_handed_on_before_a_batch_is_through():
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 300_000] * 39 + [""])], ["doc_id", "text"])
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    got = list(C.bounded(iter([batch]), lambda k, t: [(k, t)] if t else [], kinds))
    assert sum((b.column("doc_id").to_pylist() for b in got), []) == list(range(39))
    assert max(b.nbytes for b in got) < 3_000_000


def laid(*blocks, size, level=6):
    """Texts of the pieces of (type, text, level of a heading) blocks."""
    spans, at = [], 0
    for kind, text, depth in blocks:
        spans.append((at, at + len(text), kind, depth))
        at += len(text) + 2
    whole = "\n\n".join(b[1] for b in blocks)
    return [whole[a:z] for a, z in C.laid_out(whole, spans, size, level, True)]


TABLE = ("table", "\n".join(f"| row{k} | {k} |" for k in range(12)), 0)
SMALL = ("table", "| a |\n| b |", 0)
CAPTION = ("caption", "Table 1: Scores", 0)
BEFORE, AFTER = ("paragraph", "Some words before it.", 0), ("paragraph", "Some words after it.", 0)


@pytest.mark.parametrize("size", [1, 5, 20])
def test_captions_go_with_their_tables_and_figures(size):
    figure = ("figure", "A chart of sales", 0)
    for block in (TABLE, figure):
        for pair in ((CAPTION, block), (block, CAPTION)):
            got = laid(("heading", "# R", 1), BEFORE, *pair, AFTER, size=20 if block[0] == "figure" else size)
            assert sum("Scores" in p and block[1] in p for p in got) == 1
    text = BEFORE[1] + "\n\n" + CAPTION[1] + "\n\n" + TABLE[1]
    assert [text[a:z] for a, z in C.sections(text, size, 6, True)][-1] == CAPTION[1] + "\n\n" + TABLE[1]
    got = laid(SMALL, CAPTION, ("table", "| c |\n| d |", 0), size=8)
    assert got == [SMALL[1], "Table 1: Scores\n\n| c |\n| d |"]
    assert C.units([(k, k + 1, kind, 0) for k, kind in enumerate(("caption", "table", "caption", "paragraph"))]) == [[(0, 1, "caption", 0), (1, 2, "table", 0)], [(2, 3, "caption", 0)], [(3, 4, "paragraph", 0)]]


def test_headings_go_with_what_is_below_and_whole_tables_stand_alone():
    got = laid(("heading", "# T", 1), BEFORE, ("heading", "## S", 2), TABLE, AFTER, size=20, level=1)
    assert got == ["# T\n\nSome words before it.", "## S\n\n" + TABLE[1], "Some words after it."]
    long = ("paragraph", " ".join(f"Sentence {k} has a few words." for k in range(6)), 0)
    got = laid(("heading", "# T", 1), long, size=8)
    assert got[0] == "# T\n\nSentence 0 has a few words." and len(got) == 6
    roles = [("heading", "# S", 1), BEFORE, ("heading", "# E", 1), ("heading", "## A", 2), BEFORE, ("heading", "## B", 2), AFTER]
    assert [p.split("\n")[0] for p in laid(*roles, size=400)] == ["# S", "# E", "## B"]
    assert [p.split("\n")[0] for p in laid(*roles, size=400, level=1)] == ["# S", "# E"]
    assert [p.split("\n")[0] for p in laid(*roles, size=9, level=1)] == ["# S", "# E", "## B"]


def test_layout_of_texts_and_of_elements(spark):
    text = "# A #\n\nIntro one.\n## B\nTable 2. Rows\n| a | b |\n| 1 | 2 |\n\n![plan](p.png)\nFigure: a plan\n\n```\n# no\n\nx\n```\n- i\n  more\n- j\n"
    assert [(text[a:z], kind) for a, z, kind, _ in C.markdown_blocks(text)] == [
        ("# A #", "heading"), ("Intro one.", "paragraph"), ("## B", "heading"), ("Table 2. Rows", "caption"), ("| a | b |\n| 1 | 2 |", "table"), ("![plan](p.png)", "figure"),
        ("Figure: a plan", "caption"), ("```\n# no\n\nx\n```", "code"), ("- i\n  more", "list_item"), ("- j", "list_item"),
    ]
    got = C.layout_blocks(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string"), 14).orderBy("ordinal").collect()
    assert [r.heading_path for r in got] == [["A"], *[["A", "B"]] * (len(got) - 1)] and all(text[r.start : r.end] == r.text for r in got)
    assert got[1].text == "## B\nTable 2. Rows\n| a | b |\n| 1 | 2 |" and [r.embed_text for r in got[:2]] == [got[0].text, "A\n\n" + got[1].text]
    html = "<h1>A</h1><p>Intro one.</p><h2>B</h2><table><caption>cap</caption><tr><td>1<td>2</table><p>last</p>"
    got = C.element_layout(E.html_elements(spark.createDataFrame([(1, html)], "page_id long, html string")), 6).orderBy("ordinal").collect()
    assert [(r.text, r.heading_path) for r in got] == [("# A\n\nIntro one.", ["A"]), ("## B\n\ncap\n\n1 | 2", ["A", "B"]), ("last", ["A", "B"])]


def test_sentence_ranges_are_those_of_the_table_operation(spark):
    texts = [*TEXTS, "a) First. Second\nruns on. Here\n\nU.S. law, e.g. Mr. X. Then 3. Go", "1. Item. More\n| r. S |\n# H. I\nprose... And \"so.\" (Yes)", " 1. One. Two! \x0b3"]
    from lodestone.operators import sentences as N

    rows = N.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {(r.doc_id, r.start, r.end) for r in rows}
    assert want == {(k, *span) for k, t in enumerate(texts) for span in C.sentence_ranges(t)}


def test_markdown_sections_break_at_every_heading():
    text = "# A\n\n## B\n\nx y z\n\nu v\n\n# C\n\n" + "w " * 9
    cut = [text[a:z] for a, z in C.headed(text, 6)]
    assert cut == ["# A", "## B\n\nx y z", "u v", "# C", "w w w w w w", "w w w"]
