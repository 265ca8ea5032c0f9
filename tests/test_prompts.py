"""Prompts of a chat, embedding keys, registered access rules, overlaps and gates."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import access, hooks, prepare, prompts
from lodestone.operators import questions as Q
from lodestone.sources import files

TURN = "conv_id int, turn int, question string, answer string, rewrite string"


def test_rewrite_prompts(spark):
    turns = spark.createDataFrame([(1, k, f"q{k}", None if k == 2 else f"a{k}", f"r{k}" if k == 3 else "") for k in range(5)], TURN)
    asked = spark.createDataFrame([(1, 7, "and it?"), (2, 7, "first"), (3, 8, "alone"), (4, None, None)], "conv_id int, user_id int, question string")
    memories = spark.createDataFrame([(7, n, f"fact {n}") for n in range(4)], "user_id int, n int, fact string")
    summaries = spark.createDataFrame([(1, "Long ago."), (2, "")], "conv_id int, summary string")
    got = {r.conv_id: (r.prompt, r.reason) for r in prompts.rewrite_prompts(asked, turns, memories, summaries, 3, 2).collect()}
    facts = "<memories>\n- fact 2\n- fact 3\n</memories>\n\n"
    assert got[1] == (facts + "<history>\nSummary so far: Long ago.\nQ: q2\nA: \nQ: r3\nA: a3\nQ: q4\nA: a4\n</history>\n\nLatest question: and it?", None)
    assert got[2] == (facts + "Latest question: first", None) and got[3] == got[4] == (None, "no history")
    assert prompts.rewrite_prompts(asked.limit(0), turns, memories, summaries).count() == 0


def test_folding(spark):
    turns = spark.createDataFrame([(c, k, f"q{k}", f"a{k}", "r") for c, n in ((1, 6), (2, 2), (3, 5)) for k in range(n)], TURN)
    summaries = spark.createDataFrame([(1, "Old.", 2), (3, "Done.", 3)], "conv_id int, summary string, upto long")
    due = prompts.fold_prompts(turns, summaries, 2)
    assert {r.conv_id: (r.prompt, r.upto) for r in due.collect()} == {1: ("Earlier summary: Old.\n<turns>\nQ: q2\nA: a2\nQ: q3\nA: a3\n</turns>", 4)}
    replies = spark.createDataFrame([(1, " New one. And more than fits", 4), (3, " ", 9), (5, "First.", 1)], "conv_id int, reply string, upto long")
    assert {r.conv_id: (r.summary, r.upto) for r in prompts.folded(summaries, replies, 12).collect()} == {1: ("New one.", 4), 3: ("Done.", 3), 5: ("First.", 1)}


def test_history_and_keys(spark):
    rows = [(None,), ([],), ([("a", "b")],), ([("a", "b"), ("  ", "b")],), ([("a", None)],), ([None],)]
    d = spark.createDataFrame(rows, "h array<struct<question:string,answer:string>>")
    assert [r[0] is None for r in d.select(prompts.history_error(F.col("h"))).collect()] == [True, True, True, False, False, False]
    t = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "text string")
    want = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert t.select(prompts.embedding_key(F.col("text"), "m", "1", "query")).first()[0] == want("m|1|query|x")
    keyed, fresh = prompts.to_embed(t, spark.createDataFrame([(want("m|1|f4|query|y"),), (want("m|1|f4|document|x"),)], "key string"), "m", "1", "query", "f4")
    assert keyed.where("key is null").count() == 1 and [tuple(r) for r in fresh.collect()] == [(want("m|1|f4|query|x"), "x")]


def test_access(spark):
    @access.access_rule("test rule")
    def rule():
        return F.when(F.col("n") == 1, F.array(F.lit("r"))).when(F.col("n") == 2, F.array(F.lit("r"), F.lit(None).cast("string")))

    with pytest.raises(ValueError, match="already"):
        access.access_rule("test rule")(lambda: F.lit(None))
    with pytest.raises(access.Denied):
        access.resolved(F.col("id"), F.col("m"), (), ("no such rule",), ())
    d = spark.createDataFrame([("a", 0, None), ("a", 1, {}), ("a", 2, {"x": "y"}), ("f/a", 1, None), ("a", 1, {"roles": " b, a,"}), ("a", 1, {"roles": ""}), (None, None, {"roles": None})], "id string, n int, m map<string,string>")
    got = [tuple(r) for r in d.select(access.resolved(F.col("id"), F.col("m"), (("F/*", ("folder",)),), ("test rule",), ("all",)).alias("x")).select("x.*").collect()]
    assert got == [(["all"], "default"), (["r"], "access rule test rule"), ([], "access rule test rule failed"), (["folder"], "folder F/*"), (["b", "a"], "label"), ([], "label"), ([], "label")]
    del access.RULES["test rule"]


def test_overlaps_and_gates(spark):
    rows = [(1, 0, 0, 10), (1, 1, 4, 14), (1, 2, 8, 9), (1, 3, 14, 20), (2, 0, 0, 5), (2, 1, 5, 9)]
    got = {(r.doc_id, r.ordinal): r.overlaps for r in prepare.overlapping(spark.createDataFrame(rows, "doc_id int, ordinal int, start int, end int")).collect()}
    assert got == {(d, o): sum(d == e and p > o and s < z for e, p, s, _ in rows) for d, o, _, z in rows}
    runs = spark.createDataFrame([(0.9, 0.86), (0.9, 0.84), (None, 0.1), (0.5, None)], "before double, now double")
    assert [r[0] for r in runs.select(Q.judged_gate(F.col("before"), F.col("now"))).collect()] == [True, False, True, True]


def test_cross_scores(spark):
    rows = [(1, 1, 0.9, "qq", "aaaa"), (1, 2, 0.8, "qq", "aa"), (1, 3, 0.7, "qq", None), (1, 4, 0.6, "qq", "bb"), (1, 5, 0.5, "qq", "nan"), (2, 1, 0.1, None, "x")]
    d = spark.createDataFrame(rows, "query int, rank int, score double, question string, text string")

    def score(pairs):
        assert 0 < len(pairs) <= 2
        return [float("nan") if t == "nan" else -abs(len(q) - len(t)) for q, t in pairs]

    got = [(r.query, r.rank, r.prior_rank, r.prior_score, r.score) for r in hooks.cross_scored(d, score, 4, 2).orderBy("query", "rank").collect()]
    assert got == [(1, 1, 2, 0.8, 0.0), (1, 2, 4, 0.6, 0.0), (1, 3, 1, 0.9, -2.0), (1, 4, 3, 0.7, None), (2, 1, 1, 0.1, None)]


def test_sources(spark, tmp_path):
    for name in ("in/a.md", "in/sub/b.txt", "in/.hidden", "one.md", "other/a.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    got = {r.doc_id: (r.size, r.content_type) for r in files.list_sources(spark, [f"file://{tmp_path}/in", f"file://{tmp_path}/one.md"]).collect()}
    assert got == {"a.md": (7, "text/markdown"), "sub/b.txt": (12, "text/plain"), "one.md": (6, "text/markdown")}
    with pytest.raises(ValueError, match="two sources have a.md"):
        files.list_sources(spark, [f"file://{tmp_path}/in", f"file://{tmp_path}/other"])
    with pytest.raises(ValueError, match="no folder"):
        files.list_sources(spark, [])
