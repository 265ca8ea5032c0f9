"""Variants that share stages, traces of misses, streams that equal batches."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import manage, misses, variants
from lodestone.streaming import jobs


def test_variants_share_their_stages(spark, tmp_path):
    root, calls = f"file://{tmp_path}", []

    def stage(name, **settings):
        def run(df, **given):
            calls.append((name, given))
            return df.withColumn("x", F.col("x") + given.get("add", 0)) if name != "boom" else df.select(F.raise_error(F.lit("boom")).alias("x"))

        return variants.Stage(name, run, settings)

    source = spark.range(5).select(F.col("id").alias("x"))
    plans = {"a": [stage("parse"), stage("add", add=1)], "b": [stage("parse"), stage("add", add=2)], "c": [stage("parse"), stage("add", add=1), stage("add", add=1)]}
    out, log = variants.run_variants(spark, root, source, "v1", plans)
    assert {k: sorted(r.x for r in v.collect()) for k, v in out.items()} == {"a": [1, 2, 3, 4, 5], "b": [2, 3, 4, 5, 6], "c": [2, 3, 4, 5, 6]}
    assert [(r.variant, r.stage, r.status, r.n_rows) for r in log.orderBy("variant", "position").collect()] == [("a", "parse", "run", 5), ("a", "add", "run", 5), ("b", "parse", "cached", 5), ("b", "add", "run", 5), ("c", "parse", "cached", 5), ("c", "add", "cached", 5), ("c", "add", "run", 5)]
    assert [c[0] for c in calls].count("parse") == 1
    # the same again reads what stands; another version of the source does not
    assert variants.run_variants(spark, root, source, "v1", plans)[1].where("status = 'run'").count() == 0
    assert variants.run_variants(spark, root, source, "v2", {"a": plans["a"]})[1].where("status = 'run'").count() == 2
    # a stage that fails leaves the stages before it, which are not run again
    with pytest.raises(Exception, match="boom"):
        variants.run_variants(spark, root, source, "v3", {"a": [stage("parse"), stage("boom")]})
    assert [r.status for r in variants.run_variants(spark, root, source, "v3", {"a": [stage("parse"), stage("add", add=9)]})[1].orderBy("position").collect()] == ["cached", "run"]


def test_comparison(spark):
    rows = lambda *found: spark.createDataFrame([(q, r is not None, r) for q, r in enumerate(found)], "query int, found boolean, rank int")
    runs = {"a": rows(1, None, 2), "b": rows(None, 1, 2), "c": rows(None, None, None)}
    got = {r.variant: r for r in variants.compared(runs).collect()}
    assert got["a"].best and got["b"].best and not got["c"].best and got["a"].mrr == 0.5 and got["c"].hit_rate == 0
    assert {r.query: (r.found_by, r.missed_by) for r in variants.question_changes(runs).collect()} == {0: (["a"], ["b", "c"]), 1: (["b"], ["a", "c"]), 2: (["a", "b"], ["c"])}
    assert not variants.compared({"c": runs["c"]}).first().best


GOLD = "the quick brown fox jumps over a lazy dog"


def test_miss_traces(spark):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    full = "intro words here. " + GOLD + " and then some more words follow until the end of it all, one by one."
    broken = "it says the quick brown page seven fox jumps over a lazy dog with words enough to be read by anyone at all here"
    texts = {1: full, 2: broken, 3: "few words", 4: "many words " * 20, 5: full, 6: full, 7: full, 8: full, 9: full, 10: full.upper()}
    golds = table([(q, 0, GOLD) for q in texts] + [(11, 0, "  "), (12, 0, None), (1, 1, "not there at all")], "query int, place int, gold string")
    parsed = table(list(texts.items()), "query int, text string")
    clean = parsed.withColumn("text", F.when(F.col("query") == 5, F.replace("text", F.lit("fox"), F.lit(""))).otherwise(F.col("text")))
    pieces = table([(q, k, t) for q, x in texts.items() for k, t in enumerate([x[:40], x[30:]] if q == 6 else [x[:10], x])] , "query int, ordinal int, text string")
    hits = table([(q, r, t) for q, x in texts.items() for r, t in enumerate([x[:10], x[5:12], x] if q != 7 else [x[:10]], 1)], "query int, rank int, text string")
    after = hits.where("query <> 8 or rank < 3").withColumn("rank", F.when(F.col("query") == 9, F.col("rank") + 4).otherwise(4 - F.col("rank")))
    got = {r.query: r for r in misses.traced(golds, parsed, [("Strip", clean)], pieces, hits, after, k=5).collect()}
    assert set(got) == set(texts)
    assert {q: (r.lost_at, r.kind) for q, r in got.items()} == {1: (None, None), 2: ("parse", "broken"), 3: ("parse", "scanned"), 4: ("parse", "parse"), 5: ("clean", None), 6: ("chunk", None), 7: ("search", None), 8: ("rerank", None), 9: ("top_k", None), 10: (None, None)}
    assert (got[1].piece, got[1].rank, got[1].fix, [s.status for s in got[1].steps]) == (2, 1, None, ["pass"] * 6) and got[1].finding.startswith("Found")
    assert [s.status for s in got[7].steps] == ["pass", "pass", "pass", "lost", "not_checked", "not_checked"] and "1 piece, without piece 2" in got[7].finding
    assert "Strip took it away" in got[5].finding and [s.name for s in got[5].steps] == ["Parse", "Strip", "Chunk", "Search", "Rerank", "Top 5"]
    assert "begins in piece 1 and ends in piece 2" in got[6].finding and "It came 7th" in got[9].finding and got[9].rank == 7
    assert all((r.fix is None) == (r.lost_at is None) for r in got.values()) and got[2].fix == misses.FIXES["broken"]
    one = {r.query: r.lost_at for r in misses.traced(golds, parsed, [], pieces, hits, k=2).collect()}
    assert one[1] == "top_k" and one[5] == "top_k" and one[7] == "search"
    assert misses.traced(golds.limit(0), parsed, [], pieces, hits).count() == 0
    names = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 21, 111, 102)], "n long").select(misses.nth(F.col("n")))
    assert [r[0] for r in names.collect()] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "111th", "102nd"]


def stream_of(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch, in order."""
    for k, rows in enumerate(batches):
        pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_json(f"{tmp_path}/in-{k}.json", orient="records", lines=True, date_format="iso")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"file://{tmp_path}/in-*.json")


def run(spark, tmp_path, out):
    out.writeStream.format("parquet").outputMode("append").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out")


def test_limits_by_timers(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(n % 4, n, begin + timedelta(seconds=(n * n * 7) % 300 + 300 * (n // 50))) for n in range(400)]
    batches = [rows[k : k + 50] for k in range(0, 400, 50)]
    spark.conf.set(*jobs.ROCKS)
    try:
        got = run(spark, tmp_path, jobs.limited_by_timers(stream_of(spark, tmp_path, batches, "user_id long, event_id long, ts timestamp"), 3, 60))
        held = spark.read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", "held").load()
        left = held.count()
    finally:
        spark.conf.unset(jobs.ROCKS[0])
    want, times = {}, {}
    for b in batches:  # batch after batch, in order of time within each
        for user, event, at in sorted(b, key=lambda r: (r[2], r[1])):
            now = times[user] = [t for t in times.get(user, []) if t > at - timedelta(seconds=60)] + [at]
            want[event] = (user, len(now), len(now) > 3)
    assert {r.event_id: (r.user_id, r.recent, r.refused) for r in got.collect()} == want and any(r[2] for r in want.values())
    assert 0 < left < 120  # of 400 turns only those of the last minutes are still held


def test_streamed_pieces_equal_batch(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(n, begin + timedelta(minutes=9 * n - (50 if n % 6 == 5 else 0)), (f"word{n} " * (n % 40 + 1) + "\nPage 3\nlicense text\n") if n % 11 else None) for n in range(120)]
    schema = "doc_id long, ts timestamp, text string"
    stream = stream_of(spark, tmp_path, [rows[k : k + 30] for k in range(0, 120, 30)], schema)
    build = lambda d: jobs.piece_histogram(jobs.chunked(jobs.cleaned(d, (r"^page \d+$", "LICENSE")), 16, 4), step=4)
    batch = spark.createDataFrame(rows, schema)
    got, every = {tuple(r) for r in run(spark, tmp_path, build(stream)).collect()}, {tuple(r) for r in build(batch).collect()}
    closed = begin + timedelta(minutes=9 * 118) - timedelta(hours=2)
    assert got == {r for r in every if r[0] + timedelta(hours=1) <= closed} and len(got) > 20
    pieces = jobs.chunked(jobs.cleaned(batch, ("license",)), 16, 4)
    assert pieces.where("text ilike '%license%'").count() == 0 and pieces.where("text ilike '%page 3%'").count() > 0 and jobs.cleaned(batch, ()).where("text is null").count() == 11


def test_measures(spark):
    rows = [("a", 10.0, "run", 5, None, 0.5, ["declined"], "up"), ("a", 2000.0, "failed", None, 2, None, None, None), ("b", None, None, 1, 1, 0.25, [], "down")]
    d = spark.createDataFrame(rows, "step string, ms double, status string, input_tokens int, output_tokens int, dollars double, flags array<string>, feedback string")
    got = {r.step: r for r in manage.step_metrics(d).collect()}
    a = got["a"]
    assert (a.n, a.errors, a.seconds, a.le_1, a.le_8, a.input_tokens, a.output_tokens, a.dollars, a.declined, a.low_grounding, a.feedback_up, a.feedback_down) == (2, 1, 2.01, 1, 2, 5, 2, 0.5, 1, 0, 1, 0)
    assert (got["b"].feedback_down, got["b"].dollars) == (1, 0.25)
    assert manage.step_metrics(d.select("step", "ms", "status")).columns == ["step", "n", "errors", "seconds", *[f"le_{k}" for k in range(14)]]
