"""Text and vector functions on small cases, and the registered queries against their SQL."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import manage as M
from lodestone.operators import prepare as P
from lodestone.operators import retrieve as R

SF = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.match_normalise, "Exam-\n ple of ﬁne “quotes”", 'example of fine "quotes"'),
        (T.loosen, "1. one d two - three", "one two three"),
        (T.preview, "x" * 81, "x" * 79 + "…"),
        (T.preview, "x" * 80, "x" * 80),
        (T.clean_text, "a\tb\x00c", "a bc"),
        (T.says_not_found, " The documents do not say. ", True),
        (T.says_not_found, "The documents do not say. But x is y.", False),
        (T.format_of, "a/b.HTM", "html"),
        (T.raw_url, "https://github.com/a/b/blob/main/x.md?plain=1", "https://raw.githubusercontent.com/a/b/main/x.md"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f, given) == want


def test_tiers(spark):
    rows = [("ab c", "xx ab c"), ("Ab  C", "x ab c"), ("ab c", "ab 1. c"), ("q", "z"), (None, "z")]
    got = spark.createDataFrame(rows, "g string, t string").select(T.match_tier(F.col("g"), F.col("t")).alias("m")).collect()
    assert [r[0] for r in got] == ["exact", "normalized", "reworded", None, None]


def test_texts_are_normalised_only_where_they_may_match(spark):
    texts = ["xx ab c", "x ab c", "ab 1. c", "z", None, "exam-\n ple of ﬁne “quotes”", "Straße A ΟΔΟΣ", "Exam-ple of", "a\u00a0b", "1. x. y", ""]
    golds = ["ab c", "Ab  C", "example of", "fine \"quotes", "STRASSE", "ΟΔΟΣ", "οδος", "a b", ". y", "x", "\n", "1. z"]
    pairs = spark.createDataFrame([(g, t) for g in golds for t in texts], "g string, t string")
    got = pairs.select("g", "t", T.matches(T.gold_parts(F.col("g")), F.col("t")).alias("m"), T.match_tier(F.col("g"), F.col("t")).alias("tier"), T.holds(F.col("t"), T.match_normalise(F.col("g"))).alias("h"), T.match_normalise(F.col("t")).contains(T.match_normalise(F.col("g"))).alias("held")).collect()
    assert [(r.g, r.t) for r in got if bool(r.m) != (r.tier is not None) or bool(r.h) != bool(r.held)] == []
    may = spark.createDataFrame([("plain text",), ("the quick fox",), ("soft-\nened",)], "t string").select(T.may_hold(F.col("t"), F.array(F.lit("quick"))).alias("m")).collect()
    assert [r.m for r in may] == [False, True, True]


@pytest.mark.parametrize("counts", [[], [None], [7], [3, 1], [5, 5, 2, 9, None], [(i * 37) % 512 + 1 for i in range(1001)], [1] * 19 + [8], [1] * 18 + [8, 8]])
def test_chunk_stats(spark, counts):
    got = P.chunk_stats(spark.createDataFrame([(c,) for c in counts], "tokens long"))
    n = sorted(c for c in counts if c is not None)
    want = (len(n), sum(n), (n[(len(n) - 1) // 2] + n[len(n) // 2]) / 2, n[max(math.ceil(len(n) * 0.95), 1) - 1], n[-1]) if n else (0, None, None, None, None)
    assert [tuple(r) for r in got.collect()] == [want]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_ranking_reply(spark):
    df = spark.createDataFrame([("2, then 0 and 2; 99999999999",), ("",)], "r string")
    assert [r[0] for r in df.select(T.parse_order(F.col("r"), F.lit(4))).collect()] == [[2, 0, 1, 3], [0, 1, 2, 3]]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    a, z = F.col("a"), F.col("z")
    got = r.select(V.cosine(a, a), V.cosine(a, z), V.normalised(z), V.normalised(a), V.l2_score(a, z), V.truncated(a, 3)).first()
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] == [0, 0] and got[3] == pytest.approx([0.6, 0.8]) and got[4] == -5 and got[5] is None


def test_token_chunks_are_slices(spark):
    text = "  one two, three four   five.\n\nsix "
    rows = P.token_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "   ")], "doc_id long, text string"), 4, 1).collect()
    assert {r.doc_id for r in rows} == {1} and all(text[r.start : r.end] == r.text for r in rows)
    assert [r.tokens for r in sorted(rows, key=lambda r: r.ordinal)] == [4, 4, 2]


def test_filters_match_nothing_without_values(spark):
    df = spark.createDataFrame([(1, ["a"]), (None, None)], "x int, l array<string>")
    assert df.where(R.in_filter(F.col("x"), [])).count() == 0 and df.where(R.in_filter(F.col("x"), [1])).count() == 1
    assert df.where(R.any_of(F.col("l"), [])).count() == 0 and df.where(R.any_of(F.col("l"), ["a", "b"])).count() == 1


def test_fusion_refuses_no_weight(spark):
    with pytest.raises(ValueError, match="weights"):
        R.rrf(None, None, weights=(0, 0))


def test_manifest_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "doc_id long, version string")
    b = spark.createDataFrame([(2, "y"), (3, None), (4, "x")], "doc_id long, version string")
    assert dict(M.manifest_diff(a, b).collect()) == {1: "removed", 2: "changed", 3: "unchanged", 4: "added"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query_against_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.sql(entry.oracle_sql()[name])
    at = [list(found.columns).index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
