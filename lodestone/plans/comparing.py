"""Queries over variants of a pipeline and traces of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import manage as M
from lodestone.operators import misses as X
from lodestone.operators import prepare as P
from lodestone.operators import retrieve as R
from lodestone.operators import variants as V
from lodestone.plans.judging import streamed
from lodestone.plans.preparing import FOLDED, TOKENS, load
from lodestone.plans.searching import BM25, EVAL, questions
from lodestone.query_set import query
from lodestone.sources.tables import new_path, stored
from lodestone.streaming import jobs

CLEANED = BM25.replace("from documents", "from (select doc_id, replace(text, chr(10), ' ') as text from documents)")
SMALL = CLEANED.replace("448 + 512", "112 + 128").replace("448", "112").replace("512", "128")
COUNTED = CLEANED[: CLEANED.rindex("bm as (")] + "bm as (select query, piece, row_number() over (partition by query order by count(*) desc, piece) as rank from post join qt using (term) group by 1, 2)"
NUMBERS = "count(*) total, sum(found::int) n_found, round(avg(found::int), 9) hit_rate, round(avg(coalesce(1.0 / rank, 0)), 9) mrr"


def by_words(pieces: DataFrame, spark: SparkSession, sf_dir: str, how: str, k: int) -> DataFrame:
    q = questions(spark, sf_dir)
    hits = F.broadcast((R.bm25 if how == "bm25" else R.overlap)(q, pieces, k)).join(pieces, "piece")  # k rows a question
    return R.evaluation(hits, q.select("query", F.col("text").alias("gold")), k)


@query(f"""with v as (select 'large' variant, 3 n_run, * from (with {CLEANED}{EVAL} select {NUMBERS} from ev) union all select 'overlap', 1, * from (with {COUNTED}{EVAL} select {NUMBERS} from ev) union all select 'small', 2, * from (with {SMALL}{EVAL} select {NUMBERS} from ev))
select variant, n_run, 3 - n_run n_cached, total, n_found, hit_rate, mrr, hit_rate > 0 and (hit_rate, mrr) = (select (hit_rate, mrr) from v order by hit_rate desc, mrr desc limit 1) best from v""")
def variant_comparison(spark, sf_dir):
    """Two sizes of pieces and two searches: the cleaned documents are made once, the large pieces once for both searches."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    clean = V.Stage("clean", lambda d, old, new: d.withColumn("text", F.replace("text", F.lit(old), F.lit(new))), {"old": "\n", "new": " "})
    pieces = lambda size, overlap: V.Stage("chunk", lambda d, size, overlap: P.token_chunks(d, size, overlap).select((F.col("doc_id") * (1 << 32) + F.col("ordinal")).alias("piece"), "text"), {"size": size, "overlap": overlap})
    search = lambda how: V.Stage("search", lambda p, how, k: by_words(p, spark, sf_dir, how, k), {"how": how, "k": 5})
    plans = {"large": [clean, pieces(512, 64), search("bm25")], "overlap": [clean, pieces(512, 64), search("overlap")], "small": [clean, pieces(128, 16), search("bm25")]}
    found, log = V.run_variants(spark, new_path(spark, "variants"), documents, sf_dir, plans)
    runs = log.groupBy("variant").agg(F.sum((F.col("status") == "run").cast("int")).alias("n_run"), F.sum((F.col("status") == "cached").cast("int")).alias("n_cached"))
    return V.compared(found).join(runs, "variant").select("variant", "n_run", "n_cached", "total", "n_found", "hit_rate", "mrr", "best")


LOOSE = "array_to_string(list_filter(string_split({0}, ' '), lambda w: not regexp_matches(w, '" + T.MARKER + r"') and not regexp_matches(w, '^\p{L}$')), ' ')"


def tier_sql(gold: str, text: str) -> str:
    g, t = FOLDED.format(gold), FOLDED.format(text)
    return f"(contains({text}, {gold}) or contains({t}, {g}) or (length({LOOSE.replace("{0}", g)}) > 0 and contains({LOOSE.replace("{0}", t)}, {LOOSE.replace("{0}", g)})))"


PARTS = f"""{TOKENS.replace("448 + 512", "56 + 64").replace("448", "56").replace("512", "64").replace("from documents", "from cleaned")}"""


@query(rf"""with w as (select doc_id, text t, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') w from documents),
g as (select doc_id, t, trim(case when doc_id % 6 = 1 then regexp_replace(array_to_string(w[10:21], ' '), '[aeiou]', 'x', 'g') else array_to_string(w[10:21], ' ') end, ' ') gold from w), g1 as (select * from g where gold <> ''),
parsed as (select doc_id, case when doc_id % 6 = 2 then substr(t, 1, 40) else t end as text from g), cleaned as (select doc_id, case when doc_id % 6 = 3 then substr(text, 120) else text end as text from parsed),
{PARTS}, p as (select doc_id, ordinal + 1 piece, substr(whole, start + 1, "end" - start) as text from chunks), h as (select doc_id, row_number() over (partition by doc_id order by piece desc) as rank, text from p where doc_id % 6 <> 4 or piece % 2 = 0),
r as (select g1.doc_id as query, (select bool_or({tier_sql('gold', 'parsed.text')}) from parsed where parsed.doc_id = g1.doc_id) a, (select bool_or({tier_sql('gold', 'cleaned.text')}) from cleaned where cleaned.doc_id = g1.doc_id) b, (select min(piece) from p where p.doc_id = g1.doc_id and {tier_sql('gold', 'p.text')}) c, (select min(rank) from h where h.doc_id = g1.doc_id and {tier_sql('gold', 'h.text')}) d from g1),
l as (select *, case when not coalesce(a, false) then 'parse' when not coalesce(b, false) then 'clean' when c is null then 'chunk' when d is null then 'search' when d > 3 then 'top_k' end lost_at from r)
select query, lost_at, case when lost_at is null or lost_at in ('search', 'top_k') then c end piece, case when lost_at is null or lost_at = 'top_k' then d end as rank, case when lost_at is null then 5 else list_position(['parse', 'clean', 'chunk', 'search', 'top_k'], lost_at) - 1 end::int passed from l""")
def miss_traces(spark, sf_dir):
    """A question for every document; some are lost on purpose at each step."""
    i, t = F.col("doc_id"), F.col("text")
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_join(F.slice(F.filter(F.split(t, r"\s+", 24), lambda w: w != ""), 10, 12), " ")  # what follows the 22nd word is not parted
    golds = d.select(i.alias("query"), F.lit(0).alias("place"), F.when(i % 6 == 1, F.regexp_replace(words, "[aeiou]", "x")).otherwise(words).alias("gold"))
    parsed = d.select("doc_id", F.when(i % 6 == 2, F.left(t, F.lit(40))).otherwise(t).alias("text"))
    cleaned = parsed.select("doc_id", F.when(i % 6 == 3, F.substring(t, 120, 1 << 30)).otherwise(t).alias("text"))
    pieces = stored(P.token_chunks(cleaned, 64, 8).select(i.alias("query"), "ordinal", "text"), "pieces")  # read twice
    named = lambda x: x.select(i.alias("query"), "text")
    q = F.col("query")
    hits = pieces.where((q % 6 != 4) | (F.col("ordinal") % 2 == 1)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ordinal"))))
    got = X.traced(golds, named(parsed), [("Cutter", named(cleaned))], pieces, hits.select("query", "rank", "text"), k=3)
    return got.select("query", "lost_at", "piece", "rank", F.size(F.filter("steps", lambda s: s["status"] == "pass")).alias("passed"))


# --- streams

HOUR = "timestamp '2024-01-01 00:00:00' + (doc_id * interval 10 minute)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, one each ten minutes."""
    return load(spark, sf_dir, "documents").select("doc_id", "text", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id * 10 as int))").alias("ts"))


@query(rf"""with cleaned as (select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)license') and not regexp_matches(x, '(?i)^\s*(?:page )?\d+\s*$')), chr(10)) as text from documents), {TOKENS.replace("448 + 512", "112 + 128").replace("448", "112").replace("512", "128").replace("from documents", "from cleaned")}
select date_trunc('hour', {HOUR})::varchar as start, (tokens - 1) // 16 * 16 bucket, count(*) n, sum(tokens)::bigint tokens from chunks where date_trunc('hour', {HOUR}) + interval 3 hours <= (select max({HOUR}) from chunks) group by 1, 2""")
def streamed_chunks(spark, sf_dir):
    """A stream of documents cleaned and cut without state, and a histogram of the pieces by window with late data."""
    build = lambda s: jobs.piece_histogram(jobs.chunked(jobs.cleaned(s, ("license", r"^\s*(?:page )?\d+\s*$")), 128, 16), step=16)
    return streamed(spark, timed(spark, sf_dir), build).select(F.col("start").cast("string").alias("start"), "bucket", "n", "tokens")


@query("""select user_id, event_id, recent, recent > 2 refused from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) - count(*) over (partition by user_id, ts order by event_id desc) + 1 recent from events)""")
def streamed_limits_by_timers(spark, sf_dir):
    """The limit of ``streamed_limits`` from list state with timers."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    before = spark.conf.get(jobs.ROCKS[0], None)
    spark.conf.set(*jobs.ROCKS)
    try:
        return streamed(spark, e, lambda s: jobs.limited_by_timers(s, 2, 3600))
    finally:
        spark.conf.unset(jobs.ROCKS[0]) if before is None else spark.conf.set(jobs.ROCKS[0], before)


MEASURED = ", ".join(f"sum((case when event_id % 5 = {k} then 1 else 0 end))::bigint {f}" for k, f in enumerate(M.FLAGS))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    flags = F.when(i % 5 < 3, F.array(F.get(F.array(*map(F.lit, M.FLAGS)), (i % 5).cast("int"))))
    return load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), (F.col("value") * 100).alias("ms"), F.when(i % 10 == 0, "failed").otherwise("run").alias("status"), F.when(i % 4 != 0, i % 100).alias("input_tokens"), (i % 50).alias("output_tokens"), ((i % 64) / 64).alias("dollars"), flags.alias("flags"), F.when(i % 7 == 0, "up").when(i % 7 == 1, "down").alias("feedback"))


COLUMNS = f"sum(case when event_id % 4 <> 0 then event_id % 100 else 0 end)::bigint input_tokens, sum(event_id % 50)::bigint output_tokens, round(sum((event_id % 64) / 64.0::double), 9) dollars, {MEASURED}, sum((event_id % 7 = 0)::int)::bigint feedback_up, sum((event_id % 7 = 1)::int)::bigint feedback_down"


@query(f"select event_type step, count(*) n, sum((event_id % 10 = 0)::int) errors, {COLUMNS} from events group by 1")
def step_usage(spark, sf_dir):
    names = ["step", "n", "errors", "input_tokens", "output_tokens", "dollars", *M.FLAGS, "feedback_up", "feedback_down"]
    return M.step_metrics(measured(spark, sf_dir)).select(*names)


@query(f"select date_trunc('hour', ts)::varchar as start, event_type step, count(*) n, {COLUMNS} from events where date_trunc('hour', ts) + interval 3 hours <= (select max(ts) from events) group by 1, 2")
def streamed_usage(spark, sf_dir):
    names = ["step", "n", "input_tokens", "output_tokens", "dollars", *M.FLAGS, "feedback_up", "feedback_down"]
    return streamed(spark, measured(spark, sf_dir), jobs.metrics).select(F.col("start").cast("string").alias("start"), *names)
