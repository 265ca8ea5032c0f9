"""Queries over pages' elements, chunkers, reranking, model replies, regressions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks as C
from lodestone.operators import elements as E
from lodestone.operators import judge as J
from lodestone.operators import prepare as P
from lodestone.operators import rerank as K
from lodestone.operators import retrieve as R
from lodestone.operators import sentences as N
from lodestone.plans.preparing import load
from lodestone.plans.searching import DENSE, LEXICAL, asked, questions, vectors
from lodestone.query_set import query
from lodestone.sources import files
from lodestone.sources.tables import new_path, stored
from lodestone.streaming import jobs


@query()
def html_elements(spark, sf_dir):
    return E.html_elements(load(spark, sf_dir, "pages"))


@query()
def html_heading_paths(spark, sf_dir):
    return E.heading_paths(E.html_elements(load(spark, sf_dir, "pages"))).select("doc_id", "order", "heading_path")


@query(r"""select page_id, nullif(trim(regexp_replace(regexp_extract(substr(html, 1, 65536), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') title from pages""")
def html_titles(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", E.html_title(F.col("html")).alias("title"))


@query()
def markdown_elements(spark, sf_dir):
    return E.markdown_elements(load(spark, sf_dir, "documents"))


@query()
def document_sentences(spark, sf_dir):
    return N.sentences(load(spark, sf_dir, "documents"))


@query()
def sentence_windows(spark, sf_dir):
    return N.sentence_windows(load(spark, sf_dir, "documents"))


@query()
def recursive_chunks(spark, sf_dir):
    return C.recursive_chunks(load(spark, sf_dir, "documents"))


@query()
def chunks_by_table_function(spark, sf_dir):
    """The recursive chunker as a table function of SQL, over the whole table."""
    C.register_chunker(spark, "recursive_spans", C.recursive)
    return spark.sql("select * from recursive_spans(table(select doc_id, text from {d}))", d=load(spark, sf_dir, "documents"))


@query()
def markdown_sections(spark, sf_dir):
    return C.markdown_sections(load(spark, sf_dir, "documents"))


@query()
def layout_blocks(spark, sf_dir):
    return C.layout_blocks(load(spark, sf_dir, "documents"))


@query("""select doc_id, row_number() over (partition by doc_id order by turn) - 1 as "order", turn from (select conv_id doc_id, turn from conversations where role <> 'system')""")
def renumbered_turns(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("order"), "turn", "role")
    return E.renumbered(c, F.col("role") != "system").select("doc_id", "order", "turn")


@query("""select conv_id doc_id, turn id, case when turn >= 2 then turn - 2 end parent_id from conversations t where turn % 2 = 0""")
def reparented_turns(spark, sf_dir):
    e = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"))
    return E.reparented(e, e.where("id % 2 = 0"))


@query()
def mmr_rerank(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = R.dense(asked(spark, sf_dir), v, 20).join(v.select("piece", "vector"), "piece")
    return K.mmr(hits)


@query(f"with {DENSE}, h as (select query, piece, score, rank from de where rank <= 20) select query, piece, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) relevance from h window w as (partition by query)")
def hit_relevance(spark, sf_dir):
    return R.dense(asked(spark, sf_dir), vectors(spark, sf_dir), 20).select("query", "piece", F.round(K.relevance(F.col("score")), 6).alias("relevance"))


@query(f"with {DENSE}, h as (select query, piece, score, rank from de where rank <= 20) select * from (select query, piece, rank prior_rank, row_number() over (partition by query order by piece % 10 desc, rank) as rank from h) where rank <= 5")
def rescored_hits(spark, sf_dir):
    hits = R.dense(asked(spark, sf_dir), vectors(spark, sf_dir), 20)
    return K.rescored(hits, F.col("piece") % 10).select("query", "piece", "prior_rank", "rank")


STOP = " ".join(T.EXPANSION_STOP_WORDS)


@query(rf"""with {LEXICAL}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from documents), t as (select * from w where length(term) >= 3 and not list_contains(string_split('{STOP}', ' '), term)), df as (select term, count(distinct doc_id) df from t group by 1), n as (select count(*) n from documents),
own as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from benchmark), f as (select query, term, count(*) tf from (select query, piece doc_id from lx where rank <= 3) join t using (doc_id) group by 1, 2)
select * from (select query, term, score, row_number() over (partition by query order by score desc, term) as rank from (select query, term, round(tf * (ln((n + 1) / (df + 1)) + 1), 9) score from f join df using (term), n where (query, term) not in (select (query, term) from own))) where rank <= 5""")
def expansion_terms(spark, sf_dir):
    """Terms of the three documents that match each benchmark item best."""
    d = load(spark, sf_dir, "documents")
    items = questions(spark, sf_dir)
    best = R.bm25(items, d.select(F.col("doc_id").alias("piece"), "text"), 3).select("query", F.col("piece").alias("doc_id"))
    near, background = K.feedback_terms(d, best)
    return K.expansion_terms(near, background, items.select("query", F.explode(T.expansion_tokens(F.col("text"))).alias("term")).distinct())


REPLY = """case event_id % 5 when 0 then 'Well: {"score": ' || floor(value / 100 * 1000 + 0.5) / 1000 || ', "reason": "ok"}' when 1 then '{"score": true, "reason": "x"}' when 2 then 'none' when 3 then '{"score": "0.5"}' else '{"score": 0.25, "reason": "fair"}' end"""


@query("""select event_type, round(avg(s), 9) mean_score, count(s) judged, sum((s is null)::int) skipped, sum((s < 0.5)::int) n_below from (select event_type, case when event_id % 5 = 0 and round(value / 100, 3) between 0 and 1 then round(value / 100, 3) when event_id % 5 = 4 then 0.25 end s from events) group by 1""")
def judge_summary(spark, sf_dir):
    reply = J.judge_reply(F.expr(REPLY))
    return load(spark, sf_dir, "events").select("event_type", reply["score"].alias("s")).groupBy("event_type").agg(*J.judge_numbers(F.col("s"), 0.5))


@query("""select item_id, case when item_id % 4 = 0 then 'no question' when length(text) > 400 then 'question too long' when item_id % 4 = 1 then 'no gold answer' end error, case when item_id % 4 = 1 then [] else ['a', 'b'] end golds from benchmark""")
def question_checks(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    i = F.col("item_id") % 4
    golds = J.golds_of(F.when(i == 1, " || ").otherwise(" a||b ||a"))
    return b.select("item_id", J.question_error(F.when(i == 0, " ").otherwise(F.col("text")), golds, 400, 5).alias("error"), golds.alias("golds"))


@query("""select conv_id, turn, case when length(trim(text)) between 1 and 60 and not contains(trim(text), E'\\n') then trim(text) else 'q' end as text, case when trim(text) = '' then 'empty' when length(trim(text)) > 60 then 'too long' when contains(trim(text), E'\\n') then 'more than one line' end reason from conversations""")
def rewrites(spark, sf_dir):
    r = J.accepted_rewrite(F.lit("q"), F.col("text"), 60)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", r["text"].alias("text"), r["reason"].alias("reason"))


RUNS = """b as (select event_id id, 'q' || user_id question, value > 50 found from events where event_id % 3 <> 1), a as (select case when event_id % 4 = 0 then -event_id else event_id end id, 'q' || user_id question, value > 30 found from events where event_id % 3 <> 2),
same as (select b.id before_id, a.id after_id, b.found before_found, a.found after_found, 'id' matched_by from a join b on a.id = b.id), lb as (select *, row_number() over (partition by question order by id) n from b where id not in (select before_id from same)), la as (select *, row_number() over (partition by question order by id) n from a where id not in (select before_id from same)),
pairs as (select * from same union all select lb.id, la.id, lb.found, la.found, 'text' from lb join la on lb.question = la.question and lb.n = la.n)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("question", F.concat(F.lit("q"), F.col("user_id").cast("string")))
    i = F.col("event_id")
    before = e.where("event_id % 3 <> 1").select(i.alias("id"), "question", (F.col("value") > 50).alias("found"))
    after = e.where("event_id % 3 <> 2").select(F.when(i % 4 == 0, -i).otherwise(i).alias("id"), "question", (F.col("value") > 30).alias("found"))
    return J.paired(before, after)


@query(f"with {RUNS} select * from pairs")
def regression_pairs(spark, sf_dir):
    return runs(spark, sf_dir)


@query(f"with {RUNS} select 'c' || before_id % 5 category, count(*) compared, sum(before_found::int) found_before, sum(after_found::int) found_now, sum((before_found and not after_found)::int) newly_lost, sum((not before_found and after_found)::int) newly_found, sum((before_found and not after_found)::int) <= 2 gate_ok, count(*) < 10 weak from pairs group by 1")
def regression_gates(spark, sf_dir):
    return J.regression_counts(runs(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), (F.col("before_id") % 5).cast("string"))), 2)


@query("""select b.item_id, case when not coalesce(bool_or(contains(d.text, b.text)), false) then 'parse' when not bool_or(contains(d.text, b.text) and length(d.text) < 3000) then 'clean' when not bool_or(contains(d.text, b.text) and length(d.text) < 3000 and d.doc_id % 2 = 0) then 'search' end lost_at from benchmark b left join documents d on contains(d.text, b.text) group by 1""")
def miss_steps(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    short, even = F.length("text") < 3000, F.col("doc_id") % 2 == 0
    met = R.containing(b, d.select("text", short.alias("short"), even.alias("even"))).groupBy("item_id").agg(F.lit(True).alias("parsed"), F.max("short").alias("cleaned"), F.max(F.col("short") & F.col("even")).alias("hit"))
    return b.select("item_id").join(met, "item_id", "left").select("item_id", J.lost_at({"parse": F.col("parsed"), "clean": F.col("cleaned"), "search": F.col("hit")}).alias("lost_at"))


@query("""select page_id answer_id, lower(regexp_extract(split_part(url, '://', 2), '^[^/?#]*')) || regexp_replace(regexp_replace(split_part(url, '://', 2), '^[^/?#]*', ''), '[.,;:!?/]+$', '') url_key from pages where page_id % 3 <> 0 and regexp_matches(url, '^https?://')""")
def unsourced_links(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("answer_id"), F.concat(F.lit("see "), F.col("url"), F.lit(" for it")).alias("text"))
    return J.unsourced_links(p, p.where("answer_id % 3 = 0"))


@query("""select user_id, substr(fact, 1, 200) fact, n from (select *, row_number() over (partition by user_id order by turn) n from (select conv_id % 20 user_id, conv_id * 1000 + turn turn, text fact, row_number() over (partition by conv_id % 20, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') order by conv_id * 1000 + turn) k from conversations where role = 'user' and trim(text) <> '') where k = 1) where n <= 3""")
def remembered_facts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") % 20).alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.col("text").alias("fact"))
    return J.new_facts(c, c.where("false"), T.normalise)


@query("select event_type, case when count(case when event_id % 7 <> 0 or event_type <> 'error' then event_id % 50 end) = count(*) then sum(event_id % 50) end tokens from events group by 1")
def usage_sums(spark, sf_dir):
    i = F.col("event_id")
    tokens = F.when((i % 7 != 0) | (F.col("event_type") != "error"), i % 50)
    return load(spark, sf_dir, "events").groupBy("event_type").agg(J.whole_or_null(tokens).alias("tokens"))


@query()
def chunker_disagreement(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    found = stored(N.sentences(d).drop("text"), "sentences")  # read twice
    by = {"recursive": C.recursive_chunks(d), "sentences": N.windows(found), "tokens": P.token_chunks(d)}
    cuts = None
    for name, c in by.items():
        c = c.select("doc_id", F.lit(name).alias("chunker"), F.col("start").cast("long").alias("cut"))
        cuts = c if cuts is None else cuts.unionByName(c)
    units = found.select("doc_id", "start", "end")
    return J.cutters_disagree(cuts, units)


@query("select e.* from events e where user_id not in (select user_id from events where event_type = 'error' group by 1 having count(*) > 3)")
def users_deleted(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return J.without_user(e, e.where("event_type = 'error'").groupBy("user_id").count().where("count > 3"))


def streamed(spark: SparkSession, frame, build, mode: str = "append") -> DataFrame:
    """Runs build(stream of frame's rows) over all that is there, and gives what it wrote."""
    here = new_path(spark, "stream")
    frame.write.parquet(f"{here}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{here}/in")
    out = build(stream)
    out.writeStream.format("parquet").outputMode(mode).option("path", f"{here}/out").option("checkpointLocation", f"{here}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{here}/out")


@query("""select user_id, event_id, recent, recent > 2 refused from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) - count(*) over (partition by user_id, ts order by event_id desc) + 1 recent from events)""")
def streamed_limits(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, e, lambda s: jobs.limited(s, 2, 3600))


@query("select date_trunc('hour', ts)::varchar as start, event_type step, count(*) n, sum((event_id % 10 = 0)::int) errors, round(sum(value * 100) / 1000, 6) as seconds from events where date_trunc('hour', ts) + interval 3 hours <= (select max(ts) from events) group by 1, 2")
def streamed_metrics(spark, sf_dir):
    """The windows that the watermark has closed."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), (F.col("value") * 100).alias("ms"), F.when(F.col("event_id") % 10 == 0, "failed").otherwise("run").alias("status"))
    return streamed(spark, e, jobs.metrics).select(F.col("start").cast("string").alias("start"), "step", "n", "errors", "seconds")


@query("select event_id, user_id, event_type, value from events")
def streamed_once(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, e.unionByName(e), jobs.once_each).select("event_id", "user_id", "event_type", "value")


@query("select doc_id, sha256(text) sha from documents")
def streamed_ingest(spark, sf_dir):
    here = new_path(spark, "ingest")
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    d.withColumn("version", F.lit(1)).unionByName(d.withColumn("version", F.lit(0)).withColumn("text", F.lit("old"))).write.parquet(f"{here}/in")
    stream = spark.readStream.schema("doc_id long, text string, version int").parquet(f"{here}/in")
    jobs.ingest(stream, lambda b: b.select("doc_id", F.sha2("text", 256).alias("sha")), f"{here}/rows", f"{here}/state").awaitTermination()
    return jobs.newest_rows(spark.read.parquet(f"{here}/rows"))


@query(r"""select page_id, coalesce(case regexp_extract(lower(regexp_extract(url, '([^?#]*)', 1)), '\.(\w+)$', 1) when 'html' then 'text/html' when 'htm' then 'text/html' when 'md' then 'text/markdown' when 'txt' then 'text/plain' when 'pdf' then 'application/pdf' when 'csv' then 'text/csv' when 'json' then 'application/json' end, 'none') kind, case when page_id % 2 = 0 then 'tag' else page_id || ':' || length(html) end as version from pages""")
def source_versions(spark, sf_dir):
    name = F.regexp_extract("url", r"([^?#]*)", 1)
    version = files.source_version(F.when(F.col("page_id") % 2 == 0, "tag"), F.col("page_id"), F.length("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.coalesce(files.content_type(name), F.lit("none")).alias("kind"), version.alias("version"))
