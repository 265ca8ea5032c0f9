"""Queries over index rows, owners, traces, feedback and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks as C
from lodestone.operators import records as D
from lodestone.operators import retrieve as R
from lodestone.operators import sentences as N
from lodestone.plans.preparing import lines, load
from lodestone.plans.searching import ITEM_DENSE, LEXICAL, dense_and_lexical, vectors
from lodestone.query_set import query


@query("select count(*) n_rows, min(len(embedding)) dims, max(len(embedding)) most_dims, count(distinct label) labels, min(vec_id) as first, max(vec_id) as last from embeddings")
def index_descriptor(spark, sf_dir):
    return D.descriptor(vectors(spark, sf_dir))


@query("select distinct sha256('m|' || text) as key, text from documents where text not in (select text from documents where doc_id % 4 = 0)")
def texts_to_embed(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    cache = D.to_embed(d.where("doc_id % 4 = 0"), spark.createDataFrame([], "key string"), "m")[1]
    return D.to_embed(d, cache, "m")[1]


@query("select event_type, round(sum(value), 4) total, count(*) n from events where json_extract(props, '$.k')::int between 10 and 40 group by 1")
def page_filtered(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.where(R.page_range(F.col("k"), F.col("k"), 10, 40)).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("""select doc_id, ['source_my_lang=' || lang, 'source_from=' || source] fields from documents""")
def source_fields(spark, sf_dir):
    m = D.source_fields(F.create_map(F.lit("My Lang"), "lang", F.lit("from"), "source", F.lit("Roles"), F.lit("x")))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return load(spark, sf_dir, "documents").select("doc_id", pairs.alias("fields"))


@query("""with q as (select doc_id as query, case doc_id % 4 when 0 then doc_id::varchar when 1 then sha256(text) when 2 then source when 3 then null end document from documents), s as (select source, count(*) n, min(doc_id) d from documents group by 1), h as (select sha256(text) sha, min(doc_id) d from documents group by 1)
select query, coalesce(i.doc_id, h.d, case when s.n = 1 then s.d end) doc_id, case when document is null or coalesce(i.doc_id, h.d, case when s.n = 1 then s.d end) is not null then null when s.n > 1 then 'ambiguous' else 'unknown' end error from q left join documents i on q.document = i.doc_id::varchar left join h on q.document = h.sha left join s on q.document = s.source""")
def question_owners(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha2("text", 256).alias("sha"), F.col("source").alias("filename"))
    i = F.col("doc_id")
    q = d.select(i.alias("query"), F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.col("sha")).when(i % 4 == 2, F.col("filename")).alias("document"))
    return D.owners(q, d)


@query("with v as (select event_type variant, round(avg((value > 50)::int), 9) hit_rate, round(avg(case when value > 50 then 1.0 / (1 + event_id % 5) else 0 end), 9) mrr from events group by 1) select * from v where hit_rate > 0 and (hit_rate, mrr) = (select (hit_rate, mrr) from v order by hit_rate desc, mrr desc limit 1)")
def best_variants(spark, sf_dir):
    hit = F.col("value") > 50
    v = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(F.round(F.avg(hit.cast("int")), 9).alias("hit_rate"), F.round(F.avg(F.when(hit, 1.0 / (1 + F.col("event_id") % 5)).otherwise(0.0)), 9).alias("mrr"))
    return D.best_variants(v)


@query(f"with {ITEM_DENSE}, {LEXICAL}, a as (select query, list(piece) l from de where rank <= 10 group by 1), b as (select query, list(piece) l from lx where rank <= 10 group by 1) select query, len(list_intersect(a.l, b.l)) shared from a join b using (query)")
def shared_top_k(spark, sf_dir):
    dense, lexical = dense_and_lexical(spark, sf_dir, 10)
    a = dense.groupBy("query").agg(F.collect_list("piece").alias("a"))
    b = lexical.groupBy("query").agg(F.collect_list("piece").alias("b"))
    return a.join(b, "query").select("query", F.size(F.array_intersect("a", "b")).alias("shared"))


FEEDBACK = "f as (select event_id % 500 trace_id, user_id % 20 user_id, case when value > 50 then 'up' else 'down' end as value, ts from events), t as (select event_id trace_id, user_id % 20 user_id, value latency from events where event_id % 2 = 0)"


def traces(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    f = e.select((F.col("event_id") % 500).alias("trace_id"), (F.col("user_id") % 20).alias("user_id"), F.when(F.col("value") > 50, "up").otherwise("down").alias("value"), "ts")
    return e.where("event_id % 2 = 0").select(F.col("event_id").alias("trace_id"), (F.col("user_id") % 20).alias("user_id"), F.col("value").alias("latency")), f


@query(f"with {FEEDBACK} select t.trace_id, coalesce(list(f.value order by f.ts, f.value) filter (f.value is not null), []) feedback from t left join f on t.trace_id = f.trace_id group by 1")
def traces_with_feedback(spark, sf_dir):
    return D.with_feedback(*traces(spark, sf_dir)).select("trace_id", "feedback")


@query(f"with {FEEDBACK} select trace_id, user_id, value, count(*) n from f where (trace_id, user_id) in (select trace_id, user_id from t) group by all")
def owned_feedback(spark, sf_dir):
    t, f = traces(spark, sf_dir)
    return D.owned_feedback(f, t).groupBy("trace_id", "user_id", "value").agg(F.count("*").alias("n"))


@query("select conv_id, n, coalesce(last, -1) + row_number() over (partition by conv_id order by n) as position from (select event_id % 300 conv_id, event_id n from events) left join (select conv_id, max(turn) last from conversations group by 1) using (conv_id)")
def next_positions(spark, sf_dir):
    return D.next_position(load(spark, sf_dir, "conversations"), load(spark, sf_dir, "events").select((F.col("event_id") % 300).alias("conv_id"), F.col("event_id").alias("n")))


@query("select conv_id, string_agg(role || ': ' || text, E'\\n' order by turn) prompt from (select *, row_number() over (partition by conv_id order by turn desc) back from conversations) where back <= 4 group by 1")
def standalone_prompts(spark, sf_dir):
    return D.standalone_prompt(load(spark, sf_dir, "conversations"))


@query("with s as (select user_id report, event_id as position, event_id % 700 artifact, case when event_id % 5 = 0 then 'cached' else 'run' end as status from events) select artifact, report, position, made_by from (select * from s where status = 'cached') left join (select artifact, min(report) made_by from s where status = 'run' group by 1) using (artifact)")
def charge_map(spark, sf_dir):
    i = F.col("event_id")
    return D.charged(load(spark, sf_dir, "events").select(F.col("user_id").alias("report"), i.alias("position"), (i % 700).alias("artifact"), F.when(i % 5 == 0, "cached").otherwise("run").alias("status")))


@query("select conv_id doc_id, turn ordinal, 'about ' || turn || E'\\n\\n' || text embed_text from conversations where conv_id not in (select conv_id from conversations where turn = 4)")
def contextual_prefixes(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    replies = c.select("doc_id", "ordinal", F.when(F.col("ordinal") != 4, F.concat(F.lit(" about "), F.col("ordinal").cast("string"))).alias("reply"))
    return D.prefixed(c, replies).select("doc_id", "ordinal", "embed_text")


@query("select user_id as name from events group by user_id having max(ts) < (select max(ts) from events) - interval 7 days and not bool_or(event_type = 'purchase')")
def retired_collections(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    names = e.groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("replaced_at"), F.max(F.col("event_type") == "purchase").alias("kept"))
    return D.retired(names.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"))


@query()
def near_duplicate_blocks(spark, sf_dir):
    return D.near_blocks(lines(spark, sf_dir).withColumn("type", F.lit("paragraph")).withColumn("norm", T.normalise(F.col("text"))))


@query()
def hashed_vectors(spark, sf_dir):
    return D.hashed_vectors(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def sentence_provenance(spark, sf_dir):
    """The sentences that each recursive chunk meets."""
    d = load(spark, sf_dir, "documents")
    s = N.sentences(d).select("doc_id", F.col("ordinal").alias("id"), "start", "end")
    return C.provenance(C.recursive_chunks(d).drop("text"), s)
