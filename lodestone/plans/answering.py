"""Queries over filters, answers, traces, question sets and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import collections as L
from lodestone.operators import filters as W
from lodestone.operators import hooks as H
from lodestone.operators import manage as M
from lodestone.operators import prepare as P
from lodestone.operators import questions as Q
from lodestone.operators import reviews as V
from lodestone.operators import sentences as N
from lodestone.plans.preparing import FOLDED, LINES, NORM, TOKENS, lines, load
from lodestone.query_set import query

FILTERS = {
    "eq": (W.Eq("event_type", "click"), "event_type = 'click'"), "eq_missing": (W.Eq("nope", 1), "false"), "eq_other_kind": (W.Eq("event_type", 1), "false"), "bool_is_no_number": (W.Eq("event_id", True), "false"),
    "float_is_int": (W.Eq("event_id", 7.0), "event_id = 7"), "nan": (W.Eq("value", float("nan")), "false"), "in": (W.In("event_type", ("click", "error")), "event_type in ('click', 'error')"), "in_mixed": (W.In("event_id", (1, "2")), "false"),
    "in_nothing": (W.In("event_type", ()), "false"), "any_of_list": (W.AnyOf("tags", ("k7", "odd")), "event_id % 2 = 1 or event_id % 9 = 7"), "any_of_text": (W.AnyOf("event_type", ("view",)), "event_type = 'view'"), "any_of_number": (W.AnyOf("event_id", ("1",)), "false"),
    "list_eq": (W.Eq("tags", "odd"), "false"), "bool": (W.Eq("late", True), "value > 50"), "and": (W.And((W.In("event_type", ("click", "view")), W.Eq("late", False), W.NO_FILTER)), "event_type in ('click', 'view') and not value > 50"), "none": (W.NO_FILTER, "true"),
}


@query(" union all ".join(f"select '{n}' as name, count(*) filter ({sql}) n from events" for n, (_, sql) in FILTERS.items()))
def filter_predicates(spark, sf_dir):
    i = F.col("event_id")
    tags = F.array_compact(F.array(F.when(i % 2 == 1, "odd"), F.concat(F.lit("k"), (i % 9).cast("string"))))
    e = load(spark, sf_dir, "events").withColumn("tags", tags).withColumn("late", F.col("value") > 50)
    counts = e.agg(*[F.sum(W.to_column(f, e.schema).cast("long")).alias(n) for n, (f, _) in FILTERS.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in FILTERS])).alias("r")).select("r.*")


@query("select event_id from events, (select max(json_extract(props, '$.k')::int) m from events where event_type <> 'view') where json_extract(props, '$.k')::int <= least(1000, m) and json_extract(props, '$.k')::int + event_id % 3 >= 60")
def pages_to_the_last(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("first", F.get_json_object("props", "$.k").cast("int"))
    last = e.where("event_type <> 'view'").agg(F.max("first").alias("max_page"))
    e = e.crossJoin(F.broadcast(last))  # one row
    return e.where(W.pages_between(F.col("first"), F.col("first") + F.col("event_id") % 3, 60, 1000, F.col("max_page"))).select("event_id")


@query("select doc_id from documents where lang = 'en' or source = 'en'")
def section_rows(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("heading_path", F.array("lang", "source"))
    sections = d.where(F.size("heading_path") > 0).count()
    return d.where(W.in_section(F.col("heading_path"), "en", sections)).select("doc_id")


@query("""with d as (select doc_id::varchar id, sha256(text) sha from documents), q as (select item_id as query, unnest([item_id::varchar, 'no such', (select sha from d where id = (item_id + 1)::varchar), item_id::varchar]) as name from benchmark),
m as (select distinct query, name, coalesce((select sha from d where id = name), (select min(sha) from d where sha = name)) sha from q where name is not null) select query, list_sort(list(distinct sha) filter (sha is not null)) shas, list_sort(list(distinct name) filter (sha is null)) as unknown from m group by 1""")
def named_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("sha"))
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    after = b.withColumn("doc_id", (F.col("query") + 1).cast("string")).join(d, "doc_id", "left")
    own = F.col("query").cast("string")
    return W.named_documents(after.select("query", F.array_compact(F.array(own, F.lit("no such"), F.col("sha"), own)).alias("names")), d)


CALLERS = "callers(caller, held, adm) as (values ('a', ['staff'], false), ('b', ['legal', 'public'], false), ('c', []::varchar[], false), ('d', []::varchar[], true))"


@query(f"""with {CALLERS}, d as (select doc_id piece, case when starts_with(source, 'src1') then ['staff'] when starts_with(source, 'src2') then ['legal', 'staff'] when doc_id % 11 = 0 then [] else ['public'] end roles from documents)
select caller, piece, row_number() over (partition by caller order by piece) as rank from callers, d where adm or list_has_any(roles, held)""")
def hits_by_role(spark, sf_dir):
    roles = F.when(F.col("source").startswith("src1"), F.array(F.lit("staff"))).when(F.col("source").startswith("src2"), F.array(F.lit("legal"), F.lit("staff"))).when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("public")))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("piece"), roles.alias("roles"))
    callers = spark.createDataFrame([("a", ["staff"], False), ("b", ["legal", "public"], False), ("c", [], False), ("d", [], True)], "caller string, held array<string>, admin boolean")
    hits = rows.crossJoin(F.broadcast(callers.select("caller"))).select("caller", "piece", F.col("piece").alias("rank"))  # four callers
    return W.hits_for(hits, rows, callers)


@query("""select doc_id, case when doc_id % 6 = 0 then ['admin', 'staff'] when starts_with(source, 'src1') then ['staff'] when lang = 'fr' then ['fr'] when lang = 'de' then [] else ['public'] end roles, case when doc_id % 6 = 0 then 'label' when starts_with(source, 'src1') then 'folder src1*' when lang = 'fr' then 'rule 1' when lang = 'de' then 'rule 2 failed' else 'default' end reason from documents""")
def roles_with_reasons(spark, sf_dir):
    lang = F.col("lang")
    rules = (F.when(lang == "fr", F.array(F.lit("fr"))), F.when(lang == "de", F.array(F.lit(None).cast("string"))))
    d = load(spark, sf_dir, "documents")
    got = M.roles_and_reason(F.when(F.col("doc_id") % 6 == 0, "admin, staff,"), F.col("source"), (("src1*", ("staff",)),), rules, ("public",))
    return d.select("doc_id", got.alias("r")).select("doc_id", "r.roles", "r.reason")


@query("""select doc_id, case when doc_id % 13 = 0 then 'kept here' when lang[1] = 'e' then 'english' else 'other' end category, case when doc_id % 13 = 0 then 'pinned' when lang[1] = 'e' then 'Rule 1: named_like' else 'default' end reason from documents""")
def pinned_routes(spark, sf_dir):
    rules = (("english", (("named_like", V.ROUTE_CHECKS["named_like"](F.col("lang"), "E?")),)), ("never", (("has_words", V.ROUTE_CHECKS["has_words"](F.col("source"), "no such words")),)))
    pin = F.when(F.col("doc_id") % 13 == 0, "kept here")
    return load(spark, sf_dir, "documents").select("doc_id", M.sorted_document(rules, "other", pin).alias("r")).select("doc_id", "r.category", "r.reason")


# --- answers

ANSWER = "text || ' [1.' || turn || '] [2.07]. Then [9.1]' || case when turn % 2 = 0 then '' else ' more.' end"


@query(rf"""with a as (select conv_id * 100 + turn as query, {ANSWER} t, ['1.0', '1.1', '1.2', '2.7'] known from conversations),
p as (select query, known, t, regexp_split_to_array(t, '\[\d+\.\d+\](?:[ \t]*\[\d+\.\d+\])*') parts, regexp_extract_all(t, '\[\d+\.\d+\](?:[ \t]*\[\d+\.\d+\])*') runs from a),
x as (select query, known, i - 1 as ordinal, parts[i] part, parts[i + 1] nxt, runs[i] run from p, unnest(range(1, len(parts) + 1)) u(i)),
y as (select *, list_transform(regexp_extract_all(coalesce(run, ''), '\[\d+\.\d+\]'), lambda m: regexp_replace(regexp_replace(trim(m, '[]'), '^0+(\d)', '\1'), '\.0+(\d)', '.\1')) marks from x)
select query, ordinal, case when run is not null and (coalesce(nxt, '') = '' or regexp_matches(nxt, '^[.,;:!?)\]]')) then regexp_replace(part, '\s+$', '') else part end as text, list_sort(list_distinct(list_filter(marks, lambda m: list_contains(known, m)))) ids, len(list_filter(marks, lambda m: not list_contains(known, m))) invalid from y where run is not null or part <> ''""")
def answer_claims(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query"), F.expr(ANSWER).alias("text"), F.array(*map(F.lit, ("1.0", "1.1", "1.2", "2.7"))).alias("known"))
    return A.claims(c).withColumn("ids", F.sort_array("ids"))


SEGMENTS = r"""s as (select conv_id as query, turn as ordinal, case when turn % 5 = 4 then 'The documents do not say.' when turn % 3 = 1 then text || ' and' when turn % 7 = 3 then '. ' else text end t, turn % 3 = 2 cites from conversations),
l as (select *, case when not regexp_matches(t, '[\p{L}\p{N}]') or (not cites and coalesce(lead(cites) over (partition by query order by ordinal), false) and not regexp_matches(trim(t, ' '), '[.!?]$')) then null when cites then 'cited' when starts_with(lower(t), 'the documents do not') and not regexp_matches(t, '[.!?]\s+\S') then 'not_found' else 'none' end as label from s)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    text = F.when(t % 5 == 4, "The documents do not say.").when(t % 3 == 1, F.concat("text", F.lit(" and"))).when(t % 7 == 3, ". ").otherwise(F.col("text"))
    return A.labelled(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), t.alias("ordinal"), text.alias("text"), (t % 3 == 2).alias("cites")))


@query(f"with {SEGMENTS} select query, ordinal, label from l")
def segment_labels(spark, sf_dir):
    return segments(spark, sf_dir).select("query", "ordinal", "label")


@query(f"with {SEGMENTS} select query, " + ", ".join(f"count(*) filter (label = '{k}') {k}" for k in A.LABELS) + ", count(*) filter (label in ('cited', 'weak', 'similarity', 'none')) claims, count(*) filter (label in ('cited', 'weak')) citing from l group by 1")
def grounding_stats(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("query").agg(*A.label_counts(F.col("label")))


BODIES = f"""{LINES}, b as (select doc_id, "order", text, coalesce(sum(length(text) + 2) over (partition by doc_id order by "order" rows between unbounded preceding and 1 preceding), 0)::bigint s from lines), md as (select doc_id, string_agg(text, E'\\n\\n' order by "order") t from lines group by 1)"""


@query(f"""with {BODIES}, c as (select doc_id * 100000 + "order" citation, doc_id, s + 3 a, s + 3 + 10 z, case when "order" % 7 = 0 then 'other' else substr(text, 4, 10) end cited, length(text) n, format('e{{:05d}}', "order") id, s, coalesce(lead(s) over (partition by doc_id order by "order"), 1000000000) nxt, lead(format('e{{:05d}}', "order")) over (partition by doc_id order by "order") nid from b where length(text) >= 2)
select citation, a doc_start, z doc_end, coalesce(substr(t, a + 1, z - a) = cited, false) verified, case when a < s + n then id when a >= nxt then nid end element_id from c join md using (doc_id)""")
def citation_places(spark, sf_dir):
    e = P.offsets(lines(spark, sf_dir), "text").select("doc_id", "order", "id", "text", "start", "end")
    documents = e.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    own = e.where(F.length("text") >= 2)
    cited = F.when(F.col("order") % 7 == 0, "other").otherwise(F.col("text").substr(4, 10))
    c = own.select((F.col("doc_id") * 100000 + F.col("order")).alias("citation"), "doc_id", F.col("start").alias("chunk_start"), F.lit(3).alias("c_start"), F.lit(13).alias("c_end"), cited.alias("cited_text"))
    return A.located(c, own, documents)


@query(r"""with d as (select doc_id as query, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '\s', ' ', 'g') t from documents), w as (select query, string_split(t, ' ') w from d where t <> '')
select query, len(w) >= 8 placed from w""")
def broken_answers(spark, sf_dir):
    """The first words of a text, with another word put in between, are found where they stand."""
    w = F.split(T.squeeze(F.col("text")), " ")
    text = F.concat_ws(" ", F.array_join(F.slice(w, 1, 3), " "), F.lit("zzz yyy"), F.array_join(F.slice(w, 4, 5), " "))
    gold = F.when(F.size(w) >= 8, F.array_join(F.slice(w, 1, 8), " ")).otherwise("no such words at all")
    d = load(spark, sf_dir, "documents").where(F.length(T.squeeze(F.col("text"))) > 0)
    at = A.broken(d.select(F.col("doc_id").alias("query"), text.alias("text"), gold.alias("gold")))
    # words of signs alone are no words of an answer, so the place is not always 0 to 9
    return at.select("query", F.coalesce(F.col("last") - F.col("first") <= 9, F.lit(False)).alias("placed"))


@query(r"""select doc_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) < 20 scanned from documents""")
def scanned_signals(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", A.scanned(F.col("text")).alias("scanned"))


# --- traces: one for each event

TRACES = """tr as (select event_id trace_id, event_id % 300 conv_id, ts created_at, ' Question' || chr(10) || event_id || repeat(' and on', (event_id % 20)::int) question, case event_id % 6 when 0 then 'none' when 1 then 'weak' when 2 then 'similarity' when 3 then 'cited' else 'not_found' end as label, event_id % 7 = 0 refused, event_id % 4 hits, event_id % 5 = 0 thumbs from events),
tl as (select *, list_filter([case when label in ('weak', 'none') then 'low_grounding' end, case when refused then 'declined' end, case when label = 'not_found' or hits = 0 then 'not_in_documents' end], lambda x: x is not null) flags, case when thumbs then ['down'] else ['up'] end feedback from tr)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    one = {k: (i % 6 == n).cast("int") for n, k in enumerate(("none", "weak", "similarity", "cited"))}
    e = load(spark, sf_dir, "events").withColumn("label", T.label_of(one))
    question = F.concat(F.lit(" Question\n"), i.cast("string"), F.repeat(F.lit(" and on"), (i % 20).cast("int")))
    flags = T.flags_for(F.col("label"), F.when(i % 7 == 0, "refusal").otherwise("end"), i % 4)
    return e.select(i.alias("trace_id"), (i % 300).alias("conv_id"), F.col("ts").alias("created_at"), question.alias("question"), "label", flags.alias("flags"), F.array(F.when(i % 5 == 0, "down").otherwise("up")).alias("feedback"))


@query(f"with {TRACES} select trace_id, label, flags, len(flags) > 0 or thumbs needs_a_look from tl")
def trace_flags(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", "label", "flags", V.needs_a_look(F.col("flags"), F.col("feedback")).alias("needs_a_look"))


@query(f"""with {TRACES}, n as (select *, trim(replace(question, chr(10), ' '), ' ') q, row_number() over (order by created_at desc, trace_id) as place from tl where len(flags) > 0 or thumbs)
select place, trace_id, created_at, array_to_string(list_concat(flags, case when thumbs then ['thumbs down'] else [] end), ', ') notes, case when length(q) > 80 then substr(q, 1, 79) || '…' else q end question from n where place <= 100""")
def review_list(spark, sf_dir):
    return V.review_list(traces(spark, sf_dir), 100)


@query(f"""with {TRACES} select 'label' measure, label as name, count(*)::double as value from tl group by 2 union all select 'flag', f, count(*)::double from (select unnest(flags) f from tl) group by 2 union all select 'feedback', f, count(*)::double from (select unnest(feedback) f from tl) group by 2 union all select 'score', event_type, round(avg(value), 9) from events group by 2""")
def trace_measures(spark, sf_dir):
    scores = load(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("name"), "value")
    return V.trace_report(traces(spark, sf_dir), scores)


@query("""select c.conv_id * 100 + c.turn trace_id, coalesce(list(p.text order by p.turn) filter (p.turn is not null), []) questions from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn < c.turn group by 1""")
def turns_before(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), (F.col("conv_id") * 100 + F.col("turn")).alias("trace_id"), F.col("text").alias("question"), F.col("role").alias("answer"))
    got = V.history_before(turns.select("trace_id", "conv_id"), turns)
    return got.select("trace_id", F.transform("history", lambda x: x["question"]).alias("questions"))


@query("""select event_id as query, list_filter([case when event_id % 50 < 40 then 't' || (event_id % 50) || ' by rank' end, case when event_id % 20 < 10 then 't' || (event_id % 20) || ' by rank' end], lambda x: x is not null) sources from events where event_type = 'click'""")
def cited_sources(spark, sf_dir):
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").where("event_type = 'click'")
    answers = e.select(i.alias("query"), F.array((i % 50 + 100), (i % 20)).alias("source_ids"))
    text = lambda n: F.concat(F.lit("t"), n.cast("string"), F.lit(" by rank"))
    one = e.where(i % 50 < 40).select(i.alias("query"), F.lit(1).alias("rank"), (i % 50 + 100).alias("id"), text(i % 50).alias("text"))
    two = e.where(i % 20 < 10).select(i.alias("query"), F.lit(2).alias("rank"), (i % 20).alias("id"), text(i % 20).alias("text"))
    worse = one.withColumn("rank", F.lit(9)).withColumn("text", F.lit("worse"))
    got = A.cited_sources(answers, one.unionByName(two).unionByName(worse))
    return got.select("query", F.coalesce(F.transform("sources", lambda x: x["text"]), F.array().cast("array<string>")).alias("sources"))


@query("""select conv_id::varchar id, case when turn > 0 then text else 'alone ' || conv_id end question, ['gold ' || turn] gold_answers, ['promoted'] tags, turn > 0 has_history from (select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1) where conv_id % 3 <> 0 and turn % 2 = 1""")
def promoted_cases(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("t")).select("conv_id", "t.turn", "t.text")
    t = F.col("turn")
    sources = F.when(t % 2 == 1, F.array(F.concat(F.lit("gold "), t.cast("string")))).otherwise(F.array().cast("array<string>"))
    tr = c.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("text").alias("question"), F.concat(F.lit("alone "), F.col("conv_id").cast("string")).alias("standalone"), sources.alias("sources"), F.when(t > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("history"))
    return V.promoted(tr, c.where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("id")))


@query("""with s as (select event_id // 4 trace_id, event_id as place, case when event_id % 4 in (1, 2) then 'rerank' else event_type end as name, round(value * 10)::bigint ms, case when event_id % 3 = 0 then event_id / 1000.0 end dollars from events), n as (select *, row_number() over (partition by trace_id, name order by place) k, count(*) over (partition by trace_id, name) m from s)
select trace_id, case trace_id % 5 when 0 then 'none' when 1 then 'cited' else 'not_found' end as label, list(case when m > 1 then name || '.' || k else name end || ' ' || ms order by place) stages, round(sum(dollars), 9) as cost from n group by 1, 2""")
def trace_records(spark, sf_dir):
    i = F.col("event_id")
    e = load(spark, sf_dir, "events")
    steps = e.select(F.floor(i / 4).cast("long").alias("trace_id"), i.alias("place"), F.when((i % 4).isin(1, 2), "rerank").otherwise(F.col("event_type")).alias("name"), F.round(F.col("value") * 10).alias("ms"), F.when(i % 3 == 0, i / 1000).alias("dollars"))
    t = F.col("trace_id") % 5
    turns = steps.select("trace_id").distinct().select("trace_id", (t == 0).cast("int").alias("none"), F.lit(0).alias("weak"), F.lit(0).alias("similarity"), (t == 1).cast("int").alias("cited"))
    return V.records(turns, steps, turns.select("trace_id")).select("trace_id", "label", "stages", "cost")


@query("""with t as (select event_id::varchar trace_id, event_id i, value v from events), h as (select *, ('0x' || substr(sha256(trace_id || ':length'), 1, 16))::ubigint::double / 18446744073709551616 share from t)
select trace_id, 'length@2.chars' as key, case when i % 10 <> 0 and i % 9 <> 0 and i % 7 <> 0 then v end as value, case when i % 10 = 0 or i % 9 = 0 then 'skipped' when i % 7 = 0 then 'failed' else 'scored' end as status from h where share < 0.25""")
def online_scores(spark, sf_dir):
    i = F.col("i")
    t = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_id").alias("i"), F.col("value").alias("v"))
    e = V.Evaluator("length", "2", {"chars": F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v"))}, skip=i % 9 == 0)
    scored = t.where("i % 10 = 0").select("trace_id", F.lit(e.key("chars")).alias("key")).unionByName(t.where("i % 10 = 1").select("trace_id", F.lit("length@1.chars").alias("key")))
    return V.evaluate_traces(t, scored, [e], sample=0.25)


# --- costs

STEP_SQL = """st as (select user_id % 40 report, event_id as place, case event_id % 4 when 0 then 'parse' when 1 then 'chunk' when 2 then 'search' else 'answer' end stage, case when event_id % 3 = 0 then 'cached' when event_id % 17 = 0 then 'failed' else 'executed' end as status, case when event_id % 11 <> 0 then event_id % 400 end artifact, round(value * 100) ms, case when event_id % 4 = 3 then case when event_id % 5 = 0 then 'unknown' else 'gpt-5.6-luna' end end model,
case when event_id % 4 = 3 and event_id % 13 <> 0 then event_id % 900 end it, case when event_id % 4 = 3 then event_id % 300 end ot from events), sd as (select *, case when model = 'gpt-5.6-luna' then 0.2 end price, case when model = 'gpt-5.6-luna' then (it * 0.2 + ot * 1.2) / 1e6 end dollars from st)"""
COSTS = """round(sum(case when r then ms else 0 end) / 1000, 6) as seconds, sum(case when r then it end)::bigint input_tokens, sum(case when r then ot end)::bigint output_tokens, round(sum(case when r then dollars end), 9) dollars, coalesce(list_sort(list(distinct model) filter (r and model is not null and price is null)), []) unpriced,
coalesce(list_sort(list(distinct model) filter (r and price is not null and (it is null or ot is null))), []) uncounted, sum(r::int) steps_run, count(distinct case when status = 'cached' and not made then artifact end) + sum((status = 'cached' and artifact is null)::int) steps_cached"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    answer = i % 4 == 3
    e = load(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("report"), i.alias("place"), F.when(i % 4 == 0, "parse").when(i % 4 == 1, "chunk").when(i % 4 == 2, "search").otherwise("answer").alias("stage"),
        F.when(i % 3 == 0, "cached").when(i % 17 == 0, "failed").otherwise("executed").alias("status"), F.when(i % 11 != 0, i % 400).alias("artifact"), F.round(F.col("value") * 100).alias("ms"),
        F.when(answer, F.when(i % 5 == 0, "unknown").otherwise("gpt-5.6-luna")).alias("model"), F.when(answer & (i % 13 != 0), i % 900).alias("input_tokens"), F.when(answer, i % 300).alias("output_tokens"),
    ).withColumns({"requested_model": F.lit(None).cast("string"), "cached_tokens": F.lit(0)})
    priced = M.priced(e, M.price_table(spark))
    return priced.withColumn("price", F.when(F.col("model") == "gpt-5.6-luna", 0.2)).drop("requested_model", "cached_tokens")


@query(f"with {STEP_SQL}, c as (select *, status in ('executed', 'failed') r, artifact is not null and bool_or(status in ('executed', 'failed')) over (partition by artifact) made from sd) select {COSTS} from c")
def total_costs(spark, sf_dir):
    return V.total_cost(steps(spark, sf_dir))


@query(f"with {STEP_SQL}, c as (select *, status in ('executed', 'failed') r, artifact is not null and bool_or(status in ('executed', 'failed')) over (partition by report, artifact) made from sd where stage = 'search' or stage = 'chunk') select report, {COSTS} from c group by 1")
def costs_between(spark, sf_dir):
    return V.cost(V.between(steps(spark, sf_dir), "chunk", "answer"), ("report",))


@query(f"""with {STEP_SQL}, s as (select * from sd where stage in ('search', 'answer')), mk as (select artifact, arg_min(struct_pack(status, ms, model, it, ot, price, dollars), (report, place)) m from s where status = 'executed' and artifact is not null group by 1),
w as (select s.*, m, bool_or(status in ('executed', 'failed')) over (partition by report, artifact) here, row_number() over (partition by report, artifact order by status <> 'cached', place) k from s left join mk using (artifact)), ch as (select *, status = 'cached' and m is not null and not here and k = 1 as charged from w),
x as (select report, artifact, case when charged then m.status else status end as status, case when charged then m.ms else ms end ms, case when charged then m.model else model end model, case when charged then m.it else it end it, case when charged then m.ot else ot end ot, case when charged then m.price else price end price, case when charged then m.dollars else dollars end dollars from ch),
c as (select *, status in ('executed', 'failed') r, artifact is not null and bool_or(status in ('executed', 'failed')) over (partition by report, artifact) made from x) select report, {COSTS} from c group by 1""")
def varied_costs(spark, sf_dir):
    return V.varied_costs(steps(spark, sf_dir), "search")


# --- runs and retention

RUNS = "b as (select event_id as query, value > 50 f, (event_id % 7 + 1)::int r from events), n as (select event_id as query, value > 40 f, (event_id % 5 + 1)::int r from events where event_id % 3 = 0)"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    return e.select(i.alias("query"), (F.col("value") > 50).alias("found"), (i % 7 + 1).cast("int").alias("rank")), e.where(i % 3 == 0).select(i.alias("query"), (F.col("value") > 40).alias("found"), (i % 5 + 1).cast("int").alias("rank"))


@query(f"with {RUNS} select query, b.f or coalesce(n.f, false) found, case when n.f then n.r else b.r end as rank, n.query is not null asked_again from b left join n using (query)")
def reasked_questions(spark, sf_dir):
    return V.reasked(*runs(spark, sf_dir))


@query(f"with {RUNS} select query, case when n.f and not b.f then 'found' when b.f and not n.f then 'lost' when n.f and n.r < b.r then 'up' when n.f and n.r > b.r then 'down' else 'none' end as change from b join n using (query)")
def row_changes(spark, sf_dir):
    before, now = runs(spark, sf_dir)
    met = before.join(now.select("query", F.col("found").alias("f2"), F.col("rank").alias("r2")), "query")
    return met.select("query", Q.row_change(F.col("found"), F.col("f2"), F.col("rank"), F.col("r2")).alias("change"))


@query(f"with {RUNS}, p as (select query id, case when query % 4 = 0 then 'named' when query % 4 = 1 then 'follow-up' else 'uncategorized' end category, b.f bf, n.f nf from b join n using (query)) select category, count(*) compared, sum(bf::int) found_before, sum(nf::int) found_now, coalesce(list_sort(list(id) filter (bf and not nf)), []) newly_missed, coalesce(list_sort(list(id) filter (nf and not bf)), []) newly_found from p group by 1")
def category_changes(spark, sf_dir):
    before, now = runs(spark, sf_dir)
    q = F.col("query") % 4
    tags = F.when(q == 0, F.array(F.lit("x"), F.lit("category:named"), F.lit("category:other"))).otherwise(F.array(F.lit("category:")))
    pairs = before.join(now.select("query", F.col("found").alias("now")), "query").select(F.col("query").alias("id"), T.category_of(tags, q == 1).alias("category"), F.col("found").alias("before"), "now")
    return Q.by_category(pairs)


@query("""select (select sha256(string_agg(text, '|' order by text)) from benchmark) <> (select sha256(string_agg(text, '|' order by text)) from benchmark where item_id > 0) as partial, ['The question sets differ.', 'The baseline checked the top 10 pieces and this run the top 5.', 'llm_rerank, llm_rewrite can give a different result each run.'] notes from (select 1)""")
def run_notes(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select(F.lit(1).alias("set_id"), F.col("text").alias("question"), F.array("text").alias("golds"))
    one = lambda df, k, shaky: Q.fingerprints(df).select("fingerprint", F.lit(k).alias("top_k"), F.array(F.lit("d")).alias("documents"), F.array(F.lit(shaky)).alias("shaky"))
    first = load(spark, sf_dir, "benchmark").where("item_id > 0").select(F.lit(1).alias("set_id"), F.col("text").alias("question"), F.array("text").alias("golds"))
    return V.run_notes(one(b, 5, "llm_rewrite"), one(first, 10, "llm_rerank"))


@query("with g as (select distinct user_id from events where event_type = 'error' and value > 90) select 'events' as \"table\", (select count(*) from events where user_id in (from g)) n union all select 'traces', (select count(*) from events where event_id % 2 = 0 and user_id in (from g))")
def deletion_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kept, counts = V.deleted({"events": e, "traces": e.where("event_id % 2 = 0").select("event_id", "user_id")}, e.where("event_type = 'error' and value > 90"))
    return counts


@query("with t as (select event_id % 300 conv_id, event_id, ts from events), cut as (select max(ts) - interval 1 day c from events), live as (select conv_id from t, cut group by conv_id, c having max(ts) >= c) select 'turns' kind, event_id from t where conv_id in (from live) union all select 'traces', event_id from t where event_id % 2 = 0 and conv_id in (from live)")
def retained_turns(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    t = e.select((F.col("event_id") % 300).alias("conv_id"), "event_id", "ts").crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    turns, tr = V.expired_cascade(t, t.where("event_id % 2 = 0"), F.lit(t.select(F.expr("now - interval 1 day").alias("c")).first()["c"]))
    return turns.select(F.lit("turns").alias("kind"), "event_id").unionByName(tr.select(F.lit("traces").alias("kind"), "event_id"))


@query("""select 'v' || (doc_id % 4) collection, doc_id % 4 = 0 ready, case doc_id % 4 when 0 then '' when 1 then 'The recipe here is abcd, but the collection was built from wxyz.' when 2 then 'The collection v2 is not in the store.' else 'The embedding model is revision 7 here, but the collection was built with 6.' end reason from (select min(doc_id) doc_id from documents group by doc_id % 4)""")
def index_statuses(spark, sf_dir):
    k = F.col("doc_id") % 4
    d = load(spark, sf_dir, "documents").groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id"))
    meta = d.select(F.concat(F.lit("v"), k.cast("string")).alias("collection"), F.when(k == 1, "wxyz0").otherwise("abcd1").alias("recipe"), F.when(k == 3, "6").otherwise("7").alias("revision"), F.lit(2).alias("format"))
    return V.index_status(meta, "abcd1", "7", 2, meta.where("collection <> 'v2'").select(F.col("collection").alias("name")))


# --- question sets

REPLY = """case item_id % 6 when 0 then 'no json here' when 1 then '{"question": "what is it", "gold_passage": "too short"}' when 2 then '{"question": 5, "gold_passage": "a"}' when 3 then '[1]' else 'Sure: {"question": "q ' || item_id || '?", "answer": "yes", "gold_passage": "one two three four five six' || item_id || '"} done' end"""


@query("""select item_id, case when item_id % 6 >= 4 then 'q ' || item_id || '?' when item_id % 6 = 1 then 'what is it' else '' end question, case item_id % 6 when 0 then 'not the JSON asked for' when 1 then 'gold passage too short' when 2 then 'no question or no gold passage' when 3 then 'not the JSON asked for' end as "drop" from benchmark""")
def generated_questions(spark, sf_dir):
    r = Q.generated(F.expr(REPLY))
    return load(spark, sf_dir, "benchmark").select("item_id", r["question"].alias("question"), r["drop"].alias("drop"))


@query(rf"""with c as (select d.doc_id % 7 set_id, d.doc_id n, d.doc_id, case when d.doc_id % 3 = 0 then 'not there at all' when d.doc_id % 3 = 1 then substr(d.text, 1, 40) else replace(substr(d.text, 1, 40), ' ', '  ') end gold, d.text from documents d),
h as (select *, coalesce(contains(text, gold) or contains({FOLDED.format('text')}, {FOLDED.format('gold')}), false) held, {FOLDED.format('gold')} g from c), s as (select *, row_number() over (partition by set_id, held, g order by n) k from h)
select set_id, n, case when not held then 'not in the document' when k > 1 then 'same gold passage' end as "drop" from s""")
def generated_checks(spark, sf_dir):
    t, i = F.col("text"), F.col("doc_id")
    d = load(spark, sf_dir, "documents")
    gold = F.when(i % 3 == 0, "not there at all").when(i % 3 == 1, F.substring(t, 1, 40)).otherwise(F.replace(F.substring(t, 1, 40), F.lit(" "), F.lit("  ")))
    c = d.select((i % 7).alias("set_id"), i.alias("n"), "doc_id", F.concat(F.lit("ask "), F.substring(t, 1, 12)).alias("question"), gold.alias("gold"))
    return Q.checked(c, d).select("set_id", "n", "drop")


@query("select lang set_id, count(distinct source) sources from documents group by 1")
def fingerprint_sets(spark, sf_dir):
    """Sets of a language's sources, in any order and with golds in any order: one fingerprint for each language."""
    d = load(spark, sf_dir, "documents").select("lang", "source").distinct()
    up = d.select(F.col("lang").alias("set_id"), F.col("source").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("golds"))
    down = d.orderBy(F.desc("source")).select(F.col("lang").alias("set_id"), F.col("source").alias("question"), F.array(F.lit("b"), F.lit("a")).alias("golds"))
    same = Q.fingerprints(up).join(Q.fingerprints(down), ["set_id", "fingerprint"])
    return same.join(d.groupBy(F.col("lang").alias("set_id")).agg(F.count_distinct("source").alias("sources")), "set_id").select("set_id", "sources")


GOLDS = "g as (select doc_id as query, doc_id, unnest([substr(text, 1, 30), case when doc_id % 3 = 0 then replace(substr(text, 1, 30), ' ', '  ') end, case when doc_id % 5 = 0 then 'gone for good' end]) gold, text from documents)"
STATUS = f"s as (select *, case when contains(text, gold) then 'found' when contains({FOLDED.format('text')}, {FOLDED.format('gold')}) then 'found_normalized' else 'not_found' end as status from g where gold is not null)"


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id")
    each = F.array_compact(F.array(F.substring(t, 1, 30), F.when(i % 3 == 0, F.replace(F.substring(t, 1, 30), F.lit(" "), F.lit("  "))), F.when(i % 5 == 0, "gone for good")))
    return load(spark, sf_dir, "documents").select(i.alias("query"), "doc_id", F.explode(each).alias("gold"), "text")


@query(f"with {GOLDS}, {STATUS} select query, case max(case status when 'found' then 0 when 'found_normalized' then 1 else 2 end) when 0 then 'found' when 1 then 'found_normalized' else 'not_found' end as status from s group by 1")
def question_statuses(spark, sf_dir):
    return Q.question_status(golds(spark, sf_dir).withColumn("status", Q.gold_status(F.col("text"), F.col("gold"))))


@query(f"with {GOLDS}, {STATUS}, w as (select query, max(case status when 'found' then 0 when 'found_normalized' then 1 else 2 end) m from s group by 1) select sum((m = 0)::int) found, sum((m = 1)::int) found_normalized, sum((m = 2)::int) not_found from w")
def question_check_summary(spark, sf_dir):
    return Q.status_counts(Q.question_status(golds(spark, sf_dir).withColumn("status", Q.gold_status(F.col("text"), F.col("gold")))))


@query(f"with {GOLDS}, {STATUS} select query, bool_or(status = 'not_found') stale, bool_or(status <> 'not_found' and length(gold) > doc_id % 60) too_long from s group by 1")
def stale_questions(spark, sf_dir):
    g = golds(spark, sf_dir)
    biggest = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60).alias("chars"))
    return Q.stale(g.drop("text"), load(spark, sf_dir, "documents"), biggest)


@query("""select case when doc_id % 4 > 0 then lang end as document, min(doc_id) as first, count(*) total, sum((n_chars > 2000)::int) n_found from documents group by 1""")
def found_by_document(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return Q.by_document(d.select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("document"), (F.col("n_chars") > 2000).alias("found")))


@query("select count(*) total, sum((event_id % 10 <> 0)::int) scored, sum((event_id % 10 <> 0 and value > 50)::int) n_found, round(sum(case when event_id % 10 <> 0 then event_id % 3 end) / sum(case when event_id % 10 <> 0 then 3 end), 9) recall from events")
def run_totals(spark, sf_dir):
    i = F.col("event_id")
    return Q.run_totals(load(spark, sf_dir, "events").select((F.col("value") > 50).alias("found"), (i % 3).alias("golds_found"), F.lit(3).alias("golds_total"), F.when(i % 10 == 0, "x").alias("error")))


@query("select doc_id as query, lang as document from documents where lang not in ('fr', 'de') union all select doc_id, lang from documents where doc_id % 2 = 0 and lang in ('fr', 'de')")
def merged_question_files(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), F.col("lang").alias("document"))
    return Q.merged_sets(d, d.where("query % 2 = 0 and document in ('fr', 'de')"))


@query("""with h as (select event_id % 200 as query, event_id // 200 as rank, case (event_id // 200 + event_id) % 4 when 0 then 'holds THE gold text' when 1 then 'has the gold text' when 2 then '1. the (a) gold - text' else 'nothing' end as text from events),
t as (select query, rank, case when contains(text, 'the gold text') then 'exact' when contains(lower(text), 'the gold text') then 'normalized' when contains(text, '(a)') then 'reworded' end tier from h)
select query, bool_or(tier is not null and rank <= 2) found, min(case when tier is not null and rank <= 2 then rank end) as rank, arg_min(tier, rank) filter (tier is not null and rank <= 2) tier, case when bool_or(tier is not null and rank <= 2) then 1 else 0 end golds_found, 1 golds_total, case when not bool_or(tier is not null and rank <= 2) then min(case when tier is not null and rank > 2 then rank end) end found_below from t group by 1""")
def match_tiers(spark, sf_dir):
    i = F.col("event_id")
    q, r = i % 200, F.floor(i / 200).cast("long")
    hits = load(spark, sf_dir, "events").select(q.alias("query"), r.alias("rank"), F.when((r + i) % 4 == 0, "holds THE gold text").when((r + i) % 4 == 1, "has the gold text").when((r + i) % 4 == 2, "1. the (a) gold - text").otherwise("nothing").alias("text"))
    g = hits.select("query").distinct().select("query", F.explode(F.array(F.lit("the gold text"), F.lit("the |gold text"))).alias("gold"))
    return A.tiers(hits, g, 2)


@query("select query, min(doc_id) filter (k = m) doc_id, case m when 0 then 'named' when 1 then 'chunk' when 2 then 'text' else 'first' end how from (select *, min(k) over (partition by query) m from (select event_id % 100 as query, event_id doc_id, case when event_id % 100 < 25 and event_id % 3 = 0 then 0 when event_id % 100 < 50 and event_id % 5 = 0 then 1 when event_id % 100 < 75 and event_id % 7 = 0 then 2 else 3 end k from events)) group by query, m")
def trace_targets(spark, sf_dir):
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").select((i % 100).alias("query"), i.alias("doc_id"))
    q, d = F.col("query"), F.col("doc_id")
    k = F.when((q < 25) & (d % 3 == 0), 0).when((q < 50) & (d % 5 == 0), 1).when((q < 75) & (d % 7 == 0), 2).otherwise(3)
    return A.target_document(*[e.where(k == n) for n in range(4)])


# --- documents and manifests

@query("""select page_id doc_id, 'page-' || page_id || case when page_id % 2 = 0 then '.html' else '' end as name, case when page_id % 2 = 0 then 'html' end as type, octet_length(encode(html))::bigint size, url as path from pages""")
def document_facts(spark, sf_dir):
    i = F.col("page_id")
    name = F.concat(F.lit("page-"), i.cast("string"), F.when(i % 2 == 0, ".html").otherwise(""))
    return L.document_info(load(spark, sf_dir, "pages").select(i.alias("doc_id"), name.alias("name"), F.col("html").alias("content"), "url"))


@query(r"""with p as (select page_id, lower(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@|:\d*$', '')) host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) path from pages)
select page_id, left(array_to_string(list_filter(list_concat([host], list_transform(string_split(regexp_replace(path, '([^/])\.[^./]+$', '\1'), '/'), lambda x: regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'))), lambda x: x <> ''), '-'), 100) || '.html' as name from p""")
def url_file_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.url_file_name(F.col("url"), F.lit(".html")).alias("name"))


@query("""select page_id doc_id, case page_id % 5 when 0 then 'md' when 1 then 'pdf' when 2 then 'html' when 3 then 'png' end as type, case page_id % 5 when 0 then 'named .md but holds a PDF' when 1 then 'fast does not read pdf' when 3 then 'fast does not read png' when 4 then 'unknown format' end error from pages""")
def readable_files(spark, sf_dir):
    k = F.col("page_id") % 5
    name = F.when(k == 0, "a.md").when(k == 1, "b.PDF").when(k == 2, "c.htm").when(k == 3, "d.png").otherwise("e.xyz")
    head = F.when(k <= 1, F.lit(b"%PDF-1.7")).otherwise(F.substring("html", 1, 8192).cast("binary"))
    formats = spark.createDataFrame([("fast", "html"), ("fast", "md"), ("fast", "txt"), ("layout", "pdf")], "parser string, type string")
    return L.readable(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), name.alias("name"), head.alias("head")), formats, "fast")


@query("""select doc_id, case when doc_id % 5 = 0 then 'old' else sha256(text) end as version, case when doc_id % 5 = 0 or doc_id % 7 = 0 then case when doc_id % 2 = 0 then 'was' end else lang end category, case when doc_id % 5 = 0 then ['old'] else ['new'] end roles, doc_id % 2 = 0 and doc_id % 7 = 0 pinned from documents where doc_id % 2 = 0 or doc_id % 5 <> 0 and doc_id % 7 <> 0 or doc_id % 5 <> 0 and doc_id % 2 = 1""".replace("case when doc_id % 2 = 0 then 'was' end else lang", "case when doc_id % 2 = 0 then 'was' else lang end else lang"))
def committed_manifest(spark, sf_dir):
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents")
    old = d.where(i % 2 == 0).select("doc_id", F.lit("old").alias("version"), F.lit("was").alias("category"), F.array(F.lit("old")).alias("roles"), (i % 7 == 0).alias("pinned"))
    synced = d.select("doc_id", F.sha2("text", 256).alias("version"), F.col("lang").alias("category"), F.array(F.lit("new")).alias("roles"), F.when(i % 5 == 0, "failed").alias("error"))
    return L.committed(old, synced)


@query("""with o as (select doc_id, sha256(text) v from documents where doc_id % 5 <> 0), n as (select doc_id, case when doc_id % 7 = 0 then 'x' else sha256(text) end w from documents where doc_id % 3 <> 0), s as (select doc_id, case when doc_id % 11 = 0 then 'failed' when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when v = w then 'unchanged' else 'changed' end s from o full join n using (doc_id))
select sum((s = 'added')::int) added, sum((s = 'changed')::int) changed, sum((s = 'removed')::int) removed, sum((s = 'unchanged')::int) as unchanged, sum((s = 'failed')::int) failed, true config_changed, sum((s = 'failed')::int) = 0 complete from s""")
def sync_report(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("version"))
    new = d.where("doc_id % 3 <> 0").withColumn("version", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("version")))
    return L.sync_report(M.manifest_diff(d.where("doc_id % 5 <> 0"), new), d.where("doc_id % 11 = 0"), F.lit(True))


@query("select doc_id, case when doc_id % 9 = 0 then 'moved' else lang end category, doc_id % 9 = 0 or doc_id % 2 = 0 pinned from documents")
def moved_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return L.moved(d.select("doc_id", F.col("lang").alias("category"), (F.col("doc_id") % 2 == 0).alias("pinned")), d.where("doc_id % 9 = 0").select("doc_id", F.lit("moved").alias("to")))


@query("select doc_id, lang from documents where doc_id % 4 = 0")
def unread_entries(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.unread(d, d.where("doc_id % 4 <> 0"))


# --- cleaning

ROUNDS = 8
SHAPE = r"case when regexp_matches(norm, '(?i)^[-–—\[(]?\s*(?:page\s*)?\d{1,4}\s*(?:(?:/|of|\|)\s*\d{1,4})?\s*[-–—\])]?$') then '<number>' else norm end"


def _rounds() -> str:
    """The rounds one after the other; those past the last that finds something find nothing."""
    sql = f"""with {LINES}, l0 as (select source doc, doc_id page, "order" o, {NORM.format('l.text')} norm from lines l join documents using (doc_id)), ap as (select doc, count(distinct page) n from l0 group by 1), v0 as (select doc, page, o, norm from l0 where norm <> '')"""
    for k in range(ROUNDS):
        sql += f""", e{k} as (select *, row_number() over (partition by doc, page order by o) up, row_number() over (partition by doc, page order by o desc) down from v{k}),
p{k} as (select doc, page, o, pos, {SHAPE} shape from e{k}, unnest(list_filter([case when up = 1 then 'first' end, case when down = 1 then 'last' end], lambda x: x is not null)) u(pos) where (up = 1 or down = 1) and length(norm) <= 120),
f{k} as (select doc, pos, shape from p{k} join ap using (doc) where n > 1 group by doc, pos, shape, n having count(distinct page) >= greatest(2, n * 0.02 - 1e-9)),
g{k} as (select doc, page, o, arg_min(case when shape = '<number>' then 'page_number' when pos = 'first' then 'header' else 'footer' end, pos) kind from p{k} join f{k} using (doc, pos, shape) group by 1, 2, 3),
v{k + 1} as (select * from v{k} where (doc, page, o) not in (select (doc, page, o) from g{k}))"""
    return sql + ", g as (" + " union all ".join(f"select * from g{k}" for k in range(ROUNDS)) + ') select page, o as "order", kind from g'


@query(_rounds())
def header_footer_kinds(spark, sf_dir):
    source = load(spark, sf_dir, "documents").select("doc_id", "source")
    e = lines(spark, sf_dir).join(source, "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "order", "text")
    return P.running_kinds(e, min_pages=2, ratio=0.02).where("kind is not null").select("page", "order", "kind")


@query(f"""with {LINES}, r as (select *, 'holds ' || case when contains(lower(text), 'license') then 'license' else 'a year' end reason, "order" // 3 as page from lines where contains(lower(text), 'license') or regexp_matches(text, '[12][0-9]{{3}}')), g as (select doc_id, reason, count(*) n, list_sort(list(distinct page)) p, arg_min(text, "order") t from r group by 1, 2)
select doc_id, reason, n, case when len(p) = 1 then 'page ' else 'pages ' end || array_to_string(p[1:5], ', ') || case when len(p) > 5 then ' and ' || (len(p) - 5) || ' more' else '' end phrase, case when length(t) > 80 then substr(t, 1, 79) || '…' else t end as first from g""")
def clean_report(spark, sf_dir):
    e = lines(spark, sf_dir).withColumn("page", F.floor(F.col("order") / 3).cast("long"))
    has = F.lower("text").contains("license")
    removed = e.where(has | F.col("text").rlike(r"[12][0-9]{3}")).withColumn("reason", F.when(has, "holds license").otherwise("holds a year"))
    return P.clean_report(e, removed)


@query("""select doc_id, case when doc_id % 3 < 2 then array_to_string([lang, source][1:2 - doc_id % 3], ' > ') || chr(10) || chr(10) || left(text, 50) else left(text, 50) end embed_text from documents""")
def heading_contexts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("heading_path"), (F.col("doc_id") % 3).cast("int").alias("leading"), F.left("text", F.lit(50)).alias("text"))
    return P.heading_context(d).select("doc_id", "embed_text")


@query("""with x as (select doc_id, string_split(repeat('a', (doc_id % 13)::int), 'b')[1] t, doc_id % 13 n from documents) select doc_id, case n when 0 then '' when 1 then 'x' else 'x-' end || case when n > 2 then ' Y' when n = 2 then '' else 'y' end as text from x where n < 2 or n >= 2""".replace("case n when 0 then '' when 1 then 'x' else 'x-' end || case when n > 2 then ' Y' when n = 2 then '' else 'y' end", "case when n = 0 then 'xy' when n = 1 then 'x-' else 'x- Y' end"))
def soft_hyphens(spark, sf_dir):
    k = F.col("doc_id") % 13
    return load(spark, sf_dir, "documents").select("doc_id", T.soft_hyphens(F.when(k == 0, "x￾y").when(k == 1, "x￾").otherwise("x￾Y")).alias("text"))


@query(r"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') l from documents), j as (select doc_id, l, array_to_string(l, E'\n\n') t from p where len(l) > 0)
select doc_id, case when length(t) <= 500 then t else coalesce((select array_to_string(list_transform(list_distinct_in_order, lambda i: l[i + 1]), E'\n\n') from (select list_sort(list_distinct(list_transform(range(0, m), lambda q: round_even(q * (len(l) - 1)::double / (m - 1), 0)::int))) list_distinct_in_order from (select max(m) m from (select m from unnest(range(2, greatest(1, least(len(l), len(l) * 500 // length(t))) + 1)) u(m) where length(array_to_string(list_transform(list_sort(list_distinct(list_transform(range(0, m), lambda q: round_even(q * (len(l) - 1)::double / (m - 1), 0)::int))), lambda i: l[i + 1]), E'\n\n')) <= 500)) where m is not null)), left(l[1], 500)) end as sample from j""")
def budget_samples(spark, sf_dir):
    pieces = F.filter(F.transform(F.split("text", r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    d = load(spark, sf_dir, "documents").select("doc_id", pieces.alias("pieces")).where(F.size("pieces") > 0)
    return d.select("doc_id", T.budget_sample(F.col("pieces"), 500).alias("sample"))


@query(f"""with {TOKENS}, n as (select doc_id, count(*) pieces from chunks group by 1) select doc_id, case when pieces <= 10 then 'Only ' || pieces || ' pieces: a search that keeps 5 finds most answers by chance.' end warning from n""")
def few_pieces(spark, sf_dir):
    n = P.token_chunks(load(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("pieces"))
    return n.select("doc_id", P.few_pieces(F.col("pieces"), 5).alias("warning"))


# --- hooks

def count_words(prompts: list[str]) -> list[dict]:
    """A stand-in for a model: how many words a prompt has."""
    if any("0" * 4 in p for p in prompts):
        raise RuntimeError("refused")
    return [{"text": f"{len(p.split(' '))} words", "input_tokens": len(p), "output_tokens": 2} for p in prompts]


@query("select conv_id, turn, len(string_split(role || ' ' || turn || ' x', ' ')) || ' words' reply, length(role || ' ' || turn || ' x')::int input_tokens from conversations")
def model_replies(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("prompt", F.concat("role", F.lit(" "), F.col("turn").cast("string"), F.lit(" x")))
    return H.ai_map(c, "prompt", count_words, batch=8).select("conv_id", "turn", F.col("reply.text").alias("reply"), F.col("reply.input_tokens").alias("input_tokens"))


H.register_embedder("lengths", lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts], 3)


@query("select doc_id, [length(text)::double, length(text) - length(replace(text, ' ', ''))::double, 1.0] vector from documents where text is not null")
def user_embeddings(spark, sf_dir):
    return H.embedded(load(spark, sf_dir, "documents").where("text is not null"), "text", "lengths").select("doc_id", "vector")


@H.strategy
def only_language(df: DataFrame, lang: str) -> DataFrame:
    return df.where(F.col("lang") == lang)


@H.strategy
def shortened(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("text", F.left("text", F.lit(most)))


@query("select doc_id, left(text, 20) as text from documents where lang = 'en'")
def user_steps(spark, sf_dir):
    return H.run_steps(load(spark, sf_dir, "documents"), [("only_language", {"lang": "en"}), ("shortened", {"most": 20})]).select("doc_id", "text")


@query()
def numbered_sources(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return N.numbered(d.select((F.col("doc_id") % 100).alias("query"), F.floor(F.col("doc_id") / 100).cast("long").alias("chunk"), "text"))
