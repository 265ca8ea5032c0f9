"""Queries over readers, sinks and operators that other queries do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import access as S
from lodestone.operators import answers as A
from lodestone.operators import elements as E
from lodestone.operators import hooks
from lodestone.operators import manage as M
from lodestone.operators import prepare as P
from lodestone.operators import prompts as H
from lodestone.operators import questions as Q
from lodestone.operators import retrieve as R
from lodestone.plans.answering import _rounds
from lodestone.plans.preparing import FOLDED, LINES, TOKENS, lines, load
from lodestone.plans.searching import DENSE, asked, vectors
from lodestone.query_set import query
from lodestone.sources import files
from lodestone.sources.tables import new_path


@query(f"with {DENSE}, h as (select query, rank, piece, score, text from de join documents on doc_id = piece where rank <= 20) select query, rank, piece, score, substr(text, 1, 100) snippet, null::int prior_rank, null::double prior_score from h where rank <= 5")
def projected_answers(spark, sf_dir):
    hits = R.dense(asked(spark, sf_dir), vectors(spark, sf_dir), 20).join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("piece"), "text"), "piece")
    return A.projected(hits.withColumns({"prior_rank": F.lit(None).cast("int"), "prior_score": F.lit(None).cast("double")}), 5, 100)


@query(f"with {DENSE} select query, rank, piece, case when query % 100 = 0 or q.source is null or d.source = q.source then length(d.text) else 0 end::int shown from de join documents d on d.doc_id = piece left join documents q on q.doc_id = query where rank <= 20")
def own_document_hits(spark, sf_dir):
    """Hits whose text stays where they are of the source that the question is about; every second question names none."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("piece"), "text", F.col("source").alias("doc_id"))
    hits = R.dense(asked(spark, sf_dir), vectors(spark, sf_dir), 20).join(d, "piece")
    own = d.where("piece % 50 = 0").select(F.col("piece").alias("query"), F.when(F.col("piece") % 100 != 0, F.col("doc_id")).alias("doc_id"))
    return A.only_from(hits, own).select("query", "rank", "piece", F.length("text").alias("shown"))


@query(f"""select doc_id as page, e."order", coalesce(kind, 'paragraph') as type from (with {LINES} select doc_id, "order" from lines) e left join ({_rounds()}) k on k.page = e.doc_id and k."order" = e."order" """)
def retyped_lines(spark, sf_dir):
    """Running heads, feet and page numbers stay, with their kind as type."""
    source = load(spark, sf_dir, "documents").select("doc_id", "source")
    e = lines(spark, sf_dir).join(source, "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "order", "text", F.lit("paragraph").alias("type"))
    return P.stripped(P.running_kinds(e, min_pages=2, ratio=0.02), retype=True).select("page", "order", "type")


@query(r"""with c as (select conv_id, turn, text t, regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])(?:\s|$)', 1) cut from conversations) select conv_id, turn, case when length(t) <= 200 then t when cut <> '' then cut else substr(t, 1, 200) end summary from c""")
def capped_summaries(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.summary_cap(F.col("text"), 200).alias("summary"))


PARTS = TOKENS.replace("448 + 512", "56 + 64").replace("448", "56").replace("512", "64")


@query(rf"""with {PARTS}, p as (select doc_id, ordinal, {FOLDED.format('substr(whole, start + 1, "end" - start)')} t from chunks), w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[50:61] w from documents), n as (select doc_id, string_split({FOLDED.format("array_to_string(w, ' ')")}, ' ') n from w where len(w) > 0),
e as (select doc_id, array_to_string(n[1:4], ' ') h, array_to_string(n[greatest(len(n) - 3, 1):], ' ') l from n), f as (select doc_id, min(case when contains(t, h) then ordinal end) as first, max(case when contains(t, l) then ordinal end) as last from p join e using (doc_id) group by 1) select doc_id as query, first, last from f where last > first""")
def cut_golds(spark, sf_dir):
    """The words 50 to 61 of every document, where windows of 64 tokens part them or hold them twice."""
    d = load(spark, sf_dir, "documents")
    pieces = P.token_chunks(d, 64, 8).select(F.col("doc_id").alias("query"), "ordinal", "text")
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 50, 12)
    golds = d.select(F.col("doc_id").alias("query"), F.array_join(words, " ").alias("gold")).where("gold <> ''")
    return A.cut_pieces(pieces, golds)


@query("""select item_id::varchar id, text question, [text] golds, ['t' || (item_id % 3), 'x'] tags, case when item_id % 2 = 0 then 'own.md' else 'set.md' end as document, 'json' kind from benchmark union all select item_id::varchar, text, ['first', 'second ' || item_id], ['a', 'b'], case when item_id % 2 = 0 then 'own.md' end, 'csv' from benchmark""")
def question_files(spark, sf_dir):
    """The benchmark as question sets in both formats, written and read: golds and tags parted, a set's document filled in."""
    here, b = new_path(spark, "questions"), load(spark, sf_dir, "benchmark")
    own, ident = F.when(F.col("item_id") % 2 == 0, "own.md"), F.col("item_id").cast("string")
    rows = b.select(F.struct(ident.alias("id"), F.col("text").alias("question"), F.col("text").alias("gold_answer"), F.array(F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")), F.lit("x")).alias("tags"), F.coalesce(own, F.lit("")).alias("document")).alias("q"))
    one = rows.agg(F.to_json(F.struct(F.collect_list("q").alias("questions"), F.lit("set.md").alias("document"))))  # a question set is one file
    one.coalesce(1).write.text(f"{here}/json")
    flat = b.select(ident.alias("id"), F.col("text").alias("question"), F.concat(F.lit("first||second "), ident).alias("gold_answers"), F.lit("a, b,").alias("tags"), own.alias("document"))
    flat.write.option("header", True).option("escape", '"').csv(f"{here}/csv")
    kinds = [(files.questions_json(spark, f"{here}/json", 10**6), "json"), (files.questions_csv(spark, f"{here}/csv", 10**6), "csv")]
    return kinds[0][0].drop("error").withColumn("kind", F.lit("json")).unionByName(kinds[1][0].drop("error").withColumn("kind", F.lit("csv")))


@query("select lang folder, 'text/plain' content_type, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint n_bytes, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint text_bytes from documents group by 1")
def listed_files(spark, sf_dir):
    """The documents as text files in folders by language: listed with type and size, and read."""
    here = new_path(spark, "files")
    load(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "lang").write.partitionBy("lang").text(here)
    folder = F.regexp_extract("doc_id", r"lang=([^/]*)/", 1)
    held = files.list_files(spark, here).where("content_type is not null").groupBy(folder.alias("folder"), "content_type").agg(F.sum("size").alias("n_bytes"))
    read = files.read_texts(spark, here).where(folder != "").groupBy(folder.alias("folder")).agg(F.sum(F.octet_length("text")).alias("text_bytes"))
    return held.join(read, "folder")


@query(f"""with {LINES} select doc_id, "order", case "order" % 4 when 0 then 1 when 1 then least(coalesce(nullif("order" % 9, 0), 1) + 1, 6) end::int as level from lines""")
def heading_levels(spark, sf_dir):
    o = F.col("order")
    kind = F.when(o % 4 == 0, "title").when(o % 4 == 1, "section_header").otherwise("text")
    return lines(spark, sf_dir).select("doc_id", "order", E.heading_level(kind, F.nullif(o % 9, F.lit(0))).cast("int").alias("level"))


@query("select doc_id, case when doc_id % 5 = 0 then 'fresh' else source end source, case when doc_id % 5 = 0 then 2 else 1 end::bigint n from documents")
def replaced_rows(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    fresh = d.where("doc_id % 5 = 0").select("doc_id", F.explode(F.array(F.lit("fresh"), F.lit("fresh"))).alias("source"))
    return M.replace_documents(d, fresh).groupBy("doc_id").agg(F.min("source").alias("source"), F.count("*").alias("n"))


@query("with l as (select event_id % 200 item, user_id, max(ts) ts from events group by 1, 2), cut as (select max(ts) - interval 2 day c from events) select item, count(*) filter (ts > c) live, count(*) owners, bool_or(user_id % 2 = 0 and ts > c) even from l, cut group by 1")
def live_owners(spark, sf_dir):
    """Owners of each item with when they last asked for it; those of long ago have gone."""
    e = load(spark, sf_dir, "events")
    last = e.groupBy((F.col("event_id") % 200).alias("item"), "user_id").agg(F.max("ts").alias("ts"))
    m = last.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("user_id", "ts"))).alias("owners")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    live = M.live_owners(F.col("owners"), F.expr("now - interval 2 days"))
    return m.select("item", F.size(live).cast("long").alias("live"), F.size("owners").cast("long").alias("owners"), F.exists(F.map_keys(live), lambda u: u % 2 == 0).alias("even"))


@S.access_rule("by language")
def _by_language():
    return F.when(F.col("lang") == "fr", F.array(F.lit("fr"))).when(F.col("lang") == "de", F.array(F.lit("")))


@S.access_rule("long texts")
def _long_texts():
    return F.when(F.length("text") > 2000, F.array(F.lit("readers"), F.lit("staff")))


@query("""select doc_id, case when doc_id % 10 = 0 then 'admin,staff' when doc_id % 10 = 1 then '' when source like 'src1%' then 'staff' when lang = 'fr' then 'fr' when lang = 'de' then '' when length(text) > 2000 then 'readers,staff' else 'public' end roles,
case when doc_id % 10 <= 1 then 'label' when source like 'src1%' then 'folder src1*' when lang = 'fr' then 'access rule by language' when lang = 'de' then 'access rule by language failed' when length(text) > 2000 then 'access rule long texts' else 'default' end reason from documents""")
def registered_roles(spark, sf_dir):
    i = F.col("doc_id")
    labels = F.when(i % 10 == 0, F.create_map(F.lit("roles"), F.lit(" staff, admin ,"))).when(i % 10 == 1, F.create_map(F.lit("roles"), F.lit(""))).otherwise(F.create_map(F.lit("k"), F.lit("v")))
    got = S.resolved(F.col("source"), labels, (("SRC1*", ("staff",)),), ("by language", "long texts"), ("public",))
    return load(spark, sf_dir, "documents").select("doc_id", got.alias("r")).select("doc_id", F.array_join(F.array_sort("r.roles"), ",").alias("roles"), F.lower("r.reason").alias("reason"))


@query("with r as (select event_type run, avg(value) / 100 as now, avg(case when event_id % 2 = 0 then value end) / 100 before from events group by 1) select run, before - now <= 0.01 + 1e-9 holds from r")
def judged_gates(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg((F.avg("value") / 100).alias("now"), (F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / 100).alias("before"))
    return e.select("run", Q.judged_gate(F.col("before"), F.col("now"), 0.01).alias("holds"))


TURNS = "q as (select conv_id, turn, text question from conversations where role = 'user'), t as (select q.conv_id, q.turn, q.question, a.text answer, case when q.turn % 4 = 1 then 'rewritten ' || q.turn end rewrite from q left join (select conv_id, turn - 1 turn, text from conversations where role = 'assistant') a using (conv_id, turn))"


def chat_turns(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"], "left")
    return q.withColumn("rewrite", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("rewritten "), F.col("turn").cast("string"))))


def chat_summaries(spark, sf_dir):
    i = F.col("conv_id")
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct().where(i % 3 == 0)
    return c.select("conv_id", F.concat(F.lit("So far "), i.cast("string"), F.lit(".")).alias("summary"), (i % 2).alias("upto"))


@query(f"""with {TURNS}, m as (select conv_id % 20 user_id, conv_id n, text fact from conversations where role = 'system'), f as (select user_id, string_agg('- ' || fact, chr(10) order by n, fact desc) facts from (select *, row_number() over (partition by user_id order by n desc, fact) back from m) where back <= 2 group by 1),
h as (select conv_id, string_agg('Q: ' || coalesce(rewrite, question) || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) order by turn, question) history from (select *, row_number() over (partition by conv_id order by turn desc, question desc) back from t where conv_id % 5 <> 0) where back <= 2 group by 1),
c as (select distinct conv_id, conv_id % 20 user_id from conversations)
select conv_id, case when facts is not null or history is not null then coalesce('<memories>' || chr(10) || facts || chr(10) || '</memories>' || chr(10) || chr(10), '') || coalesce('<history>' || chr(10) || case when conv_id % 3 = 0 then 'Summary so far: So far ' || conv_id || '.' || chr(10) else '' end || history || chr(10) || '</history>' || chr(10) || chr(10), '') || 'Latest question: and then ' || conv_id || '?' end prompt, case when facts is null and history is null then 'no history' end reason from c left join f using (user_id) left join h using (conv_id)""")
def rewrite_prompts(spark, sf_dir):
    i = F.col("conv_id")
    c = load(spark, sf_dir, "conversations")
    asked_ = c.select("conv_id", (i % 20).alias("user_id"), F.concat(F.lit("and then "), i.cast("string"), F.lit("?")).alias("question")).distinct()
    memories = c.where("role = 'system'").select((i % 20).alias("user_id"), i.alias("n"), F.col("text").alias("fact"))
    return H.rewrite_prompts(asked_, chat_turns(spark, sf_dir).where(i % 5 != 0), memories, chat_summaries(spark, sf_dir), 2, 2)


@query(f"""with {TURNS}, k as (select *, row_number() over (partition by conv_id order by turn, question) k, count(*) over (partition by conv_id) n, case when conv_id % 3 = 0 then conv_id % 2 else 0 end upto from t)
select conv_id, case when conv_id % 3 = 0 then 'Earlier summary: So far ' || conv_id || '.' || chr(10) else '' end || '<turns>' || chr(10) || string_agg('Q: ' || question || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) order by turn, question) || chr(10) || '</turns>' prompt, max(k) upto from k where k > upto and k <= n - 1 group by conv_id""")
def fold_prompts(spark, sf_dir):
    return H.fold_prompts(chat_turns(spark, sf_dir), chat_summaries(spark, sf_dir), 1)


@query("""select sha256('m|7|float32|query|' || text) as key, text from (select distinct text from documents where text is not null) where text not in (select text from documents where doc_id % 4 = 0)""")
def queries_to_embed(spark, sf_dir):
    """What has to be computed for queries where a quarter of the texts are kept as queries, and all as documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    key = lambda kind: H.embedding_key(F.col("text"), "m", "7", kind, "float32").alias("key")
    cache = d.where("doc_id % 4 = 0").select(key("query")).unionByName(d.select(key("document")))
    return H.to_embed(d, cache, "m", "7", "query", "float32")[1]


@query(f"""with {DENSE}, h as (select query, piece, rank prior_rank, (0 - abs(length(d.text) - length(q.text)))::double score from de join documents d on d.doc_id = piece join documents q on q.doc_id = query where rank <= 20) select * from (select query, piece, prior_rank, score, row_number() over (partition by query order by score desc, prior_rank) as rank from h) where rank <= 5""")
def cross_scored_hits(spark, sf_dir):
    """The nearest vectors ordered anew by a function of pairs of texts, in batches."""
    d = load(spark, sf_dir, "documents")
    hits = R.dense(asked(spark, sf_dir), vectors(spark, sf_dir), 20).join(d.select(F.col("doc_id").alias("piece"), "text"), "piece").join(d.select(F.col("doc_id").alias("query"), F.col("text").alias("question")), "query")
    return hooks.cross_scored(hits, lambda pairs: [-abs(len(q) - len(t)) for q, t in pairs]).select("query", "piece", "prior_rank", "score", "rank")
