"""Queries over documents, pages and elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import nearest as B
from lodestone.operators import prepare as P
from lodestone.query_set import query

LINES = r"""lines as (select doc_id, i - 1 as "order", l[i] as text from (select doc_id, list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(x, ' ') <> '') l from documents), unnest(range(1, len(l) + 1)) u(i))"""
NORM = r"replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')), 'ß', 'ss')"

# What two parsers of one passage agree on.
MATCHED = r"translate(regexp_replace({0}, '-[ \t]*[\r\n]\s*', '', 'g'), '‘’‚′“”„″', repeat(chr(39), 4) || repeat(chr(34), 4))"
FOLDED = "replace(lower(trim(regexp_replace(replace(replace(replace(replace(replace(" + MATCHED + r", 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '\s+', ' ', 'g'), ' ')), 'ß', 'ss')"

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.line_elements(load(spark, sf_dir, "documents"))


@query("select sha256(text) sha, count(*) copies, min(doc_id) doc_id from documents group by 1")
def content_identity(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))


@query(r"""select page_id, format, case when format in ('html', 'md', 'txt') then null else 'not readable' end error from (select page_id, case when regexp_matches(p, '\.html?$') then 'html' when regexp_matches(p, '\.md$') then 'md' when regexp_matches(p, '\.txt$') then 'txt' when regexp_matches(p, '\.pdf$') then 'pdf' end format
from (select page_id, lower(regexp_extract(url, '([^?#]*)', 1)) p from pages))""")
def format_detection(spark, sf_dir):
    kind = T.format_of(F.regexp_extract("url", r"([^?#]*)", 1))
    return load(spark, sf_dir, "pages").select("page_id", kind.alias("format"), F.when(kind.isin("html", "md", "txt"), None).otherwise("not readable").alias("error"))


@query("select doc_id, substr(text, 1, 4000) first_page_text, case when length(text) > 80 then substr(text, 1, 79) || '…' else text end preview from documents")
def text_facts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 4000).alias("first_page_text"), T.preview(F.col("text")).alias("preview"))


@query("""select page_id, 'https://raw.githubusercontent.com/team/' || split_part(split_part(url, '://', 2), '/', 1) || '/main/' || page_id || '.md' raw from pages""")
def raw_urls(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    blob = F.concat(F.lit("https://github.com/team/"), host, F.lit("/blob/main/"), F.col("page_id").cast("string"), F.lit(".md?plain=1#L3"))
    return load(spark, sf_dir, "pages").select("page_id", T.raw_url(blob).alias("raw"))


@query(f"with {LINES} select doc_id, \"order\", format('e{{:05d}}', \"order\") id, 'paragraph' as type, text from lines")
def line_elements(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"""with {LINES}, k as (select doc_id, "order", case when "order" = 0 then '# ' || text when "order" % 7 = 3 then '- ' || text when "order" % 11 = 5 then '' else text end body from lines)
select doc_id, "order", s as start, s + length(body) as "end" from (select doc_id, "order", body, coalesce(sum(length(body) + case when body <> '' then 2 else 0 end) over (partition by doc_id order by "order" rows between unbounded preceding and 1 preceding), 0)::bigint s from k)""")
def render_offsets(spark, sf_dir):
    o = F.col("order")
    kind = F.when(o == 0, "heading").when(o % 7 == 3, "list_item").when(o % 11 == 5, "footer").otherwise("paragraph")
    e = lines(spark, sf_dir).withColumn("body", P.rendered(kind, F.col("text"), F.lit(1)))
    return P.offsets(e).select("doc_id", "order", "start", "end")


@query(f"""with {LINES}, k as (select doc_id, "order", case when "order" % 11 = 5 then '' else text end body from lines) select doc_id, sha256(string_agg(body, E'\\n\\n' order by "order")) sha from k where body <> '' group by 1""")
def render_documents(spark, sf_dir):
    e = lines(spark, sf_dir).where(F.col("order") % 11 != 5)
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n\n")
    return e.groupBy("doc_id").agg(F.sha2(parts, 256).alias("sha"))


@query(f"with {LINES} select doc_id, count(*) kept from lines where not contains(lower(text), 'license') and not regexp_matches(text, '[0-9]{{4}}') group by 1")
def drop_matching_blocks(spark, sf_dir):
    e = P.drop_matching(P.drop_matching(lines(spark, sf_dir), "License"), r"[0-9]{4}", regex=True, case=True)
    return e.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"""with {LINES}, n as (select *, {NORM.format('text')} norm from lines), r as (select *, row_number() over w rn, first_value(format('e{{:05d}}', "order")) over w f from n window w as (partition by doc_id, norm order by "order"))
select doc_id, "order", case when norm <> '' and rn > 1 then f end duplicate_of from r""")
def dedupe_blocks_exact(spark, sf_dir):
    return P.dedupe_blocks(lines(spark, sf_dir)).select("doc_id", "order", "duplicate_of")


@query(f"""with {LINES}, n as (select *, {NORM.format('text')} norm from lines), r as (select doc_id, "order", norm, row_number() over (partition by norm order by doc_id, "order") rn from n)
select doc_id, count(*) filter (norm <> '' and rn > 1) repeated, count(*) blocks from r group by 1""")
def dedupe_blocks_corpus(spark, sf_dir):
    e = P.dedupe_blocks(lines(spark, sf_dir), ())
    return e.groupBy("doc_id").agg(F.count("duplicate_of").alias("repeated"), F.count("*").alias("blocks"))


@query(f"""with {LINES}, n as (select source doc, doc_id page, "order", {NORM.format('l.text')} norm from lines l join documents using (doc_id)),
e as (select *, row_number() over (partition by doc, page order by "order") up, row_number() over (partition by doc, page order by "order" desc) down from n), p as (select doc, count(distinct page) all_pages from n group by 1),
f as (select doc, case when up = 1 then 'first' else 'last' end as position, case when regexp_matches(norm, '(?i)^[-–—\\[(]?\\s*(?:page\\s*)?\\d{{1,4}}\\s*(?:(?:/|of|\\|)\\s*\\d{{1,4}})?\\s*[-–—\\])]?$') then '<number>' else norm end shape, count(distinct page) pages from e where (up = 1 or down = 1) and length(norm) <= 120 and norm <> '' group by 1, 2, 3)
select doc, position, shape, pages from f join p using (doc) where all_pages > 1 and pages >= greatest(2, all_pages * 0.02 - 1e-9)""")
def header_footer_round(spark, sf_dir):
    source = load(spark, sf_dir, "documents").select("doc_id", "source")
    e = lines(spark, sf_dir).join(source, "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "order", "text")
    return P.running_lines(e, min_pages=2, ratio=0.02)


TOKENS = r"""toks as (select doc_id, text, regexp_extract_all(text, '\s*(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])') p from documents),
cut as (select doc_id, text, p, len(p) n, unnest(range(0, len(p), 448)) f from toks where len(p) > 0),
win as (select doc_id, text, p, n, f, least(f + 512, n) l from cut where f = 0 or f - 448 + 512 < n),
chunks as (select doc_id, (f // 448)::bigint ordinal, (coalesce(list_sum(list_transform(p[1:f], lambda x: length(x))), 0) + length(p[f + 1]) - length(regexp_replace(p[f + 1], '^\s+', '')))::bigint as start, list_sum(list_transform(p[1:l], lambda x: length(x)))::bigint as "end", (l - f)::bigint tokens, text whole from win)"""


@query(rf"""with {TOKENS} select doc_id, ordinal, start, "end", tokens, sha256(substr(whole, start + 1, "end" - start)) sha, substr(sha256(concat_ws(chr(0), doc_id, 'token_based', ordinal, start, "end")), 1, 16) id from chunks""")
def token_chunks(spark, sf_dir):
    c = P.token_chunks(load(spark, sf_dir, "documents"))
    ident = P.chunk_id(F.col("doc_id"), "token_based", F.col("ordinal"), F.col("start"), F.col("end"))
    return c.select("doc_id", "ordinal", "start", "end", "tokens", F.sha2("text", 256).alias("sha"), ident.alias("id"))


@query(f"""with {TOKENS}, s as (select list_sort(list(tokens)) t, count(*) n, sum(tokens) m, median(tokens) md, max(tokens) mx from chunks) select n pieces, m::bigint tokens, md median_tokens, t[greatest(ceil(n * 0.95), 1)::int] p95_tokens, mx largest from s""")
def chunk_stats(spark, sf_dir):
    return P.chunk_stats(P.token_chunks(load(spark, sf_dir, "documents")))


@query(f"""with {TOKENS}, r as (select *, coalesce(max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding), 0) reach, coalesce(lag("end") over (partition by doc_id order by ordinal), 0) prev from chunks)
select doc_id, sum(greatest(0, "end" - greatest(start, reach)))::bigint covered, sum(greatest(0, least(prev, "end") - start))::bigint repeated from r group by 1""")
def chunk_coverage(spark, sf_dir):
    c = P.token_chunks(load(spark, sf_dir, "documents")).select("doc_id", "ordinal", "start", "end")
    again = P.repeats(c).groupBy("doc_id").agg(F.sum("repeated").alias("repeated"))
    return P.coverage(c).join(again, "doc_id")


@query(f"""with {TOKENS} select a.doc_id, count(*) pairs from chunks a join chunks b on a.doc_id = b.doc_id and a.ordinal < b.ordinal and b.start < a."end" group by 1""")
def overlapping_pieces(spark, sf_dir):
    c = P.token_chunks(load(spark, sf_dir, "documents")).select("doc_id", "ordinal", "start", "end")
    return P.overlapping(c).groupBy("doc_id").agg(F.sum("overlaps").alias("pairs")).where("pairs > 0")


@query(f"""with {LINES}, k as (select doc_id, "order", row_number() over (partition by doc_id order by "order") k, count(*) over (partition by doc_id) n from lines) select doc_id, "order", ((k * 4 - 1) // n)::bigint part from k""")
def paragraph_parts(spark, sf_dir):
    return P.paragraph_parts(lines(spark, sf_dir), 4).select("doc_id", "order", "part")


@query(r"""select term, count(*) df, sum(tf)::bigint cf, max(tf) most from (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) term from documents) group by 1, 2) group by 1""")
def postings_by_term(spark, sf_dir):
    p = P.postings(load(spark, sf_dir, "documents"), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


@query(rf"""with m as (select doc_id, translate(regexp_replace(text, '-[ \t]*[\r\n]\s*', '', 'g'), '‘’‚′“”„″', repeat(chr(39), 4) || repeat(chr(34), 4)) t from documents)
select doc_id, sha256({NORM.format('text')}) norm, sha256({NORM.format("replace(replace(replace(replace(replace(t, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')")}) matched from m join documents using (doc_id)""")
def normalised_texts(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise(t), 256).alias("norm"), F.sha2(T.match_normalise(t), 256).alias("matched"))


@query(r"""with w as (select item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: not list_contains(string_split('a an and are as at be by can do does for from has have how in is it its of on or that the their this to was were what when where which who why will with', ' '), x)) q from benchmark),
p as (select a.item_id, a.q, coalesce(b.q, []) h from w a left join w b on b.item_id = a.item_id + 1)
select item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3 and not list_contains(string_split('STOP', ' '), x)))::int expansion, case when len(q) = 0 then 0.0 else len(list_filter(q, lambda x: list_contains(h, x)))::double / len(q) end copied from p join benchmark using (item_id)""".replace("STOP", " ".join(T.EXPANSION_STOP_WORDS)))
def question_words(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("passage"))
    return b.join(after, "item_id", "left").select("item_id", F.size(T.expansion_tokens(F.col("text"))).alias("expansion"), T.copied_share(F.col("text"), F.coalesce("passage", F.lit(""))).alias("copied"))


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\t\n\r\x0B\f]', ' ', 'g'), '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), '^\s+|\s+$', '', 'g') cleaned, starts_with(lower(trim(text, ' ')), 'the documents do not') and not regexp_matches(trim(text, ' '), '[.!?]\s+\S') not_found from conversations""")
def cleaned_turns(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_text(t).alias("cleaned"), T.says_not_found(t).alias("not_found"))


@query("""select l_orderkey, l_linenumber, list_concat(s, list_filter([0, 1, 2, 3, 4, 5], lambda x: not list_contains(s, x))) as "order" from (select *, case when a >= 6 then [b] when a = b then [a] else [a, b] end s from (select l_orderkey, l_linenumber, (l_partkey % 7)::int a, (l_suppkey % 5)::int b from lineitem))""")
def ranking_replies(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    reply = F.concat(F.lit("rank "), (F.col("l_partkey") % 7).cast("string"), F.lit(" then "), (F.col("l_suppkey") % 5).cast("string"), F.lit(" and 12"))
    return li.select("l_orderkey", "l_linenumber", T.parse_order(reply, F.lit(6)).alias("order"))


@query("""with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings), q as (select vec_id as query, v q, n qn from e where vec_id % 50 = 0)
select query, vec_id, list_dot_product(v, q) dot, case when n * qn = 0 then 0 else list_dot_product(v, q) / (n * qn) end cosine, -list_distance(v, q) l2 from e, q""")
def vector_scores(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))  # the stated query set
    rows, kind = e.select(F.col("vec_id").alias("piece"), F.col("embedding").alias("vector")), q.schema["query"].dataType.simpleString()
    return reduce(DataFrame.unionByName, [B.all_scores(t, kind) for t in B.blocks(q, rows, 10_000)]).withColumnRenamed("piece", "vec_id")


@query("""with e as (select vec_id, embedding::double[] v, embedding[1:16]::double[] t from embeddings) select vec_id, list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) whole, list_sum(list_transform(t, lambda x: x / sqrt(list_dot_product(t, t)))) cut from e""")
def truncated_vectors(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return load(spark, sf_dir, "embeddings").select("vec_id", total(V.normalised(F.col("embedding"))).alias("whole"), total(V.truncated(F.col("embedding"), 16)).alias("cut"))


@query(f"""with {TOKENS} select doc_id, substr(sha256(string_agg(substr(sha256(concat_ws(chr(0), doc_id, 'token_based', ordinal, start, "end")), 1, 16), chr(10) order by ordinal)), 1, 16) doc_version from chunks group by 1""")
def doc_versions(spark, sf_dir):
    c = P.token_chunks(load(spark, sf_dir, "documents"))
    c = c.select("doc_id", "ordinal", P.chunk_id(F.col("doc_id"), "token_based", F.col("ordinal"), F.col("start"), F.col("end")).alias("id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]), "\n")
    return c.groupBy("doc_id").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("doc_version"))
