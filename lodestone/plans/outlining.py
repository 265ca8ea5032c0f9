"""Queries over headings, pages, line boxes, offsets of normalised texts and texts that nearly agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import alignment as A
from lodestone.operators import layout as L
from lodestone.operators import outline as O
from lodestone.operators import prepare as P
from lodestone.operators import similar as S
from lodestone.plans.preparing import FOLDED, LINES, TOKENS, lines, load
from lodestone.query_set import query

# Elements of the documents' lines: every fifth is a heading, of levels 1, 2, 3, 2, 1 …, the next some a running head; a
# page holds twelve lines.
KIND = """case when "order" % 5 = 0 then 'heading' when "order" % 12 = 11 then 'footer' when "order" % 7 = 3 then 'list_item' else 'paragraph' end"""
RENDERED = rf"""{LINES}, el as (select doc_id, "order", format('e{{:05d}}', "order") id, {KIND} as kind, case when "order" % 5 = 0 then abs((("order" // 5) % 4)::int - 2) + 1 end as lv, ("order" // 12 + 1)::int page, text from lines),
bo as (select *, case kind when 'heading' then repeat('#', lv) || ' ' || text when 'footer' then '' when 'list_item' then '- ' || text else text end body from el),
pl as (select *, coalesce(sum(length(body) + case when body <> '' then 2 else 0 end) over (partition by doc_id order by "order" rows between unbounded preceding and 1 preceding), 0)::bigint s from bo),
pe as (select *, s + length(body) e from pl where body <> ''),
rendered as (select doc_id, string_agg(body, E'\n\n' order by "order") as text from bo where body <> '' group by 1), {TOKENS.replace("from documents", "from rendered")}"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("order")
    kind = F.when(o % 5 == 0, "heading").when(o % 12 == 11, "footer").when(o % 7 == 3, "list_item").otherwise("paragraph")
    level = F.when(o % 5 == 0, F.abs(F.floor(o / 5) % 4 - 2) + 1).cast("int")
    e = lines(spark, sf_dir).withColumns({"type": kind, "level": level, "page": (F.floor(o / 12) + 1).cast("int")})
    return P.offsets(e.withColumn("body", P.rendered(F.col("type"), F.col("text"), F.col("level"))))


def pieces(e: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Token windows of the rendered documents of elements(doc_id, order, body)."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "body"))), lambda x: x["body"]), "\n\n")
    return P.token_chunks(e.where("body <> ''").groupBy("doc_id").agg(text.alias("text")), size, overlap)


HELD = """ch as (select doc_id, ordinal, start, "end" from chunks),
held as (select c.doc_id, c.ordinal, list(p.id order by p."order") ids, list(p.kind order by p."order") kinds, list(p.s order by p."order") starts, min(p.page) first_page, max(p.page) last_page from ch c join pe p on p.doc_id = c.doc_id and p.s < c."end" and p.e > c.start group by 1, 2),
led as (select ch.*, ids, first_page, last_page, starts, coalesce(case when len(list_filter(kinds, lambda x: x <> 'heading')) = 0 then len(kinds) else list_position(list_transform(kinds, lambda x: x <> 'heading'), true) - 1 end, 0)::int n from ch left join held using (doc_id, ordinal))"""
HEADS = """hd as (select doc_id, "order", s, lv, text from pe where kind = 'heading'),
lh as (select c.doc_id, c.ordinal, h."order", h.text, h.lv, max(case when g.lv <= h.lv and g."order" > h."order" then 1 else 0 end) ended from at_ c join hd h on h.doc_id = c.doc_id and h.s <= c.place join hd g on g.doc_id = c.doc_id and g.s <= c.place group by all),
paths as (select doc_id, ordinal, list(text order by "order") filter (ended = 0) path from lh group by 1, 2)"""


@query(f"""with {RENDERED}, {HELD}, at_ as (select doc_id, ordinal, start as place from led), {HEADS}
select doc_id, ordinal, coalesce(path, []) heading_path, n n_leading, coalesce(ids, []) source_element_ids, first_page, last_page from led left join paths using (doc_id, ordinal)""")
def chunk_outlines(spark, sf_dir):
    e = elements(spark, sf_dir)
    return O.outlined(pieces(e), e)


@query(f"""with {RENDERED.replace("448 + 512", "112 + 128").replace("448", "112").replace("512", "128")}, {HELD}, at_ as (select doc_id, ordinal, case when n > 0 then starts[n] else start end as place from led), {HEADS}
select doc_id, ordinal, case when len(coalesce(path, [])) > n then array_to_string(path[1:len(path) - n], ' > ') || E'\\n\\n' else '' end as prefix, len(coalesce(path, [])) as depth from led left join paths using (doc_id, ordinal)""")
def contextual_pieces(spark, sf_dir):
    """What stands before a piece when it is embedded: the headings above those that it opens with."""
    e = elements(spark, sf_dir)
    p = pieces(e, 128, 16)
    o = O.outlined(p, e, leading=True).join(p.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"])
    c = P.heading_context(o.withColumn("leading", F.col("n_leading")))
    return c.select("doc_id", "ordinal", F.expr("left(embed_text, length(embed_text) - length(text))").alias("prefix"), F.size("heading_path").alias("depth"))


# Lines as a page has them: 60 characters each, a hyphen where a word is cut, a wider gap before each line of the document, a
# second column after 24 lines of a page of 48.  Every 97th document has no boxes.
BOXES = rf"""{LINES}, cut as (select doc_id, "order", unnest(range(0, length(text), 60)) a, text from lines),
ln as (select doc_id, (row_number() over (partition by doc_id order by "order", a) - 1)::int n, a, trim(substr(text, a + 1, 60), ' ') || case when regexp_matches(substr(text, a + 60, 2), '^\p{{L}}\p{{Ll}}$') then '-' else '' end as text from cut),
bx as (select doc_id, n // 48 page, n % 48 as line, text, a > 0 inner_, (case when n % 48 >= 24 then 300 else 20 end)::double as "left", (700 - 14 * (n % 24) - sum(case when a = 0 then 9 else 0 end) over (partition by doc_id, n // 24 order by n))::double as bottom from ln where trim(text, ' ') <> ''),
li as (select doc_id, page, line, text, case when doc_id % 97 <> 0 then "left" end "left", case when doc_id % 97 <> 0 then bottom end bottom, case when doc_id % 97 <> 0 then "left" + 4 * length(text) end "right", case when doc_id % 97 <> 0 then bottom + 11 end top from bx)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "order", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(60))).alias("a"))
    w = Window.partitionBy("doc_id").orderBy("order", "a")
    broken = F.substr("text", F.col("a") + 60, F.lit(2)).rlike(r"^\p{L}\p{Ll}\z")
    ln = cut.select("doc_id", (F.row_number().over(w) - 1).alias("n"), "a", F.concat(F.trim(F.substr("text", F.col("a") + 1, F.lit(60))), F.when(broken, "-").otherwise("")).alias("text")).where(F.trim("text") != "")
    n, column = F.col("n"), Window.partitionBy("doc_id", F.floor(F.col("n") / 24)).orderBy("n")
    bottom = (700 - 14 * (n % 24) - F.sum(F.when(F.col("a") == 0, 9).otherwise(0)).over(column)).cast("double")
    left = F.when(n % 48 >= 24, 300.0).otherwise(20.0)
    bx = ln.withColumns({"bottom": bottom, "left": left})
    here = lambda c: F.when(F.col("doc_id") % 97 != 0, c)
    return bx.select("doc_id", F.floor(n / 48).alias("page"), (n % 48).alias("line"), "text", here(F.col("left")).alias("left"), here(F.col("bottom")).alias("bottom"), here(F.col("left") + 4 * F.length("text")).alias("right"), here(F.col("bottom") + 11).alias("top"))


@query(rf"""with {BOXES}, w1 as (select *, lag(top) over (partition by doc_id, page order by line) - top pitch from li), w2 as (select *, median(case when pitch > 0 then pitch end) over (partition by doc_id, page) med from w1),
w3 as (select *, sum((top is null or pitch is null or pitch <= 0 or pitch > 1.5 * coalesce(med, 0))::int) over (partition by doc_id, page order by line) - 1 para from w2),
w4 as (select *, lag(text) over p was, lead(text) over p next from w3 window p as (partition by doc_id, page, para order by line)),
w5 as (select *, case when was is null or (regexp_matches(was, '[\p{{L}}\p{{Nl}}\p{{No}}]-$') and regexp_matches(text, '^\p{{Ll}}')) then '' else ' ' end || case when next is not null and regexp_matches(text, '[\p{{L}}\p{{Nl}}\p{{No}}]-$') and regexp_matches(next, '^\p{{Ll}}') then left(text, length(text) - 1) else text end piece from w4)
select doc_id, page::bigint page, para::int paragraph, string_agg(piece, '' order by line) as text, count(*) n_lines, min("left") as "left", min(bottom) bottom, max("right") as "right", max(top) top from w5 group by 1, 2, 3""")
def joined_paragraphs(spark, sf_dir):
    return L.paragraphs(boxes(spark, sf_dir))


@query(rf"""with n as (select doc_id, text, {FOLDED.format('text')} norm from documents),
u as (select doc_id, regexp_extract_all(text, '(?s)(?:-[ \t]*[\r\n]\s*|\s+|.)') l from documents), x as (select doc_id, unnest(l) u, generate_subscripts(l, 1) k from u),
y as (select doc_id, k, u, (sum(length(u)) over (partition by doc_id order by k) - length(u))::bigint o, regexp_matches(u, '^\s+$') sp, regexp_matches(u, '^-[ \t]*[\r\n]') br from x),
z as (select *, sum((not sp and not br)::int) over (partition by doc_id order by k) seen, sum((not sp and not br)::int) over (partition by doc_id) every from y),
c as (select doc_id, k, o, case when br or (sp and (seen = 0 or seen = every)) then 0 when u in ('ﬃ', 'ﬄ') then 3 when u in ('ﬀ', 'ﬁ', 'ﬂ', 'ß', 'ẞ') then 2 else 1 end times from z),
m as (select doc_id, list(o order by k, i) map from (select doc_id, k, o, unnest(range(times)) i from c) group by 1)
select doc_id, sha256(norm) norm, sha256(array_to_string(coalesce(map, []), ',')) offsets, case when contains(norm, 'the ') then map[instr(norm, 'the ')] end::bigint as first_the from n left join m using (doc_id)""")
def normalised_offsets(spark, sf_dir):
    o = A.normalised_with_offsets(load(spark, sf_dir, "documents"))
    found = A.found_span(F.col("norm"), F.col("offsets"), F.lit("the "))
    return o.select("doc_id", F.sha2("norm", 256).alias("norm"), F.sha2(F.array_join(F.col("offsets").cast("array<string>"), ","), 256).alias("offsets"), found["start"].alias("first_the"))


def edited_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold for every document: its tenth to thirtieth word, some with the words changed, some of another document's text."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    i = F.col("doc_id")
    part = F.array_join(F.slice(words, 10, 12), " ")
    changed = F.when(i % 3 == 0, part).when(i % 3 == 1, F.regexp_replace(part, "[aeiou]", "x")).otherwise(F.concat(F.left(part, F.lit(30)), F.lit(" and more")))
    return load(spark, sf_dir, "documents").select(i.alias("query"), "doc_id", changed.alias("gold")).where("length(gold) > 0")


@query()
def closest_golds(spark, sf_dir):
    return S.closest_sentences(edited_golds(spark, sf_dir), load(spark, sf_dir, "documents"))


@query()
def near_duplicate_questions(spark, sf_dir):
    """Questions made of each turn's first words, a set for each role: many differ by a few letters, some by none."""
    c = load(spark, sf_dir, "conversations").select(F.col("role").alias("set_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.left("text", F.lit(60)).alias("question"), F.substring("text", 61, 30).alias("gold"))
    return S.kept_in_order(c).select("set_id", "n", "drop")
