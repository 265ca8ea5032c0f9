"""Queries over facts of files, manifests and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import collections as C
from lodestone.operators import facts as K
from lodestone.operators import manage as M
from lodestone.operators import prepare as P
from lodestone.plans.preparing import TOKENS, load
from lodestone.query_set import query
from lodestone.sources.collection import Collection, Meta, described, versioned
from lodestone.sources.tables import new_path, stored

HEAD = """'<!-- <meta name="author" content="none"> --><meta content="v' || page_id || '" name=author><META NAME="Author" content=x><meta property=''og:type'' content="a &amp; b"/><meta name="empty" content=""><meta name="title" content="meta">'"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more tags before their own."""
    return load(spark, sf_dir, "pages").withColumn("html", F.concat(F.expr(HEAD), "html"))


@query(r"""select page_id, 'v' || page_id author, 'a & b' kind, coalesce(t, 'meta') title, 3 n from (select page_id, nullif(trim(replace(regexp_replace(regexp_extract(substr(html, 1, 65000), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '&amp;', '&')), '') t from pages)""")
def html_properties(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", K.html_properties(F.col("html")).alias("p"))
    return p.select("page_id", K.looked_up(F.col("p"), "AUTHOR").alias("author"), K.looked_up(F.col("p"), "og:Type").alias("kind"), K.looked_up(F.col("p"), "title").alias("title"), F.size("p").alias("n"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a store: folders by language, a label of the source, every fourth a page."""
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.when(i % 4 == 0, ".html").when(i % 4 == 1, ".MD").when(i % 4 == 2, ".txt").otherwise(".bin"))
    ident = F.concat("lang", F.lit("/"), name)
    labels = K.source_labels(ident, F.create_map(F.lit("Source"), F.col("source"), F.lit("path"), F.lit("elsewhere")))
    body = F.when(i % 4 == 0, F.concat(F.lit("<title>Page of "), "source", F.lit("</title>"), "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select(ident.alias("doc_id"), name.alias("name"), body.cast("binary").alias("content"), F.lit(None).cast("string").alias("url"), labels.alias("labels"))


FILES = """f as (select lang || '/' || doc_id || ext doc_id, doc_id || ext as name, case when doc_id % 4 = 0 then '<title>Page of ' || source || '</title>' || text else text end body, source, lang, doc_id i from documents, (values (0, '.html'), (1, '.MD'), (2, '.txt'), (3, '.bin')) x(k, ext) where doc_id % 4 = k)"""


@query(f"""with {FILES} select doc_id, case i % 4 when 0 then 'html' when 1 then 'md' when 2 then 'txt' end as type, octet_length(encode(body))::bigint size, doc_id as path, case when i % 4 = 0 then 'Page of ' || source end title, source as label, doc_id as labelled_path, case i % 4 when 0 then 'text/html' when 1 then 'text/markdown' when 2 then 'text/plain' else 'application/octet-stream' end content_type, case when i % 4 in (1, 2) then length(substr(body, 1, 4000)) else 0 end::int first_page from f""")
def document_information(spark, sf_dir):
    d = K.document_facts(files(spark, sf_dir))
    label = lambda k: K.looked_up(F.col("labels"), k)
    return d.select("doc_id", "type", "size", "path", K.looked_up(F.col("properties"), "title").alias("title"), label("SOURCE").alias("label"), label("path").alias("labelled_path"), label("content_type").alias("content_type"), F.length("first_page_text").alias("first_page"))


@query(f"""with {FILES} select doc_id, case when source in ('src1', 'src11') and i % 4 = 0 then 'titled' when contains(lower(source), '7') then 'sevens' when lang = 'en' and i % 4 = 1 then 'english notes' when i % 3 = 0 then 'scans' when i % 4 in (1, 2) and contains(lower(substr(body, 1, 4000)), 'password') then 'words' else 'other' end category from f""")
def routed_by_facts(spark, sf_dir):
    """Routes on properties inside files, labels, paths, text layers and first words."""
    d = K.document_facts(files(spark, sf_dir))
    layer = F.when(F.regexp_extract("name", r"^(\d+)", 1).cast("long") % 3 == 0, False)
    title = lambda n: K.properties(F.col("properties"), "TITLE", equals=f"page of SRC{n}")
    rules = (
        ("titled", (("properties", title(1) | title(11)),)), ("sevens", (("metadata", K.metadata(F.col("labels"), "source", contains="7")),)),
        ("english notes", (("path_like", K.path_like(F.col("path"), "EN/*")), ("file_type", K.file_type(F.col("type"), ["MD"])))), ("scans", (("text_layer", K.text_layer(layer, False)),)), ("words", (("contains_any", K.contains_any(F.col("first_page_text"), ["no such", "Password"])),)),
    )
    return d.select("doc_id", M.routed(rules, "other")["category"].alias("category"))


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of two thirds of the documents, and what a sync says of four fifths."""
    i, d = F.col("doc_id"), load(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    facts = [i.cast("string").alias("doc_id"), F.lit("pieces").alias("chunk_set"), F.lit("rule").alias("reason"), F.create_map(F.lit("source"), "source").alias("metadata"), F.lit("v1").alias("version")]
    before = d.where(i % 3 != 0).select(*facts, F.when(i % 4 == 0, "old").otherwise(sha).alias("content_hash"), F.when(i % 6 != 1, F.col("lang")).alias("category"))
    error = F.when(i % 7 == 0, "no text")
    now = d.where(i % 5 != 0).select(*facts, sha.alias("content_hash"), F.lit("new").alias("category"), error.alias("error"), "source", F.when(i % 11 == 0, "staff, admin").alias("label"))
    return before, now


ROLES = (("src1*", ("staff",)),)


@query("""with b as (select doc_id i, case when doc_id % 4 = 0 then 'old' else sha256(text) end h, case when doc_id % 6 <> 1 then lang end c from documents where doc_id % 3 <> 0),
n as (select doc_id i, sha256(text) h, source, doc_id % 7 = 0 failed from documents where doc_id % 5 <> 0), m as (select coalesce(b.i, n.i) i, b.i is not null was, n.i is not null and not coalesce(failed, false) is_, coalesce(failed, false) failed, b.h bh, n.h nh, b.c, source from b full join n on b.i = n.i)
select i::varchar doc_id, case when failed then 'failed' when not was then 'added' when not is_ then 'removed' when bh = nh then 'unchanged' else 'changed' end as status, case when is_ then coalesce(c, 'new') end category, case when not is_ then null when i % 11 = 0 then 'admin,staff' when source like 'src1%' then 'staff' else 'public' end roles, case when not is_ then null when i % 11 = 0 then 'label' when source like 'src1%' then 'folder src1*' else 'default' end roles_reason from m""")
def committed_roles(spark, sf_dir):
    """Every document of two listings: what a commit makes of it, and who sees it by the roles taken anew."""
    before, now = listings(spark, sf_dir)
    roles = M.roles_and_reason(F.col("label"), F.col("source"), ROLES, (), ("public",))
    after = C.next_manifest(before, now, roles)
    changes = C.manifest_changes(before, after, now.where("error is not null"))
    return changes.join(after.select("doc_id", "category", F.array_join(F.array_sort("roles"), ",").alias("roles"), "roles_reason"), "doc_id", "left")


def unversioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.token_chunks(load(spark, sf_dir, "documents").select(F.col("doc_id"), "text"))
    ident = P.chunk_id(F.col("doc_id"), "token_based", F.col("ordinal"), F.col("start"), F.col("end"))
    vector = F.array(F.col("ordinal").cast("double"), F.col("tokens").cast("double"))
    return c.select(ident.alias("id"), "doc_id", "ordinal", "text", vector.alias("vector"), F.array(F.lit("public")).alias("roles"), F.when(F.col("ordinal") > 0, F.array(F.lit("Part"))).otherwise(F.array().cast("array<string>")).alias("section"), F.array((F.floor(F.col("ordinal") / 2) + 1).cast("string")).alias("pages"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned(unversioned(spark, sf_dir))


META = Meta("counts", "1", 2, "cosine", "abcd" * 8)


@query(f"""with {TOKENS}, r as (select doc_id, ordinal, substr(sha256(concat_ws(chr(0), doc_id, 'token_based', ordinal, start, "end")), 1, 16) id from chunks),
v as (select doc_id, count(*) n_rows, substr(sha256(string_agg(id, chr(10) order by ordinal)), 1, 16) doc_version from r where doc_id % 7 <> 0 and doc_id % 5 <> 0 group by 1)
from v union all select doc_id, 1, 'new' from documents where doc_id % 5 = 0 and doc_id % 7 <> 0""")
def collection_after_changes(spark, sf_dir):
    """A collection of all pieces, a fifth of the documents replaced by one row each, a seventh deleted, read back."""
    c = Collection(spark, new_path(spark, "collections"), "pieces", buckets=8)
    c.write_all(versioned(stored(unversioned(spark, sf_dir), "index-rows")), META)  # read for the versions and for the rows
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents")
    fresh = d.where((i % 5 == 0) & (i % 7 != 0)).select(F.concat(F.lit("n"), i.cast("string")).alias("id"), "doc_id", F.lit("new").alias("doc_version"), F.lit(0).cast("long").alias("ordinal"), F.lit("new").alias("text"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"), F.array(F.lit("public")).alias("roles"), F.array().cast("array<string>").alias("section"), F.array(F.lit("1")).alias("pages"))
    c.change(fresh=fresh)
    c.change(gone=d.where(i % 7 == 0))
    return c.read().groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.min("doc_version").alias("doc_version"))


@query(f"with {TOKENS} select count(*) n_rows, count(distinct doc_id) documents, count(*) filter (ordinal > 0) sections, max(ordinal // 2 + 1)::int max_page, 2 dims, 'cosine' metric, 'counts@1' model from chunks")
def collection_descriptor(spark, sf_dir):
    return described(index_rows(spark, sf_dir), META)
