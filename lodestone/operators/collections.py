"""Manifests: what a sync commits, moves and reports, and the facts of each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import published
from lodestone.sources.tables import stored

MANIFEST = "doc_id string, content_hash string, chunk_set string, category string, reason string, roles array<string>, roles_reason string, metadata map<string,string>, version string"


def document_info(files: DataFrame) -> DataFrame:
    """doc_id, name, type, size, path of files(doc_id, name, content, url): the path is the link, or an id with a slash."""
    path = F.when(F.col("url").isNotNull(), F.col("url")).when(F.col("doc_id").cast("string").contains("/"), F.col("doc_id").cast("string"))
    return files.select("doc_id", "name", T.format_of(F.col("name")).alias("type"), F.octet_length("content").cast("long").alias("size"), path.alias("path"))


def readable(files: DataFrame, capabilities: DataFrame, parser: str) -> DataFrame:
    """doc_id, type, error of files(doc_id, name, head) for a parser whose formats capabilities(parser, type) lists."""
    own = capabilities.where(F.col("parser") == parser).select("type", F.lit(True).alias("reads"))
    f = files.withColumn("type", T.format_of(F.col("name"))).join(own, "type", "left")
    held = T.disguised(F.col("name"), F.col("head"))
    error = F.when(F.col("type").isNull(), "unknown format").when(F.col("reads").isNull(), F.concat(F.lit(f"{parser} does not read "), F.col("type"))).when(held.isNotNull(), F.concat(F.lit("named ."), F.col("type"), F.lit(" but holds "), held))
    return f.select("doc_id", "type", error.alias("error"))


def committed(manifest: DataFrame, synced: DataFrame) -> DataFrame:
    """The next manifest: documents of synced(doc_id, version, category, roles, error) without an error, which keep a
    category set before; a failed one keeps its old row; manifest(doc_id, version, category, roles, pinned)."""
    old = manifest.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in ("version", "category", "roles", "pinned")], F.lit(True).alias("was"))
    m = synced.join(old, "doc_id", "left").where(F.col("error").isNull() | F.col("was").isNotNull())
    failed = F.col("error").isNotNull()
    sticky = F.coalesce("o_pinned", F.lit(False))
    return m.select(
        "doc_id", F.when(failed, F.col("o_version")).otherwise(F.col("version")).alias("version"), F.when(failed | sticky, F.col("o_category")).otherwise(F.col("category")).alias("category"),
        F.when(failed, F.col("o_roles")).otherwise(F.col("roles")).alias("roles"), sticky.alias("pinned"),
    )


def sync_report(status: DataFrame, failed: DataFrame, config_changed: Column) -> DataFrame:
    """One row of status(doc_id, status) and failed(doc_id): counts, whether settings changed, whether all went well."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    s = status.join(failed.select("doc_id", F.lit(True).alias("failed")), "doc_id", "left").withColumn("status", F.when(F.col("failed"), "failed").otherwise(F.col("status")))
    return s.agg(n("added"), n("changed"), n("removed"), n("unchanged"), n("failed"), config_changed.alias("config_changed")).withColumn("complete", F.col("failed") == 0)


def moved(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """The manifest with the documents of moves(doc_id, to) in their new category, pinned there."""
    m = manifest.join(moves.select("doc_id", "to"), "doc_id", "left")
    return m.withColumn("category", F.coalesce("to", "category")).withColumn("pinned", F.col("pinned") | F.col("to").isNotNull()).drop("to")


def unread(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Listed entries that the sync was to read and did not; an empty listing or a repeated id is refused."""
    bad = listing.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()["most"]
    if bad != 1:
        raise ValueError("the source lists nothing" if bad == 0 else "the source lists an id twice")
    return listing.join(read.select("doc_id"), "doc_id", "left_anti")


def next_manifest(before: DataFrame, documents: DataFrame, roles: Column | None = None) -> DataFrame:
    """The manifest of documents(doc_id, content_hash, chunk_set, category, reason, metadata, version, error) without an
    error: a document that before(doc_id, category, reason, metadata) sorted stays in its category, new metadata replace
    old, and roles, a struct(roles, reason) over the columns of documents, is taken anew for every document."""
    none = F.struct(F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("string").alias("reason"))
    old = before.select(F.col("doc_id").alias("o_id"), F.col("category").alias("o_category"), F.col("reason").alias("o_reason"), F.col("metadata").alias("o_metadata"))
    kept = documents.where("error is null").withColumn("who", roles if roles is not None else none)
    m = kept.join(old, F.col("doc_id") == F.col("o_id"), "left")
    sorted_ = F.col("o_category").isNotNull()
    return m.select(
        "doc_id", "content_hash", "chunk_set", F.when(sorted_, F.col("o_category")).otherwise(F.col("category")).alias("category"), F.when(sorted_, F.col("o_reason")).otherwise(F.col("reason")).alias("reason"),
        F.col("who.roles").alias("roles"), F.col("who.reason").alias("roles_reason"), F.coalesce("metadata", "o_metadata").alias("metadata"), "version",
    )


def manifest_changes(before: DataFrame, after: DataFrame, failed: DataFrame) -> DataFrame:
    """doc_id, status: failed, added, changed (content, pieces, or a category set before), removed or unchanged."""
    facts = ("content_hash", "chunk_set", "category")
    o = before.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in facts], F.lit(True).alias("was"))
    n = after.select("doc_id", *[F.col(c).alias(f"n_{c}") for c in facts], F.lit(True).alias("is"))
    f = failed.select("doc_id", F.lit(True).alias("failed")).distinct()
    same = F.col("o_content_hash").eqNullSafe(F.col("n_content_hash")) & F.col("o_chunk_set").eqNullSafe(F.col("n_chunk_set")) & F.coalesce("o_category", "n_category").eqNullSafe(F.col("n_category"))
    status = F.when(F.col("failed"), "failed").when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return o.join(n, "doc_id", "full_outer").join(f, "doc_id", "full_outer").select("doc_id", status.alias("status"))


def commit(spark: SparkSession, root: str, documents: DataFrame, build: Callable[[DataFrame], str], roles: Column | None = None, keep: int = 2) -> DataFrame:
    """Indexes what ``documents`` says the collection should hold, then makes the new manifest at ``root`` current; returns
    manifest_changes.

    build gets the new manifest and returns the name of the index it made.  If it raises, or every document failed, the
    manifest before stays current, and its index with it.  Afterwards all manifests but the last ``keep`` go."""
    before = published.current(spark, root)
    before = spark.createDataFrame([], MANIFEST + ", collection string") if before is None else before
    documents = stored(documents, "sync")
    after = stored(next_manifest(before, documents, roles), "manifest")
    failed = documents.where("error is not null")
    changes = stored(manifest_changes(before, after, failed), "changes")
    if after.head(1):
        name = build(after)
        published.publish(after.withColumn("collection", F.lit(name)), root)
        published.retire(spark, root, keep)
    return changes


def current_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    return published.current(spark, root)


def added(manifest: DataFrame, fresh: DataFrame, replace: bool = False) -> DataFrame:
    """The listing after an addition: manifest(doc_id, name, …) and fresh rows of the same columns.

    A name that stands already is refused, in the column error, unless it may be replaced; of two fresh rows of one id
    the one with the least name counts."""
    one = fresh.groupBy("doc_id").agg(F.min_by(F.struct(*fresh.columns), "name").alias("x")).select("x.*")
    there = manifest.select("doc_id", F.lit(True).alias("there"))
    new = one.join(there, "doc_id", "left").withColumn("error", F.when(F.col("there") & F.lit(not replace), "already in the collection")).drop("there")
    old = manifest.join(one.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit(None).cast("string"))
    refused = manifest.join(new.where("error is not null").select("doc_id", F.col("error")), "doc_id")
    taken = new.where("error is null")
    return old.unionByName(refused.select(*old.columns)).unionByName(taken.select(*old.columns))


def listed(manifest: DataFrame, category: str | None = None, like: str | None = None) -> DataFrame:
    """doc_id, category, reason, roles, version of a manifest in order of category and id, those of one category or whose id
    matches a shell pattern."""
    m = manifest if category is None else manifest.where(F.col("category") == category)
    m = m if like is None else m.where(F.coalesce(T.glob(F.col("doc_id").cast("string"), like), F.lit(False)))
    return m.select("doc_id", "category", "reason", "roles", "version").orderBy("category", "doc_id")


def sort_preview(manifest: DataFrame, documents: DataFrame, sorting: Column) -> DataFrame:
    """doc_id, before, after, reason of the documents that rules, a struct(category, reason) over documents, would sort otherwise
    than the manifest has them; a pinned document (reason "pinned") stays, a document that is not in it has a null before."""
    now = documents.select("doc_id", sorting.alias("s")).select("doc_id", F.col("s.category").alias("after"), F.col("s.reason").alias("reason"))
    was = manifest.select("doc_id", F.col("category").alias("before"), F.col("reason").alias("was"))
    return now.join(was, "doc_id", "left").where(~F.coalesce(F.col("was") == "pinned", F.lit(False)) & ~F.col("before").eqNullSafe(F.col("after"))).select("doc_id", "before", "after", "reason")
