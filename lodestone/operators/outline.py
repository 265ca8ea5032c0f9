"""Where a piece of a rendered document stands: headings above it, elements in it, its pages.

Elements are those of ``prepare.offsets``: doc_id, order, start, end, type, level, text, and page where known.
An element without width is in no piece, and a null level counts as 1.  Pieces are rows of doc_id, ordinal, start
and end; further columns of either table never meet an operator's own, which only reads those it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def live_path(last: Column, levels: int = LEVELS) -> Column:
    """The texts of an array of the last heading of each level (struct: at, text), without those that a heading of
    a smaller level has ended since, outermost first."""
    at = lambda k: F.get(last, F.lit(k - 1))
    live = []
    for k in range(1, levels + 1):
        ended = F.greatest(*[F.coalesce(at(j)["at"], F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        live.append(F.when(at(k)["at"] > ended, at(k)["text"]))
    return F.array_compact(F.array(*live))


def paths_at(places: DataFrame, elements: DataFrame, levels: int = LEVELS) -> DataFrame:
    """places(doc_id, key, at) with heading_path: the headings in force at an offset, one that begins there included.

    Places and headings of a document are merged by offset and read once in order, with the last heading of each level
    carried along: no place is held against the headings of its document.  A level beyond ``levels`` counts as the
    deepest.  Places at a null offset, and those of documents without headings, have an empty path."""
    depth = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(levels)).cast("int")
    heads = elements.where("type = 'heading' and end > start").select("doc_id", F.lit(None).cast(places.schema["key"].dataType).alias("key"), F.col("start").cast("long").alias("at"), F.lit(0).alias("place"), F.col("order").cast("long").alias("nth"), depth.alias("depth"), "text")
    spots = places.select("doc_id", "key", F.col("at").cast("long").alias("at"), F.lit(1).alias("place"), F.lit(0).cast("long").alias("nth"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("at", "place", "nth").rowsBetween(Window.unboundedPreceding, 0)
    merged = heads.unionByName(spots)
    # a heading is known by where it stands in the order, so that two at one offset are told apart
    merged = merged.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "place", "nth")))
    last = F.array(*[F.last(F.when(F.col("depth") == k, F.struct(F.col("n").alias("at"), "text")), ignorenulls=True).over(w) for k in range(1, levels + 1)])
    return merged.withColumn("last", last).where("place = 1").select("doc_id", "key", "at", live_path(F.col("last"), levels).alias("heading_path"))


def held_elements(pieces: DataFrame, elements: DataFrame, width: int = 1024) -> DataFrame:
    """doc_id, ordinal, held: the elements (order, id, type, start, page) that a piece meets, in order.

    Both sides are dealt to bins of ``width`` characters and a pair counts in the first bin they share, so a long
    document is never held against itself whole."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    page = F.col("page").cast("int") if "page" in elements.columns else F.lit(None).cast("int")
    e = elements.where("end > start").select("doc_id", F.struct("order", "id", "type", F.col("start").cast("long").alias("start"), page.alias("page")).alias("e"), F.col("start").alias("e_start"), F.col("end").alias("e_end")).withColumn("bin", bins("e_start", "e_end"))
    p = pieces.where("end > start").select("doc_id", "ordinal", "start", "end").withColumn("bin", bins("start", "end"))
    first = F.floor(F.greatest("e_start", "start") / width)
    met = p.join(e, ["doc_id", "bin"]).where((F.col("e_start") < F.col("end")) & (F.col("e_end") > F.col("start")) & (F.col("bin") == first))
    return met.groupBy("doc_id", "ordinal").agg(F.sort_array(F.collect_list("e")).alias("held"))


def outlined(pieces: DataFrame, elements: DataFrame, leading: bool = False) -> DataFrame:
    """doc_id, ordinal, heading_path, n_leading, source_element_ids, first_page, last_page of every piece.

    n_leading counts the headings that the piece opens with.  The path is that at the piece's start or, with
    ``leading``, at the last of those headings, as a piece that opens with a chapter and its section is about the section.
    A piece without elements has no ids and null pages; pages that are null do not count."""
    p = pieces.select("doc_id", "ordinal", "start", "end")
    body = F.array_position(F.transform("held", lambda x: x["type"] != "heading"), F.lit(True))
    n = F.when(F.col("held").isNull(), 0).when(body == 0, F.size("held")).otherwise(body - 1).cast("int")
    known = p.join(held_elements(p, elements), ["doc_id", "ordinal"], "left").withColumn("n_leading", n)
    at = F.when(F.lit(leading) & (F.col("n_leading") > 0), F.get("held", F.col("n_leading") - 1)["start"]).otherwise(F.col("start"))
    pages = F.transform("held", lambda x: x["page"])
    known = known.withColumns({"at": at, "ids": F.coalesce(F.transform("held", lambda x: x["id"]), F.array().cast("array<string>")), "first_page": F.array_min(pages), "last_page": F.array_max(pages)}).drop("held")
    paths = paths_at(known.select("doc_id", F.col("ordinal").alias("key"), "at"), elements).select("doc_id", F.col("key").alias("ordinal"), "heading_path")
    return known.join(paths, ["doc_id", "ordinal"]).select("doc_id", "ordinal", "heading_path", "n_leading", F.col("ids").alias("source_element_ids"), "first_page", "last_page")
