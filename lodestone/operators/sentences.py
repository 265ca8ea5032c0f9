"""Sentences and sentence windows of whole tables, from line to unit to sentence.

A text's lines are exploded; a window over each document tells units apart (a paragraph, a list item
with the lines it runs on to, a table row, a heading); units are split at stops by one regular
expression; a second window gives offsets.  Texts that are null or blank have no sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

LINE = r"[^\n\r\x0B\f\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]|$)"

# White space, as (?U)\s has it.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(df: DataFrame, piece: str, at: str) -> DataFrame:
    """Adds start and end of the piece without outer white space, from its offset; blank pieces go."""
    body = F.trim(F.col(piece), F.lit(SPACE))
    lead = F.length(piece) - F.length(F.ltrim(F.col(piece), F.lit(SPACE)))
    return df.withColumn("start", (F.col(at) + lead).cast("long")).withColumn("end", (F.col(at) + lead + F.length(body)).cast("long")).where(F.length(body) > 0)


def units(documents: DataFrame) -> DataFrame:
    """doc_id, unit, text, kind (item, row, heading or prose) in order; the units of a document are its whole text."""
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), 0)).alias("line", "text"))
    kind = F.when(F.col("text").rlike(r"(?U)^\s*$"), "blank").when(F.col("text").rlike(T.LIST_ITEM), "item").when(F.col("text").rlike(r"^[ \t]*\|"), "row").when(F.col("text").rlike(r"^[ \t]*#{1,6}\s"), "heading").otherwise("plain")
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    # a plain line goes on with an item; else it begins prose, or goes on with it
    last = F.last(F.when(F.col("kind") != "plain", F.col("kind")), ignorenulls=True).over(w)
    opens = F.col("kind").isin("item", "row", "heading") | ((F.col("kind") == "plain") & ~F.coalesce(last == "item", F.lit(False)) & F.coalesce(F.col("before") != "plain", F.lit(True)))
    lines = lines.withColumn("unit", F.sum(opens.cast("int")).over(w)).withColumn("opens", opens)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    grouped = lines.groupBy("doc_id", "unit").agg(joined.alias("text"), F.max(F.when(F.col("opens"), F.col("kind"))).alias("kind"))
    return grouped.select("doc_id", "unit", "text", F.when(F.col("kind") == "plain", "prose").otherwise(F.col("kind")).alias("kind"))


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, end, kind, text of every sentence of documents(doc_id, text)."""
    stopped = F.regexp_replace(F.translate("text", "\u0001", " "), T.STOP, "$0\u0001")
    parts = F.when(F.col("kind") == "prose", F.split(stopped, "\u0001")).otherwise(F.array("text"))
    pieces = units(documents).select("doc_id", "unit", "kind", F.posexplode(parts).alias("part", "piece"))
    before = Window.partitionBy("doc_id").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    found = trimmed(pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))), "piece", "at")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return found.select("doc_id", ordinal.cast("long").alias("ordinal"), "start", "end", "kind", F.trim(F.col("piece"), F.lit(SPACE)).alias("text"))


def sentence_windows(documents: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    """``windows`` of the documents' sentences."""
    return windows(sentences(documents), size, overlap)


def windows(found: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    """doc_id, ordinal, start, end of sentences that were found: runs of ``size`` of them, each beginning ``overlap`` before the end of the
    one before.  Headings count as part of the sentence after them, those at the end of the one before."""
    stride = max(1, size - overlap)
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    body = (F.col("kind") != "heading").cast("int")
    s = found.withColumn("n", F.sum(body).over(Window.partitionBy("doc_id")))
    s = s.withColumn("k", F.greatest(F.least(F.sum(body).over(w) - body, F.col("n") - 1), F.lit(0))).withColumn("n", F.greatest("n", F.lit(1)))
    first = F.greatest(F.ceil((F.col("k") - size + 1) / stride), F.lit(0)).cast("long")
    s = s.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("k") / stride).cast("long"))))
    s = s.where((F.col("window") == 0) | ((F.col("window") - 1) * stride + size < F.col("n")))
    return s.groupBy("doc_id", F.col("window").alias("ordinal")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def numbered(chunks: DataFrame) -> DataFrame:
    """query, sid, chunk, start, end, line of the sentences of chunks(query, chunk, text): chunk c's sentence s is
    ``c.s``, both from 1; the line is what a prompt shows, white space squeezed."""
    key = F.struct("query", "chunk")
    s = sentences(chunks.select(key.alias("doc_id"), "text"))
    sid = F.concat(F.col("doc_id.chunk").cast("string"), F.lit("."), (F.col("ordinal") + 1).cast("string"))
    return s.select("doc_id.query", sid.alias("sid"), "doc_id.chunk", "start", "end", F.concat(F.lit("["), sid, F.lit("] "), T.squeeze(F.col("text"))).alias("line"))


def prompt_blocks(chunks: DataFrame, fence: Column) -> DataFrame:
    """query, block: the numbered lines of each query's chunks, each chunk between fence lines that name it."""
    n = numbered(chunks).groupBy("query", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    name = F.concat(F.lit("Source "), F.col("chunk").cast("string"))
    block = F.concat(F.lit("<"), fence, F.lit(" "), name, F.lit(">\n"), F.col("lines"), F.lit("\n</"), fence, F.lit(">"))
    return n.withColumn("block", block).groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "block"))), lambda x: x["block"]), "\n\n").alias("block"))
