"""Paragraphs from the boxes of a page's lines.

lines(doc_id, page, line, text, left, bottom, right, top) have y growing upwards.  A page with a line that lacks a
box is left as it is, line by line.  Ties of ``line`` are ordered by text; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

SIDES = ("left", "bottom", "right", "top")
# A word broken at a line's end, and what may go on with it.
BROKEN, GOES_ON = r"[\p{L}\p{Nl}\p{No}]-\z", r"^\p{IsLowercase}"


def boundary(pitch: Column, median: Column, ratio: float) -> Column:
    """Does a paragraph begin here?  A line at or above the one before stands in another column or region."""
    return pitch.isNull() | (pitch <= 0) | (pitch > ratio * F.coalesce(median, F.lit(0.0)))


def with_paragraphs(lines: DataFrame, ratio: float = 1.5) -> DataFrame:
    """lines with paragraph (from 0 on each page): a new one begins where the pitch to the line before exceeds ``ratio``
    times the median of the page's positive pitches, or is not positive."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("line", "text")
    whole = F.min(F.when(F.greatest(*[F.col(s).isNull().cast("int") for s in SIDES]) == 0, 1).otherwise(0)).over(page)
    e = lines.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"_pitch": F.lag("top").over(order) - F.col("top"), "_whole": whole})
    e = e.withColumn("_median", F.median(F.when(F.col("_pitch") > 0, F.col("_pitch"))).over(page))
    new = F.when(F.col("_whole") == 0, True).otherwise(boundary(F.col("_pitch"), F.col("_median"), ratio))
    number = F.sum(new.cast("int")).over(order) - 1
    return e.withColumn("paragraph", number.cast("int")).select(*lines.columns, "paragraph")


def paragraphs(lines: DataFrame, ratio: float = 1.5) -> DataFrame:
    """doc_id, page, paragraph, text, n_lines, left, bottom, right, top: lines joined by a space, or by nothing where a
    hyphen broke a word that goes on in lower case; the box is the union of the lines' boxes.

    Hyphens that a reader left as U+FFFE are resolved first.  A line's piece of the text needs its neighbours only,
    so a paragraph is joined once, however long."""
    e = with_paragraphs(lines.withColumn("text", T.soft_hyphens(F.coalesce("text", F.lit("")))), ratio)
    w = Window.partitionBy("doc_id", "page", "paragraph").orderBy("line", "text")
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    glued = lambda head, tail: F.coalesce(head.rlike(BROKEN) & tail.rlike(GOES_ON), F.lit(False))
    body = F.when(glued(F.col("text"), after), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    piece = F.concat(F.when(before.isNull() | glued(before, F.col("text")), "").otherwise(" "), body)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text", "_piece"))), lambda x: x["_piece"]), "")
    box = [F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top")]
    return e.withColumn("_piece", piece).groupBy("doc_id", "page", "paragraph").agg(text.alias("text"), F.count("*").alias("n_lines"), *box)
