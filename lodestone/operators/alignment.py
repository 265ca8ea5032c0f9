"""Normalised texts with the place each character came from.

A text falls into units: runs of visible ASCII, which fold one to one; any other character by itself, which may fold to
several or to one; white space, which becomes one space; and a hyphen at a line's end with the white space after it,
which becomes nothing.  A text's units stay an array in its own row, so nothing is shuffled; the units' places are sums of
lengths in order, taken of a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

BREAK = r"-[ \t]*[\r\n]\s*"
UNIT = rf"(?Us)(?:{BREAK}|\s+|-|[\x21-\x2C\x2E-\x7E]+|.)"

TEXTS = 128  # whose places are worked out at once


def folded(unit: Column) -> Column:
    """What a unit turns into by itself; white space becomes a space, a hyphen at a line's end nothing."""
    plain = F.translate(unit, "".join(T.QUOTES), "".join(T.QUOTES.values()))
    for glyph, letters in T.LIGATURES.items():
        plain = F.replace(plain, F.lit(glyph), F.lit(letters))
    return F.when(unit.rlike(rf"(?U)^{BREAK}\z"), "").when(unit.rlike(r"(?U)^\s+\z"), " ").otherwise(T.casefold(plain))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets of the characters of (key, norm, lengths, sizes): sizes are what units of these lengths turn into, with a
    minus where a run counts sign by sign."""
    for key, norm, lengths, sizes in (b.slice(at, TEXTS).columns for b in batches for at in range(0, b.num_rows, TEXTS)):
        ends = np.asarray(lengths.value_lengths().fill_null(0), dtype=np.int64).cumsum()
        length, size = (np.asarray(x.flatten(), dtype=np.int64) for x in (lengths, sizes))
        sums, of = np.concatenate([[0], length.cumsum()]), np.concatenate([[0], ends])
        start = sums[:-1] - np.repeat(sums[of[:-1]], np.diff(of))  # of each unit in its text
        times = np.abs(size)
        made = np.concatenate([[0], times.cumsum()])
        within = np.arange(made[-1]) - np.repeat(made[:-1], times)
        offsets = np.repeat(start, times) + np.where(np.repeat(size < 0, times), within, 0)
        mask = np.concatenate([np.asarray(lengths.is_null()), [False]])
        lists = pa.ListArray.from_arrays(pa.array(made[of].astype(np.int32), mask=mask), pa.array(offsets.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([key, norm, lists], ["key", "norm", "offsets"])


def normalised_with_offsets(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, norm, offsets: what ``functions.text.match_normalise`` gives, and for each of its characters the offset it
    came from; a run of white space counts by its first sign, and every letter of a ligature by the ligature.
    White space that would begin or end the normalised text turns into nothing.  An empty or blank text has an empty norm,
    a null one a null norm."""
    kind = texts.schema[key].dataType.simpleString()
    u = texts.select(F.col(key).alias("key"), F.regexp_extract_all("text", F.lit(UNIT), 0).alias("units"))
    u = u.select("key", F.transform("units", lambda x: F.struct(F.length(x).alias("length"), folded(x).alias("piece"))).alias("u"))
    solid = F.transform("u", lambda x: (x["piece"] != "") & (x["piece"] != " "))
    first, last = F.array_position(solid, True), F.size("u") + 1 - F.array_position(F.reverse(solid), True)
    u = u.select("key", "u", first.alias("first"), last.alias("last"))
    inner = lambda x, n: F.when((x["piece"] == " ") & ((F.col("first") == 0) | (n + 1 < F.col("first")) | (n + 1 > F.col("last"))), "").otherwise(x["piece"])
    u = u.select("key", F.transform("u", lambda x, n: F.struct(x["length"].alias("length"), inner(x, n).alias("piece"))).alias("u"))
    run = lambda x: (F.length(x["piece"]) == x["length"]) & x["piece"].rlike(r"^[\x21-\x7E]+\z")
    sizes = F.transform("u", lambda x: F.when(run(x), -F.length(x["piece"])).otherwise(F.length(x["piece"])))
    u = u.select("key", F.array_join(F.transform("u", lambda x: x["piece"]), "").alias("norm"), F.transform("u", lambda x: x["length"]).alias("lengths"), sizes.alias("sizes"))
    return u.mapInArrow(placed, f"key {kind}, norm string, offsets array<int>").withColumnRenamed("key", key)


def composed(outer: Column, inner: Column) -> Column:
    """The map of a text that was changed twice: outer leads to places in the text between, inner from there to the first."""
    return F.transform(outer, lambda i: F.get(inner, i))


def found_span(norm: Column, offsets: Column, needle: Column) -> Column:
    """struct(start, end) of the needle's first place, in the text before it was normalised; null where it is not there
    or empty."""
    at = F.call_function("locate", needle, norm)
    span = F.struct(F.get(offsets, at - 1).cast("long").alias("start"), (F.get(offsets, at + F.length(needle) - 2) + 1).cast("long").alias("end"))
    return F.when((at > 0) & (needle != ""), span)
