"""Typed filters over index rows, compiled to Columns, and who may see which row.

A filter on a column that the rows lack, on a value of another kind than the column's, or with no
values matches nothing, as a null does; a filter never raises for its values."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


@dataclass(frozen=True)
class Eq:
    field: str
    value: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class AnyOf:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class And:
    filters: tuple[Eq | In | AnyOf | And, ...]


NO_FILTER = And(())


def kind_of(value: object) -> str | None:
    """bool, num or str; null for what cannot be compared, as NaN."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num" if math.isfinite(value) else None
    return "str" if isinstance(value, str) else None


def _kind(of: S.DataType) -> str | None:
    if isinstance(of, S.ArrayType):
        return "list" if isinstance(of.elementType, S.StringType) else None
    return "bool" if isinstance(of, S.BooleanType) else "num" if isinstance(of, S.NumericType) else "str" if isinstance(of, S.StringType) else None


def to_column(where: Eq | In | AnyOf | And, schema: S.StructType) -> Column:
    """The filter as a Column that is never null.  A bool is no number; 1 equals 1.0."""
    if isinstance(where, And):
        return reduce(lambda a, b: a & b, (to_column(f, schema) for f in where.filters), F.lit(True))
    kind = next((_kind(f.dataType) for f in schema.fields if f.name == where.field), None)
    values = (where.value,) if isinstance(where, Eq) else tuple(where.values)
    column = F.col("`" + where.field.replace("`", "``") + "`")
    if kind is None or not values:
        return F.lit(False)
    if kind == "list":
        usable = isinstance(where, AnyOf) and all(isinstance(v, str) for v in values)
        return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False)) if usable else F.lit(False)
    if isinstance(where, AnyOf) and kind != "str" or any(kind_of(v) != kind for v in values):
        return F.lit(False)
    return F.coalesce(column.isin(list(values)), F.lit(False))


def pages_between(first: Column, last: Column, low: int, high: int, max_page: Column) -> Column:
    """Whether a piece touches a page of low .. high that the index has; null pages never match."""
    return F.coalesce((first <= F.least(F.lit(high), max_page)) & (last >= low), F.lit(False))


def in_section(path: Column, section: str, sections: int) -> Column:
    """Exact membership in the heading path; refused where the index has no section at all."""
    if not sections:
        raise ValueError("the index has no sections")
    return F.coalesce(F.array_contains(path, section), F.lit(False))


def named_documents(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """query, shas (distinct, sorted), unknown (names of no document, sorted) of asked(query, names) over
    documents(doc_id string, sha); a name is a document's id, else its sha."""
    each = asked.select("query", F.explode_outer("names").alias("name")).distinct()
    by_id = documents.select(F.col("doc_id").alias("name"), F.col("sha").alias("own")).dropDuplicates(["name"])
    by_sha = documents.select(F.col("sha").alias("name"), F.col("sha").alias("held")).distinct()
    met = each.join(by_id, "name", "left").join(by_sha, "name", "left").withColumn("sha", F.coalesce("own", "held"))
    return met.groupBy("query").agg(F.sort_array(F.collect_set("sha")).alias("shas"), F.sort_array(F.collect_set(F.when(F.col("sha").isNull(), F.col("name")))).alias("unknown"))


def visible(roles: Column, caller: Column, admin: Column) -> Column:
    """Whether a caller with these roles sees a row: an admin sees all, no roles see nothing."""
    return F.coalesce(admin, F.lit(False)) | F.coalesce(F.arrays_overlap(roles, caller), F.lit(False))


def hits_for(hits: DataFrame, rows: DataFrame, callers: DataFrame) -> DataFrame:
    """hits(caller, piece, rank) that the caller may see, checked again against rows(piece, roles) and
    callers(caller, held, admin), the ranks without gaps."""
    from pyspark.sql import Window

    seen = hits.join(callers, "caller").join(rows.select("piece", "roles"), "piece").where(visible(F.col("roles"), F.col("held"), F.col("admin")))
    return seen.select("caller", "piece", F.row_number().over(Window.partitionBy("caller").orderBy("rank")).alias("rank"))
