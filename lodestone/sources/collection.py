"""Collections of index rows in bucketed Parquet, with replacing and deleting by document.

A document's rows are in the bucket its id hashes to.  Each change writes the buckets it touches as a new generation of
files and then publishes a new state, one row a bucket with the folder that holds it; other buckets keep
their files.  Readers see the state before or after, never half of a change.

Rows have id, doc_id, doc_version, text, vector and roles, and may have further columns; null doc_ids share a bucket."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from lodestone.sources import published
from lodestone.sources.tables import stored

METRICS = ("cosine", "dot", "l2")
ROW = ("id", "doc_id", "doc_version", "text", "vector", "roles")


@dataclass(frozen=True)
class Meta:
    """What a collection was built with."""

    embed_model: str
    embed_revision: str
    dims: int
    metric: str
    recipe: str
    format_version: int = 1


class Refused(ValueError):
    """Rows that a collection cannot take."""


def collection_name(recipe: str, artifact: str) -> str:
    """A collection is named by the recipe and by the run that made it."""
    return f"{recipe[:16]}-{artifact[:12]}"


def check_columns(rows: DataFrame) -> None:
    """Refuses rows without a field or with a vector of another type; reads nothing."""
    if lacking := [c for c in ROW if c not in rows.columns]:
        raise Refused(f"rows lack {', '.join(lacking)}")
    kind = rows.schema["vector"].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, FloatType | DoubleType):
        raise Refused(f"a vector is an array of float or double, not {kind.simpleString()}")


def check_rows(rows: DataFrame, dims: int) -> None:
    """Refuses rows without a field, with a vector of another type or length, or with a number that is not finite; one pass."""
    check_columns(rows)
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = rows.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for n, c in (("absent", v.isNull()), ("dims", F.size(v) != dims), ("odd", odd), ("ids", F.col("id").isNull()))]).first()
    for name, said in (("ids", "no id"), ("absent", "no vector"), ("dims", f"a vector that has not {dims} numbers"), ("odd", "a number that is not finite")):
        if bad[name]:
            raise Refused(f"{bad[name]} rows have {said}")


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 64, spread: int = 4):
        """root/name; ``buckets`` is fixed when the collection is made, ``spread`` the most files of a bucket in a generation."""
        self.spark, self.path, self.spread = spark, f"{root}/{name}", spread
        state = published.current(spark, f"{self.path}/state")
        self.buckets = state.count() if state is not None else buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")

    def state(self) -> DataFrame:
        """bucket, folder (null: empty), schema and Meta's fields."""
        state = published.current(self.spark, f"{self.path}/state")
        if state is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return state

    def meta(self) -> Meta:
        row = self.state().first()
        return Meta(**{k: row[k] for k in Meta.__dataclass_fields__})

    def _write(self, rows: DataFrame, touched: list[int], folders: dict[int, str | None], meta: Meta, checked: bool = False) -> str:
        """Writes a generation and publishes it; where ``checked``, it is read once more before, and goes if it is refused."""
        generation = f"{self.path}/rows/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(self.spread)))
        dealt.sortWithinPartitions("_bucket", "doc_id", "id").write.partitionBy("_bucket").parquet(generation)
        if checked:
            try:
                check_rows(self.spark.read.schema(rows.schema).parquet(generation), meta.dims)
            except Refused:
                published.delete(self.spark, generation)
                raise
        for b in touched:
            folder = f"{generation}/_bucket={b}"
            folders[b] = folder if published.exists(self.spark, folder) else None
        schema = rows.schema.json()
        state = self.spark.createDataFrame([(b, folders.get(b), schema, *asdict(meta).values()) for b in range(self.buckets)], "bucket int, folder string, schema string, embed_model string, embed_revision string, dims int, metric string, recipe string, format_version int")
        return published.publish(state.coalesce(1), f"{self.path}/state")

    def write_all(self, rows: DataFrame, meta: Meta) -> str:
        """Makes these rows all that the collection holds."""
        if meta.metric not in METRICS:
            raise Refused(f"the metric is one of {', '.join(METRICS)}")
        check_columns(rows)
        # what was written is checked, so that the rows are made once
        return self._write(rows, list(range(self.buckets)), {}, meta, checked=True)

    def change(self, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> str:
        """Replaces the rows of every document of ``fresh`` and drops those of gone(doc_id); only their buckets are read and written."""
        rows, meta = self.read(), self.meta()
        fresh = rows.where("false") if fresh is None else fresh
        check_columns(fresh)
        fresh = stored(fresh.select(*rows.columns), "fresh-rows")
        check_rows(fresh, meta.dims)
        names = fresh.select("doc_id") if gone is None else fresh.select("doc_id").unionByName(gone.select("doc_id"))
        names = stored(names.distinct(), "changed-documents")
        touched = sorted(r[0] for r in names.select(self._bucket()).distinct().collect())  # at most the number of buckets
        folders = {r.bucket: r.folder for r in self.state().collect()}
        old = self._rows([folders[b] for b in touched if folders[b]], rows.schema)
        kept = old.join(names.withColumnRenamed("doc_id", "_name"), old["doc_id"].eqNullSafe(F.col("_name")), "left_anti")
        return self._write(kept.unionByName(fresh), touched, folders, meta)

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self.state().collect()
        return self._rows([r.folder for r in state if r.folder], StructType.fromJson(json.loads(state[0].schema)))

    def documents(self) -> DataFrame:
        """doc_id, doc_version."""
        return self.read().groupBy("doc_id").agg(F.min("doc_version").alias("doc_version"))

    def retire(self, keep: int = 2) -> int:
        """Deletes states but the last ``keep``, and generations that none of these refers to; returns how many went."""
        published.retire(self.spark, f"{self.path}/state", keep)
        held = {r.folder.rsplit("/", 2)[1] for path in published.versions(self.spark, f"{self.path}/state") for r in self.spark.read.parquet(path).where("folder is not null").collect()}
        fs, at = published._folder(self.spark, f"{self.path}/rows")
        gone = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in held]
        for name in gone:
            published.delete(self.spark, f"{self.path}/rows/{name}")
        return len(gone)


def described(rows: DataFrame, meta: Meta) -> DataFrame:
    """One row about an index: its rows, documents, dims and metric, how many rows stand under a heading (section), and the
    last page that any touches; rows may have section array<string> and pages array<string>."""
    n = lambda c, e: (F.coalesce(F.sum(e.cast("int")), F.lit(0)) if c in rows.columns else F.lit(0)).cast("long")
    page = F.max(F.array_max(F.transform("pages", lambda p: p.cast("int")))) if "pages" in rows.columns else F.lit(None).cast("int")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("documents"), n("section", F.size("section") > 0).alias("sections"), F.coalesce(page, F.lit(0)).alias("max_page"), F.lit(meta.dims).alias("dims"), F.lit(meta.metric).alias("metric"),
        F.concat_ws("@", F.lit(meta.embed_model), F.lit(meta.embed_revision)).alias("model"),
    )


def versioned(rows: DataFrame) -> DataFrame:
    """rows(id, doc_id, ordinal, …) with doc_version: a short hash of the document's row ids in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]), "\n")
    version = rows.groupBy("doc_id").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("doc_version"))
    return rows.drop("doc_version").join(version, "doc_id")
