"""Tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own = ""
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one temporary folder only where that is unset, as in tests."""
    global _own
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    _own = _own or f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends, or by ``discard``."""
    path = f"{shared_folder(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear)
    _written[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost
    executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.stored_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _clear() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session's JVM may be gone by now
            return


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or one made from it that no frame has as a column; Spark's names ignore case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_bit(df: DataFrame, key: Column, keys: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a boolean column: may the long key be one of keys(key)?  Yes for each that is, and for others whose
    bit of a bitmap of fixed size happens to be set.  Its 2**(bits - 6) words at most are broadcast."""
    word = keys.where("key is not null").selectExpr(f"pmod(key, {1 << bits}) as bit").groupBy(F.expr("shiftright(bit, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
    at, bit = unused("w", df), F.pmod(key, F.lit(1 << bits))
    held = unused("v", df)
    got = df.withColumn(at, F.shiftright(bit, 6)).join(F.broadcast(word.withColumnsRenamed({"w": at, "v": held})), at, "left")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    return got.select(*df.columns, F.coalesce(F.col(held).bitwiseAND(mask) != 0, F.lit(False)).alias(name))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star joins, each a grouped minimum that combines before the
    shuffle, until no edge changes.  The driver sees two numbers a round.  Null ends are ignored.
    """
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: each neighbour above the node, and the node, go to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each neighbour below the node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e, old = stored(small, "edges"), e
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components: no fixed point within {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
