"""File listings, question sets and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import judge

# Content types by extension.
CONTENT_TYPES = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf"}

QUESTION = "struct<id: string, question: string, gold_answer: string, gold_answers: array<string>, tags: array<string>, document: string>"


def content_type(name: Column) -> Column:
    ext = F.regexp_extract(F.lower(name), r"\.(\w+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]), ext)


def source_version(tag: Column, modified: Column, size: Column) -> Column:
    """A store's own tag if it has one, else modification time and size."""
    return F.coalesce(F.nullif(tag, F.lit("")), F.concat_ws(":", modified.cast("string"), size.cast("string")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id (path below root), version, content_type and size of every file that is not hidden; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    name = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    e = f.select(name.alias("doc_id"), source_version(F.lit(None).cast("string"), F.unix_micros("modificationTime"), F.col("length")).alias("version"), F.col("length").alias("size"))
    return e.where(~F.col("doc_id").rlike(r"(^|/)\.")).withColumn("content_type", content_type(F.col("doc_id")))


def list_sources(spark: SparkSession, roots: list[str]) -> DataFrame:
    """list_files over folders and single files: a file's id is its name, a folder's files are named by their path below it.

    An id that two roots share is refused, as an index could not tell its documents apart."""
    out = None
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
        part = list_files(spark, root.rsplit("/", 1)[0]).where(F.col("doc_id") == root.rsplit("/", 1)[1]) if single else list_files(spark, root)
        part = part.withColumn("root", F.lit(root))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folder and no file is named")
    if twice := out.groupBy("doc_id").count().where("count > 1").orderBy("doc_id").head(1):
        raise ValueError(f"two sources have {twice[0].doc_id}")
    return out


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and text of the files of list_files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    return f.select(name.alias("doc_id"), F.col("content").cast("string").alias("text")).where(~F.col("doc_id").rlike(r"(^|/)\."))


def _questions(rows: DataFrame, document: Column, most_chars: int, most_golds: int) -> DataFrame:
    golds = F.array_distinct(F.filter(F.concat(F.coalesce("gold_answers", F.array().cast("array<string>")), F.array("gold_answer")), lambda g: F.trim(F.coalesce(g, F.lit(""))) != ""))
    q = rows.select("id", "question", golds.alias("golds"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce(F.nullif("document", F.lit("")), document).alias("document"))
    return q.withColumn("error", judge.question_error(F.col("question"), F.col("golds"), most_chars, most_golds))


def questions_json(spark: SparkSession, path: str, most_chars: int = 2000, most_golds: int = 20) -> DataFrame:
    """A question set: a JSON list, or an object with questions and perhaps a document that fills empty ones."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    body = F.when(listed, F.concat(F.lit('{"questions":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    s = raw.select(F.from_json(body, f"struct<questions: array<{QUESTION}>, document: string>").alias("s"))
    return _questions(s.select(F.col("s.document").alias("_set"), F.inline("s.questions")), F.col("_set"), most_chars, most_golds)


def questions_csv(spark: SparkSession, path: str, most_chars: int = 2000, most_golds: int = 20) -> DataFrame:
    """The same from CSV: golds are parted by ||, tags by commas."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for name in ("id", "question", "gold_answer", "gold_answers", "tags", "document"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(T.StringType()))
    tags = F.filter(F.transform(F.split("tags", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.select("id", "question", "gold_answer", judge.golds_of(F.col("gold_answers")).alias("gold_answers"), tags.alias("tags"), "document")
    return _questions(rows, F.lit(None).cast("string"), most_chars, most_golds)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a row."""
    report.write.mode("overwrite").json(path)


def write_index(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """A new index version, dealt by document, sorted inside each file so that a document's rows are skipped to."""
    rows.repartition(buckets, "doc_id").sortWithinPartitions("doc_id").write.mode("errorifexists").parquet(path)
