"""Secret scans over an incremental blob ledger.  DataFrame functions only.

Method.  Every version of a file is addressed by the SHA-256 of its text.  The ledger, a Parquet table
in the shared folder that runs append to, holds for each blob the rule versions it was scanned with and
what they found.  A run scans each distinct blob once, with those rules whose version the ledger does
not hold for it, appends that, and joins the ledger's findings back to all paths (rows) that carry the
blob.  Copies are dropped before the shuffle as well as after it.  Only blobs with findings are joined
back, by an outer equi join without an aggregate above it, so that a blob with very many paths may be
split.  Redaction passes on the rows that a bitmap of fixed size shows to be without findings in a map.

Spans are in code points, the end exclusive.  A span's start is the length of all that the pattern's
split leaves before it plus the length of the earlier matches.

Defined cases.  A null text is the empty text, which has no findings; its redaction stays null.  Rows
are kept as they are: null ids, repeated rows and rows with equal text each get a result.  A ledger that
is not there yet holds nothing; findings of rule versions that are not asked for are left out.  An empty
table gives an empty result.  All columns of the versions are kept, whatever their names; where one is
named ``blob`` or ``spans`` already, the new one's name gets an underscore.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path, stored, table, unused, with_bit


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The kinds in their order, their patterns, and the least length of the group.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + MORE
# A text without this can hold no finding of the kind: what a scan may skip.
NEEDS = {"github": r"_", "pem": r"-----BEGIN "}
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once: a lambda's argument is not put in again wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(values: Column, size: int = 128) -> Column:
    """For each of an array of longs the sum of those before it.  Arrays grow by copying, so sums are taken over runs of
    ``size`` first, then within each run: n * size / 2 steps and not n * n / 2."""
    empty = F.array().cast("array<long>")

    def sums(x: Column, begin: Column) -> Column:
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(x, F.struct(begin.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def cut(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * size + 1, F.lit(size)))
        return once(runs, lambda r: F.flatten(F.zip_with(r, sums(F.transform(r, lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, n: s + n)), F.lit(0).cast("long")), sums)))

    return once(values, cut)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The findings of one rule in a text, in order."""
    hits, values, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), F.split(text, rule.pattern, -1)
    each = F.arrays_zip(F.transform(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(values, F.length).alias("value"))

    def located(x: Column) -> Column:
        """The matches long enough, each where the gaps and matches before it end."""
        before = sums_before(F.transform(x, lambda m: (m["gap"] + m["hit"]).cast("long")))
        begin = lambda m: m["m"]["gap"] + m["before"]
        span = lambda m: F.struct(begin(m).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin(m) + m["m"]["hit"]).alias("end"))
        return F.transform(F.filter(F.arrays_zip(x.alias("m"), before.alias("before")), lambda m: m["m"]["value"] >= rule.least), span)

    found = once(each, located).cast(SPAN)
    # the cheap test first: a match of at least the least length, wherever the pattern's own start lies
    quick = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}.get(rule.kind)
    test = text.rlike(quick) if quick else text.contains(NEEDS[rule.kind])
    return F.when(test, found).otherwise(F.array().cast(SPAN))


DONE = f"array<struct<rule:string,version:int,spans:{SPAN}>>"


def _blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger (blob, done) at a path; an empty one where none is yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"blob string, done {DONE}")
    return spark.read.schema(f"blob string, done {DONE}").parquet(path)


def scan(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a run adds to the ledger: (blob, done), a row for each distinct blob of versions(text) that lacks
    rules; done holds each of these with its spans."""
    blobs = versions.select(_blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    held = F.flatten(F.collect_list(F.transform("done", lambda x: F.concat_ws("@", x["rule"], x["version"]))))
    seen = ledger.where("blob is not null").groupBy("blob").agg(F.array_distinct(held).alias("seen"))
    blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.where(~F.forall(F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]), lambda x: F.array_contains("seen", x)))
    each = [F.when(~F.array_contains("seen", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r, k).alias("spans"))) for k, r in enumerate(rules)]
    return blobs.select("blob", F.filter(F.array(*each), lambda x: x.isNotNull()).cast(DONE).alias("done"))


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at the path lacks, appends it, and returns the ledger."""
    spark = versions.sparkSession
    scan(versions, ledger_at(spark, path), rules).write.mode("append").parquet(path)
    return ledger_at(spark, path)


def found(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of every blob with findings of these rule versions, in order."""
    now = [f"{r.kind}@{r.version}" for r in rules]
    spans = F.flatten(F.transform(F.filter("done", lambda x: F.concat_ws("@", x["rule"], x["version"]).isin(now)), lambda x: x["spans"]))
    some = ledger.select("blob", spans.alias("spans")).where(F.size("spans") > 0)
    # a blob that two runs scanned at once is there twice: of equal neighbours the first stays
    every = F.array_sort(F.flatten(F.collect_list("spans")))
    one = once(every, lambda x: F.filter(x, lambda s, i: (i == 0) | (s != F.get(x, i - 1))))
    return stored(some.groupBy("blob").agg(one.alias("spans")), "findings")


def findings(versions: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with blob and spans (all findings in order).  The ledger is at the path, or a new one."""
    blob, spans = unused("blob", versions), unused("spans", versions)
    got = found(update(versions, path or new_path(versions.sparkSession, "ledger"), rules), rules).withColumnsRenamed({"blob": blob, "spans": spans})
    return versions.withColumn(blob, _blob()).join(got, blob, "left").select(*versions.columns, blob, F.coalesce(spans, F.array().cast(SPAN)).alias(spans))


def redact(versions: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with every finding of the text replaced by ``[kind]``; the columns stay as they are.

    Spans are merged where they overlap, the first one's kind standing for the run."""
    cols = versions.columns
    got = found(update(versions, path or new_path(versions.sparkSession, "ledger"), rules), rules)
    blob, spans = unused("blob", versions), unused("spans", versions)
    maybe = unused("maybe", versions)
    told = with_bit(versions, F.xxhash64(_blob()), got.select(F.xxhash64("blob").alias("key")), 20, maybe)
    text = F.col("text")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(text.substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")))).alias("out"))
    )
    clean = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], text.substr(a["at"].cast("int") + 1, F.length(text))))
    held = told.where(maybe).withColumn(blob, _blob()).join(got.withColumnsRenamed({"blob": blob, "spans": spans}), blob, "left")
    return told.where(~F.col(maybe)).drop(maybe).unionByName(held.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*cols))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    got = update(documents.select("text"), new_path(spark, "ledger"))
    got = documents.select("doc_id", _blob().alias("blob")).join(found(got), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    n = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return got.select("doc_id", *n, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob")


_ORACLE_SPANS = """list_transform(list_filter(list_transform(range(1, len(h) + 1), lambda i: struct_pack(
  s := list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::bigint, n := length(h[i])::bigint, v := length(v[i]))), lambda x: x.v >= {least}), lambda x: struct_pack(s := x.s, r := {rank}, t := '{kind}:' || x.s || ':' || (x.s + x.n)))"""


def oracle() -> str:
    """DuckDB SQL of op1: the same split and lengths, without blobs."""
    quote = lambda p: p.replace("(?i)", "").replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        opt = ", 'i'" if "(?i)" in r.pattern else ""
        p = ("(?i)" if opt else "") + quote(r.pattern)
        spans = _ORACLE_SPANS.format(least=r.least, rank=k, kind=r.kind)
        parts.append(f"select i, {spans} as f{k} from (select i, regexp_extract_all(t, '{p}', 0) h, regexp_extract_all(t, '{p}', {r.group}) v, regexp_split_to_array(t, '{p}') g from d)")
    joins = " ".join(f"join ({p}) p{k} using (i)" for k, p in enumerate(parts))
    text = lambda which: f"array_to_string(list_transform(list_sort({which}), lambda x: x.t), ',')"
    base, every = (" || ".join(f"f{k}" for k in range(n)) for n in (len(BASE), len(RULES)))
    counts = ", ".join(f"len(f{k})::bigint n_{r.kind}" for k, r in enumerate(BASE))
    return f"with d as (select row_number() over () i, doc_id, coalesce(text, '') t from documents) select doc_id, {counts}, sha256({text(base)}) base_sha256, {text(every)} spans, sha256(t) blob from d {joins}"
