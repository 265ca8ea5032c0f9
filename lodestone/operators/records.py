"""Index rows, question ownership, traces, feedback and conversation records."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWINS = pa.schema([("doc_id", pa.int64()), ("order", pa.int32()), ("duplicate_of", pa.int32())])


def descriptor(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """One row about an index: rows, dims, how many rows differ from the dims, and its first and last id."""
    dims = F.min(F.size(vector))
    return rows.agg(F.count("*").alias("n_rows"), dims.alias("dims"), F.max(F.size(vector)).alias("most_dims"), F.count_distinct("label").alias("labels"), F.min("piece").alias("first"), F.max("piece").alias("last"))


def to_embed(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(keyed texts, distinct texts that cache(key) lacks): each text is embedded once, whatever its copies."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("|", F.lit(model), "text"), 256))
    return keyed, keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def hashed_vectors(texts: DataFrame, dim: int = 64) -> DataFrame:
    """texts(id, text) with a vector: each word adds one at a signed place that its hash names; then length 1.
    A stand-in for a model, the same on every machine; a text without words has the zero vector."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    w = texts.select("*", F.posexplode_outer(hashes).alias("_p", "_h"))
    spot = w.groupBy("id", F.expr(f"cast(pmod(_h, {dim}) as int)").alias("at")).agg(F.sum(F.when(F.col("_h").bitwiseAND(1 << 40) == 0, 1.0).otherwise(-1.0)).alias("x"), F.count("_h").alias("n"))
    spots = spot.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("at", "x")))).alias("m"), F.sqrt(F.sum(F.when(F.col("n") > 0, F.col("x") * F.col("x")).otherwise(0.0))).alias("norm"))
    value = lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0)
    return spots.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))


def source_fields(labels: Column) -> Column:
    """A map of labels as source_<key> fields, keys in lower case with _ for other signs; roles are left out."""
    kept = F.map_filter(labels, lambda k, _: F.lower(k) != "roles")
    return F.transform_keys(kept, lambda k, _: F.concat(F.lit("source_"), F.regexp_replace(F.lower(k), "[^a-z0-9_]", "_")))


def owners(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """questions(query, document) with doc_id and error; document is a doc_id, a sha or a file name that one document has."""
    by = documents.groupBy("filename").agg(F.count("*").alias("n"), F.min("doc_id").alias("f_doc"))
    q = questions.join(documents.select(F.col("doc_id").alias("i_doc")), F.col("document") == F.col("i_doc").cast("string"), "left")
    q = q.join(documents.groupBy("sha").agg(F.min("doc_id").alias("s_doc")), F.col("document") == F.col("sha"), "left")
    q = q.join(by, F.col("document") == F.col("filename"), "left")
    found = F.coalesce("i_doc", "s_doc", F.when(F.col("n") == 1, F.col("f_doc")))
    error = F.when(F.col("document").isNull() | found.isNotNull(), None).when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return q.select("query", found.alias("doc_id"), error.alias("error"))


def best_variants(scores: DataFrame) -> DataFrame:
    """The variants, all ties, with the greatest hit rate and then mean reciprocal rank; none if nothing was found."""
    top = scores.agg(F.max(F.struct("hit_rate", "mrr")).alias("top"))
    return scores.crossJoin(F.broadcast(top)).where("hit_rate = top.hit_rate and mrr = top.mrr and hit_rate > 0").drop("top")


def with_feedback(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """Traces with their feedback values in time order, an empty array where there is none."""
    f = feedback.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("feedback"))
    return traces.join(f, "trace_id", "left").withColumn("feedback", F.coalesce("feedback", F.array().cast("array<string>")))


def owned_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Feedback by the user whose trace it is."""
    return feedback.join(traces.select("trace_id", "user_id"), ["trace_id", "user_id"], "left_semi")


def next_position(turns: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh(conv_id, n) with the positions that follow each conversation's last turn."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("n"))
    return fresh.join(last, "conv_id", "left").select("conv_id", "n", (F.coalesce("last", F.lit(-1)) + k).alias("position"))


def standalone_prompt(turns: DataFrame, last: int = 4) -> DataFrame:
    """conv_id, prompt: the last turns in order, one a line."""
    t = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return t.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("prompt"))


def charged(steps: DataFrame) -> DataFrame:
    """steps(report, position, artifact, status): each cached step with the first report whose run made its artifact."""
    made = steps.where("status = 'run'").groupBy("artifact").agg(F.min("report").alias("made_by"))
    return steps.where("status = 'cached'").select("report", "position", "artifact").join(made, "artifact", "left")


def prefixed(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """embed_text = reply, blank line, text; a document with a chunk whose reply is missing or empty has none at all."""
    c = chunks.join(replies, ["doc_id", "ordinal"], "left")
    ok = F.min((F.coalesce(F.trim("reply"), F.lit("")) != "").cast("int")).over(Window.partitionBy("doc_id")) == 1
    return c.withColumn("_ok", ok).where("_ok").withColumn("embed_text", F.concat(F.trim("reply"), F.lit("\n\n"), "text")).drop("_ok", "reply")


def retired(names: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """names(name, replaced_at, kept) that may be deleted: replaced more than days ago and not kept."""
    return names.where((F.col("replaced_at") < now - F.make_dt_interval(F.lit(days))) & ~F.coalesce("kept", F.lit(False))).select("name")


def twins(blocks: list[tuple[int, str]], similarity: float) -> Iterator[tuple[int, int]]:
    """(order, order of the first earlier kept block as similar) of blocks(order, text) in order.

    Lengths and counts of signs, by 64 classes, bound the ratio; difflib sees only the pairs that both leave."""
    bags = np.zeros((len(blocks), 64), np.int32)
    for k, (_, text) in enumerate(blocks):
        bags[k] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
    length = bags.sum(axis=1)
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    kept = np.zeros(len(blocks), np.int64)
    n = 0
    for k, (order, text) in enumerate(blocks):
        least = similarity * (length[kept[:n]] + length[k]) - 1e-6
        near = kept[:n][2 * np.minimum(length[kept[:n]], length[k]) >= least]
        if len(near):
            near = near[2 * np.minimum(bags[near], bags[k]).sum(axis=1) >= similarity * (length[near] + length[k]) - 1e-6]
        if len(near):
            matcher.set_seq2(text)
        for at in near:
            other = blocks[at][1]
            matcher.set_seq1(other)
            if other == text or (2 * min(len(text), len(other)) >= similarity * (len(text) + len(other)) and matcher.quick_ratio() >= similarity and matcher.ratio() >= similarity):
                yield order, blocks[at][0]
                break
        else:
            kept[n] = k
            n += 1


def near_blocks(elements: DataFrame, similarity: float = 0.95) -> DataFrame:
    """elements(doc_id, order, type, norm): order and duplicate_of of each block whose text is as similar to an
    earlier kept block of its document and type.  One document's blocks of a type are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, held in zip(batch.column("doc_id").to_pylist(), batch.column("held"), strict=True):
                out += [(doc, *twin) for twin in twins(sorted((b["order"], b["norm"]) for b in held.as_py()), similarity)]
            yield pa.RecordBatch.from_pydict({"doc_id": [x[0] for x in out], "order": [x[1] for x in out], "duplicate_of": [x[2] for x in out]}, schema=TWINS)

    e = elements.where("norm <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("order").cast("int").alias("order"), "type", "norm")
    held = e.groupBy("doc_id", "type").agg(F.collect_list(F.struct("order", "norm")).alias("held")).where(F.size("held") > 1)
    return held.select("doc_id", "held").mapInArrow(run, "doc_id long, order int, duplicate_of int")
