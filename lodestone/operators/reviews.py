"""Stored traces: what needs a look, reports, online scores, promotion to test cases, costs of several reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def needs_a_look(flags: Column, feedback: Column) -> Column:
    """Any flag, or a thumbs-down."""
    return (F.coalesce(F.size(flags), F.lit(0)) > 0) | F.coalesce(F.array_contains(feedback, "down"), F.lit(False))


def newest(traces: DataFrame, limit: int, since: Column | None = None, flagged: bool = False) -> DataFrame:
    """At most ``limit`` traces(trace_id, created_at, flags, feedback), newest first, ties by id."""
    t = traces if since is None else traces.where(F.col("created_at") >= since)
    t = t.where(needs_a_look(F.col("flags"), F.col("feedback"))) if flagged else t
    return t.orderBy(F.desc("created_at"), "trace_id").limit(limit)


def review_list(traces: DataFrame, limit: int) -> DataFrame:
    """place, trace_id, created_at, notes, question: the newest traces that need a look."""
    notes = F.concat("flags", F.when(F.array_contains("feedback", "down"), F.array(F.lit("thumbs down"))).otherwise(F.array().cast("array<string>")))
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "trace_id"))  # over at most limit rows
    return newest(traces, limit, flagged=True).select(place.alias("place"), "trace_id", "created_at", F.array_join(notes, ", ").alias("notes"), T.preview(T.clean_text(F.col("question"))).alias("question"))


def trace_report(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """measure, name, value: counts by label, flag and feedback, and means of numeric scores, of traces(trace_id, label,
    flags, feedback) and scores(trace_id, name, value)."""
    count = lambda df, measure: df.where("name is not null and name <> ''").groupBy("name").agg(F.count("*").cast("double").alias("value")).select(F.lit(measure).alias("measure"), "name", "value")
    by = [count(traces.select(F.col("label").alias("name")), "label"), count(traces.select(F.explode("flags").alias("name")), "flag"), count(traces.select(F.explode("feedback").alias("name")), "feedback")]
    mean = scores.groupBy("name").agg(F.round(F.avg("value"), 9).alias("value")).select(F.lit("score").alias("measure"), "name", "value")
    return by[0].unionByName(by[1]).unionByName(by[2]).unionByName(mean)


def history_before(traces: DataFrame, turns: DataFrame) -> DataFrame:
    """trace_id, history array of (question, answer) of the turns before the trace's own in its conversation; empty
    where the turn is no longer there.  traces(trace_id, conv_id), turns(conv_id, position, trace_id, question, answer)."""
    own = traces.join(turns.select("conv_id", "trace_id", F.col("position").alias("own")), ["conv_id", "trace_id"], "left").select("trace_id", "conv_id", "own")
    past = own.join(turns.select("conv_id", "position", "question", "answer"), "conv_id").where("position < own")
    got = past.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "question", "answer"))), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("history"))
    return traces.select("trace_id").join(got, "trace_id", "left").withColumn("history", F.coalesce("history", F.array().cast("array<struct<question:string,answer:string>>")))


def promoted(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """id, question, gold_answers, tags, has_history of the test cases that traces(trace_id, question, standalone, sources,
    history) add to cases(id): the standalone question unless earlier turns go with it; without sources there is no case."""
    fresh = traces.where(F.size("sources") > 0).join(cases.select(F.col("id").alias("trace_id")), "trace_id", "left_anti")
    follows = F.size("history") > 0
    question = F.when(follows, F.col("question")).otherwise(F.coalesce(F.nullif("standalone", F.lit("")), F.col("question")))
    return fresh.select(F.col("trace_id").alias("id"), question.alias("question"), F.col("sources").alias("gold_answers"), F.array(F.lit("promoted")).alias("tags"), follows.alias("has_history"))


def records(turns: DataFrame, steps: DataFrame, sources: DataFrame) -> DataFrame:
    """turns(trace_id, label counts as columns none, weak, similarity, cited, …) with label, stages, cost and sources.

    steps(trace_id, place, name, ms, dollars): several of a name are numbered; cost is null without any price."""
    again, many = Window.partitionBy("trace_id", "name").orderBy("place"), Window.partitionBy("trace_id", "name")
    s = steps.withColumn("n", F.row_number().over(again)).withColumn("of", F.count("*").over(many))
    s = s.withColumn("name", F.when(F.col("of") > 1, F.concat_ws(".", "name", "n")).otherwise(F.col("name")))
    each = F.transform(F.sort_array(F.collect_list(F.struct("place", "name", F.round("ms").cast("long").alias("ms")))), lambda x: F.concat(x["name"], F.lit(" "), x["ms"].cast("string")))
    stages = s.groupBy("trace_id").agg(each.alias("stages"), F.round(F.sum("dollars"), 9).alias("cost"))
    label = T.label_of({k: F.col(k) for k in ("none", "weak", "similarity", "cited")})
    return turns.withColumn("label", label).join(stages, "trace_id", "left").join(sources, "trace_id", "left")


@dataclass(frozen=True)
class Evaluator:
    """An online evaluator: a Column over a trace's own columns for each declared output.

    A null output is a failure; ``skip`` says which traces it has nothing to say about."""

    name: str
    version: str
    outputs: dict[str, Column]
    skip: Column | None = None

    def key(self, output: str) -> str:
        return f"{self.name}@{self.version}.{output}"


EVALUATORS: dict[str, Evaluator] = {}


def online_evaluator(evaluator: Evaluator) -> Evaluator:
    EVALUATORS[evaluator.name] = evaluator
    return evaluator


def evaluate_traces(traces: DataFrame, scored: DataFrame, evaluators: list[Evaluator], sample: float = 1.0, rerun: bool = False) -> DataFrame:
    """trace_id, key, value, status of the evaluators' outputs over traces(trace_id string, …): scored, failed (null or
    not finite) or skipped.  A trace that scored(trace_id, key) holds every output of is skipped unless rerun; a share of
    the traces is taken by the id and the evaluator's name, the same in every run."""
    out = None
    for e in evaluators:
        held = scored.where(F.col("key").isin([e.key(o) for o in e.outputs])).groupBy("trace_id").agg(F.count_distinct("key").alias("held_keys"))
        t = traces.where(T.sample_share(F.col("trace_id"), e.name) < sample) if sample < 1 else traces
        t = t.join(held, "trace_id", "left")
        done = F.lit(False) if rerun else F.coalesce(F.col("held_keys") == len(e.outputs), F.lit(False))
        values = {o: c.cast("double") for o, c in e.outputs.items()}
        bad = F.exists(F.array(*values.values()), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        status = F.when(done | F.coalesce(e.skip if e.skip is not None else F.lit(False), F.lit(False)), "skipped").when(bad, "failed").otherwise("scored")
        rows = F.explode(F.array(*[F.struct(F.lit(e.key(o)).alias("key"), c.alias("value")) for o, c in values.items()])).alias("row")
        got = t.withColumn("status", status).select("trace_id", "status", rows).select("trace_id", "row.key", F.when(F.col("status") == "scored", F.col("row.value")).alias("value"), "status")
        out = got if out is None else out.unionByName(got)
    return out


# Where each stage falls in a run.
STAGE_ORDER = {"source": 0, "parse": 1, "clean": 2, "chunk": 3, "enrich": 4, "embed": 5, "store": 5, "index": 5, "rewrite": 6, "search": 7, "rerank": 8, "answer": 9}


def place_of(stage: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_ORDER.items() for x in kv]), stage)


def between(steps: DataFrame, since: str | None = None, before: str | None = None) -> DataFrame:
    """The steps at ``since`` or after it and before ``before``, in the order of a run."""
    for s in (since, before):
        if s is not None and s not in STAGE_ORDER:
            raise ValueError(f"'{s}' is not a stage")
    if since is not None:
        steps = steps.where(place_of(F.col("stage")) >= STAGE_ORDER[since])
    return steps if before is None else steps.where(place_of(F.col("stage")) < STAGE_ORDER[before])


def cost(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Costs of priced steps(status, artifact, ms, model, input_tokens, output_tokens, price, dollars), one row for each
    ``by``: seconds, tokens and dollars of the steps that ran, null where none has any; models without a price and
    priced models without counts, sorted; steps run; cached steps, each artifact once and not where it also ran."""
    ran = F.col("status").isin("executed", "failed")
    cached = F.col("status") == "cached"
    own = F.max(F.when(ran, 1)).over(Window.partitionBy(*by, "artifact"))
    s = steps.withColumn("made_here", F.col("artifact").isNotNull() & own.isNotNull())
    used = ran & F.col("model").isNotNull()
    counted = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return s.groupBy(*by).agg(
        F.round(F.sum(F.when(ran, F.col("ms")).otherwise(0)) / 1000, 6).alias("seconds"), F.sum(F.when(ran, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(ran, F.col("output_tokens"))).alias("output_tokens"),
        F.round(F.sum(F.when(ran, F.col("dollars"))), 9).alias("dollars"), F.sort_array(F.collect_set(F.when(used & F.col("price").isNull(), F.col("model")))).alias("unpriced"),
        F.sort_array(F.collect_set(F.when(used & F.col("price").isNotNull() & ~counted, F.col("model")))).alias("uncounted"), F.sum(ran.cast("int")).alias("steps_run"),
        (F.count_distinct(F.when(cached & ~F.col("made_here"), F.col("artifact"))) + F.sum((cached & F.col("artifact").isNull()).cast("int"))).alias("steps_cached"),
    )


def total_cost(steps: DataFrame) -> DataFrame:
    """The cost of all reports together: a cached read of what another report ran is not counted."""
    return cost(steps)


def varied_costs(steps: DataFrame, since: str) -> DataFrame:
    """Each report's cost from a stage on, as if it had run alone: a cached step that another report made is charged as
    the first step, by report and place, that made it, once for each report."""
    s = between(steps, since)
    ran = F.col("status") == "executed"
    rest = [c for c in s.columns if c not in ("report", "place", "artifact", "stage")]
    made = s.where(ran & F.col("artifact").isNotNull()).groupBy("artifact").agg(F.min_by(F.struct(*rest), F.struct("report", "place")).alias("made"))
    w = Window.partitionBy("report", "artifact").orderBy("place")
    here = F.max(F.when(F.col("status").isin("executed", "failed"), 1)).over(Window.partitionBy("report", "artifact"))
    first = F.row_number().over(w.orderBy(F.col("status") != "cached", "place")) == 1
    s = s.join(made, "artifact", "left").withColumn("charged", (F.col("status") == "cached") & F.col("made").isNotNull() & here.isNull() & first)
    return cost(s.select("report", "place", "artifact", "stage", *[F.when(F.col("charged"), F.col(f"made.{c}")).otherwise(F.col(c)).alias(c) for c in rest]), ("report",))


def reasked(first: DataFrame, again: DataFrame) -> DataFrame:
    """first(query, found, rank) with a row replaced by that of again where the second ask found it, and asked_again."""
    a = again.select("query", F.col("found").alias("f2"), F.col("rank").alias("r2"), F.lit(True).alias("asked"))
    take = F.coalesce("f2", F.lit(False))
    return first.join(a, "query", "left").select("query", (F.col("found") | take).alias("found"), F.when(take, F.col("r2")).otherwise(F.col("rank")).alias("rank"), F.coalesce("asked", F.lit(False)).alias("asked_again"))


def run_notes(now: DataFrame, before: DataFrame) -> DataFrame:
    """partial, notes of two one-row frames(fingerprint, top_k, documents, shaky arrays)."""
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns])
    note = lambda test, text: F.when(test, text)
    sets, tops = F.col("fingerprint") != F.col("b_fingerprint"), ~F.col("top_k").eqNullSafe(F.col("b_top_k"))
    shaky = F.array_sort(F.array_union("shaky", "b_shaky"))
    notes = F.array(
        note(sets, F.lit("The question sets differ.")), note(tops, F.concat(F.lit("The baseline checked the top "), F.col("b_top_k").cast("string"), F.lit(" pieces and this run the top "), F.col("top_k").cast("string"), F.lit("."))),
        note((F.size("b_documents") > 0) & (F.col("b_documents") != F.col("documents")), F.lit("The documents differ.")), note(F.size(shaky) > 0, F.concat(F.array_join(shaky, ", "), F.lit(" can give a different result each run."))),
    )
    return now.crossJoin(F.broadcast(b)).select((sets | tops).alias("partial"), F.filter(notes, lambda x: x.isNotNull()).alias("notes"))  # one row each


def index_status(descriptor: DataFrame, recipe: str, revision: str, newest_format: int, collections: DataFrame) -> DataFrame:
    """ready, reason of the one-row descriptor(collection, recipe, revision, format) against what runs here."""
    d = descriptor.join(collections.select(F.col("name").alias("collection"), F.lit(True).alias("there")), "collection", "left")
    reason = (
        F.when(F.col("collection").isNull(), "Nothing is synced yet.").when(F.col("there").isNull(), F.concat(F.lit("The collection "), F.col("collection"), F.lit(" is not in the store.")))
        .when(F.col("format") > newest_format, "The collection's format is newer than this version reads.")
        .when(F.col("recipe") != recipe, F.concat(F.lit(f"The recipe here is {recipe[:4]}, but the collection was built from "), F.left("recipe", F.lit(4)), F.lit(".")))
        .when(~F.col("revision").eqNullSafe(F.lit(revision)), F.concat(F.lit(f"The embedding model is revision {revision} here, but the collection was built with "), F.col("revision"), F.lit(".")))
    )
    return d.select("collection", reason.isNull().alias("ready"), F.coalesce(reason, F.lit("")).alias("reason"))


def deleted(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(each table without the users' rows; (table, n): how many rows went)."""
    gone = users.select("user_id").distinct()
    kept = {name: t.join(gone, "user_id", "left_anti") for name, t in tables.items()}
    counts = None
    for name, t in tables.items():
        n = t.join(gone, "user_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def expired_cascade(turns: DataFrame, traces: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(turns of conversations that live, traces of these and no orphans): a conversation goes when its newest turn is
    older than the cutoff; turns(conv_id, ts, …), traces(trace_id, conv_id, …)."""
    live = turns.groupBy("conv_id").agg(F.max("ts").alias("newest")).where(F.col("newest") >= cutoff).select("conv_id")
    return turns.join(live, "conv_id", "left_semi"), traces.join(live, "conv_id", "left_semi")


Check = Callable[..., Column]
ROUTE_CHECKS: dict[str, Check] = {}


def route_check(f: Check) -> Check:
    """Registers a function that returns a boolean Column under its name, for use in routing rules."""
    ROUTE_CHECKS[f.__name__] = f
    return f


@route_check
def named_like(column: Column, pattern: str) -> Column:
    return T.glob(column, pattern)


@route_check
def has_words(column: Column, words: str) -> Column:
    return F.coalesce(F.lower(column).contains(words.lower()), F.lit(False))
