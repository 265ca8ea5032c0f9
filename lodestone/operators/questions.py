"""Question sets: generated replies, checks against documents, fingerprints, categories and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

SEVERITY = ("found", "found_normalized", "not_found")


def generated(reply: Column, most_question: int = 300, most_answer: int = 500, least_gold: int = 6) -> Column:
    """struct(question, gold, answer, drop) of the first {…} of a reply; drop says why it is no question, else null."""
    body = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    said = lambda name: T.clean_text(F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant")) == "STRING", F.try_variant_get(body, f"$.{name}", "string")), F.lit("")))
    question, gold, answer = (said(n) for n in ("question", "gold_passage", "answer"))
    words = F.size(F.filter(F.split(T.squeeze(gold), " "), lambda w: w != ""))
    drop = (
        F.when(F.coalesce(F.schema_of_variant(body), F.lit("")).startswith("OBJECT") == F.lit(False), "not the JSON asked for").when((question == "") | (gold == ""), "no question or no gold passage")
        .when(F.length(question) > most_question, "question too long").when(F.length(answer) > most_answer, "answer too long").when(words < least_gold, "gold passage too short")
    )
    return F.struct(question.alias("question"), gold.alias("gold"), answer.alias("answer"), drop.alias("drop"))


def checked(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """candidates(set_id, n, doc_id, question, gold) with drop, not in the document or the same gold as an earlier kept
    one of the set, and tags (copied where most content words of the question are in its gold)."""
    d = documents.select("doc_id", F.col("text").alias("_text"))
    held = F.col("_text").contains(F.col("gold")) | T.match_normalise(F.col("_text")).contains(T.match_normalise(F.col("gold")))
    c = candidates.join(d, "doc_id", "left").withColumn("held", F.coalesce(held, F.lit(False))).drop("_text")
    same = F.row_number().over(Window.partitionBy("set_id", "held", T.match_normalise(F.col("gold"))).orderBy("n"))
    c = c.withColumn("drop", F.when(~F.col("held"), "not in the document").when(same > 1, "same gold passage"))
    copied = T.copied_share(T.normalise(F.col("question")), T.normalise(F.col("gold"))) > 0.6
    return c.withColumn("tags", F.when(F.col("drop").isNull() & copied, F.array(F.lit("copied"))).otherwise(F.array().cast("array<string>"))).drop("held")


def fingerprints(questions: DataFrame) -> DataFrame:
    """set_id, fingerprint: a hash of a set's questions and golds, whatever their order; questions(set_id, question, golds)."""
    entry = F.to_json(F.struct("question", F.sort_array("golds").alias("golds")))
    return questions.groupBy("set_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(entry))), 256).alias("fingerprint"))


def gold_status(text: Column, gold: Column) -> Column:
    """found, found_normalized or not_found."""
    return F.when(F.coalesce(text.contains(gold), F.lit(False)), "found").when(F.coalesce(T.match_normalise(text).contains(T.match_normalise(gold)), F.lit(False)), "found_normalized").otherwise("not_found")


def question_status(golds: DataFrame) -> DataFrame:
    """query, status: the worst of its golds(query, status)."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    return golds.groupBy("query").agg(F.max_by("status", rank).alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*[F.sum((F.col("status") == s).cast("int")).alias(s) for s in SEVERITY])


def stale(golds: DataFrame, documents: DataFrame, biggest: DataFrame) -> DataFrame:
    """query, stale, too_long of golds(query, doc_id, gold): is a gold gone from its document, or longer than the
    document's biggest(doc_id, chars) piece?"""
    met = golds.join(documents.select("doc_id", "text"), "doc_id", "left").join(biggest, "doc_id", "left")
    gone = gold_status(F.col("text"), F.col("gold")) == "not_found"
    return met.groupBy("query").agg(F.max(gone).alias("stale"), F.max(~gone & (F.length("gold") > F.col("chars"))).alias("too_long"))


def by_category(pairs: DataFrame) -> DataFrame:
    """category, compared, found_before, found_now, newly_missed, newly_found of pairs(id, category, before, now)."""
    names = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("id"))))
    return pairs.groupBy("category").agg(
        F.count("*").alias("compared"), F.sum(F.col("before").cast("int")).alias("found_before"), F.sum(F.col("now").cast("int")).alias("found_now"),
        names(F.col("before") & ~F.col("now")).alias("newly_missed"), names(F.col("now") & ~F.col("before")).alias("newly_found"),
    )


def gates(categories: DataFrame, allow: int, weak_below: int = 10) -> DataFrame:
    """Adds failed (found less than before by more than allow) and weak (a named category with few questions)."""
    return categories.select("category", "compared", (F.col("found_before") - F.col("found_now") > allow).alias("failed"), ((F.col("category") != "uncategorized") & (F.col("compared") < weak_below)).alias("weak"))


def judged_gate(before: Column, now: Column, most: float = 0.05) -> Column:
    """Has the mean judged correctness fallen by at most so much?  So it has where either run was not judged."""
    return F.coalesce(before - now <= most + 1e-9, F.lit(True))


def by_document(rows: DataFrame) -> DataFrame:
    """document (null: named none), place of its first question, total, found of rows(position, document, found)."""
    return rows.groupBy("document").agg(F.min("position").alias("first"), F.count("*").alias("total"), F.sum(F.col("found").cast("int")).alias("n_found"))


def run_totals(rows: DataFrame) -> DataFrame:
    """One row over rows(found, rank, golds_found, golds_total, error): total, scored, found, recall (null unless some
    question has more than one gold)."""
    ok = F.col("error").isNull()
    share = F.round(F.sum(F.when(ok, F.col("golds_found"))) / F.sum(F.when(ok, F.col("golds_total"))), 9)
    return rows.agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("scored"), F.sum((ok & F.col("found")).cast("int")).alias("n_found"), F.when(F.max("golds_total") > 1, share).alias("recall"))


def row_change(before_found: Column, now_found: Column, before_rank: Column, now_rank: Column) -> Column:
    """found, lost, up, down or none, from one run to another."""
    return F.when(now_found & ~before_found, "found").when(before_found & ~now_found, "lost").when(now_found & (now_rank < before_rank), "up").when(now_found & (now_rank > before_rank), "down").otherwise("none")


def merged_sets(kept: DataFrame, fresh: DataFrame, key: tuple[str, ...] = ("document",)) -> DataFrame:
    """kept question rows of the documents that fresh does not bring, then fresh."""
    return kept.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)
