"""Model replies, question sets, regressions between runs, and where an answer was lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("parse", "clean", "chunk", "search", "rerank", "top_k")


def judge_reply(reply: Column, most: int = 300) -> Column:
    """struct(score, reason) of the first {…} of a reply; null unless score is a number in 0..1."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    raw = F.get_json_object(body, "$.score")
    bare = F.regexp_extract(body, r'"score"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1)
    score = F.when(bare != "", raw.try_cast("double"))
    return F.when(score.between(0, 1), F.struct(score.alias("score"), F.left(F.coalesce(F.get_json_object(body, "$.reason"), F.lit("")), F.lit(most)).alias("reason")))


def judge_numbers(score: Column, below: float) -> list[Column]:
    return [F.round(F.avg(score), 9).alias("mean_score"), F.count(score).alias("judged"), F.sum(score.isNull().cast("int")).alias("skipped"), F.sum((score < below).cast("int")).alias("n_below")]


def question_error(question: Column, golds: Column, most_chars: int, most_golds: int) -> Column:
    """Why a question row cannot be asked; null where it can."""
    real = F.filter(golds, lambda g: F.trim(g) != "")
    return (
        F.when(F.coalesce(F.trim(question), F.lit("")) == "", "no question").when(F.length(question) > most_chars, "question too long")
        .when(F.coalesce(F.size(real), F.lit(0)) < 1, "no gold answer").when(F.size(golds) > most_golds, "too many gold answers")
    )


def golds_of(field: Column) -> Column:
    """The gold answers of a CSV field: parts between ||, trimmed, blank ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(field, r"\|\|"), lambda x: F.trim(x)), lambda x: x != ""))


def accepted_rewrite(original: Column, rewrite: Column, most: int = 300) -> Column:
    """struct(text, reason): the rewrite if it is one line of at most ``most`` characters, else the original."""
    t = F.trim(F.coalesce(rewrite, F.lit("")))
    reason = F.when(t == "", "empty").when(F.length(t) > most, "too long").when(t.contains("\n"), "more than one line")
    return F.struct(F.when(reason.isNull(), t).otherwise(original).alias("text"), reason.alias("reason"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (id, question, found) of two runs, one to one: by id, then what is left by text, the n-th of
    a text with the n-th.  Rows without a partner are left out."""
    left = before.select(F.col("id").alias("before_id"), F.col("question").alias("bq"), F.col("found").alias("before_found"))
    right = after.select(F.col("id").alias("after_id"), F.col("question").alias("aq"), F.col("found").alias("after_found"))
    same = left.join(right, F.col("before_id") == F.col("after_id"))
    n = lambda d, q, i: d.withColumn("n", F.row_number().over(Window.partitionBy(q).orderBy(i)))
    rest_l = n(left.join(right, F.col("before_id") == F.col("after_id"), "left_anti"), "bq", "before_id")
    rest_r = n(right.join(left, F.col("before_id") == F.col("after_id"), "left_anti"), "aq", "after_id")
    rest = rest_l.join(rest_r, (F.col("bq") == F.col("aq")) & (rest_l["n"] == rest_r["n"]))
    columns = ("before_id", "after_id", "before_found", "after_found")
    return same.select(*columns, F.lit("id").alias("matched_by")).unionByName(rest.select(*columns, F.lit("text").alias("matched_by")))


def regression_counts(pairs: DataFrame, allow: int = 0, weak_below: int = 10) -> DataFrame:
    """Per category: compared, found before and now, newly lost and found, and whether the gate holds."""
    was, now = F.col("before_found"), F.col("after_found")
    g = pairs.groupBy("category").agg(
        F.count("*").alias("compared"), F.sum(was.cast("int")).alias("found_before"), F.sum(now.cast("int")).alias("found_now"),
        F.sum((was & ~now).cast("int")).alias("newly_lost"), F.sum((~was & now).cast("int")).alias("newly_found"),
    )
    return g.withColumn("gate_ok", F.col("newly_lost") <= allow).withColumn("weak", F.col("compared") < weak_below)


def lost_at(held: dict[str, Column]) -> Column:
    """The first step, in order, whose texts no longer hold the answer; null where all do."""
    out = F.lit(None).cast("string")
    for step in reversed(STEPS):
        if step in held:
            out = F.when(~F.coalesce(held[step], F.lit(False)), step).otherwise(out)
    return out


def unsourced_links(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers(answer_id, text) and sources(answer_id, text): each address in an answer that none of its
    sources holds.  Addresses are compared without scheme, outer punctuation and case of the host."""
    link = r"(?i)\b(?:https?|ftp|javascript|data)://[^\s<>\"')\]]+"

    def keys(d: DataFrame) -> DataFrame:
        u = d.select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(link), F.lit(0))).alias("url"))
        bare = F.regexp_replace(F.regexp_replace("url", r"^[^:]+://", ""), r"[.,;:!?/]+$", "")
        host = F.regexp_extract(bare, r"^[^/?#]*", 0)
        return u.withColumn("url_key", F.concat(F.lower(host), F.regexp_replace(bare, r"^[^/?#]*", "")))

    return keys(answers).join(keys(sources).select("answer_id", "url_key").distinct(), ["answer_id", "url_key"], "left_anti").select("answer_id", "url_key").distinct()


def new_facts(facts: DataFrame, stored: DataFrame, normal, most: int = 3, chars: int = 200) -> DataFrame:
    """facts(user_id, position, fact) that stored(user_id, fact) lacks by their normal form: the first
    ``most`` of a user, cut to chars."""
    f = facts.withColumn("norm", normal(F.col("fact"))).where("norm <> ''")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "norm").orderBy("position"))).where("n = 1")
    f = f.join(stored.select("user_id", normal(F.col("fact")).alias("norm")).distinct(), ["user_id", "norm"], "left_anti")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("position"))).where(F.col("n") <= most)
    return f.select("user_id", F.left("fact", F.lit(chars)).alias("fact"), F.col("n").cast("int").alias("n"))


def whole_or_null(x: Column) -> Column:
    """The sum, null if any row lacks it."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def cutters_disagree(cuts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """cuts(doc_id, chunker, cut) and paragraphs(doc_id, start, end): for each paragraph how many chunkers
    cut inside it, how many different cut sets they make, and the cuts in all."""
    c = cuts.withColumnRenamed("doc_id", "_doc")
    inside = paragraphs.join(c, (F.col("doc_id") == F.col("_doc")) & (F.col("cut") > F.col("start")) & (F.col("cut") < F.col("end")))
    per = inside.groupBy("doc_id", "start", "chunker").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    return per.groupBy("doc_id", "start").agg(F.count("*").alias("chunkers"), F.count_distinct("cuts").alias("sets"), F.sum(F.size("cuts")).alias("n_cuts"))


def without_user(table: DataFrame, gone: DataFrame, key: str = "user_id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
