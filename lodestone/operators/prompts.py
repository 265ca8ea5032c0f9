"""What a chat asks a model: rewriting a follow-up so that it stands alone, and folding older turns into a summary.

Turns are (conv_id, turn, question, answer, rewrite); of equal turns the order is by question.  Null answers count as
empty, and a null or empty rewrite as none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def _line(standalone: bool) -> Column:
    asked = F.coalesce(F.nullif("rewrite", F.lit("")), F.col("question")) if standalone else F.col("question")
    return F.concat(F.lit("Q: "), F.coalesce(asked, F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")))


def _joined(turns: DataFrame, standalone: bool, name: str) -> DataFrame:
    rows = turns.select("conv_id", F.struct("turn", "question", _line(standalone).alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias(name))


def rewrite_prompts(asked: DataFrame, turns: DataFrame, memories: DataFrame, summaries: DataFrame, last: int = 4, most: int = 20) -> DataFrame:
    """conv_id, prompt, reason of asked(conv_id, user_id, question): the user's newest ``most`` memories(user_id, n, fact), then
    the summary so far and the last turns, each as it was searched with, then the question.

    Without turns and memories the question stands by itself: no prompt, and the reason is "no history".  Windows rank
    before rows are gathered, so a group holds ``last`` turns or ``most`` facts."""
    newest = lambda key, by: F.row_number().over(Window.partitionBy(key).orderBy(*by))
    facts = memories.withColumn("back", newest("user_id", [F.desc("n"), "fact"])).where(F.col("back") <= most)
    facts = facts.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("back"), "fact"))), lambda x: F.concat(F.lit("- "), x["fact"])), "\n").alias("facts"))
    recent = turns.withColumn("back", newest("conv_id", [F.desc("turn"), F.desc("question")])).where(F.col("back") <= last)
    q = asked.select("conv_id", "user_id", "question").join(facts, "user_id", "left").join(_joined(recent, True, "history"), "conv_id", "left").join(summaries.select("conv_id", "summary"), "conv_id", "left")
    known = F.concat(F.lit("<memories>\n"), "facts", F.lit("\n</memories>\n\n"))
    so_far = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Summary so far: "), "summary", F.lit("\n"))).otherwise("")
    past = F.concat(F.lit("<history>\n"), so_far, "history", F.lit("\n</history>\n\n"))
    alone = F.col("facts").isNull() & F.col("history").isNull()
    prompt = F.concat(F.coalesce(known, F.lit("")), F.coalesce(past, F.lit("")), F.lit("Latest question: "), F.coalesce("question", F.lit("")))
    return q.select("conv_id", F.when(~alone, prompt).alias("prompt"), F.when(alone, "no history").alias("reason"))


def fold_prompts(turns: DataFrame, summaries: DataFrame, last: int = 4) -> DataFrame:
    """conv_id, prompt, upto of the conversations with turns to fold: those between what summaries(conv_id, summary, upto)
    cover and the last ones; upto is how many turns the new summary will cover."""
    order = Window.partitionBy("conv_id").orderBy("turn", "question")
    t = turns.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("conv_id"))}).join(summaries.select("conv_id", "summary", "upto"), "conv_id", "left")
    t = t.where((F.col("k") > F.coalesce("upto", F.lit(0))) & (F.col("k") <= F.col("n") - last))
    ends = t.groupBy("conv_id").agg(F.max("k").cast("long").alias("upto"), F.first("summary").alias("summary"))
    old = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Earlier summary: "), "summary", F.lit("\n"))).otherwise("")
    return _joined(t, False, "lines").join(ends, "conv_id").select("conv_id", F.concat(old, F.lit("<turns>\n"), "lines", F.lit("\n</turns>")).alias("prompt"), "upto")


def folded(summaries: DataFrame, replies: DataFrame, most: int = 1500) -> DataFrame:
    """summaries after replies(conv_id, reply, upto): a reply, cut at a sentence end, takes the old summary's place; without a
    reply, or with a blank one, the old stays and the same turns are folded next time."""
    new = replies.where(F.coalesce(F.trim("reply"), F.lit("")) != "").select("conv_id", T.summary_cap(F.trim("reply"), most).alias("n_summary"), F.col("upto").alias("n_upto"))
    return summaries.join(new, "conv_id", "full_outer").select("conv_id", F.coalesce("n_summary", "summary").alias("summary"), F.coalesce("n_upto", "upto").alias("upto"))


def history_error(history: Column) -> Column:
    """Why a question's history, an array of (question, answer), cannot be used; null where it can, or there is none."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""
    bad = F.exists(history, lambda t: t.isNull() | blank(t["question"]) | blank(t["answer"]))
    return F.when(bad, "history is a list of pairs, each with a question and an answer")


def embedding_key(text: Column, model: str, revision: str, kind: str, dtype: str = "") -> Column:
    """The key a vector is kept under: a query's and a document's of one text differ, as do two revisions' and, where it is
    given, two number types'."""
    name = "|".join([model, revision, dtype] if dtype else [model, revision])
    return F.sha2(F.concat(F.lit(f"{name}|{kind}|"), text), 256)


def to_embed(texts: DataFrame, cache: DataFrame, model: str, revision: str, kind: str, dtype: str = "") -> tuple[DataFrame, DataFrame]:
    """(texts with key, what has to be computed: key and text, once each): texts whose key cache(key) lacks; null texts have
    no key."""
    keyed = texts.withColumn("key", embedding_key(F.col("text"), model, revision, kind, dtype))
    return keyed, keyed.where("key is not null").select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
