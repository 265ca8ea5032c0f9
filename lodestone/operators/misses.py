"""Where each question's answer was lost: parsed text, cleaned text, pieces, search, reranking or the cut.

All steps' texts meet a question's golds once, in one join by question; a gold is held by its tier, exact, normalized
or reworded.  Questions without a gold, or whose golds are blank, have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A

# What to try where an answer is lost.
FIXES = {
    "broken": "Read the page by its layout: other text stands in the midst of the answer.", "scanned": "Read the page's image: the text has almost no words.", "parse": "Try another parser.", "clean": "Leave this cleaner out, or change what it drops.",
    "chunk": "Cut larger pieces, or let them overlap more.", "search": "Search by words too, or put the question otherwise.", "rerank": "Keep more pieces after reranking, or rerank otherwise.", "top_k": "Look at more pieces, or rerank them.",
}


def nth(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th …"""
    teen = (n % 100).between(10, 20)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def _counted(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " piece").otherwise(" pieces"))


def traced(golds: DataFrame, parsed: DataFrame, cleaned: list[tuple[str, DataFrame]], pieces: DataFrame, hits: DataFrame, reranked: DataFrame | None = None, k: int = 5) -> DataFrame:
    """query, lost_at (null: found), kind, piece, rank, finding, fix, steps of golds(query, place, gold).

    parsed and each named cleaned table have query and text; pieces query, ordinal and text; hits and reranked query, rank
    and text.  kind tells what is wrong at parse: broken, scanned or parse; piece counts from 1; rank is that of the
    last ranking that holds a gold.  steps are (stage, name, status, sentence) in order: pass, lost or not_checked, and
    nothing is checked past the loss."""
    g = golds.where(F.coalesce(F.trim("gold"), F.lit("")) != "").select("query", "place", T.gold_parts(F.trim("gold")).alias("gold"))
    head, tail = A.edges(F.col("one.normal"))
    g = g.groupBy("query").agg(F.collect_list("gold").alias("golds"), F.min_by("gold", "place").alias("one")).select("query", "golds", head.alias("head"), tail.alias("tail"))
    part = lambda df, step, at: df.select("query", F.lit(step).alias("step"), at.cast("long").alias("at"), "text")
    every = part(parsed, "parse", F.lit(0)).unionByName(part(pieces, "chunk", F.col("ordinal") + 1)).unionByName(part(hits, "search", F.col("rank")))
    for n, (_, df) in enumerate(cleaned):
        every = every.unionByName(part(df, f"clean{n}", F.lit(0)))
    if reranked is not None:
        every = every.unionByName(part(reranked, "rerank", F.col("rank")))
    names = ["parse", *[f"clean{n}" for n in range(len(cleaned))], "chunk", "search", *(["rerank"] if reranked is not None else [])]
    t, step, at = F.col("text"), F.col("step"), F.col("at")
    met = every.join(g, "query").withColumn("held", F.coalesce(F.exists("golds", lambda x: T.matches(x, t)), F.lit(False)))
    # what is wrong at parse is asked only of parsed texts that hold no gold
    unheld = (step == "parse") & ~F.col("held")
    torn = F.exists("golds", lambda x: A.closest_place(t, x["gold"]).isNotNull())
    q = g.select("query").join(
        met.groupBy("query").agg(
            *[F.min(F.when((step == s) & F.col("held"), at)).alias(f"at_{s}") for s in names],
            *[F.sum((step == s).cast("int")).alias(f"n_{s}") for s in ("chunk", "search", "rerank")],
            F.max(F.when(unheld, torn)).alias("broken"), F.min(F.when(unheld, A.scanned(t))).alias("scanned"),
            *[f(F.when((step == "chunk") & T.holds(t, F.col(edge)), at)).alias(name) for f, edge, name in ((F.min, "head", "cut_first"), (F.max, "tail", "cut_last"))],
        ), "query", "left",
    )
    q = q.withColumns({c: F.when(F.col("cut_last") > F.col("cut_first"), F.col(c)) for c in ("cut_first", "cut_last")})
    q = q.na.fill(0, [f"n_{s}" for s in ("chunk", "search", "rerank")])
    rank = F.col("at_rerank") if reranked is not None else F.col("at_search")
    ok = {s: F.col(f"at_{s}").isNotNull() for s in names} | {"top_k": F.coalesce(rank <= k, F.lit(False))}
    stage = lambda s: "clean" if s.startswith("clean") else s
    order = [*names, "top_k"]
    lost = F.coalesce(*[F.when(~ok[s], F.lit(s)) for s in order])
    kind = F.when(F.coalesce("broken", F.lit(False)), "broken").when(F.coalesce("scanned", F.lit(True)), "scanned").otherwise("parse")
    q = q.withColumns({"lost": lost, "kind": F.when(lost == "parse", kind), "piece": F.when(lost.isNull() | ~lost.startswith("clean") & ~lost.isin("parse", "chunk"), F.col("at_chunk")), "rank": F.when(lost.isNull() | (lost == "top_k"), rank)})
    label = F.concat(F.lit("piece "), F.col("piece").cast("string"))
    title = {"parse": "Parse", "chunk": "Chunk", "search": "Search", "rerank": "Rerank", "top_k": f"Top {k}"} | {f"clean{n}": name for n, (name, _) in enumerate(cleaned)}
    cutting = F.concat(F.lit("The answer is cut: it begins in piece "), F.col("cut_first").cast("string"), F.lit(" and ends in piece "), F.col("cut_last").cast("string"), F.lit("."))
    found = {
        "parse": (F.lit("The parsed text holds the answer."), F.when(F.col("kind") == "broken", "The answer's words stand in order, with other text between them.").when(F.col("kind") == "scanned", "There is almost no text.").otherwise("The answer is not in the parsed text.")),
        "chunk": (F.concat(F.lit("Piece "), F.col("at_chunk").cast("string"), F.lit(" of "), F.col("n_chunk").cast("string"), F.lit(" holds it whole.")), F.coalesce(cutting, F.lit("No piece holds the whole answer."))),
        "search": (F.concat(F.lit("It came back "), nth(F.col("at_search")), F.lit(" of "), F.col("n_search").cast("string"), F.lit(".")), F.concat(F.lit("The search gave "), _counted(F.col("n_search")), F.lit(", without "), F.concat(F.lit("piece "), F.col("at_chunk").cast("string")), F.lit("."))),
        "top_k": (F.concat(F.lit("It is "), nth(rank), F.lit(f", within the {k} looked at.")), F.concat(F.lit("It came "), nth(rank), F.lit(f", below the {k} looked at."))),
    }
    if reranked is not None:
        found["rerank"] = (F.concat(F.lit("It is "), nth(F.col("at_rerank")), F.lit(" of "), F.col("n_rerank").cast("string"), F.lit(" after reranking.")), F.concat(F.lit("Reranking kept "), _counted(F.col("n_rerank")), F.lit(", without it.")))
    for n, (name, _) in enumerate(cleaned):
        found[f"clean{n}"] = (F.lit(f"It is still there after {name}."), F.lit(f"{name} took it away."))
    at = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("lost")), F.lit(len(order) + 1))
    steps = []
    for n, s in enumerate(order, 1):
        passed, missed = found[s]
        status = F.when(at > n, "pass").when(at == n, "lost").otherwise("not_checked")
        sentence = F.when(at > n, passed).when(at == n, missed).otherwise("Not checked.")
        steps.append(F.struct(F.lit(stage(s)).alias("stage"), F.lit(title[s]).alias("name"), status.alias("status"), sentence.alias("sentence")))
    fix = F.coalesce(*[F.when((F.col("kind") == s) | (F.col("kind").isNull() & (F.regexp_replace("lost", r"\d+$", "") == s)), F.lit(text)) for s, text in FIXES.items()])
    q = q.withColumn("steps", F.array(*steps))
    lost_step = F.get("steps", (at - 1).cast("int"))
    finding = F.when(F.col("lost").isNull(), "Found: every step holds the answer.").otherwise(F.concat(F.lit("Lost at "), lost_step["name"], F.lit(". "), lost_step["sentence"]))
    return q.select("query", F.regexp_replace("lost", r"\d+$", "").alias("lost_at"), "kind", "piece", "rank", finding.alias("finding"), fix.alias("fix"), "steps")
