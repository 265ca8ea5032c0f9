"""Answers: their claims, labels, citations, and where a missed answer broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

RUN = r"\[\d+\.\d+\](?:[ \t]*\[\d+\.\d+\])*"
LABELS = ("cited", "weak", "similarity", "none", "not_found")


def claims(answers: DataFrame) -> DataFrame:
    """query, ordinal, text, ids, invalid of answers(query, text, known): the stretches that end in a run of
    markers ``[c.s]``, and what follows the last.  ids are the known markers in order, each once; invalid
    counts the others.  White space before a run goes where the run ends the text or a sign follows it."""
    parts, runs = F.split("text", RUN, -1), F.regexp_extract_all("text", F.lit(RUN), 0)
    a = answers.where("text is not null").select("query", F.coalesce("known", F.array().cast("array<string>")).alias("known"), parts.alias("parts"), runs.alias("runs"))
    a = a.select("query", "known", "parts", "runs", F.posexplode("parts").alias("ordinal", "part"))
    tight = F.coalesce(F.get("parts", F.col("ordinal") + 1), F.lit("")).rlike(r"^(?:\n?\z|[.,;:!?)\]])")
    run = F.get("runs", F.col("ordinal"))
    plain = lambda m: F.concat_ws(".", F.regexp_extract(m, r"\[0*(\d+)\.", 1), F.regexp_extract(m, r"\.0*(\d+)\]", 1))
    marks = F.coalesce(F.transform(F.regexp_extract_all(run, F.lit(r"\[\d+\.\d+\]"), 0), plain), F.array().cast("array<string>"))
    known = F.filter(marks, lambda m: F.array_contains("known", m))
    text = F.when(run.isNotNull() & tight, F.regexp_replace("part", r"(?U)\s+$", "")).otherwise(F.col("part"))
    got = a.select("query", "ordinal", text.alias("text"), F.array_distinct(known).alias("ids"), (F.size(marks) - F.size(known)).alias("invalid"), run.isNotNull().alias("ran"))
    return got.where("ran or text <> ''").drop("ran")


def labelled(segments: DataFrame) -> DataFrame:
    """Adds label to segments(query, ordinal, text, cites): cited, not_found, none for one that cites nothing, and null
    where a segment says nothing or leads in to a cited one without ending a sentence."""
    after = F.lead("cites").over(Window.partitionBy("query").orderBy("ordinal"))
    says = F.coalesce(F.col("text").rlike(r"(?U)[\p{L}\p{N}]"), F.lit(False))
    leads = ~F.col("cites") & F.coalesce(after, F.lit(False)) & ~F.regexp_replace("text", r"(?U)\s+$", "").rlike(r"[.!?]$")
    return segments.withColumn("label", F.when(~says | leads, None).when(F.col("cites"), "cited").when(T.says_not_found(F.col("text")), "not_found").otherwise("none"))


def label_counts(label: Column) -> list[Column]:
    """Aggregates: how many of each label, claims (all that say something but not_found) and citing (cited or weak)."""
    n = {k: F.sum(F.coalesce((label == k).cast("int"), F.lit(0))) for k in LABELS}
    return [*[c.alias(k) for k, c in n.items()], (n["cited"] + n["weak"] + n["similarity"] + n["none"]).alias("claims"), (n["cited"] + n["weak"]).alias("citing")]


def located(citations: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """citation, doc_start, doc_end, verified, element_id of citations(citation, doc_id, chunk_start, c_start, c_end,
    cited_text) in documents(doc_id, text) and elements(doc_id, id, start, end), which do not overlap.

    The element is the last to begin at or before the citation, found in one ordered pass over both."""
    c = citations.select("citation", "doc_id", (F.col("chunk_start") + F.col("c_start")).alias("doc_start"), (F.col("chunk_start") + F.col("c_end")).alias("doc_end"), "cited_text")
    mark = elements.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("id", F.col("end").alias("ends")).alias("element"), F.lit(None).cast(c.schema["citation"].dataType).alias("citation"))
    ask = c.select("doc_id", F.col("doc_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(mark.schema["element"].dataType).alias("element"), "citation")
    held = F.last("element", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at", "kind"))
    found = mark.unionByName(ask).withColumn("held", held).where("kind = 1").select("citation", F.when(F.col("held.ends") > F.col("at"), F.col("held.id")).alias("element_id"))
    verified = F.coalesce(F.col("text").substr(F.col("doc_start") + 1, F.col("doc_end") - F.col("doc_start")) == F.col("cited_text"), F.lit(False))
    # what is verified leaves the text behind, so no further shuffle holds it once for each citation
    got = c.join(documents.select("doc_id", "text"), "doc_id", "left").select("citation", "doc_start", "doc_end", verified.alias("verified"))
    return got.join(found, "citation").select("citation", "doc_start", "doc_end", "verified", "element_id")


def closest_place(text: Column, gold: Column, spread: int = 3) -> Column:
    """length, first and last of the closest place where the gold's words stand in order among those of text, within
    ``spread`` times its length; null where there is none."""
    key = lambda w: T.casefold(F.regexp_replace(w, r"(?U)^\W+|\W+$", ""))
    whole = F.transform(F.split(T.squeeze(F.regexp_replace(text, r"-\s*\n\s*", "")), " "), key)
    want = F.filter(F.transform(F.split(T.squeeze(gold), " "), key), lambda w: w != "")

    def closest(x: Column) -> Column:
        words, sought = x["words"], x["want"]
        limit = F.size(sought) * spread

        def last(start: Column) -> Column:
            def step(at: Column, w: Column) -> Column:
                room = F.slice(words, at + 2, F.greatest(start + limit - at - 1, F.lit(0)))
                return F.when(at < 0, at).otherwise(F.coalesce(at + F.nullif(F.array_position(room, w), F.lit(0).cast("long")), F.lit(-1).cast("long")).cast("int"))

            return F.aggregate(F.slice(sought, 2, F.greatest(F.size(sought) - 1, F.lit(0))), start, step)

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == F.get(sought, F.lit(0)))
        ends = F.filter(F.transform(places, lambda i: F.struct(i.alias("first"), last(i).alias("last"))), lambda e: e["last"] >= 0)
        return F.array_min(F.transform(ends, lambda e: F.struct((e["last"] - e["first"]).alias("length"), e["first"].alias("first"), e["last"].alias("last"))))

    # a text without one of the words has no place; upper-case sigma and hyphens at line ends are left to the words themselves
    maybe = F.exists(F.array(T.casefold(text)), lambda t: F.forall(want, lambda w: t.contains(w))) | text.contains("Σ") | text.rlike(r"-\s*\n")
    # one element, so that the words are made once for each row, wherever the optimiser puts what follows
    return F.when(maybe, F.get(F.transform(F.array(F.struct(whole.alias("words"), want.alias("want"))), closest), F.lit(0)))


def broken(rows: DataFrame, spread: int = 3) -> DataFrame:
    """rows(text, gold, …) with first and last: the words between which the gold's words stand in order within
    ``spread`` times its length, the closest such place; null where there is none.  Text and gold go, and
    columns that are named as the results."""
    keep = [c for c in rows.columns if c.lower() not in ("text", "gold", "first", "last")]
    best = closest_place(F.col("text"), F.col("gold"), spread)
    r = rows.select(*[F.col(f"`{c}`") for c in keep], best.alias("_lodestone_best"))
    return r.select(*[F.col(f"`{c}`") for c in keep], F.col("_lodestone_best.first").alias("first"), F.col("_lodestone_best.last").alias("last"))


def edges(normalised: Column, edge: int = 4) -> tuple[Column, Column]:
    """The first and the last words of a normalised gold."""
    words = F.split(normalised, " ")
    return F.array_join(F.slice(words, 1, edge), " "), F.array_join(F.slice(words, F.greatest(F.size(words) - edge + 1, F.lit(1)), F.lit(edge)), " ")


def cut_pieces(pieces: DataFrame, golds: DataFrame, edge: int = 4) -> DataFrame:
    """query, first, last: the first piece with the gold's first words and the last with its last, where the one comes
    after the other; pieces(query, ordinal, text) are those of the gold's document, golds(query, gold)."""
    head, tail = edges(T.match_normalise(F.col("gold")), edge)
    ends = golds.select("query", head.alias("head"), tail.alias("tail"))
    met = pieces.join(ends, "query").groupBy("query").agg(*[f(F.when(T.holds(F.col("text"), F.col(part)), F.col("ordinal"))).alias(name) for f, part, name in ((F.min, "head", "first"), (F.max, "tail", "last"))])
    return met.where("last > first")


def scanned(text: Column, least: int = 20) -> Column:
    """Whether a parsed text has almost no words."""
    return F.size(F.filter(F.split(T.squeeze(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")) < least


def cited_sources(answers: DataFrame, hits: DataFrame, most: int = 2000) -> DataFrame:
    """query, sources array of (id, text) of answers(query, source_ids) in citation order; the text is that of the
    best hit(query, rank, id, text) of that id, cut; ids of no hit are left out."""
    each = answers.select("query", F.posexplode("source_ids").alias("place", "id"))
    best = hits.groupBy("query", "id").agg(F.left(F.min_by("text", "rank"), F.lit(most)).alias("text"))
    met = each.join(best, ["query", "id"]).groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("sources"))
    return answers.select("query").join(met, "query", "left")


def projected(hits: DataFrame, k: int, most: int) -> DataFrame:
    """The search answer: each query's first k hits with a snippet; a prior rank or score stays, null if none."""
    return hits.where(F.col("rank") <= k).select("query", "rank", "piece", "score", F.left("text", F.lit(most)).alias("snippet"), "prior_rank", "prior_score")


def only_from(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """hits whose text is blanked where the piece is not of the question's own document; ranks stay."""
    return hits.join(owners.select("query", F.col("doc_id").alias("own")), "query", "left").withColumn("text", F.when(F.col("own").isNull() | (F.col("doc_id") == F.col("own")), F.col("text")).otherwise("")).drop("own")


def target_document(named: DataFrame, by_chunk: DataFrame, by_text: DataFrame, every: DataFrame) -> DataFrame:
    """query, doc_id, how: the document a trace looks at: named, else the first with a chunk that holds a gold, else
    the first whose text does, else the first of all; each of (query, doc_id)."""
    sides = ((named, "named"), (by_chunk, "chunk"), (by_text, "text"), (every, "first"))
    union = None
    for k, (df, how) in enumerate(sides):
        part = df.where("doc_id is not null").groupBy("query").agg(F.min("doc_id").alias("doc_id")).withColumns({"k": F.lit(k), "how": F.lit(how)})
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query").agg(F.min_by(F.struct("doc_id", "how"), "k").alias("x")).select("query", "x.doc_id", "x.how")


def tiers(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """query, found, rank, tier, golds_found, golds_total, found_below of hits(query, rank, text) and golds(query, gold).

    rank and tier are of the first of the k hits that holds a gold, exact before normalized before reworded;
    golds that differ in ``|`` or white space alone count once; found_below is the first rank past k that holds one."""
    g = golds.select("query", "gold", T.match_normalise(F.translate("gold", "|", "")).alias("variant"))
    met = g.join(hits, "query", "left").withColumn("tier", T.match_tier(F.col("gold"), F.col("text"))).withColumn("order", F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "normalized", 1).when(F.col("tier") == "reworded", 2))
    within = F.col("tier").isNotNull() & (F.col("rank") <= k)
    best = F.min(F.when(within, F.struct("rank", "order", "tier")))
    got = met.groupBy("query").agg(best.alias("b"), F.count_distinct(F.when(within, F.col("variant"))).alias("golds_found"), F.count_distinct("variant").alias("golds_total"), F.min(F.when(F.col("tier").isNotNull() & (F.col("rank") > k), F.col("rank"))).alias("found_below"))
    return got.select("query", F.col("b").isNotNull().alias("found"), "b.rank", "b.tier", "golds_found", "golds_total", F.when(F.col("b").isNull(), F.col("found_below")).alias("found_below"))
