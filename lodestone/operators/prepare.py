"""Documents to elements, cleaned elements and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.tables import stored

# Element types that are left out of the text.
EXCLUDED = ("header", "footer", "page_number")


def line_elements(documents: DataFrame) -> DataFrame:
    """doc_id, order, id, type, text: one element for each line that is not blank."""
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != "")
    return documents.select("doc_id", F.posexplode(lines).alias("order", "text")).select("doc_id", "order", F.format_string("e%05d", "order").alias("id"), F.lit("paragraph").alias("type"), "text")


def rendered(kind: Column, text: Column, level: Column) -> Column:
    """An element as Markdown; empty where it is left out of the text."""
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text)
    return F.when(kind.isin(*EXCLUDED), "").when(kind == "heading", heading).when(kind == "list_item", F.concat(F.lit("- "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)


def offsets(elements: DataFrame, body: str = "body") -> DataFrame:
    """Adds start and end of each element's body in the document's text; bodies are parted by a blank line."""
    before = Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(body) + F.when(F.length(body) > 0, 2).otherwise(0)).over(before), F.lit(0))
    return elements.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length(body)).cast("long"))


def drop_matching(elements: DataFrame, pattern: str, regex: bool = False, case: bool = False) -> DataFrame:
    """Without the blocks that hold the pattern; an empty pattern drops none, and a null text holds none."""
    if not pattern:
        return elements
    if regex:
        held = F.col("text").rlike(pattern if case else f"(?i){pattern}")
    else:
        held = F.col("text").contains(pattern) if case else F.lower("text").contains(pattern.lower())
    return elements.where(~F.coalesce(held, F.lit(False)))


def dedupe_blocks(elements: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds duplicate_of: the first earlier block of the scope with the same type and normalised text; null in those kept.

    The first block of each text is an aggregate joined back, so a text that very many documents share is split like
    any skewed key.  Null and blank texts and excluded types are never duplicates; other columns stay as they are."""
    norm, first = "_lodestone_norm", "_lodestone_first"
    keys = [*dict.fromkeys((*scope, "type"))]
    e = elements.withColumn(norm, T.normalise(F.col("text")))
    counts = F.coalesce((F.col(norm) != "") & ~F.col("type").isin(*EXCLUDED), F.lit(False))
    best = e.where(counts).groupBy(*keys, norm).agg(F.min(F.struct("doc_id", "order", "id")).alias(first))
    met = e.join(best, [*keys, norm], "left")
    later = F.struct("doc_id", "order", "id") > F.col(first)
    return met.withColumn("duplicate_of", F.when(counts & later, F.col(f"{first}.id"))).select(*elements.columns, "duplicate_of")


def running_lines(lines: DataFrame, min_pages: int = 3, ratio: float = 0.5, most: int = 120) -> DataFrame:
    """One round over lines(doc, page, order, text): doc, position, norm, pages of the first and last
    lines that repeat on enough pages or look like page numbers."""
    up, down = Window.partitionBy("doc", "page").orderBy("order"), Window.partitionBy("doc", "page").orderBy(F.desc("order"))
    e = lines.withColumn("norm", T.normalise(F.col("text"))).withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    edges = e.where("up = 1 or down = 1").withColumn("position", F.when(F.col("up") == 1, "first").otherwise("last"))
    number = F.col("norm").rlike(T.PAGE_NUMBER)
    shape = F.when(number, "<number>").otherwise(F.col("norm"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("all_pages"))
    found = edges.where((F.length("norm") <= most) & (F.col("norm") != "")).groupBy("doc", "position", shape.alias("shape")).agg(F.count_distinct("page").alias("pages"))
    need = F.greatest(F.lit(float(min_pages)), F.col("all_pages") * ratio - 1e-9)
    return found.join(pages, "doc").where((F.col("all_pages") > 1) & (F.col("pages") >= need)).select("doc", "position", "shape", "pages")


TOKEN = r"(?:\s*+(?:\w++|[^\w\s]))"


def token_chunks(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, ordinal, start, end, tokens, text: windows of tokens; the last reaches the end.

    One regular expression cuts a text into runs of as many tokens as windows lie apart, each with the white space
    before it; a window is a run and the first tokens of what follows, so no token is looked at alone.  Null texts
    and texts without tokens have no windows."""
    stride = max(1, size - overlap)
    more = -(-(size - stride) // stride)
    runs = F.regexp_extract_all("text", F.lit(rf"(?U){TOKEN}{{1,{stride}}}"), 0)
    d = documents.where("text is not null").select("doc_id", runs.alias("runs")).where(F.size("runs") > 0)
    d = d.select("doc_id", "runs", F.transform("runs", F.length).alias("lengths"), ((F.size("runs") - 1) * stride + F.regexp_count(F.element_at("runs", -1), F.lit(rf"(?U){TOKEN}"))).alias("n"))
    follow = lambda i: F.regexp_extract(F.array_join(F.slice("runs", i + 2, more), ""), rf"(?U)^{TOKEN}{{1,{size - stride}}}", 0) if more else F.lit("")
    at = lambda i: F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)
    windows = F.transform("runs", lambda r, i: F.when((i == 0) | ((i - 1) * stride + size < F.col("n")), F.struct(i.cast("long").alias("ordinal"), at(i).alias("at"), F.concat(r, follow(i)).alias("piece"), F.least(F.lit(size), F.col("n") - i * stride).cast("long").alias("tokens"))))
    w = d.select("doc_id", F.explode(F.array_compact(windows)).alias("w")).select("doc_id", "w.*")
    text = F.regexp_replace("piece", r"(?U)^\s+", "")
    start = F.col("at") + F.length("piece") - F.length(text)
    return w.select("doc_id", "ordinal", start.cast("long").alias("start"), (F.col("at") + F.length("piece")).cast("long").alias("end"), "tokens", text.alias("text"))


def chunk_id(doc: Column, chunker: str, ordinal: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", doc.cast("string"), F.lit(chunker), ordinal.cast("string"), start.cast("string"), end.cast("string")), 256), 1, 16)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: pieces, tokens, median, nearest-rank p95 and largest token count."""
    n = F.col("tokens")
    counts = chunks.groupBy(n).agg(F.count(n).alias("c"))  # a row for each token count
    total = counts.agg(F.sum("c").alias("pieces"), F.sum(n * F.col("c")).alias("tokens"), F.max(n).alias("largest"))
    # the pieces of at most each token count; the value at a rank is the least token count that reaches it
    upto = F.sum("c").over(Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ran = counts.where(n.isNotNull()).select(n.alias("value"), upto.alias("upto")).crossJoin(F.broadcast(total))
    pieces = F.col("pieces")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    middle = (at(F.floor((pieces + 1) / 2)) + at(F.floor((pieces + 2) / 2))) / 2
    ranks = ran.agg(middle.alias("median_tokens"), at(F.greatest(F.ceil(pieces * 0.95), F.lit(1))).alias("p95_tokens"))
    return total.crossJoin(F.broadcast(ranks)).select(F.coalesce("pieces", F.lit(0).cast("long")).alias("pieces"), "tokens", "median_tokens", "p95_tokens", "largest")


def coverage(chunks: DataFrame) -> DataFrame:
    """doc_id, covered: characters that some piece covers."""
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(w), F.lit(0))
    return chunks.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach))).groupBy("doc_id").agg(F.sum("fresh").cast("long").alias("covered"))


def repeats(chunks: DataFrame) -> DataFrame:
    """Adds repeated: characters of each piece that the one before holds too."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return chunks.withColumn("repeated", F.greatest(F.lit(0), F.least(F.coalesce(before, F.lit(0)), F.col("end")) - F.col("start")).cast("long"))


def overlapping(chunks: DataFrame) -> DataFrame:
    """Adds overlaps: how many later pieces of its document begin before a piece ends.

    Pieces in order begin in order, so those that a piece meets follow it directly: the k-th one after it is looked at as
    long as any piece meets its k-th, which for windows is as often as they overlap."""
    c = stored(chunks, "pieces")
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    n, k = F.lit(0).cast("long"), 1
    while True:
        met = F.coalesce(F.lead("start", k).over(w) < F.col("end"), F.lit(False))
        if not c.select(met.alias("met")).where("met").head(1):
            return c.withColumn("overlaps", n)
        n, k = n + met.cast("long"), k + 1


def paragraph_parts(elements: DataFrame, count: int) -> DataFrame:
    """Adds part: the run of whole paragraphs, of ``count`` runs, that an element falls in."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1
    return elements.withColumn("part", F.floor(((k + 1) * count - 1) / n).cast("long"))


def postings(pieces: DataFrame, key: str = "piece", text: str = "text") -> DataFrame:
    """term, key, tf over lower-cased runs of letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W\d_]+"), 0)
    return pieces.select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def running_kinds(lines: DataFrame, min_pages: int = 3, ratio: float = 0.5, most: int = 120) -> DataFrame:
    """lines(doc, page, order, text) with kind: page_number, header or footer for running lines, else null.

    Each round looks at the first and last lines of each page that are left, until none is found; every round
    is a written table.  A line that is both first and last of its page counts as first.  Null and blank
    lines are never running lines, and hide none."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("all_pages"))
    rows = lines.select("doc", "page", "order").where("false").withColumn("kind", F.lit(""))
    shape = lambda norm: F.when(norm.rlike(T.PAGE_NUMBER), "<number>").otherwise(norm)
    live = stored(lines.withColumn("norm", T.normalise(F.col("text"))).where("norm <> ''").select("doc", "page", "order", "norm"), "lines")
    while True:
        up, down = Window.partitionBy("doc", "page").orderBy("order"), Window.partitionBy("doc", "page").orderBy(F.desc("order"))
        edges = live.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).where("up = 1 or down = 1")
        places = F.array_compact(F.array(F.when(F.col("up") == 1, "first"), F.when(F.col("down") == 1, "last")))
        edges = edges.where(F.length("norm") <= most).select("doc", "page", "order", F.explode(places).alias("position"), shape(F.col("norm")).alias("shape"))
        seen = edges.groupBy("doc", "position", "shape").agg(F.count_distinct("page").alias("pages")).join(pages, "doc")
        found = seen.where((F.col("all_pages") > 1) & (F.col("pages") >= F.greatest(F.lit(float(min_pages)), F.col("all_pages") * ratio - 1e-9))).select("doc", "position", "shape")
        kind = F.when(F.col("shape") == "<number>", "page_number").when(F.col("position") == "first", "header").otherwise("footer")
        got = edges.join(found, ["doc", "position", "shape"]).groupBy("doc", "page", "order").agg(F.min_by(kind, "position").alias("kind"))
        got = stored(got, "verdicts")
        if not got.head(1):
            return lines.join(rows, ["doc", "page", "order"], "left")
        rows = rows.unionByName(got)
        live = stored(live.join(got, ["doc", "page", "order"], "left_anti"), "lines")


def stripped(lines: DataFrame, retype: bool = False) -> DataFrame:
    """lines with kind: without the running ones, or with these as their type."""
    if retype:
        return lines.withColumn("type", F.coalesce("kind", "type")).drop("kind")
    return lines.where("kind is null").drop("kind")


def clean_report(before: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, reason, n, phrase, first of removed(doc_id, order, page, text, reason): how many blocks went for each
    reason, on which pages (the first five), and the first one's preview."""
    pages = F.array_sort(F.collect_set("page"))
    shown = F.array_join(F.transform(F.slice(pages, 1, 5), lambda p: p.cast("string")), ", ")
    phrase = F.concat(F.when(F.size(pages) == 1, "page ").otherwise("pages "), shown, F.when(F.size(pages) > 5, F.concat(F.lit(" and "), (F.size(pages) - 5).cast("string"), F.lit(" more"))).otherwise(""))
    return removed.join(before.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "reason").agg(F.count("*").alias("n"), phrase.alias("phrase"), T.preview(F.min_by("text", "order")).alias("first"))


def heading_context(chunks: DataFrame) -> DataFrame:
    """chunks(heading_path, leading, text) with embed_text: the part of the path above the ``leading`` headings that the
    chunk opens with, joined by " > ", and a blank line before the text; the text alone where nothing is above."""
    above = F.slice("heading_path", 1, F.greatest(F.size("heading_path") - F.col("leading"), F.lit(0)))
    return chunks.withColumn("embed_text", F.when(F.size(above) > 0, F.concat(F.array_join(above, " > "), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))


def few_pieces(pieces: Column, k: int) -> Column:
    """A warning where a search that keeps k pieces sees almost all of them; null otherwise."""
    return F.when(pieces <= 2 * k, F.concat(F.lit("Only "), pieces.cast("string"), F.lit(f" pieces: a search that keeps {k} finds most answers by chance.")))
