"""Text functions as Column builders; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotes and ligatures that compare as plain characters.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"'}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# Fixed value: a list marker that stands alone.
MARKER = r"^(?:[-•*–·▪‣◦]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.)])$"
# Fixed value: the shapes of a page number.
PAGE_NUMBER = r"(?i)^[-–—\[(]?\s*(?:page\s*)?\d{1,4}\s*(?:(?:/|of|\|)\s*\d{1,4})?\s*[-–—\])]?$"
# Fixed value: words without content.
STOP_WORDS = "a an and are as at be by can do does for from has have how in is it its of on or that the their this to was were what when where which who why will with".split()

# Words that carry no topic, left out when a search is widened.
EXPANSION_STOP_WORDS = """
    about above after again against all also and any are aren because been
    before being below between both but can cannot could did does doing down
    during each few for from further had has have having her here hers herself
    him himself his how into its itself just more most myself nor not now off
    once only other our ours ourselves out over own same she should since some
    such than that the their theirs them themselves then there these they this
    those through too under until very was were what when where which while who
    whom why will with would you your yours yourself yourselves were way may
    might must shall upon via etc per within without across along among around
    get got use used using like well many much one two three new yet ever even
""".split()
# Words whose period does not end a sentence, lower-cased.
ABBREVIATIONS = """
    e.g i.e etc vs cf al approx dr mr mrs ms prof sr jr st fig figs eq eqs no
    nos vol pp p ch sec inc ltd co corp dept est jan feb mar apr jun jul aug sep
    sept oct nov dec
""".split()
# Fixed value: the start of a line that is a list item.
LIST_ITEM = r"^[ \t]*(?:[-*+•]|\d{1,3}[.)]|[a-z][.)]|[A-Z]\))\s"
# What may stand before a period that does not end a sentence: such a word, an initial, parts of at most two
# signs between periods, or a number that begins the unit; opening quotes may stand before these.
_KEPT = (
    r"(?:^|\s)[\"'“‘(\[]{0,9}(?:(?i:" + "|".join(w.replace(".", r"\.") for w in ABBREVIATIONS) + r")|\p{Lu}|" + r"[^\s.]{0,2}\.[^\s.]{0,2}" + r"(?:\.[^\s.]{0,2})?" * 6 + r")|^\s{0,99}[\"'“‘(\[]{0,9}\d{1,9}"
)
# A stop that ends a sentence, with its closing quotes and brackets; a capital, digit or opening sign follows.
STOP = rf"(?U)(?=[.!?])(?<![.!?])(?:(?=\.)(?<!{_KEPT})\.[.!?]*|[!?][.!?]*)[\"'”’)\]]*(?=\s+[A-Z0-9\"'“‘(\[])"


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column) -> Column:
    return casefold(squeeze(c))


def holds_any(c: Column, signs: str) -> Column:
    """Whether c has one of a few signs that are not ASCII; far cheaper than a class of them in a regular expression."""
    return (F.octet_length(c) > F.length(c)) & reduce(Column.__or__, [c.contains(x) for x in signs])


def match_normalise(c: Column) -> Column:
    """What two parsers of one passage agree on: line-end hyphens, quotes and ligatures folded too."""
    folded = F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))
    for glyph, letters in LIGATURES.items():
        folded = F.replace(folded, F.lit(glyph), F.lit(letters))
    # most texts hold none of these, and translate looks each character up
    c = F.when(holds_any(c, "".join([*QUOTES, *LIGATURES])), folded).otherwise(c)
    return normalise(F.regexp_replace(c, r"(?U)-[ \t]*[\r\n]\s*", ""))


def may_hold(text: Column, words: Column) -> Column:
    """Whether match_normalise(text) may hold each of words, which have no white space: exact but for texts that it changes
    by more than case and white space, of which it is always true.  It costs a fraction of match_normalise."""
    low = F.array(F.lower(text))  # one element, so that it is made once for all words
    return F.exists(low, lambda t: F.forall(words, lambda w: t.contains(w))) | holds_any(text, "".join([*QUOTES, *LIGATURES, "ßẞΣ"])) | (text.contains("-") & text.rlike(r"-[ \t]*[\r\n]"))


def loosen(normalised: Column) -> Column:
    """Without list markers and lone letters."""
    words = F.split(normalised, " ")
    return F.array_join(F.filter(words, lambda w: ~w.rlike(MARKER) & ~w.rlike(r"(?U)^\p{L}$")), " ")


def match_tier(gold: Column, text: Column) -> Column:
    """exact, normalized, reworded or null."""
    g, t = match_normalise(gold), match_normalise(text)
    return F.when(text.contains(gold), "exact").when(t.contains(g), "normalized").when((F.length(loosen(g)) > 0) & loosen(t).contains(loosen(g)), "reworded")


def gold_parts(gold: Column) -> Column:
    """What ``matches`` needs of a gold, made once: gold, normal, loose, words (each stands in every normalised text that matches)."""
    return F.get(F.transform(F.transform(F.array(match_normalise(gold)), lambda n: F.struct(n.alias("normal"), loosen(n).alias("loose"))), lambda x: F.struct(
        gold.alias("gold"), x["normal"].alias("normal"), x["loose"].alias("loose"), F.split(F.when(x["loose"] != "", x["loose"]).otherwise(x["normal"]), " ").alias("words"),
    )), F.lit(0))


def matches(parts: Column, text: Column) -> Column:
    """Whether match_tier(gold, text) has a tier, of ``gold_parts(gold)``; a text is normalised only where it may match."""
    loosely = lambda t: (parts["loose"] != "") & F.forall(parts["words"], lambda w: t.contains(w)) & loosen(t).contains(parts["loose"])
    fully = F.exists(F.array(match_normalise(text)), lambda t: t.contains(parts["normal"]) | loosely(t))
    return text.contains(parts["gold"]) | (may_hold(text, parts["words"]) & fully)


def holds(text: Column, phrase: Column) -> Column:
    """Whether match_normalise(text) holds a phrase that is normalised; a text is normalised only where it may."""
    return may_hold(text, F.split(phrase, " ")) & F.exists(F.array(match_normalise(text)), lambda t: t.contains(phrase))


def clean_text(c: Column, cap: int | None = None) -> Column:
    """On one line, without control characters and without white space at the ends."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\n\r\x0B\f]", " "), r"[\x00-\x1F\x7F-\x9F]", "")
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return c if cap is None else F.left(c, F.lit(cap))


def preview(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def content_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), 0), lambda w: ~w.isin(STOP_WORDS))


def copied_share(question: Column, passage: Column) -> Column:
    """Share of the question's content words, repeats counted, that the passage holds; 0 without any."""
    own, held = content_words(question), content_words(passage)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.filter(own, lambda w: F.array_contains(held, w))) / F.size(own))


def expansion_tokens(c: Column) -> Column:
    """Words of three letters and more that carry a topic."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(EXPANSION_STOP_WORDS))


def sample_share(trace: Column, name: str) -> Column:
    """A stable number in [0, 1) from the id and the name: the first 8 bytes of their SHA-256."""
    digest = F.substring(F.sha2(F.concat(trace, F.lit(":" + name)), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def glob(c: Column, pattern: str) -> Column:
    """Shell pattern over the whole string, case-insensitive: *, ? and [...]."""
    import re

    out = "".join(".*" if p == "*" else "." if p == "?" else p.replace("[!", "[^", 1) if len(p) > 1 else re.escape(p) for p in re.findall(r"\[!?[^\]]+\]|.", pattern, re.S))
    return c.rlike(f"(?is)^{out}$")


def says_not_found(c: Column) -> Column:
    t = F.trim(c)
    return F.lower(t).startswith("the documents do not") & ~t.rlike(r"[.!?]\s+\S")


def category_of(tags: Column, has_history: Column) -> Column:
    named = F.filter(tags, lambda t: t.startswith("category:") & (F.length(t) > 9))
    return F.coalesce(F.substring(F.get(named, F.lit(0)), 10, 1000), F.when(has_history, "follow-up").otherwise("uncategorized"))


def label_of(counts: dict[str, Column]) -> Column:
    """The worst grounding label that occurs."""
    return F.coalesce(*[F.when(counts[k] > 0, k) for k in ("none", "weak", "similarity", "cited")], F.lit("not_found"))


def flags_for(label: Column, stop_reason: Column, hits: Column) -> Column:
    return F.filter(
        F.array(F.when(label.isin("weak", "none"), "low_grounding"), F.when(stop_reason == "refusal", "declined"), F.when((label == "not_found") | (hits == 0), "not_in_documents")), lambda x: x.isNotNull()
    )


def parse_order(reply: Column, n: Column) -> Column:
    """The order a ranking reply names: its numbers below n as they first appear, then the rest in order."""
    numbers = F.filter(F.transform(F.regexp_extract_all(reply, F.lit(r"\d+"), 0), lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x < n))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array_distinct(numbers), F.array_except(every, numbers))


def summary_cap(c: Column, most: int = 1500) -> Column:
    """Cut at the last sentence end within the first ``most`` characters, if there is one."""
    head = F.left(c, F.lit(most))
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(c) <= most, c).when(cut != "", cut).otherwise(head)


def format_of(name: Column) -> Column:
    """pdf, docx, pptx, html, md, txt, png or jpg by the extension; null otherwise."""
    kinds = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "htm": "html", "md": "md", "txt": "txt", "png": "png", "jpg": "jpg", "jpeg": "jpg"}
    suffix = F.regexp_extract(F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1)), r"[^.]\.(\w+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.when(suffix.isin(list(kinds)), suffix))


def raw_url(url: Column) -> Column:
    """The raw file behind a repository page's blob url, its query dropped."""
    return F.regexp_replace(url, r"^https?://github\.com/([^/]+/[^/]+)/blob/([^?#]+).*$", "https://raw.githubusercontent.com/$1/$2")


def soft_hyphens(c: Column) -> Column:
    """U+FFFE, which stands for a hyphen at a line's end: dropped before a lower-case letter, else a hyphen and, if
    something follows, a space."""
    c = F.regexp_replace(c, r"\x{FFFE}(?=\p{Ll})", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\x{FFFE}(?=.)", "- "), r"\x{FFFE}", "-")


def url_file_name(url: Column, suffix: Column, most: int = 100) -> Column:
    """A url's host and path joined by -, the path's own extension dropped, cut, with the suffix."""
    rest = F.regexp_replace(url, r"^[^:/?#]+://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d*$", ""))
    path = F.filter(F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/"), lambda x: ~x.isin("", ".", ".."))
    path = F.transform(path, lambda x, i: F.when(i == F.size(path) - 1, F.regexp_replace(x, r"(?<=.)\.[^.]+$", "")).otherwise(x))
    parts = F.filter(F.transform(F.concat(F.array(host), path), lambda x: F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")), lambda x: x != "")
    stem = F.left(F.array_join(parts, "-"), F.lit(most))
    return F.concat(F.when(F.coalesce(stem, F.lit("")) == "", "page").otherwise(stem), suffix)


def disguised(name: Column, head: Column) -> Column:
    """"a PDF" or "an image" where a file named as text or office holds one, by its first bytes; else null."""
    starts = lambda hexes: F.startswith(F.hex(head), F.lit(hexes))
    image = starts("89504E47") | starts("FFD8FF") | starts("47494638") | starts("49492A00") | starts("4D4D002A") | (starts("52494646") & (F.substring(F.hex(head), 17, 8) == "57454250"))
    held = F.when(starts("25504446"), "a PDF").when(image, "an image")
    return F.when(format_of(name).isin("docx", "pptx", "html", "md", "txt"), held)


def budget_sample(pieces: Column, budget: int) -> Column:
    """The pieces joined by blank lines, or, if that is longer than the budget, as many whole pieces spread evenly
    from first to last as fit; the first piece alone is cut to it."""
    joined = F.array_join(pieces, "\n\n")
    total = F.size(pieces)
    most = F.greatest(F.lit(1), F.least(total, F.floor(total * budget / F.length(joined)).cast("int")))
    pick = lambda m: F.array_join(F.transform(F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.bround(j * (total - 1) / (m - 1)).cast("int"))), lambda i: F.get(pieces, i)), "\n\n")
    fits = F.filter(F.when(most > 1, F.sequence(most, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda m: F.length(pick(m)) <= budget)
    return F.when(F.length(joined) <= budget, joined).when(F.size(fits) > 0, pick(F.get(fits, F.lit(0)))).otherwise(F.left(F.get(pieces, F.lit(0)), F.lit(budget)))
