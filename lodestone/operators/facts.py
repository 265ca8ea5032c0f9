"""What is known of a file before it is parsed: properties of its head, labels of its listing, and checks on both.

Maps are looked up without regard to case, and the first of two keys that differ in case alone counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.reviews import route_check
from lodestone.sources.files import content_type

# References that stand in attribute values and titles.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    for name, sign in REFERENCES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, whatever the order and quotes; null where it has none or an empty one."""
    at = rf"(?is)^<[a-z]+(?:\s+[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*?\s+{name}\s*=\s*"
    forms = [F.regexp_extract(tag, at + form, 1) for form in (r"\"([^\"]*)\"", r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(unescaped(f), F.lit("")) for f in forms])


def first_of_key(entries: Column) -> Column:
    """A map of structs (key, value) in order: of keys that differ in case alone, the first."""
    lower = F.transform(entries, lambda e: F.lower(e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(lower, F.lower(e["key"])) == i + 1))


def html_properties(html: Column, first: int = 65_536) -> Column:
    """A map of the page's meta tags, by name or property, and its <title> as Title, which takes the place of a meta title.

    One scan finds the tags of the page's start, comments, scripts and styles left out; a null page has an empty map."""
    head = F.regexp_replace(F.left(F.coalesce(html, F.lit("")), F.lit(first)), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>"), F.lit(0))
    named = F.transform(tags, lambda t: F.struct(F.coalesce(attribute(t, "name"), attribute(t, "property")).alias("key"), attribute(t, "content").alias("value")))
    title = F.nullif(F.trim(unescaped(T.squeeze(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))), F.lit(""))
    metas = F.filter(named, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (title.isNull() | (F.lower(e["key"]) != "title")))
    own = F.when(title.isNotNull(), F.array(F.struct(F.lit("Title").alias("key"), title.alias("value"))))
    return first_of_key(F.concat(metas, F.coalesce(own, F.filter(metas, lambda _: F.lit(False)))))


def source_labels(doc_id: Column, custom: Column) -> Column:
    """A listing's own labels, which custom ones of its store (a map) cannot displace: path and content type."""
    own = F.create_map(F.lit("path"), doc_id, F.lit("content_type"), F.coalesce(content_type(doc_id), F.lit("application/octet-stream")))
    kept = F.map_filter(F.coalesce(custom, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin("path", "content_type"))
    return F.map_concat(kept, own)


def document_facts(files: DataFrame) -> DataFrame:
    """doc_id, name, type, size, path, properties, labels, first_page_text of files(doc_id, name, content, url, labels)."""
    body = F.col("content").cast("string")
    kind = T.format_of(F.col("name"))
    ident = F.col("doc_id").cast("string")
    path = F.coalesce("url", F.when(ident.contains("/"), ident), F.lit(""))
    none = F.create_map().cast("map<string,string>")
    return files.select(
        "doc_id", "name", kind.alias("type"), F.octet_length("content").cast("long").alias("size"), path.alias("path"), F.when(kind == "html", html_properties(body)).otherwise(none).alias("properties"),
        F.coalesce("labels", none).alias("labels"), F.when(kind.isin("md", "txt"), F.left(body, F.lit(4000))).otherwise("").alias("first_page_text"),
    )


def looked_up(values: Column, key: str) -> Column:
    """The value of the first key that equals this one but for case; null without one."""
    return F.get(F.filter(F.map_entries(values), lambda e: F.lower(e["key"]) == key.lower()), F.lit(0))["value"]


def _matches(value: Column, equals: str | None, contains: str | None, pattern: str | None) -> Column:
    if sum(x is not None for x in (equals, contains, pattern)) != 1:
        raise ValueError("give one of equals, contains and pattern")
    test = F.lower(value) == equals.lower() if equals is not None else F.lower(value).contains(contains.lower()) if contains is not None else T.glob(value, pattern)
    return F.coalesce(test, F.lit(False))


@route_check
def file_type(kind: Column, types: list[str]) -> Column:
    return F.coalesce(kind.isin([t.lower() for t in types]), F.lit(False))


@route_check
def path_like(path: Column, pattern: str) -> Column:
    return F.coalesce((path != "") & T.glob(path, pattern), F.lit(False))


@route_check
def metadata(labels: Column, key: str, equals: str | None = None, contains: str | None = None, pattern: str | None = None) -> Column:
    """Does a label of this key, in any case, equal, contain or match a value, in any case?"""
    return _matches(looked_up(labels, key), equals, contains, pattern)


@route_check
def properties(found: Column, key: str, equals: str | None = None, contains: str | None = None, pattern: str | None = None) -> Column:
    """The same of what stands inside the file."""
    return _matches(looked_up(found, key), equals, contains, pattern)


@route_check
def text_layer(layer: Column, has: bool = True) -> Column:
    """Has a file of pages text that can be selected (has), or images alone?  Null, other files, is neither."""
    return F.coalesce(layer == has, F.lit(False))


@route_check
def contains_any(first_page: Column, words: list[str]) -> Column:
    """Does the first page hold any of these words, in any case?"""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(first_page).contains(w.lower())
    return F.coalesce(out, F.lit(False))
