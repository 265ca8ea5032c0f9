"""Who may see a document: its own label, folders, registered rules, a default.  What goes wrong closes the document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

Rule = Callable[[], Column]
RULES: dict[str, Rule] = {}


class Denied(ValueError):
    """A rule that nobody has registered."""


def access_rule(name: str) -> Callable[[Rule], Rule]:
    """Registers a function without arguments that gives an array of roles over a document's columns; null: no opinion."""

    def add(f: Rule) -> Rule:
        if name in RULES and RULES[name] is not f:
            raise ValueError(f"an access rule is named {name} already")
        RULES[name] = f
        return f

    return add


def resolved(doc_id: Column, labels: Column, folders: tuple[tuple[str, tuple[str, ...]], ...], rules: tuple[str, ...], default: tuple[str, ...]) -> Column:
    """struct(roles, reason): the label ``roles`` (a comma list, even an empty one), else the first folder pattern that fits
    the id, else the first registered rule with an opinion, else the default.

    A rule that gives a null or empty role has failed, and nobody sees the document.  A rule that is not registered is
    refused before anything runs."""
    if unknown := [r for r in rules if r not in RULES]:
        raise Denied(f"not registered: {', '.join(unknown)}")
    array = lambda roles: F.array(*map(F.lit, roles)).cast("array<string>")
    said = lambda roles, reason: F.struct(roles.alias("roles"), F.lit(reason).alias("reason"))
    out = said(array(default), "default")
    for name in reversed(rules):
        got = RULES[name]()
        failed = F.exists(got, lambda r: r.isNull() | (r == ""))
        out = F.when(failed, said(array(()), f"access rule {name} failed")).when(got.isNotNull(), said(got.cast("array<string>"), f"access rule {name}")).otherwise(out)
    for pattern, roles in reversed(folders):
        out = F.when(F.coalesce(T.glob(doc_id, pattern), F.lit(False)), said(array(roles), f"folder {pattern}")).otherwise(out)
    own = F.filter(F.transform(F.split(F.try_element_at(labels, F.lit("roles")), ","), lambda r: F.trim(r)), lambda r: r != "")
    return F.when(F.coalesce(F.array_contains(F.map_keys(labels), "roles"), F.lit(False)), said(F.coalesce(own, array(())), "label")).otherwise(out)
